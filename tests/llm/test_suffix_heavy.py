"""A phrase shorter than what counts as a repeat, in many documents and never in the same surroundings."""

import random
import time

import numpy as np
from pyspark.sql import functions as F
from test_training_data import brute_repeats, docs_of

from panelwright.llm import suffix


def test_a_frequent_short_phrase_is_dealt_out(spark, monkeypatch):
    r = random.Random(11)
    other = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    phrase, longer = other(46), other(70)
    rows = [(i, other(60) + (longer if i % 9 == 0 else phrase) + other(60)) for i in range(900)]
    rows += [(2000 + i, rows[i][1][40:150]) for i in range(40)] + [(3000, rows[0][1]), (None, rows[5][1]), (3000, rows[0][1])]
    rows += [(3100, longer + longer[:55]), (3101, "")]
    tables = []
    monkeypatch.setattr(suffix, "HEAVY", 4000, raising=False)
    monkeypatch.setattr(suffix, "SHARE", 100, raising=False)
    monkeypatch.setattr(suffix, "discard", lambda df: None)
    kept = suffix.cut
    monkeypatch.setattr(suffix, "cut", lambda df: tables.append(kept(df)) or tables[-1])
    got = suffix.remove_repeats(docs_of(spark, [(i, t, "s") for i, t in rows]).repartition(5)).collect()
    want = brute_repeats([(i if i is not None else 1 << 62, t) for i, t in rows])
    assert {(r["doc_id"] if r["doc_id"] is not None else 1 << 62): (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want
    assert len(got) == len(rows) and sum(r["n_removed"] for r in got) > 5000
    # Of the tables of runs and strings that are grouped, the last has the heavy names.
    last = [t for t in tables if "content" in t.columns][-1].where("part >= 0")
    sizes = [x["b"] for x in last.groupBy([c for c in ("part", "share") if c in last.columns]).agg(F.sum(F.octet_length("content")).alias("b")).collect()]
    assert max(sizes) < sum(sizes) / 10


def test_work_a_chunk_does_not_grow_with_the_number_of_groups():
    """Names are dealt and looked up in the same time for 128 and for 128,000 groups."""
    rng = np.random.default_rng(2)
    name = np.unique(rng.integers(0, 1 << 63, 125_000, dtype=np.uint64))
    took = {}
    for groups in (128, 128_000):
        began = time.perf_counter()
        dealt = list(suffix.split(suffix._group_of(name, groups), groups))
        replies = [(g, name[i[: len(i) // 2]].astype(np.uint32).tobytes()) for g, i in dealt]
        found = suffix.held_elsewhere(name, groups, [g for g, _ in replies], [b for _, b in replies])
        took[groups] = time.perf_counter() - began
        assert found.sum() == sum(len(i) // 2 for _, i in dealt) and sum(len(i) for _, i in dealt) == len(name)
    assert took[128_000] < 2.0  # some microseconds a name; a loop over groups took half a minute


def test_no_replies_and_no_names():
    assert suffix.held_elsewhere(np.zeros(3, np.uint64), 8, [], []).tolist() == [False] * 3
    assert list(suffix.split(np.zeros(0, np.int64), 8)) == []
