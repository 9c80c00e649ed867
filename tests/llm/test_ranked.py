"""Ranked search against scores computed document by document."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from panelwright.llm import ranked
from panelwright.llm.common import NULL_ID

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, score string, `a.b` int"


def terms(text):
    return [re.sub("[A-Z]", lambda c: c[0].lower(), w) for w in TERM.findall(text or "")]


def brute(docs, items, k=20):
    words = [terms(t) for _, t in docs]
    size = sum(1 for w in words if w)
    total = sum(map(len, words))
    df = Counter(t for w in words for t in set(w))
    out = []
    for item, text in items:
        scores = []
        for (doc, _), w in zip(docs, words, strict=True):
            tf, score = Counter(w), 0
            for t in terms(text):
                if tf[t]:
                    m = 100 - 25 + 25 * len(w) * size // total
                    score += math.floor(1000 * math.log((2 * size + 2) / (2 * df[t] + 1))) * (1000000000 * tf[t] // (1000 * tf[t] + 12 * m))
            if score > 0:
                scores.append((-score, NULL_ID if doc is None else doc))
        out += [(item, r + 1, None if d == NULL_ID else d, -s) for r, (s, d) in enumerate(sorted(scores)[:k])]
    return out


def made(n, seed, vocabulary=400):
    rng = np.random.default_rng(seed)
    p = 1 / np.arange(1, vocabulary + 1)
    names = np.array([f"w{i}" if i % 3 else f"Ünï{i}" for i in range(vocabulary)])
    return [" ".join(names[rng.choice(vocabulary, rng.integers(1, 60), p=p / p.sum())]) for _ in range(n)]


def key(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3]))


def test_ranks_equal_the_direct_computation(spark):
    texts = made(700, 1)
    docs = [(i, t) for i, t in enumerate(texts)] + [(3, texts[5]), (None, texts[5]), (900, None), (901, ""), (902, " .,;"), (903, texts[6]), (904, texts[6].upper()), (905, "w1 " * 30000)]
    items = [(i, t) for i, t in enumerate(made(25, 2))] + [(7, texts[6]), (None, texts[5]), (60, None), (61, "absent"), (62, "w1 W1 w1-w1"), (63, "")]
    got = ranked.top_documents(spark.createDataFrame([(*d, "x", 1) for d in docs], DOCS).repartition(5), spark.createDataFrame(items, "item_id long, text string"))
    assert [f.name for f in got.schema] == ["item_id", "rank", "doc_id", "score"]
    assert key(tuple(r) for r in got.collect()) == key(brute(docs, items))


def test_items_in_several_passes_give_the_same(spark, monkeypatch):
    docs, items = list(enumerate(made(60, 3))), list(enumerate(made(12, 4)))
    monkeypatch.setattr(ranked, "ITEM_ROWS", 50)
    got = ranked.top_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 3)
    assert key(tuple(r) for r in got.collect()) == key(brute(docs, items, 3))


@pytest.mark.parametrize(("docs", "items"), [([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")]), ([(1, "a")], [(1, "a")])])
def test_empty_tables_and_terms_of_no_weight(spark, docs, items):
    got = ranked.top_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert [tuple(r) for r in got.collect()] == brute(docs, items)


def segment(texts, query, monkeypatch=None):
    docs = list(enumerate(texts))
    vocabulary = np.unique(np.concatenate([ranked.hashed(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[0] for w in {*terms(query)}]))
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs], pa.int64()), pa.array(texts)], ["doc_id", "text"])
    return docs, vocabulary, list(ranked._segments([batch], vocabulary))


def test_documents_that_cannot_win_are_skipped():
    texts = [("common " * 5 + "rare " * (20 if i in (7, 40, 4000) else 0) + f"x{i % 9} " * (i % 30)) for i in range(6000)]
    query = "common rare x1"
    docs, vocabulary, rows = segment(texts, query)
    (row,) = rows
    ids, n, term, df, doc, tf = (np.asarray(row.column(c)[0].values) for c in range(2, 8))
    s = ranked.Segment(n, term, df, doc, tf, int(row.column(0)[0].as_py()), int(row.column(1)[0].as_py()))
    full = np.zeros(len(vocabulary), np.int64)
    full[term] = df
    best = ranked.Best(2)
    best.ids = ids
    s.search(np.arange(len(term)), ranked.weights(full, len(docs))[term], best)
    assert best.id.tolist() == [r[2] for r in brute(docs, [(0, query)], 2)]
    assert 0 < s.seen < len(docs) / 5


def test_segments_end_and_count_every_document(monkeypatch):
    monkeypatch.setattr(ranked, "SEGMENT", 50)
    texts = [*made(333, 5), "", "..."]
    _, _, rows = segment(texts, "w1 w2")
    assert len(rows) > 6 and sum(r.column(0)[0].as_py() for r in rows) == 333
    assert sum(r.column(1)[0].as_py() for r in rows) == sum(len(terms(t)) for t in texts)
    got = Counter()
    for r in rows:
        for t, f in zip(r.column(4)[0].as_py(), r.column(5)[0].as_py(), strict=True):
            got[t] += f
    assert sorted(got.values()) == sorted([sum("w1" in terms(t) for t in texts), sum("w2" in terms(t) for t in texts)])


def test_norms_do_not_overflow():
    assert ranked.norms(np.array([10, 1 << 40]), 1 << 30, 1 << 50).tolist() == [75 + 25 * 10 * (1 << 30) // (1 << 50), 75 + 25 * (1 << 40) * (1 << 30) // (1 << 50)]
