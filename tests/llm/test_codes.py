"""Vector codes against a direct computation of every distance."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import types as T

from panelwright.llm.codes import Trie, compress, compressed

SCHEMA = "vec_id long, embedding array<double>, label int, code string, dim int"


def brute(rows, parts=4, rounds=4):
    """rows: (vec_id, vector, label), all of one dimension; returns {row position: (code, error)} and the digest."""
    x = [[[int(np.floor(1024 * v)) for v in r[1][p * len(r[1]) // parts : (p + 1) * len(r[1]) // parts]] for p in range(parts)] for r in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))
    books = [[list(x[i][p]) for i in order[:256]] for p in range(parts)]

    def nearest(y, book):
        d = [sum((a - b) ** 2 for a, b in zip(y, e, strict=True)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            took = {}
            for r in x:
                took.setdefault(nearest(r[p], books[p])[0], []).append(r[p])
            for k, members in took.items():
                books[p][k] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    out = []
    for r in x:
        found = [nearest(r[p], books[p]) for p in range(parts)]
        out.append(("".join(f"{k:02x}" for k, _ in found), sum(d for _, d in found)))
    return out, hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def test_every_code_error_and_entry_equals_the_direct_computation(spark):
    rng = np.random.default_rng(1)
    rows = [(i * 3, [float(v) for v in rng.normal(0, 0.1, 8)], int(i % 3) if i % 5 else None) for i in range(300)]
    rows += [rows[7]] * 40 + [(2, rows[9][1], 1)]  # copies, and a vector that comes again under another id
    # more columns, two of them named as the outputs are
    got = compressed(spark.createDataFrame([(*r, "x", 9) for r in rows], SCHEMA)).collect()
    want, digest = brute(rows)
    label = {}
    for r, (_, e) in zip(rows, want, strict=True):
        label[r[2]] = label.get(r[2], 0) + e
    assert {r.codebooks_sha256 for r in got} == {digest}
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in got) == sorted((r[0], c, e, label[r[2]]) for r, (c, e) in zip(rows, want, strict=True))


def test_few_and_unusable_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.5, 0.25, 0.0], None), (None, [0.5, -0.5, 0.25, 0.1], None), (3, None, 1), (4, [nan, 0.0, 0.0, 0.0], 1), (5, [inf, 0.0, 0.0, 0.0], 1), (6, [None, 0.0, 0.0, 0.0], 1), (7, [], 2), (8, [0.1] * 6, 2)]
    got = {r.vec_id: r for r in compressed(spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)).collect()}
    assert set(got) == {1, None, 7, 8}
    assert got[1].code == "00000000" and got[1].error == 0 and got[None].code == "00000001" and got[None].label_error == 0
    assert got[7].code == "00000000" and got[8].error == 0
    assert got[8].codebooks_sha256 == hashlib.sha256(b"102,102,102,102,102,102,0,0").hexdigest()  # six components fill parts of two


def test_an_empty_table_gives_no_rows(spark):
    out = compressed(spark.createDataFrame([], SCHEMA))
    assert out.collect() == [] and [f.dataType for f in out.schema][:4] == [T.LongType(), T.StringType(), T.LongType(), T.LongType()]


def test_components_beyond_64_bit_distances_are_refused(spark):
    with pytest.raises(ValueError, match="64 bits"):
        compress(spark.createDataFrame([(1, [1e30, 0.0, 0.0, 0.0], 1, None, None)], SCHEMA))


def test_decoding_gives_the_entries_back(spark):
    rows = [(i, [i / 8, -i / 8, 0.0, 1.0], 0, None, None) for i in range(20)]
    out, books = compress(spark.createDataFrame(rows, SCHEMA))
    for r in out.collect():
        assert np.abs(books.decode(r.code, 4) - rows[r.vec_id][1]).max() <= 0.5 / 1024


@pytest.mark.parametrize("n", [1, 40, 5000])
def test_the_walk_equals_all_distances_and_shares_beginnings(n):
    rng = np.random.default_rng(n)
    rows, entries = rng.integers(-3, 3, (n, 5)), rng.integers(-3, 3, (256, 5))
    trie = Trie(rows)
    index, least = trie.nearest(entries)
    full = ((rows[:, None, :] - entries[None]) ** 2).sum(2)
    assert (index[trie.source] == full.argmin(1)).all() and (least[trie.source] == full.min(1)).all()
    assert sum(map(len, trie.first)) == sum(len(np.unique(rows[:, : d + 1], axis=0)) for d in range(5))


def test_wide_components_use_wide_sums():
    rows = np.array([[1 << 27, -(1 << 27)], [5, 5]])
    index, least = Trie(rows).nearest(np.array([[0, 0], [1 << 27, 0]]))
    assert least.tolist() == [50, 1 << 54] and index.tolist() == [0, 1]
