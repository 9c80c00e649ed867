"""The word model against one made of dictionaries, and the trie against its definition."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from panelwright.llm import lm, ngrams
from panelwright.llm.common import mix64
from panelwright.llm.words import hashed

END, START = "<end>", "<start>"


def tokens(text):
    return [re.sub("[A-Z]", lambda c: c[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + [END]


def held_out(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 10 == 0


def word_hash(w):
    return int(lm._END) if w == END else int(hashed(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]), spaces=True)[0][0])


def brute(docs, share=lm.SHARE, split=lm.SPLIT):
    """{row: (held_out, n_tokens, n_known, N, base, score)} with unquantised probabilities."""
    texts = [tokens(t) for _, t in docs]
    every = Counter(w for t in texts for w in t)
    train = Counter(w for (d, _), t in zip(docs, texts, strict=True) if not held_out(d) for w in t)
    n, v, total = sum(train.values()), len(train), sum(every.values())
    frequent = {w: i for i, w in enumerate(sorted((w for w in every if every[w] > share * total), key=word_hash))}
    rest = total - sum(every[w] for w in frequent)

    def context(w):
        return lm._START if w == START else frequent[w] if w in frequent else len(frequent) + int(mix64(np.array([word_hash(w)], np.uint64))[0]) % lm.CLASSES

    parts = {context(w): -(-every[w] // split) for w in frequent}

    def last_of(before, last):
        s = parts.get(last, max(1, -(-rest // (lm.CLASSES * split))))
        return last, int(mix64(np.array([before], np.uint64) + lm._SEED)[0]) % s

    def events(t):
        c = [context(w) for w in t]
        return [(last_of(lm._START if i == 1 else c[i - 2], c[i - 1]), lm._START if i == 1 else c[i - 2], t[i]) for i in range(1, len(t))]

    triples = Counter(e for (d, _), t in zip(docs, texts, strict=True) if not held_out(d) for e in events(t))
    pair, after_pair, last, after_last, two = Counter(), defaultdict(set), Counter(), defaultdict(set), Counter()
    for (g, b, w), c in triples.items():
        pair[g, b] += c
        after_pair[g, b].add(w)
        last[g] += c
        after_last[g].add(w)
        two[g, w] += c
    z, d = n + 0.1 * (v + 1), lm.DISCOUNT

    def p(w, e=None):
        out = (train[w] + 0.1) / z
        if e and e[0] in last:
            g, b, _ = e
            out = max(two[g, w] - d, 0) / last[g] + d * len(after_last[g]) / last[g] * out
            if (g, b) in pair:
                out = max(triples[e] - d, 0) / pair[g, b] + d * len(after_pair[g, b]) / pair[g, b] * out
        return out

    return [(held_out(i), len(t), sum(train[w] > 0 for w in t), n, sum(math.log10((train[w] + 0.1) / z) for w in t), math.log10(p(t[0])) + sum(math.log10(p(e[2], e)) for e in events(t))) for (i, _), t in zip(docs, texts, strict=True)]


def made(n, seed):
    rng = np.random.default_rng(seed)
    p = 1 / np.arange(1, 301)
    names = np.array([f"W{i}" if i % 3 else f"é{i}," for i in range(300)])
    return [" \t\n"[i % 3].join(names[rng.choice(300, rng.integers(1, 80), p=p / p.sum())]) for i in range(n)]


@pytest.mark.parametrize("settings", [{}, {"share": 1 / 60, "task": 1500, "split": 300}])
def test_scores_equal_the_dictionaries(spark, settings):
    texts = made(300, 1)
    docs = [(i * 7, t) for i, t in enumerate(texts)] + [(5, texts[3]), (5, texts[3]), (None, texts[4]), (11, None), (12, ""), (13, " \n"), (14, "w1 " * 5000)]
    out = lm.log_probabilities(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score int").repartition(3), **settings)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in out.collect())
    want = sorted((d[0] is None, d[0] or 0, *w) for d, w in zip(docs, brute(docs, settings.get("share", lm.SHARE), settings.get("split", lm.SPLIT)), strict=True))
    assert [g[:6] for g in got] == [w[:6] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[6] == pytest.approx(w[6], rel=1e-9, abs=1e-9)
        assert g[7] == pytest.approx(w[7], abs=3e-4 * w[3] + 1e-5 * abs(w[7]))  # a code is off by 1 / (2 * STEPS) powers of ten at most, three of them in a token


def test_the_model_does_not_depend_on_how_the_work_is_dealt(spark):
    texts = made(300, 2)
    docs = [(i * 7, t) for i, t in enumerate(texts)] + [(5, texts[3]), (None, texts[4]), (11, None), (14, "w1 " * 5000)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    scores = lambda **k: sorted((r.doc_id is None, r.doc_id or 0, r.score) for r in lm.log_probabilities(table, **k).collect())
    want = sorted((d[0] is None, d[0] or 0, w[5], w[1]) for d, w in zip(docs, brute(docs, 0, 1 << 62), strict=True))
    whole, dealt = scores(), scores(known=1 / 60, task=1500, spread=100)
    for w, x, y in zip(want, whole, dealt, strict=True):
        assert w[:2] == x[:2] == y[:2] and x[2] == pytest.approx(y[2], rel=1e-6)
        assert y[2] == pytest.approx(w[2], abs=3e-4 * w[3] + 1e-5 * abs(w[2]))


def test_what_is_learned_helps_on_rows_held_out(spark):
    rng = np.random.default_rng(3)
    follow = rng.integers(0, 200, (200, 4))

    def text():
        w, out = int(rng.integers(200)), []
        for _ in range(100):
            out.append(f"t{w}")
            w = int(follow[w, rng.integers(4)])
        return " ".join(out)

    rows = lm.log_probabilities(spark.createDataFrame([(i, text()) for i in range(400)], "doc_id long, text string")).where("held_out").collect()
    assert len(rows) > 20 and all(r.score > 0.5 * r.base_score for r in rows)


@pytest.mark.parametrize("docs", [[], [(1, None)], [(None, "a b")], [(19, "a b c")]])
def test_tables_with_little_to_learn_from(spark, docs):
    got = lm.log_probabilities(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    for r, w in zip(got, brute(docs), strict=True):
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert (r.base_score, r.score) == (pytest.approx(w[4], abs=1e-9), pytest.approx(w[5], abs=2e-3))


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], [3, 7, 7, 8, 1000], [2**63, 2**64 - 1]])
def test_sequences_of_few_values(values):
    e = ngrams.EliasFano(*ngrams.EliasFano.arrays(np.array(values, np.uint64)))
    assert e.find(np.array([v for v in values], np.uint64)).tolist() == [values.index(v) for v in values]
    assert e.find(np.array([1, 6, 9, 2**40], np.uint64)).tolist() == [-1] * 4
    if values and values[-1] < 2**62:
        assert e.values(np.arange(len(values))).tolist() == values


@pytest.mark.parametrize("top", [50, 10**4, 10**9, 2**62])
def test_sequences_find_what_they_hold_in_few_bits(top):
    rng = np.random.default_rng(top % 97)
    v = np.unique(rng.integers(0, top, 2000, dtype=np.uint64))
    arrays = ngrams.EliasFano.arrays(v)
    e = ngrams.EliasFano(*arrays)
    asked = np.r_[v, rng.integers(0, top + 5, 2000, dtype=np.uint64)]
    at = np.searchsorted(v, asked)
    there = (at < len(v)) & (v[np.minimum(at, len(v) - 1)] == asked)
    assert (e.find(asked) == np.where(there, at, -1)).all() and (e.values(np.arange(len(v))) == v.astype(np.int64)).all()
    assert 8 * sum(a.nbytes for a in arrays[1:]) <= len(v) * (3 + max(1, math.log2(top / len(v)))) + 300


def test_a_mapped_trie_answers_as_counts_do(tmp_path):
    rng = np.random.default_rng(5)
    rows = np.unique(rng.integers(0, 12, (900, 3)), axis=0)
    count = rng.integers(1, 9, len(rows))
    word = mix64(np.arange(12, dtype=np.uint64))
    order = np.lexsort((word[rows[:, 2]], rows[:, 1], rows[:, 0]))
    rows, count = rows[order], count[order]
    path = tmp_path / "trie"
    path.write_bytes(ngrams.Trie.build(rows[:, 0].astype(np.uint64), rows[:, 1], word[rows[:, 2]], count, 0.7))
    trie = ngrams.Trie.open(path)
    asked = np.array([(a, b, c) for a in range(13) for b in range(13) for c in range(12)])
    got_a, got_b = trie.query(asked[:, 0].astype(np.uint64), asked[:, 1], word[asked[:, 2]])
    table = {tuple(r): c for r, c in zip(rows.tolist(), count.tolist(), strict=True)}
    for (a, b, c), x, y in zip(asked.tolist(), got_a, got_b, strict=True):
        last = {k: v for k, v in table.items() if k[0] == a}
        pair = {k: v for k, v in last.items() if k[1] == b}
        share, left = 0.0, 1.0
        if last:
            n = sum(last.values())
            share, left = max(0, sum(v for k, v in last.items() if k[2] == c) - 0.7) / n, 0.7 * len({k[2] for k in last}) / n
        if pair:
            n = sum(pair.values())
            m = 0.7 * len(pair) / n
            share, left = max(0, pair.get((a, b, c), 0) - 0.7) / n + m * share, m * left
        assert (x, y) == (pytest.approx(share, rel=1e-3), pytest.approx(left, rel=1e-3))
