"""The training-data operators against brute force, on small tables with the awkward cases."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import embed, idfile, minhash, mixing, packing, suffix, topk, toxicity
from panelwright.llm.common import cut, word_count

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = prose(60)
    passage = prose(30)
    out = [(0, base, "b"), (1, base, "a"), (2, base + " tail", None), (3, None, "a"), (4, "", "a"), (5, "   \n\t ", "c"), (6, "two words", "c"), (7, "two  words", "c"), (8, prose(5) + passage + prose(5), "a"), (9, passage + " " + prose(3), "b"), (10, prose(9000), "a"), (11, "é" * 40 + " ü" * 40, "b"), (12, "x" * 200, "b"), (13, "x" * 120, "b")]
    out += [(20 + i, prose(r.randint(1, 80)), r.choice(["a", "b", "c", None])) for i in range(40)]
    return out


def test_mix_copies(spark, texts):
    d = docs_of(spark, texts).withColumn("target", F.lit("mine")).drop("target").withColumn("size", word_count(F.col("text")))
    rows = mixing.mix(d).collect()
    again = mixing.mix(d.repartition(3)).collect()
    key = lambda rs: sorted((r["doc_id"], r["copies"]) for r in rs)
    assert key(rows) == key(again)
    assert len(rows) == len(texts)
    total = sum(r["size"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
        assert 0 <= r["copies"] <= 2
    assert abs(sum(g[0]["target"] for g in by.values()) - 1.5 * total) < 1e-6
    for g in by.values():
        assert g[0]["source_size"] == sum(r["size"] for r in g)
        assert g[0]["target"] <= 2 * g[0]["source_size"] + 1e-9
        assert abs(sum(r["copies"] * r["size"] for r in g) - g[0]["target"]) <= 2 * max(r["size"] for r in g) + 1e-6


def test_mix_targets_by_hand(spark):
    t = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame([("a", 100), ("b", 100), (None, 100)], "source string, source_size long")).collect()}
    # 450 words by 5:2:1 would give a 281; it stops at 200, and so does b at 166 of the other 250.
    assert t["a"] == 200 and abs(t["b"] - 250 * 2 / 3) < 1e-9 and abs(t[None] - 250 / 3) < 1e-9


def test_mix_empty_and_repeated(spark):
    assert mixing.mix(docs_of(spark, []).withColumn("size", F.lit(1).cast("long"))).count() == 0
    d = docs_of(spark, [(1, "a b", "s")] * 6 + [(None, "c", "s")] * 2 + [(2, "", None)]).withColumn("size", word_count(F.col("text")))
    rows = mixing.mix(d).collect()
    assert len(rows) == 9 and sum(r["copies"] for r in rows if r["source"] is None) == 0


def test_top_k_against_all_scores(spark):
    r = np.random.default_rng(1)
    v = r.standard_normal((400, 12)).astype(np.float32)
    v[100:200] = v[:100]
    v[300:330] = v[0] + r.standard_normal((30, 12)) * 0.01
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(400, None), (450, [1.0, None]), (500, [float("nan")] * 12), (550, []), (None, [1.0] * 12), (600, [1.0, 2.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))).collect()
    e = np.floor(256 * v.astype(np.float64))
    for q in range(0, 400, 50):
        s = e @ e[q]
        want = sorted(((-int(s[i]), i) for i in range(400) if i != q))[:5]
        assert [(-x["score"], x["vec_id"]) for x in sorted((g for g in got if g["query_id"] == q), key=lambda g: g["rank"])] == want
    assert {g["query_id"] for g in got} == set(range(0, 400, 50))


def test_cover_tree_and_pruning():
    """Every node covers its points, siblings' centres are apart, and clustered data leave most pairs unscored."""
    r = np.random.default_rng(2)
    centers = r.standard_normal((60, 16)) * 10
    x = np.vstack([centers, centers[r.integers(0, 60, 6000)] + r.standard_normal((6000, 16)) * 0.3, np.repeat(centers[:1], 100, 0)])
    tree = topk.Tree(x, np.arange(len(x)))
    assert sorted(tree.ids) == list(range(len(x))) and (tree.first < tree.last).sum() > 5
    for a in range(len(tree.lo)):
        assert (np.linalg.norm(tree.x[tree.lo[a] : tree.hi[a]] - tree.center[a], axis=1) <= tree.radius[a] + 1e-9).all()
        own = np.arange(tree.first[a], tree.last[a])
        if len(own):
            assert tree.lo[own[0]] == tree.lo[a] and tree.hi[own[-1]] == tree.hi[a] and (tree.lo[own[1:]] == tree.hi[own[:-1]]).all()
            apart = np.linalg.norm(tree.center[own][:, None] - tree.center[own][None], axis=2)[~np.eye(len(own), dtype=bool)]
            assert apart.min() > tree.radius[a] / topk.SHRINK - 1e-6 and (tree.radius[own] <= tree.radius[a] / topk.SHRINK + 1e-6).all()
    q = topk.Tree(x[::50], np.arange(0, len(x), 50), topk.QUERY_LEAF)
    found = topk.Search(q, topk.Tree.load(tree.dump()), 5)
    assert found.scored < 0.5 * len(q.x) * len(x)
    s = q.x @ x.T
    s[np.arange(len(q.x)), q.ids] = -np.inf
    assert np.allclose(found.score, -np.sort(-s, 1)[:, :5])
    even = np.random.default_rng(3).standard_normal((2000, 64))  # evenly spread points still make a tree of several levels
    assert len(topk.Tree(even, np.arange(2000)).lo) > 30


def test_top_k_over_several_blocks(spark, monkeypatch):
    """Pivots, salted blocks, repeated rows and blocks that are never met."""
    monkeypatch.setattr(topk, "DATA_BLOCK", 150)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    r = np.random.default_rng(5)
    v = np.vstack([r.standard_normal((400, 6)) * 0.1 + c for c in (5 * np.eye(6))[:3]] + [np.ones((300, 6))])
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(50, v[50].tolist())] * 3
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    e, ids = np.floor(256 * np.array([x for _, x in rows])), np.array([i for i, _ in rows])
    for q in range(0, len(v), 50):
        s = e @ np.floor(256 * v[q])
        want = sorted((-int(a), int(i)) for a, i in zip(s, ids, strict=True) if i != q)[:5]
        assert [(-x["score"], x["vec_id"]) for x in sorted((g for g in got if g["query_id"] == q), key=lambda g: g["rank"])] == want
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_toxicity_learns(spark):
    r = random.Random(3)
    syllables = ["an", "er", "on", "th", "is", "it", "or", "ed"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
    rows, labels = [], []
    for i in range(4000):
        w = [word() for _ in range(r.randint(5, 60))]
        bad = i % 5 == 0
        if bad:
            w[r.randrange(len(w))] = r.choice(["grubnik", "zolkpaf", "vuxmarg"]) + r.choice(["", "en", "s"])
        rows.append((i, " ".join(w), "s"))
        labels.append((i, 1, int(bad)))
    rows += [(8000, None, "s"), (8001, "", "s"), (8002, "that GRUBNIKS is on", None), (8003, "z" * 50000, "s")]
    d = docs_of(spark, rows).withColumn("mix", F.lit("kept"))
    out = {x["doc_id"]: x for x in toxicity.toxicity(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert len(out) == len(rows) and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.5) for x in out.values())
    held = [(i, t) for i, _, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([out[i]["predicted"] == t for i, t in held]) > 0.97
    assert out[8002]["predicted"] == 1 and out[8001]["predicted"] == 0 and out[8000]["score"] == out[8001]["score"]
    assert toxicity.toxicity(d, spark.createDataFrame([], "doc_id long, quality int, toxic int")).where("score = 0").count() == len(rows)


def test_quality_learns(spark):
    from panelwright.llm.quality import quality

    r = random.Random(4)
    rows, labels = [], []
    for i in range(700):
        good = i % 4 != 0
        w = ["".join(r.choice("aeionst") for _ in range(r.randint(2, 8))) for _ in range(r.randint(5, 120))]
        rows.append((i, " ".join(x if good else x + r.choice(["%%%", "&&&"]) for x in w), "s"))
        labels.append((i, int(good), 0))
    rows += [(9000, None, "s"), (9001, "", "s"), (9002, "seat noise " * 4000, "s")]
    out = {x["doc_id"]: x for x in quality(docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held = [(i, q) for i, q, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(out) == len(rows) and np.mean([out[i]["predicted"] == q for i, q in held]) > 0.97
    assert all(0 <= x["score"] <= 1 for x in out.values()) and abs(out[9000]["score"] - out[9001]["score"]) < 1e-5


def test_token_counts_and_cache(spark, texts, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    import pyarrow as pa
    from tokenizers import Tokenizer

    from panelwright.llm.tokens import Encoder, token_counts

    path = public.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    odd = ["a   b", "x\n y", " lead", "trail ", "it's  'll don't", "<|endoftext|> foo <|endoftext|>", "a b c", "tab\tx \t y", "\n\n a", "\x1c b\x85 c", "  two  lead", "don 't"]
    small = Encoder(path)
    together = small.flat(pa.array([*odd, None, "plain words"]))
    assert together[0].tolist() == [i for o in [*odd, "", "plain words"] for i in t.encode(o, add_special_tokens=False).ids]
    for o in odd:
        assert small.flat(pa.array([o, o]))[0].tolist() == 2 * t.encode(o, add_special_tokens=False).ids, repr(o)
    other = public.path("word_bpe_49k.json")  # its rules drop white space: whole texts are encoded
    assert Encoder(other).counts(pa.array(odd)).tolist() == [len(Tokenizer.from_file(other).encode(o, add_special_tokens=False).ids) for o in odd]
    d = docs_of(spark, [*texts, *[(100 + i, o, "o") for i, o in enumerate(odd)], (1, texts[1][1], "again")]).withColumn("n_tokens_before", F.lit(1))
    want = Counter((i, len(t.encode(x or "", add_special_tokens=False).ids), len((x or "").encode())) for i, x in [(r["doc_id"], r["text"]) for r in d.collect()])
    for _ in range(2):  # the second time everything is in the cache
        got = token_counts(d, path, str(tmp_path / "cache"))
        assert Counter((r["doc_id"], r["n_tokens"], r["n_bytes"]) for r in got.collect()) == want
        assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got.collect())
    stored = spark.read.parquet(str(tmp_path / "cache"))
    assert stored.count() == stored.select("digest").distinct().count() == d.select(F.coalesce("text", F.lit(""))).distinct().count()


def brute_repeats(rows):
    where, out = {}, {}
    for i, t in rows:
        b = (t or "").encode()
        for j in range(len(b) - 49):
            g = b[j : j + 50]
            where[g] = min(where.get(g, i), i)
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - 49):
            if where[b[j : j + 50]] < i:
                gone[j : j + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1])), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_against_brute_force(spark, texts, monkeypatch):
    rows = [(i, t) for i, t, _ in texts]
    want = brute_repeats(rows)
    d = docs_of(spark, texts).withColumn("n_removed_before", F.lit("x")).repartition(3)
    got = suffix.remove_repeats(d).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want
    assert {(r["doc_id"], r["text"]) for r in got} == set(rows)
    assert suffix.remove_repeats(docs_of(spark, [])).count() == 0
    twice = suffix.remove_repeats(docs_of(spark, [(7, "a b " * 30, "s")] * 2 + [(None, "a b " * 30, "s")])).collect()
    assert sorted((r["doc_id"] is None, r["n_removed"]) for r in twice) == [(False, 0), (False, 0), (True, 120)]


def test_previous_factors_masks():
    text = np.frombuffer(b"k" * 30 + b"m" * 40, np.uint8)
    both = np.r_[text, text]
    mask = suffix.previous_factors(both, np.array([0, 70]), np.array([21, 21]), np.array([4, 2]))
    assert mask.tolist() == [(1 << 21) - 1, 0]


def test_longest_previous_factors_against_plain():
    """Against comparing each string with every string of a smaller document; below 50 bytes only that it is below."""
    r = random.Random(11)
    for _ in range(20):
        stock = [bytes(r.choice(b"ab") for _ in range(120)) for _ in range(3)]
        runs = []
        for _ in range(12):
            s = bytearray(r.choice(stock))
            for _ in range(r.randint(0, 3)):
                s[r.randrange(120)] ^= 3
            a = r.randint(0, 40)
            runs.append(bytes(s[a : a + r.randint(50, 80)]))
        strings = np.array([len(x) - 49 for x in runs])
        first = np.array([r.randint(0, 6) for _ in runs])
        content, at = np.frombuffer(b"".join(runs), np.uint8), np.cumsum([0, *map(len, runs)])[:-1]
        run, i, _, order, lcp = suffix._ordered(content, at, strings)
        got = suffix.longest_previous_factors(first[run][order], lcp)
        text = [runs[a][b : b + 50] for a, b in zip(run[order], i[order], strict=True)]
        document = first[run][order]
        common = lambda x, y: next((k for k in range(50) if x[k] != y[k]), 50)
        assert text == sorted(text) and lcp.tolist() == [0, *[common(x, y) for x, y in zip(text[:-1], text[1:], strict=True)]]
        plain = [max([common(x, y) for y, e in zip(text, document, strict=True) if e < d], default=0) for x, d in zip(text, document, strict=True)]
        assert [min(g, 49) if p < 50 else g for g, p in zip(got.tolist(), plain, strict=True)] == [g if p < 50 else 50 for g, p in zip(got.tolist(), plain, strict=True)]
        assert [g >= 50 for g in got] == [p >= 50 for p in plain] and any(p >= 50 for p in plain)


def brute_classes(rows):
    bags = {}
    for i, t in rows:
        w = (t or "").encode().split()
        n = min(5, len(w))
        bags[i] = Counter(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) if w else Counter()
    up = {i: i for i in bags}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(bags)
    for x in ids:
        for y in ids:
            if y < x and bags[x] and bags[y]:
                both = sum((bags[x] & bags[y]).values())
                if both >= 0.8 * (sum(bags[x].values()) + sum(bags[y].values()) - both):
                    a, b = sorted((top(x), top(y)))
                    up[b] = a
    return {i: top(i) for i in ids}


def test_near_duplicates_against_brute_force(spark, texts):
    r = random.Random(8)
    rows = [(i, t) for i, t, _ in texts]
    base = texts[0][1].split()
    for k in range(60):  # copies with a few words changed, around the threshold
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = "changed"
        rows.append((1000 + k, " ".join(w)))
    rows += [(2000, "a b c d e " * 40), (2001, "a b c d e " * 36), (2002, "a b c d e " * 20)]
    got = minhash.near_duplicates(docs_of(spark, [(i, t, "s") for i, t in rows])).collect()
    want = brute_classes(rows)
    assert {x["doc_id"]: x["class_id"] for x in got} == want
    assert all(x["kept"] == (x["doc_id"] == x["class_id"]) for x in got)
    assert minhash.near_duplicates(docs_of(spark, [])).count() == 0
    odd = minhash.near_duplicates(docs_of(spark, [(None, "a b", "s"), (None, "a b", "s"), (3, "a b", "s"), (3, "a b", "s")])).collect()
    assert sorted((x["doc_id"] or -1, x["kept"]) for x in odd) == [(-1, True), (-1, True), (3, True), (3, True)]


def test_bag_minhash_estimates():
    r = np.random.default_rng(3)
    f = minhash.mix64(np.arange(400, dtype=np.uint64))
    a, b = r.integers(1, 40, 400), r.integers(1, 40, 400)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    got = [(minhash.bag_minhash(minhash.mix64(f + np.uint64(k)), a) == minhash.bag_minhash(minhash.mix64(f + np.uint64(k)), b)).mean() for k in range(30)]
    assert abs(np.mean(got) - want) < 4 * np.sqrt(want * (1 - want) / (30 * 128))
    many = minhash.bag_minhash(np.r_[f, f], np.r_[a, b], np.r_[np.zeros(400, int), np.ones(400, int)], 2)
    assert (many[0] == minhash.bag_minhash(f, a)[0]).all() and (many[1] == minhash.bag_minhash(f, b)[0]).all()


def test_packing_invariants(spark, texts):
    d = docs_of(spark, texts).withColumn("size", word_count(F.col("text"))).unionByName(docs_of(spark, [(50, "again again", "s"), (None, "no id", "s"), (None, "no id", "s")]).withColumn("size", F.lit(2).cast("long")))
    rows = packing.pack(d, lengths=(64, 128, 256), per_shard=25).collect()
    sizes = Counter()
    for r in d.collect():
        sizes[r["doc_id"]] += r["size"]
    got, bins = Counter(), {}
    for r in rows:
        got[r["doc_id"]] += r["length"]
        if r["length"]:
            bins.setdefault(r["bin_id"], []).append(r)
        else:
            assert r["bin_id"] is None and r["bin_capacity"] is None
    assert {k: v for k, v in got.items()} == dict(sizes)
    for b in bins.values():
        end = 0
        for r in sorted(b, key=lambda r: r["bin_offset"]):
            assert r["bin_offset"] == end
            end += r["length"]
        assert b[0]["bin_capacity"] == min(c for c in (64, 128, 256) if c >= end)
    assert packing.pack(docs_of(spark, []).withColumn("size", F.lit(1))).count() == 0


def least_capacity(sizes, lengths):
    """The least total capacity, over all ways to part the sizes."""
    import functools

    cap = lambda total: next((c for c in lengths if c >= total), None)

    @functools.cache
    def rest(mask):
        if not mask:
            return 0
        low, others = mask & -mask, mask & (mask - 1)
        best, sub = None, others
        while True:  # every set with the first item
            c = cap(sum(x for i, x in enumerate(sizes) if (low | sub) >> i & 1))
            if c is not None:
                total = c + rest(others & ~sub)
                best = total if best is None else min(best, total)
            if not sub:
                return best
            sub = (sub - 1) & others

    return rest((1 << len(sizes)) - 1)


def test_packing_lengths_are_chosen_together():
    r = random.Random(8)
    lengths = [512, 1024, 2048, 4096]
    got = want = 0
    for _ in range(60):
        sizes = sorted((r.choice([r.randint(1, 4096), r.randint(1, 1100), 1000]) for _ in range(r.randint(3, 8))), reverse=True)
        place, capacity = packing.best_fit(sizes, lengths, 16)
        assert all(sum(n for n, (b, _) in zip(sizes, place, strict=True) if b == k) <= c for k, c in enumerate(capacity))
        got, want = got + sum(capacity), want + least_capacity(tuple(sizes), lengths)
    assert got <= 1.02 * want
    # lengths that don't divide each other: what fills one well leaves room in another
    sizes = sorted((r.choice([r.randint(1400, 1530), r.randint(1400, 1530), r.randint(2500, 4000), r.randint(20, 100)]) for _ in range(5000)), reverse=True)
    place, capacity = packing.best_fit(sizes, [600, 1536, 4096], 16)
    _, alone = packing.best_fit(sizes, [4096], 16)
    used = Counter(capacity)
    assert sum(capacity) < 0.99 * sum(alone) and len([c for c in used if used[c] > 10]) >= 2, used


def test_embeddings_against_all_pairs(spark):
    r = np.random.default_rng(6)
    v = r.standard_normal((250, 16))
    v[50:90] = v[0] + r.standard_normal((40, 16)) * 0.2
    v[100:110] = v[100]
    v[110] = 3 * v[100]
    rows = [(i, x.tolist()) for i, x in enumerate(v.astype(np.float32))]
    rows += [(300, None), (301, [0.0] * 16), (302, [float("inf")] * 16), (303, [None] * 16), (None, [1.0] * 16), (304, [1.0, 2.0]), (305, [])]
    got = {x["vec_id"]: x for x in embed.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(0))).collect()}
    x = v.astype(np.float32).astype(np.float64)
    c = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    link = c >= 0.95
    np.fill_diagonal(link, False)
    label = embed.least_labels(250, *np.nonzero(link))
    for i in range(250):
        assert (got[i]["n_links"], got[i]["component_id"]) == (link[i].sum(), label[i]), i
    for i in (300, 301, 302, 303, 304, 305):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[None]["component_id"] is None and len(got) == len(rows)


def test_blocks_round_trip():
    r = np.random.default_rng(0)
    for n, vocabulary in ((1, 5), (2, 50257), (127, 300), (129, 50257), (5000, 50257), (40_000, 200_000)):
        for ids in ((r.zipf(1.4, n) % vocabulary).astype(np.int32), r.integers(0, vocabulary, n).astype(np.int32), np.full(n, vocabulary - 1, np.int32)):
            assert (idfile.decode_block(idfile.encode_block(ids), n) == ids).all()
    same = idfile.encode_block(np.tile(np.arange(50, dtype=np.int32), 2000))
    assert len(same) < 12_000  # what repeats costs about a bit an id, half of it the lanes' ends


def test_blocks_beat_frequencies():
    """Contexts must pay: ids drawn from a chain cost less than their order-0 entropy, and ids drawn alone little more."""
    r = np.random.default_rng(1)
    n, v = 200_000, 400
    follow = r.integers(0, v, (v, 2))
    ids = np.zeros(n, np.int32)
    for i in range(1, n):
        ids[i] = follow[ids[i - 1], int(r.random() < 0.2)]
    alone = (r.zipf(1.3, n) % v).astype(np.int32)
    for x, most in ((ids, 0.45), (alone, 1.08)):
        p = np.bincount(x)[np.unique(x)] / n
        assert len(idfile.encode_block(x)) * 8 / n < most * -(p * np.log2(p)).sum()


def test_damaged_blocks_are_refused(spark, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    idfile.write_ids(docs_of(spark, [(i, f"some words {i} and more", "s") for i in range(50)]), public.path("byte_bpe_50k.json"), str(tmp_path / "a"))
    rows = [r.asDict() for r in spark.read.parquet(str(tmp_path / "a")).collect()]
    for harm in (lambda c: c[:-2], lambda c: c[:-9] + bytes([c[-9] ^ 64]) + c[-8:], lambda c: c[:9] + bytes([c[9] ^ 64]) + c[10:]):
        place = str(tmp_path / f"b{harm(bytes(50)).hex()}")
        spark.createDataFrame([{**r, "coded": bytearray(harm(bytes(r["coded"])))} for r in rows], idfile.FILE).write.parquet(place)
        with pytest.raises(Exception, match="checksum|length"):
            idfile.read_ids(spark.range(1), place).collect()


def test_crc32_joined():
    for a, b in ((b"", b"x"), (b"hello", b" world"), (b"q" * 999, b"r" * 12345)):
        assert idfile.crc32_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_id_files_against_the_library(spark, texts, tmp_path, monkeypatch):
    monkeypatch.setattr(idfile, "BLOCK", 5000)  # the longest text spans blocks
    monkeypatch.setattr(idfile, "PART", 20_000)
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    rows = [*texts, (None, "no id", "s")]
    got = {r["doc_id"]: r for r in idfile.id_files(docs_of(spark, rows), public.path("byte_bpe_50k.json"), str(tmp_path / "ids")).collect()}
    at = 0
    for i, x, _ in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), i
        at += len(ids)
    assert len(got) == len(rows)


def test_cut_survives(spark, tmp_path):
    d = cut(spark.range(10), str(tmp_path / "t"))
    assert d.count() == 10 and d.rdd.getNumPartitions() >= 1
