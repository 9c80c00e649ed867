"""Near-duplicate documents by BagMinHash signatures of word shingles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import components, cut, least_labels, mix64, slices, text_buffers
from panelwright.llm.words import hashed

#: Registers of a signature, in bands of ROWS. Two documents of similarity 0.8 share none of 32 bands of 4 with probability 5e-8.
REGISTERS, ROWS = 128, 4
#: Members of one bucket that one comparison takes at a time.
BLOCK = 1024
#: Pairs whose signatures agree in fewer registers are not recomputed: 0.8 lies four standard deviations above.
LEAST_AGREEING = int(0.66 * REGISTERS)


def shingles(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Hashes of all runs of n words; a shorter document is one shingle of all its words, one without words has none."""
    if len(words) == 0:
        return words
    n = min(n, len(words))
    h = np.zeros(len(words) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - n + 1 + i]
    return mix64(h)


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def bag_minhash(feature: np.ndarray, weight: np.ndarray, owner: np.ndarray | None = None, owners: int = 1, registers: int = REGISTERS) -> np.ndarray:
    """Signatures of multisets: distinct feature hashes with integer weights >= 1, each of one owner.

    Each feature owns a Poisson process of rate 1 over time and every unit of weight, and each point of it
    falls into one register; a register keeps the earliest point whose level lies below the feature's
    weight. The levels are split into [0,1), [1,2), [2,4), [4,8), ... with a process each, whose rate is
    the interval's length, so a feature of weight w runs log2(w) + 1 of them, and in the last one the points
    at levels beyond w are thinned out. Two multisets agree in a register with probability equal to their
    weighted Jaccard similarity. A process stops once its next point is later than all its owner's registers.
    Returns 64-bit names of the winning points, a row an owner; an owner without features keeps zeros.
    """
    owner = np.zeros(len(feature), np.int64) if owner is None else owner
    time = np.full(owners * registers, np.inf)
    name = np.zeros(owners * registers, np.uint64)
    top = int(np.ceil(np.log2(weight.max()))) if len(weight) and weight.max() > 1 else 0
    low = np.r_[0, 2 ** np.arange(top)].astype(np.int64)[: top + 1]
    width = np.maximum(1, low)
    which, level = np.nonzero(weight[:, None] > low[None, :])
    with np.errstate(over="ignore"):
        seed = mix64(feature[which] + (level.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03))
    rate, lowest, w, who = width[level].astype(float), low[level], weight[which], owner[which]
    t = np.zeros(len(seed))
    step = 0
    while len(seed):
        step += 1
        with np.errstate(over="ignore"):
            h = mix64(seed + np.uint64(step) * np.uint64(0x9E3779B97F4A7C15))
        t = t - np.log(_uniform(h)) / rate
        if step > 1:
            live = np.flatnonzero(t < time.reshape(owners, registers).max(1)[who])
            seed, rate, lowest, w, who, t, h = (x[live] for x in (seed, rate, lowest, w, who, t, h))
        with np.errstate(over="ignore"):
            h2 = mix64(h ^ np.uint64(0xA0761D6478BD642F))
        inside = np.flatnonzero((rate == 1) | (lowest + np.floor(_uniform(mix64(h2)) * rate) < w))
        register = who[inside] * registers + (h2[inside] % np.uint64(registers)).astype(np.int64)
        at = t[inside]
        np.minimum.at(time, register, at)
        first = at == time[register]
        name[register[first]] = h[inside[first]]
    return name.reshape(owners, registers)


def multisets(words: np.ndarray, doc: np.ndarray, docs: int, n: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, count, document) of all documents at once, sorted by document and shingle; shingles as in shingles()."""
    if len(words) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = np.bincount(doc, minlength=docs)
    first = np.r_[0, np.cumsum(size)]
    h, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(words) >= n:
        h = np.zeros(len(words) - n + 1, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - n + 1 + i]
        whole = np.flatnonzero(doc[: len(h)] == doc[n - 1 :])
        h, of = mix64(h[whole]), doc[whole]
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        h = np.r_[h, np.concatenate([shingles(words[first[d] : first[d + 1]], n) for d in short])]
        of = np.r_[of, short]
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (of[1:] != of[:-1])])
    return h[new], np.diff(np.r_[new, len(h)]), of[new]


def _multiset(text_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingles(text_words), return_counts=True)


def jaccard(a: tuple, b: tuple) -> float:
    """Sum of the lesser over sum of the greater weights; 0 where both are empty."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(a[1][i], b[1][j]).sum()
    whole = a[1].sum() + b[1].sum() - least
    return float(least / whole) if whole else 0.0


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text (binary), signature (a byte a register), bands (array of long; empty for texts without words) and their low 32 bits as names."""

    def sign(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            data, at = text_buffers(batch.column(1))
            digest, sig, bands, short = [], [], [], []
            for a, b in slices(at, 1 << 20):
                h, doc = hashed(data[at[a] : at[b]], at[a : b + 1] - at[a], spaces=True)
                feature, count, owner = multisets(h, doc, b - a)
                names = bag_minhash(feature, count, owner, b - a)
                band = np.zeros((b - a, REGISTERS // ROWS), np.uint64)
                with np.errstate(over="ignore"):
                    for r in range(ROWS):
                        band = mix64(band * np.uint64(31) + names[:, r::ROWS])
                some = np.bincount(owner, minlength=b - a) > 0
                byte = (names & np.uint64(255)).astype(np.uint8)
                for i in range(b - a):
                    digest.append(hashlib.sha256(data[at[a + i] : at[a + i + 1]].tobytes()).digest()[:16])
                    sig.append(byte[i].tobytes() if some[i] else None)
                    bands.append(band[i].view(np.int64).tolist() if some[i] else [])
                    short.append(band[i].astype(np.uint32).tobytes() if some[i] else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest, pa.binary()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(short, pa.binary())], ["doc_id", "digest", "signature", "bands", "names"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sign, "doc_id long, digest binary, signature binary, bands array<long>, names binary")


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Those of pairs (a, b) whose multisets of shingles overlap by `least`, from the texts themselves."""

    def overlap(batches):
        import pyarrow as pa

        for batch in batches:
            sides = []
            for column in (batch.column(2), batch.column(3)):
                # Pairs arrive by their first document, so its text comes many times over: it is read once.
                known, sets = {}, []
                for t in column.to_pylist():
                    if t not in known:
                        raw = np.frombuffer(t.encode(), np.uint8)
                        if len(known) > 256:
                            known.clear()
                        known[t] = _multiset(hashed(raw, np.array([0, len(raw)]), spaces=True)[0])
                    sets.append(known[t])
                sides.append(sets)
            keep = pa.array([jaccard(x, y) >= least for x, y in zip(*sides, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    left, right = (texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(overlap, "a long, b long")


DEALT = "band long, slot int, i int, j int, mine int, doc_id long, component long, signature binary, names binary, deal long"


def _candidates(t):
    """For each pair of blocks in t (sorted): (first row, one past the last, pairs of rows within).

    Pairs are of different groups so far, agree in enough registers, and share no earlier band, so that each
    pair is found in one band only.
    """
    group = np.stack([np.asarray(t[c]) for c in ("band", "i", "j", "mine", "doc_id", "component")])
    slot = np.asarray(t["slot"])
    sig = np.frombuffer(b"".join(t["signature"].to_pylist()), np.uint8).reshape(len(t), -1)
    names = np.frombuffer(b"".join(t["names"].to_pylist()), np.uint32).reshape(len(t), -1)
    edge = np.flatnonzero(np.r_[True, (group[:3, 1:] != group[:3, :-1]).any(0), True])
    for x, y in zip(edge[:-1], edge[1:], strict=True):
        of, ids, comp, s = group[3, x:y], group[4, x:y], group[5, x:y], sig[x:y]
        one, two = np.flatnonzero(of == group[1, x]), np.flatnonzero(of == group[2, x])
        pairs = [[], []]
        for k in one:
            other = two[(comp[two] != comp[k]) & ((ids[two] > ids[k]) if group[1, x] == group[2, x] else np.ones(len(two), bool))]
            near = other[(s[other] == s[k]).sum(1) >= LEAST_AGREEING]
            near = near[~(names[x + near, : slot[x]] == names[x + k, : slot[x]]).any(1)]
            pairs[0].append(np.full(len(near), k))
            pairs[1].append(near)
        if pairs[0]:
            yield x, y, np.concatenate(pairs[0]), np.concatenate(pairs[1])


def _sorted(t):
    return t.sort_by([("band", "ascending"), ("i", "ascending"), ("j", "ascending"), ("doc_id", "ascending")])


def _likely(t):
    """The rows of t that have a likely partner: rows, however many pairs they make."""
    t = _sorted(t)
    take = np.zeros(len(t), bool)
    for x, _, i, j in _candidates(t):
        take[x + i] = take[x + j] = True
    return t.filter(take)


def _links(t, least: float):
    """Verify the likely pairs of rows that came with their texts; returns, for each row linked, the least row that links inside its bucket reach."""
    import pyarrow as pa

    t = _sorted(t)
    ids = np.asarray(t["doc_id"])
    out = [[], []]
    for x, y, i, j in _candidates(t):
        rows = np.unique(np.r_[i, j])
        data, at = text_buffers(t["text"].combine_chunks().slice(x, y - x).take(rows))
        words, doc = hashed(data, at, spaces=True)
        feature, count, owner = multisets(words, doc, len(rows))
        whole = np.bincount(owner, count, len(rows))
        _, code = np.unique(feature, return_inverse=True)
        first = np.searchsorted(owner, np.arange(len(rows) + 1))
        i, j = np.searchsorted(rows, i), np.searchsorted(rows, j)
        weight = np.zeros(int(code.max(initial=0)) + 1, np.int64)
        keep = np.zeros(len(i), bool)
        order = np.argsort(i, kind="stable")
        cuts = np.searchsorted(i[order], np.arange(len(rows) + 1))
        for k in np.flatnonzero(np.diff(cuts)):
            mine = slice(first[k], first[k + 1])
            weight[code[mine]] = count[mine]
            p = order[cuts[k] : cuts[k + 1]]
            size = np.diff(first)[j[p]]
            entry = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[j[p]], size)
            both = np.add.reduceat(np.minimum(weight[code[entry]], count[entry]), np.cumsum(size) - size)
            keep[p] = both >= least * (whole[k] + whole[j[p]] - both)
            weight[code[mine]] = 0
        i, j = i[keep], j[keep]
        if len(i):
            low = least_labels(len(rows), i, j)
            some = np.flatnonzero(low != np.arange(len(rows)))
            out[0].append(ids[x + rows[low[some]]])
            out[1].append(ids[x + rows[some]])
    return pa.table({n: pa.array(np.concatenate(o) if o else np.zeros(0, np.int64), pa.int64()) for n, o in zip("ab", out, strict=True)})


def _crossing(members: DataFrame, texts: DataFrame, deals: int, least: float) -> DataFrame:
    """Links (a, b) between members of one bucket that were in different groups so far.

    A bucket of more than BLOCK members is split into blocks by a hash, and each pair of blocks is a group
    of its own, so no task holds more than two blocks. Signatures first leave the rows with a likely
    partner; only those are sent again with their texts, compared in the task, and give one link a row.
    """
    members = members.withColumn("blocks", (F.col("n") / BLOCK).cast("int") + 1)
    members = members.withColumn("mine", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("mine")).alias("i"), F.greatest(o, F.col("mine")).alias("j")))
    dealt = members.withColumn("pair", F.explode(pair)).select("band", "slot", "pair.i", "pair.j", "mine", "doc_id", "component", "signature", "names")
    # Many buckets share a group of rows.
    dealt = dealt.withColumn("deal", F.pmod(F.xxhash64("band", "i", "j"), F.lit(deals)))
    likely = cut(dealt.groupBy("deal").applyInArrow(_likely, DEALT))
    return likely.join(texts, "doc_id").groupBy("deal").applyInArrow(lambda t: _links(t, least), "a long, b long")


def near_duplicates(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """One row per row of docs: doc_id, class_id (the smallest id that links of similarity >= least reach), kept (doc_id = class_id).

    Similarity is the weighted Jaccard similarity of the multisets of five-word shingles; words are what
    ASCII white space separates, as they stand. A document of fewer than five words is one shingle; one
    without words is like no other. Equal texts with words are in one class. A null id is a document of its
    own with a null class, and is kept. Rows of one id are one document: they repeat its row, and where
    their texts differ, what is similar to any of them is in its class. Only doc_id and text are read; an
    empty table gives no rows.

    Equal texts are reduced to their smallest id first. Then each bucket links all members to its smallest;
    those pairs are recomputed from the texts and give first groups. In buckets that still hold several
    groups, all pairs between groups are compared by signature inside the task that holds the bucket, and
    the likely ones recomputed from the texts there. So a large class costs one link a member and bucket,
    not one a pair, and a pair of different texts is missed only if its signatures miss it.
    """
    keyed = docs.where(F.col("doc_id").isNotNull())
    sig = cut(signatures(keyed))
    words = sig.where(F.col("signature").isNotNull())
    first = cut(words.groupBy("digest").agg(F.min("doc_id").alias("first"), F.min("signature").alias("signature"), F.min("bands").alias("bands"), F.min("names").alias("names")))
    bands = first.select(F.col("first").alias("doc_id"), F.posexplode("bands").alias("slot", "h")).select("doc_id", "slot", F.xxhash64("slot", "h").alias("band"))
    shared = bands.groupBy("band").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")).where("n > 1")
    members = cut(bands.join(shared, "band"))
    star = cut(members.where("low <> doc_id").select(F.col("low").alias("a"), F.col("doc_id").alias("b")).distinct())
    some = members.select("doc_id").distinct()
    texts = cut(keyed.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(some, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))
    # An id with several texts ties them together.
    several = words.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y").select("doc_id")
    tied = words.select("doc_id", "digest").join(several, "doc_id", "left_semi").join(first.select("digest", "first"), "digest").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    links = cut(_verified(star, texts, least).unionByName(tied))
    groups = cut(components(links))
    labelled = members.join(groups, members.doc_id == groups.id, "left").select("band", "n", "slot", members.doc_id, F.coalesce("component", "doc_id").alias("component"))
    mixed = labelled.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("band")
    sigs = first.select(F.col("first").alias("doc_id"), "signature", "names")
    more = cut(_crossing(labelled.join(mixed, "band", "left_semi").join(sigs, "doc_id"), texts, 16 + members.count() // 8192, least))
    groups = components(groups.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
    of_text = first.join(groups, first["first"] == groups.id, "left").select("digest", F.coalesce("component", "first").alias("class_id"))
    out = sig.join(of_text, "digest", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    out = out.withColumn("kept", F.col("doc_id") == F.col("class_id"))
    nulls = docs.where(F.col("doc_id").isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"), F.lit(True).alias("kept"))
    return out.unionByName(nulls)
