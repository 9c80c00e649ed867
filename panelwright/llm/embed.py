"""Near-duplicate embeddings by codes of randomly rotated signs."""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import components, cut, least_labels
from panelwright.llm.vectors import by_dimension, usable

#: Standard deviations of the estimate that its bound allows for.
DEVIATIONS = 5.0
#: Chance that no table brings together two vectors just at the threshold.
MISS = 1e-5
#: Rows of a bucket that the tables aim at; of a bucket's block, and of all buckets of a task.
BUCKET, BLOCK, TASK = 512, 2048, 65_536
#: Buckets of more than BLOCK rows whose sizes are broadcast at most (16 bytes each); beyond, a join deals the rows.
BROADCAST_BUCKETS = 200_000
#: Pairs that are computed exactly at a time.
PAIRS = 1 << 16


@functools.cache
def rotation(d: int, k: int) -> np.ndarray:
    """The k-th random rotation of d dimensions."""
    q, r = np.linalg.qr(np.random.default_rng([11, d, k]).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def tables(n: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """(bits of a bucket's name, tables): about BUCKET rows a bucket, and so many tables that a pair at the threshold meets in one but for `miss`."""
    bits = int(min(24, max(4, round(math.log2(max(1, n) / BUCKET)))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-meet)))


def keys(u: np.ndarray, bits: int, n: int) -> np.ndarray:
    """The bucket of each unit vector in each table: signs after as many rotations as the bits take."""
    d = u.shape[1]
    signs = np.hstack([u @ rotation(d, k) > 0 for k in range(-(-bits * n // d))])[:, : bits * n]
    return (signs.reshape(len(u), n, bits) @ (1 << np.arange(bits))).astype(np.int32)


def code_type(d: int) -> np.dtype:
    """What is stored of a vector of d dimensions: the signs after rotation 0, its components there in four bits as planes, their least value and step, and the correction factor."""
    words = -(-d // 64)
    return np.dtype([("signs", "<u8", words), ("planes", "<u8", (4, words)), ("least", "<f4"), ("step", "<f4"), ("factor", "<f4")])


def encode(u: np.ndarray) -> np.ndarray:
    """The code of each unit vector. The factor is the inner product of the vector with its signs' direction."""
    n, d = u.shape
    out = np.zeros(n, code_type(d))
    r = u @ rotation(d, 0)

    def packed(bits):
        raw = np.zeros((n, 8 * out["signs"].shape[1]), np.uint8)
        raw[:, : -(-d // 8)] = np.packbits(bits, axis=1, bitorder="little")
        return raw.view("<u8")

    out["signs"], out["factor"] = packed(r > 0), np.abs(r).sum(1) / math.sqrt(d)
    out["least"] = r.min(1)
    out["step"] = np.maximum((r.max(1) - out["least"]) / 15, 1e-9)
    # rounding up or down at random, by the component's own constant, leaves sums without bias
    q = np.floor((r - out["least"][:, None]) / out["step"][:, None] + np.random.default_rng([12, d]).random(d)).clip(0, 15).astype(np.uint8)
    for b in range(4):
        out["planes"][:, b] = packed(q >> b & 1)
    return out


def estimate(x: np.ndarray, y: np.ndarray, d: int) -> np.ndarray:
    """Unbiased estimates of the inner products of x's vectors with y's: x's signs with y's components, by counting bits, over x's factor."""
    of_x, of_y = np.bitwise_count(x["signs"]).sum(1, dtype=np.float64), np.bitwise_count(y["planes"]).sum(2, dtype=np.float64) @ [1, 2, 4, 8]
    both = np.zeros((len(x), len(y)), np.int32)
    for b in range(4):
        for w in range(x["signs"].shape[1]):
            both += np.bitwise_count(x["signs"][:, w, None] & y["planes"][None, :, b, w]).astype(np.int32) << b
    least, step = y["least"].astype(np.float64), y["step"].astype(np.float64)
    return (2 * (np.outer(of_x, least) + both * step) - (d * least + step * of_y)) / (math.sqrt(d) * x["factor"].astype(np.float64)[:, None])


def open_pairs(x: np.ndarray, y: np.ndarray, d: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose inner product may reach the threshold.

    For two unit vectors with inner product p the estimate's error comes from the part of y that is
    orthogonal to x, of length sqrt(1 - p^2), and has deviation sqrt((1 - f^2) (1 - p^2) / (f^2 (d - 1)));
    rounding to four bits adds at most step / (2 f). A pair at the threshold or above lies within DEVIATIONS
    of these, and up to 26 dimensions always.
    """
    f = x["factor"].astype(np.float64)[:, None]
    spread = np.maximum(0, 1 - f * f) * max(0.0, 1 - threshold * threshold) / max(1, d - 1) + y["step"].astype(np.float64) ** 2 / 4
    return np.nonzero(estimate(x, y, d) + DEVIATIONS * np.sqrt(spread) / f + 1e-6 >= threshold)


def open_among(code: np.ndarray, one: np.ndarray, two: np.ndarray, d: int, threshold: float) -> np.ndarray:
    """Which pairs (i, j), i < j, of a row of `one` and a row of `two` may reach the threshold: a square of the codes' rows."""
    out = np.zeros((len(code), len(code)), bool)
    for k in range(0, len(one), 1024):
        i, j = open_pairs(code[one[k : k + 1024]], code[two], d, threshold)
        i, j = one[k : k + 1024][i], two[j]
        out[np.minimum(i, j), np.maximum(i, j)] = True
    np.fill_diagonal(out, False)
    return out


def linked(x: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs (i, j) of x's rows have a cosine >= threshold, in double precision. No other pair is computed."""
    norm, out = np.linalg.norm(x, axis=1), np.zeros(len(i), bool)
    for k in range(0, len(i), PAIRS):
        a, b = i[k : k + PAIRS], j[k : k + PAIRS]
        out[k : k + PAIRS] = (x[a] * x[b]).sum(1) / (norm[a] * norm[b]) >= threshold
    return out


def near_vectors(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept (vec_id = component_id).

    Vectors link where their cosine in double precision is at least `threshold`; n_links counts the other
    vectors linked directly, component_id is the smallest id that links reach. Null, empty and zero
    vectors, those with null or non-finite components, and those of another dimension link with nothing. A
    row without an id has no links, a null component, and is kept. Only vec_id and embedding are read.

    Equal vectors are one class with a count. A class is coded once: the signs of its rotated direction, its
    components there in four bits, and a correction factor, 52 bytes for 64 dimensions. Classes go to
    buckets of several tables by signs after random rotations, with their codes alone. There the estimates
    and their bounds leave pairs open; the vectors of the rows in open pairs follow, each with a bit for
    every partner, and these pairs, no others, are computed. A pair of classes counts in the first table where it meets, so counts are sums over tasks.
    Buckets of more than BLOCK rows are split into pairs of blocks. A task returns one row for each of its
    classes: links found, and the least class it is connected with inside the bucket, so a large cluster
    costs rows, not pairs.
    """
    own = vectors.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    ok = usable(F.col("embedding")) & F.exists("embedding", lambda x: x != 0)
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"  # then four bytes a component lose nothing
    own = own.withColumn("embedding", F.when(ok, F.col("embedding") if single else F.col("embedding").cast("array<double>")))
    good = own.where(F.col("embedding").isNotNull())
    classes = cut(good.groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("m")))
    bits, n = tables(classes.count(), threshold)

    def dealt(batches):
        import pyarrow as pa

        for batch in batches:
            for at, x in by_dimension(batch.column(0)):
                u = x / np.linalg.norm(x, axis=1)[:, None]
                k, ids = keys(u, bits, n), pa.array(np.asarray(batch.column(1))[at])
                raw = pa.array([r.tobytes() for r in encode(u)], pa.binary())
                for t in range(n):
                    yield pa.RecordBatch.from_arrays([pa.array((np.int64(x.shape[1]) << 44) + (np.int64(t) << 32) + k[:, t]), ids, raw], ["bucket", "id", "code"])

    rows = classes.select("embedding", "id").mapInArrow(dealt, "bucket long, id long, code binary")
    sizes = cut(rows.groupBy("bucket").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK))
    rows = rows.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_BUCKETS else sizes, "bucket", "left")
    blocks = F.coalesce((F.col("size") / BLOCK).cast("int"), F.lit(0)) + 1
    rows = rows.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(o, F.col("mine")) * F.col("blocks") + F.greatest(o, F.col("mine")))
    rows = rows.withColumn("pair", F.explode(pair)).drop("size")
    tasks = max(1, classes.count() * n // TASK)
    task = F.pmod(F.xxhash64("bucket", "pair"), F.lit(tasks))

    def ends(bucket: np.ndarray, pair: np.ndarray):
        edge = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (pair[1:] != pair[:-1]), True])
        return zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)

    def sides(pair: int, blocks: int, mine: np.ndarray):
        """Rows of the two blocks that meet."""
        return np.flatnonzero(mine == pair // blocks), np.flatnonzero(mine == pair % blocks)

    def sift(t):
        import pyarrow as pa

        t = t.sort_by([("bucket", "ascending"), ("pair", "ascending"), ("id", "ascending")])
        bucket, pair, blocks, mine = (np.asarray(t[c]) for c in ("bucket", "pair", "blocks", "mine"))
        raw = t["code"].to_pylist()
        keep, partners = np.zeros(len(bucket), bool), []
        for a, b in ends(bucket, pair):
            d = int(bucket[a] >> 44)
            code = np.frombuffer(b"".join(raw[a:b]), code_type(d))
            found = open_among(code, *sides(pair[a], blocks[a], mine[a:b]), d, threshold)
            keep[a:b] = found.any(0) | found.any(1)
            rest = np.flatnonzero(keep[a:b])
            partners += [r.tobytes() for r in np.packbits(found[np.ix_(rest, rest)], axis=1)]
        return t.drop(["code", "task", "blocks", "mine"]).filter(keep).append_column("partners", pa.array(partners, pa.binary()))

    opened = rows.withColumn("task", task).groupBy("task").applyInArrow(sift, "bucket long, id long, pair int, partners binary")
    vector = classes.select("id", "m", "embedding")
    rows = opened.join(vector, "id").withColumn("task", task)

    def compare(t):
        import pyarrow as pa

        t = t.sort_by([("bucket", "ascending"), ("pair", "ascending"), ("id", "ascending")])
        bucket, pair, ids, m = (np.asarray(t[c]) for c in ("bucket", "pair", "id", "m"))
        partners = t["partners"].to_pylist()
        row, matrix = np.zeros(len(bucket), np.int64), {}
        for at, x in by_dimension(t["embedding"]):
            row[at], matrix[x.shape[1]] = np.arange(len(at)), x
        out = [[], [], []]
        for a, b in ends(bucket, pair):
            x = matrix[int(bucket[a] >> 44)][row[a:b]]
            marks = np.frombuffer(b"".join(partners[a:b]), np.uint8).reshape(b - a, -1)
            i, j = np.nonzero(np.unpackbits(marks, axis=1, count=b - a))  # the rows of sift, in its order
            near = linked(x, i, j, threshold)
            i, j = i[near], j[near]
            t_no = int(bucket[a] >> 32) & 0xFFF
            if t_no and len(i):  # counted already where they met before
                some, at = np.unique(np.r_[i, j], return_inverse=True)
                names = keys(x[some] / np.linalg.norm(x[some], axis=1)[:, None], bits, n)[:, :t_no]
                one_, two_ = at[: len(i)], at[len(i) :]
                new = np.ones(len(i), bool)
                for column in names.T:
                    new &= column[one_] != column[two_]
                i, j = i[new], j[new]
            if len(i):
                links = np.bincount(i, m[a + j], b - a) + np.bincount(j, m[a + i], b - a)
                some = np.flatnonzero(links)
                low = least_labels(b - a, i, j)
                for o, v in zip(out, (ids[a + some], links[some].astype(np.int64), ids[a + low[some]]), strict=True):
                    o.append(v)
        return pa.table(dict(zip(("id", "links", "to"), (pa.array(np.concatenate(o) if o else np.zeros(0, np.int64), pa.int64()) for o in out), strict=True)))

    found = cut(rows.groupBy("task").applyInArrow(compare, "id long, links long, to long"))
    groups = components(found.select(F.col("id").alias("a"), F.col("to").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    of_class = classes.join(links, "id", "left").join(groups, "id", "left").select("embedding", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = own.join(of_class, "embedding", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    out = out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
    none = vectors.where(F.col("vec_id").isNull()).select(F.lit(None).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(none)
