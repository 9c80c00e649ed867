"""Vectors as short codes: each part of a vector is the index of its nearest codebook entry.

Nearest entries come from a lexicographic trie over the distinct parts. Parts that begin with the same
components share the distances of that beginning to all entries: the trie is walked depth first with the
accumulated distances of the path, one addition an edge, and a leaf takes the least of them.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import cut, discard
from panelwright.llm.vectors import by_dimension

#: Entries of a codebook; an index is one byte.
ENTRIES = 256
#: Nodes of the trie whose distances to all entries are held at a time on each level.
WIDTH = 512
#: Rows that one walk of a trie takes at most.
ROWS = 32_768
#: Labels up to so many are broadcast with their errors (24 bytes each).
BROADCAST_LABELS = 100_000


@dataclass
class Codebooks:
    """Entries by dimension of the vectors: int64 of shape (parts, entries, dimension / parts), in order of the index."""

    entries: dict[int, np.ndarray]
    scale: float

    def sha256(self, dim: int) -> str:
        return hashlib.sha256(",".join(map(str, self.entries[dim].ravel().tolist())).encode()).hexdigest()

    def decode(self, code: str, dim: int) -> np.ndarray:
        """The vector that a code stands for: the middle of the steps that its entries name."""
        which = np.frombuffer(bytes.fromhex(code), np.uint8)
        return np.concatenate([self.entries[dim][p, i] + 0.5 for p, i in enumerate(which)]) / self.scale


class Trie:
    """Distinct rows of an integer matrix in lexicographic order, as the nodes where their beginnings part.

    first[d] holds the row at which each node of depth d + 1 begins; rows between two of them have the first
    d + 1 components in common. source maps the given rows to the distinct ones.
    """

    def __init__(self, rows: np.ndarray):
        n, dims = rows.shape
        order = np.lexsort(rows.T[::-1]) if dims else np.arange(n)
        rows = rows[order]
        parted = np.zeros((n, dims), bool)
        if n:
            parted[0] = True
            np.logical_or.accumulate(rows[1:] != rows[:-1], axis=1, out=parted[1:])
        distinct = parted[:, -1] if dims else np.arange(n) == 0
        self.source = np.empty(n, np.int64)
        self.source[order] = np.cumsum(distinct) - 1
        self.rows = rows[distinct]
        self.first = [np.flatnonzero(parted[distinct, d]) for d in range(dims)]

    def nearest(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, squared distance) for each distinct row; ties go to the lower index."""
        n, dims = self.rows.shape
        index, least = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if n == 0 or dims == 0:
            return index, least
        reach = [int(max(abs(int(self.rows.min())), abs(int(self.rows.max())))), int(max(abs(int(entries.min())), abs(int(entries.max()))))]
        kind = np.int32 if dims * sum(reach) ** 2 < 2**31 else np.int64
        stack = [(0, 0, n, np.zeros((1, len(entries)), kind), np.zeros(1, np.int64))]
        while stack:
            depth, lo, hi, above, starts = stack.pop()
            nodes = self.first[depth]
            a, b = np.searchsorted(nodes, (lo, hi))
            if b - a > WIDTH:  # the rest of these children comes after all that lies below the first of them
                stack.append((depth, int(nodes[a + WIDTH]), hi, above, starts))
                b = a + WIDTH
                hi = int(nodes[b])
            own = nodes[a:b]
            reached = self.rows[own, depth].astype(kind)[:, None] - entries[:, depth].astype(kind)
            reached *= reached
            reached += above if np.array_equal(own, starts) else above[np.searchsorted(starts, own, "right") - 1]
            if depth + 1 < dims:
                stack.append((depth + 1, lo, hi, reached, own))
            else:
                index[own] = reached.argmin(1)
                least[own] = reached[np.arange(len(own)), index[own]]
        return index, least


def compress(vectors: DataFrame, parts: int = 4, rounds: int = 4, scale: float = 1024.0) -> tuple[DataFrame, Codebooks]:
    """(one row for each usable row of vectors: vec_id, label, code string, error long; the codebooks).

    A component x counts as the integer floor(scale * x). Vectors are cut into `parts` equal consecutive
    parts, each with a codebook of its own. A codebook starts as that part of the 256 rows with the smallest
    vec_ids (nulls last; equal ids by the vectors), all of them where there are fewer. Each round assigns
    every part to the nearest entry and replaces an entry by the floor of the mean of its parts; an entry
    without parts stays. The code lists the indexes of the last assignment, two hex digits each; error is the
    squared distance summed over the parts.

    Rows whose vector is null, or holds null or non-finite components (after scaling), are left out. Vectors
    of another dimension have codebooks of their own; a dimension that `parts` does not divide is filled up
    with zeros, which changes no distance. Repeated rows count each time. Components so large that squared
    distances would not fit 64 bits raise ValueError. Without a usable row there are no codebooks. Only
    vec_id, embedding and label are read.

    Distinct parts are counted once, ordered by range, and stored; a round reads them in place, and a task
    walks the tries of its own range and returns a sum for each entry: no part moves again. Vectors are coded
    where they lie. The driver holds codebooks alone: 256 vectors for each dimension.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(F.lit(float(scale)) * x.cast("double")) < float("inf")))
    own = vectors.where(F.coalesce(F.col("embedding").isNotNull() & finite, F.lit(False))).select("vec_id", "label", F.transform("embedding", lambda x: F.lit(float(scale)) * x.cast("double")).alias("x"))
    limits = own.groupBy(F.size("x").alias("dim")).agg(F.max(F.greatest(F.lit(0.0), F.coalesce(F.array_max("x"), F.lit(0.0)), -F.coalesce(F.array_min("x"), F.lit(0.0)))).alias("most")).collect()
    for r in limits:
        if max(1, r["dim"]) * (2 * (r["most"] + 1)) ** 2 >= 2.0**62:
            raise ValueError(f"components up to {r['most'] / scale:g}: squared distances of {r['dim']} such components do not fit 64 bits")
    own = own.withColumn("x", F.transform("x", lambda x: F.floor(x)))
    books = Codebooks({r["dim"]: _first(own, r["dim"], parts) for r in limits}, scale)
    if books.entries and rounds:
        width = F.ceil(F.size("x") / F.lit(parts)).cast("int")
        cells = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.struct(p.alias("part"), F.slice("x", p * width + 1, width).alias("y")))
        counted = own.withColumn("dim", F.size("x")).select("dim", F.explode(cells).alias("c")).groupBy("dim", "c.part", "c.y").agg(F.count("*").alias("n"))
        counted = cut(counted.repartitionByRange("dim", "part", "y").sortWithinPartitions("dim", "part", "y"))
        for _ in range(rounds):
            _improve(counted, books)
        discard(counted)
    return _coded(own, books, parts), books


def _padded(x: np.ndarray, parts: int) -> np.ndarray:
    """Rows as (rows, parts, components)."""
    width = -(-x.shape[1] // parts)
    out = np.zeros((len(x), parts * width), np.int64)
    out[:, : x.shape[1]] = x
    return out.reshape(len(x), parts, width)


def _first(own: DataFrame, dim: int, parts: int) -> np.ndarray:
    rows = own.where(F.size("x") == dim).select("vec_id", "x").orderBy(F.asc_nulls_last("vec_id"), "x").limit(ENTRIES).collect()
    return np.ascontiguousarray(_padded(np.array([r["x"] for r in rows], np.int64).reshape(len(rows), dim), parts).transpose(1, 0, 2))


def _improve(counted: DataFrame, books: Codebooks) -> None:
    """One round: the entries become the means of the parts nearest to them."""
    entries = books.entries

    def summed(batches):
        import pyarrow as pa

        total: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            dims, part, n = (np.asarray(batch.column(i)) for i in (0, 1, 3))
            for dim, p in {(int(d), int(p)) for d, p in zip(dims, part, strict=True)}:
                mine = np.flatnonzero((dims == dim) & (part == p))
                book = entries[dim][p]
                rows = np.zeros((len(mine), book.shape[1]), np.int64)
                for at, x in by_dimension(batch.column(2).take(pa.array(mine))):
                    rows[at, : x.shape[1]] = x.astype(np.int64)  # the last part of a filled-up dimension is shorter
                sums, counts = total.setdefault((dim, p), (np.zeros(book.shape, np.int64), np.zeros(len(book), np.int64)))
                trie = Trie(rows)
                index, _ = trie.nearest(book)
                weight = np.zeros(len(index), np.int64)
                np.add.at(weight, trie.source, n[mine])
                np.add.at(counts, index, weight)
                np.add.at(sums, index, trie.rows * weight[:, None])
        for (dim, p), (sums, counts) in total.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), dim, np.int32)), pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(counts[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))],
                ["dim", "part", "entry", "n", "total"],
            )

    partial = counted.select("dim", "part", "y", "n").mapInArrow(summed, "dim int, part int, entry int, n long, total array<long>")
    cells = partial.select("dim", "part", "entry", "n", F.posexplode_outer("total").alias("at", "s"))
    sums = cells.groupBy("dim", "part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    new = {dim: book.copy() for dim, book in entries.items()}
    for r in sums.where("at IS NOT NULL").collect():  # at most 256 vectors for each dimension
        new[r["dim"]][r["part"], r["entry"], r["at"]] = r["s"] // r["n"]
    books.entries = new


def _coded(own: DataFrame, books: Codebooks, parts: int) -> DataFrame:
    entries = books.entries

    def coded(batches):
        import pyarrow as pa

        for whole_batch in batches:
            for a in range(0, whole_batch.num_rows, ROWS):
                batch = whole_batch.slice(a, ROWS)
                index, error = np.zeros((batch.num_rows, parts), np.uint8), np.zeros(batch.num_rows, np.int64)
                for at, x in by_dimension(batch.column(2)):
                    cells = _padded(x.astype(np.int64), parts)
                    for p in range(parts):
                        trie = Trie(cells[:, p])
                        i, e = trie.nearest(entries[x.shape[1]][p])
                        index[at, p] = i[trie.source]
                        error[at] += e[trie.source]
                text = [r.tobytes().hex() for r in index]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(error), pa.array(np.diff(np.asarray(batch.column(2).offsets)).astype(np.int32))], ["vec_id", "label", "code", "error", "dim"])

    kinds = dict(own.dtypes)
    return own.mapInArrow(coded, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long, dim int")


def compressed(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error (errors summed over rows of the same label, null labels together; null beyond a long) and codebooks_sha256 (of the dimension's codebooks) for each usable row; see compress()."""
    rows, books = compress(vectors)
    rows = cut(rows)
    sums = rows.groupBy(F.col("label").alias("of")).agg(F.expr("try_cast(sum(CAST(error AS DECIMAL(38, 0))) AS BIGINT)").alias("label_error"))
    few = sums.count() <= BROADCAST_LABELS
    out = rows.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("of")), "left")
    digest = F.lit(None).cast("string")
    for dim in books.entries:
        digest = F.when(F.col("dim") == dim, F.lit(books.sha256(dim))).otherwise(digest)
    return out.select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))
