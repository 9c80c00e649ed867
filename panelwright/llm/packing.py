"""Best-fit packing into bins of several permitted lengths."""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKED = "doc_id long, piece int, piece_start long, length long, bin_id string, bin_capacity long, bin_offset long"


def best_fit(sizes: list[int], lengths: list[int], opening: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Pack sizes (longest first, each at most the longest permitted length).

    The longest size that is left opens a bin. For every permitted length that holds it, the bin is filled
    in thought: what goes in next is the size that leaves the least room, as long as any left fits. The
    bin takes the length whose cost (the length and `opening`) for each unit so held is least, ties go to
    the longer, and these contents. So lengths are weighed by what is really left for them, and no later
    size fits a bin that is closed. At the end each bin shrinks to the least permitted length that holds its
    contents. Returns (bin, offset) per size and the capacity per bin.
    """
    vals = sorted(set(sizes))
    counts = dict.fromkeys(vals, 0)
    for n in sizes:
        counts[n] += 1
    left = [counts[v] for v in vals]
    following, at = [0] * len(vals), 0  # the place among sizes of the next of each value
    for i in range(len(vals) - 1, -1, -1):
        following[i], at = at, at + left[i]
    below = list(range(-1, len(vals) - 1))  # where to look on from a value that has run out

    def present(i: int) -> int:
        """The greatest value not above i of which some are left, -1 if none."""
        passed = []
        while i >= 0 and not left[i]:
            passed.append(i)
            i = below[i]
        for j in passed:
            below[j] = i
        return i

    def contents(room: int) -> list[tuple[int, int]]:
        out, i = [], len(vals) - 1
        while room >= vals[0]:
            i = present(min(i, bisect.bisect_right(vals, room) - 1))
            if i < 0:
                break
            n = min(left[i], room // vals[i])
            out.append((i, n))
            room, i = room - n * vals[i], i - 1
        return out

    place, capacity = [(0, 0)] * len(sizes), []
    top = present(len(vals) - 1)
    while top >= 0:
        left[top] -= 1
        best = None
        for c in (c for c in lengths if c >= vals[top]):
            more = contents(c - vals[top])
            used = vals[top] + sum(vals[i] * n for i, n in more)
            if best is None or (c + opening) * best[1] <= best[0] * used:
                best = c + opening, used, more
        used = 0
        for i, n in [(top, 1), *best[2]]:
            if i != top or used:
                left[i] -= n
            for k in range(following[i], following[i] + n):
                place[k] = (len(capacity), used)
                used += vals[i]
            following[i] += n
        capacity.append(next(c for c in lengths if c >= used))
        top = present(top)
    return place, capacity


def pack(docs: DataFrame, size: str = "size", lengths: tuple[int, ...] = (512, 1024, 2048, 4096), opening: int = 16, per_shard: int = 20_000) -> DataFrame:
    """Pack documents of `size` units into training sequences.

    A document longer than the longest length is cut into pieces of that length and a rest; a document of
    size 0 or null has no piece and appears once with piece 0, length 0 and no bin. Documents are dealt by
    a hash of (doc_id, size) and, where rows repeat, the copy's number to shards of about `per_shard` rows,
    each packed by itself, so the loss against one global packing is about one open bin of each length per
    shard. Repeated rows are packed as often as they appear. Ties keep (size, doc_id). Other columns are not
    read; an empty table gives no rows. Returns doc_id, piece, piece_start, length, bin_id (unique over shards), bin_capacity, bin_offset.
    """
    lengths = sorted(set(lengths))
    longest = lengths[-1]
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"))
    d = d.groupBy("doc_id", "size").agg(F.count("*").alias("times"))
    shards = max(1, -(-int(d.agg(F.sum("times")).first()[0] or 0) // per_shard))
    # Equal rows come as one with a count, so a repeated or null id is spread by its copy's number.
    # The copies come in two steps, so that no array is longer than 10,000 or a ten-thousandth of them.
    d = d.select("doc_id", "size", "times", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / 10_000))).alias("from"))
    d = d.select("doc_id", "size", F.explode(F.sequence(F.col("from") * 10_000 + 1, F.least(F.col("times"), F.col("from") * 10_000 + 10_000))).alias("copy"))
    d = d.withColumn("shard", F.pmod(F.xxhash64("doc_id", "size", "copy"), F.lit(shards)))
    d = d.withColumn("none", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))

    def shard(key, pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values(["size", "none", "doc_id", "copy"], ascending=[False, True, True, True], kind="stable")
        size, ids, none = pdf["size"].to_numpy(np.int64), pdf["doc_id"].to_numpy(), pdf["none"].to_numpy()
        n_pieces = np.maximum(1, -(-size // longest))
        doc = np.repeat(np.arange(len(size)), n_pieces)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
        length = np.minimum(longest, size[doc] - piece * longest)
        order = np.argsort(-length, kind="stable")
        full = order[length[order] > 0]
        place, capacity = best_fit([int(x) for x in length[full]], lengths, opening)
        bins, offset = np.full(len(doc), -1), np.zeros(len(doc), np.int64)
        if place:
            bins[full], offset[full] = np.array(place).T
        out = pd.DataFrame({
            "doc_id": pd.array(ids[doc], dtype="Int64"), "piece": piece.astype("int32"), "piece_start": piece * longest, "length": length,
            "bin_id": [f"{key[0]}-{b}" if b >= 0 else None for b in bins],
            "bin_capacity": pd.array([capacity[b] if b >= 0 else None for b in bins], dtype="Int64"), "bin_offset": pd.array([int(o) if b >= 0 else None for o, b in zip(offset, bins, strict=True)], dtype="Int64"),
        })
        out.loc[none[doc], "doc_id"] = pd.NA
        return out

    return d.groupBy("shard").applyInPandas(shard, PACKED)
