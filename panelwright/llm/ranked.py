"""The best documents for each item of a query table, by a saturated sum of term weights.

Documents stand in segments of a few thousand, with postings of the query terms alone. In a segment an item's
short lists are summed term by term into accumulators, and these are one more list with a bound. Together with
the long lists it is read document by document, and blocks and documents that can't reach the item's k-th best
score so far are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.common import NULL_ID, cut, discard, slices, temporary, text_buffers
from panelwright.llm.words import hashed

#: (item, term) rows that are searched for at a time, 24 bytes each in every task; more items take more passes.
ITEM_ROWS = 2_000_000
#: Documents of a segment, and bytes of text from which a segment ends.
SEGMENT, SEGMENT_BYTES = 8192, 16 << 20
#: Bytes of a row group of segments: what a task reads at a time.
ROW_GROUP = 32 << 20
#: Documents of a block that has one bound for each long list, and blocks looked at between two looks at the k-th score.
SPAN, RUN = 64, 16
#: The shortest lists of an item that together hold at most this share of a segment's documents are summed first.
SHORT = 0.25
#: Tasks' results of one item meet in so many groups before they meet in one.
GROUPS = 64


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.floor(1000 * np.log((2.0 * documents + 2) / (2.0 * df + 1))).astype(np.int64)


def norms(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """m of documents with n terms each."""
    if len(n) and 25 * int(n.max()) * documents >= 1 << 63:
        return np.array([75 + 25 * x * documents // terms for x in n.tolist()], np.int64)
    return 75 + 25 * n.astype(np.int64) * documents // max(terms, 1)


class Segment:
    """Postings of one segment with their shares of a score (before the term's weight)."""

    def __init__(self, n: np.ndarray, term: np.ndarray, df: np.ndarray, doc: np.ndarray, tf: np.ndarray, documents: int, terms: int):
        self.size = len(n)
        self.starts = np.r_[0, np.cumsum(df, dtype=np.int64)]
        self.doc = doc.astype(np.int64)
        tf = tf.astype(np.int64)
        self.share = 1_000_000_000 * tf // (1000 * tf + 12 * norms(n, documents, terms)[self.doc])
        self.term = term
        self._tops: dict[int, np.ndarray] = {}
        #: Documents whose score was summed or begun, for tests.
        self.seen = 0

    def list(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.starts[i], self.starts[i + 1]
        return self.doc[a:b], self.share[a:b]

    def tops(self, i: int) -> np.ndarray:
        """The largest share of list i in each block."""
        if i not in self._tops:
            doc, share = self.list(i)
            block = doc // SPAN
            edge = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            out = np.zeros(-(-self.size // SPAN), np.int64)
            out[block[edge]] = np.maximum.reduceat(share, edge)
            self._tops[i] = out
        return self._tops[i]

    def search(self, lists: np.ndarray, weight: np.ndarray, best: Best) -> None:
        """Offer best all documents that may be among its k best; lists are positions of term."""
        length = self.starts[lists + 1] - self.starts[lists]
        order = np.argsort(length, kind="stable")
        few = int(np.searchsorted(np.cumsum(length[order]), SHORT * self.size, "right"))
        total = np.zeros(-(-self.size // SPAN) * SPAN, np.int64)
        for j in order[:few]:  # term at a time: a list holds a document once
            doc, share = self.list(lists[j])
            total[doc] += weight[j] * share
        bound = total.reshape(-1, SPAN).max(1)
        long = order[few:]
        tops = np.zeros((len(long), len(bound)), np.int64)
        for row, j in enumerate(long):
            tops[row] = weight[j] * self.tops(lists[j])
        by_weight = np.argsort(-tops.max(1, initial=0), kind="stable")
        tops, long = tops[by_weight], long[by_weight]
        bound = bound + tops.sum(0)
        alive = np.flatnonzero(bound >= best.floor)
        at = 0
        while at < len(alive):  # document at a time, a run of blocks in one step
            run = alive[at : at + RUN]
            at += RUN
            run = run[bound[run] >= best.floor]
            if len(run) == 0:
                continue
            doc = (run[:, None] * SPAN + np.arange(SPAN)).ravel()
            block = np.repeat(np.arange(len(run)), SPAN)
            inside = doc < self.size
            doc, block = doc[inside], block[inside]
            score, rest = total[doc], tops[:, run].sum(0)
            self.seen += len(doc)
            for row, j in enumerate(long):
                keep = score + rest[block] >= best.floor
                if not keep.all():
                    doc, block, score = doc[keep], block[keep], score[keep]
                    if len(doc) == 0:
                        break
                rest = rest - tops[row, run]
                docs, share = self.list(lists[j])
                i = np.minimum(np.searchsorted(docs, doc), len(docs) - 1)
                score += np.where(docs[i] == doc, weight[j] * share[i], 0)
            best.offer(score, doc)


class Best:
    """The k best (score, id) so far: higher scores first, then smaller ids."""

    def __init__(self, k: int):
        self.k, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.floor, self.ids = 1, None

    def offer(self, score: np.ndarray, doc: np.ndarray) -> None:
        """ids, set for each segment, names the documents."""
        good = np.flatnonzero(score >= self.floor)
        if len(good) == 0:
            return
        s, i = np.r_[self.score, score[good]], np.r_[self.id, self.ids[doc[good]]]
        order = np.lexsort((i, -s))[: self.k]
        self.score, self.id = s[order], i[order]
        if len(order) == self.k:
            self.floor = max(1, int(self.score[-1]))  # an equal score may still win by a smaller id


def top_documents(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank int (from 1), doc_id, score long: the k highest-scoring documents of each row of items.

    Reads doc_id, text of docs and item_id, text of items. Terms are runs of ASCII letters and digits and all
    characters beyond ASCII, A-Z lower-cased, told apart by 64-bit hashes; they come from whole texts. A null
    or empty text has none: such a document is in no result and not counted, such an item has no rows. Every
    row of docs is a document and every row of items an item, equal rows too. Scores of 0 are left out, equal
    scores go by ascending doc_id, null ids last.

    One pass over the texts counts terms and keeps the postings of the items' terms, stored in segments; a
    second one ranks each segment, keeping the k best of each item for a whole task. Only the items' terms go
    to all tasks, ITEM_ROWS at a time (an item stays whole).
    """

    def split(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        key = TaskContext.get().partitionId() << 33
        for batch in batches:
            data, off = text_buffers(batch.column(1))
            term, item = hashed(data, off)
            order = np.lexsort((term, item))
            term, item = term[order], item[order]
            edge = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (item[1:] != item[:-1])]) if len(term) else np.zeros(0, np.int64)
            n = np.diff(np.r_[edge, len(term)])
            which = item[edge]
            yield pa.RecordBatch.from_arrays([pa.array(key + which), batch.column(0).take(pa.array(which)), pa.array(term[edge].view(np.int64)), pa.array(n.astype(np.int64))], ["key", "item_id", "term", "n"])
            key += batch.num_rows

    kind = dict(items.dtypes)["item_id"]
    asked = cut(items.select("item_id", "text").mapInArrow(split, f"key long, item_id {kind}, term long, n long"))
    blocks = max(1, -(-asked.count() // ITEM_ROWS))
    found = None
    for b in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).select("key", "term", "n").toPandas()
        part = _ranked(docs, mine["key"].to_numpy(np.int64), mine["term"].to_numpy(np.int64).view(np.uint64), mine["n"].to_numpy(np.int64), k)
        found = part if found is None else found.unionByName(part)
    near = Window.partitionBy("key", F.col("task") % GROUPS).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    found = found.withColumn("r", F.row_number().over(near)).where(F.col("r") <= k)
    last = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    found = found.withColumn("rank", F.row_number().over(last).cast("int")).where(F.col("rank") <= k)
    return found.join(asked.select("key", "item_id").distinct(), "key").select("item_id", "rank", "doc_id", "score")


def _ranked(docs: DataFrame, key: np.ndarray, term: np.ndarray, times: np.ndarray, k: int) -> DataFrame:
    """(key, task, doc_id, score): the k best of each task, for the items given as rows (key, term, times)."""
    spark = docs.sparkSession
    terms, term = np.unique(term, return_inverse=True)
    order = np.lexsort((term, key))
    key, term, times = key[order], term[order], times[order]
    keys, starts = np.unique(key, return_index=True)
    starts = np.r_[starts, len(key)]

    path = temporary(spark, "segments")
    schema = "documents long, terms long, doc_id array<long>, n array<int>, term array<int>, df array<int>, doc array<int>, tf array<int>"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts.mapInArrow(lambda batches: _segments(batches, terms), schema).write.option("compression", "zstd").option("parquet.block.size", str(ROW_GROUP)).parquet(path)
    stored = spark.read.schema(schema).parquet(path)
    counts = stored.agg(F.sum("documents").alias("d"), F.sum("terms").alias("t")).first()
    documents, total = counts["d"] or 0, counts["t"] or 0
    # a row for each of the items' terms, which every task holds anyway
    held = stored.select(F.explode(F.arrays_zip("term", "df")).alias("x")).groupBy("x.term").agg(F.sum("x.df").alias("df")).toPandas()
    df = np.zeros(len(terms), np.int64)
    df[held["term"].to_numpy(np.int64)] = held["df"].to_numpy(np.int64)
    weight = times * weights(df, documents)[term]
    use = (df[term] > 0) & (weight > 0)

    def ranked(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        best = [Best(k) for _ in keys]
        where = np.full(len(terms), -1, np.int64)
        for batch in batches:
            for r in range(batch.num_rows):
                ids, n, own, held, doc, tf = (batch.column(c)[r].values for c in range(2, 8))
                ids = np.asarray(pc.fill_null(ids, NULL_ID))
                own = np.asarray(own)
                segment = Segment(np.asarray(n), own, np.asarray(held), np.asarray(doc), np.asarray(tf), documents, total)
                where[own] = np.arange(len(own))
                for i, b in enumerate(best):
                    a, z = starts[i], starts[i + 1]
                    at = where[term[a:z]]
                    live = (at >= 0) & use[a:z]
                    if live.any():
                        b.ids = ids
                        segment.search(at[live], weight[a:z][live], b)
                where[own] = -1
        task = TaskContext.get().partitionId()
        for i, b in enumerate(best):
            if len(b.id):
                b.ids = None
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.id), keys[i])), pa.array(np.full(len(b.id), task, np.int64)), pa.array(b.id, mask=b.id == NULL_ID), pa.array(b.score)], ["key", "task", "doc_id", "score"])

    out = cut(stored.mapInArrow(ranked, "key long, task long, doc_id long, score long"))
    discard(stored)
    return out


def _segments(batches, terms: np.ndarray) -> Iterator:
    """Rows of Segment's arrays; documents without a term are left out."""
    import pyarrow as pa

    bits = 16
    terms = terms if len(terms) else np.zeros(1, np.uint64)  # without items the documents are still counted
    may = np.zeros(1 << bits, bool)
    may[(terms & np.uint64((1 << bits) - 1)).astype(np.int64)] = True

    def row(ids, n, keys, tf):
        n, keys, tf = np.concatenate(n), np.concatenate(keys), np.concatenate(tf)
        order = np.argsort(keys >> 32, kind="stable")  # documents come in ascending order already
        keys, tf = keys[order], tf[order]
        term, df = np.unique(keys >> 32, return_counts=True)
        arrays = [pa.concat_arrays(ids), pa.array(n.astype(np.int32)), *(pa.array(x.astype(np.int32)) for x in (term, df, keys & 0xFFFFFFFF, tf))]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in arrays]
        return pa.RecordBatch.from_arrays([pa.array([len(n)], pa.int64()), pa.array([int(n.sum())], pa.int64()), *lists], ["documents", "terms", "doc_id", "n", "term", "df", "doc", "tf"])

    ids, sizes, keys, tfs, held, count = [], [], [], [], 0, 0
    for batch in batches:
        data, off = text_buffers(batch.column(1))
        for a, b in slices(off, 4 << 20):
            for a in range(a, b, SEGMENT):
                z = min(a + SEGMENT, b)
                h, doc = hashed(data[off[a] : off[z]], off[a : z + 1] - off[a])
                n = np.bincount(doc, minlength=z - a)
                full = np.flatnonzero(n)
                if len(full) == 0:
                    continue
                if count and (count + len(full) > SEGMENT or held + off[z] - off[a] > SEGMENT_BYTES):
                    yield row(ids, sizes, keys, tfs)
                    ids, sizes, keys, tfs, held, count = [], [], [], [], 0, 0
                near = np.flatnonzero(may[(h & np.uint64((1 << bits) - 1)).astype(np.int64)])
                at = np.minimum(np.searchsorted(terms, h[near]), len(terms) - 1)
                hit = terms[at] == h[near]
                place = np.cumsum(n > 0) - 1 + count
                key, tf = np.unique((at[hit].astype(np.int64) << 32) | place[doc[near[hit]]], return_counts=True)
                ids.append(batch.column(0).take(pa.array(a + full)))
                sizes.append(n[full])
                keys.append(key)
                tfs.append(tf)
                held, count = held + int(off[z] - off[a]), count + len(full)
    if count:
        yield row(ids, sizes, keys, tfs)
