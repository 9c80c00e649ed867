"""Removing repeated passages by longest-previous-factor arrays.

A byte goes when a string of LENGTH bytes that covers it also starts in a document with a smaller id. All
strings of that length cannot be shuffled, so each is named by the least hash of the K-byte strings inside
it; neighbouring strings with one name form a run, and runs are cut by content alone, so equal strings
have equal names wherever they stand.

1. Documents are packed, whole record batches, into chunks of a few MB, and every chunk lists the names
   that it holds. Names that a second chunk or document holds are sent back to the chunks.
2. Each chunk sends the runs of such names, once for each content with its smallest document.
3. By name, the strings of those runs are put in suffix order, with the common prefixes of neighbours. The
   previous and the next smaller document of each place give its longest previous factor; where that has
   LENGTH bytes the string goes. The answers go back to the chunks, which cut their texts.

A short phrase that is frequent in different surroundings gives one name many runs without any repeat of
LENGTH bytes. Parts of step 3 that come out heavy are therefore dealt anew, string by string, by a hash of
the whole string, after each chunk has reduced equal strings to its smallest document.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import NULL_ID, cut, discard, masked, mix64, text_buffers

LENGTH, K = 50, 24
#: Bytes of text in a chunk, and of all texts in a group of names.
CHUNK, GROUP = 2 << 20, 8 << 20
#: Bytes of runs beyond which a part is dealt anew by whole strings, and strings in each share of it.
HEAVY, SHARE = 8 << 20, 50_000


def names(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of LENGTH-byte strings with one name: (start, strings, name); 64 strings at most in a run, none over a document's end."""
    out = []
    n = len(data)
    for at in range(0, max(0, n - LENGTH + 1), 1 << 18):
        x = data[at : at + (1 << 18) + LENGTH - 1].astype(np.uint64)
        with np.errstate(over="ignore"):
            h, p, size = x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019), np.uint64(0x5851F42D4C957F2D), 1
            while size * 2 <= K:
                h = h[: len(h) - size] * p + h[size:]
                p, size = p * p, size * 2
            if size < K:  # two overlapping halves
                h = h[: len(h) - (K - size)] * p + h[K - size :]
        h = mix64(h)
        w, size = LENGTH - K + 1, 1
        while size * 2 <= w:
            h = np.minimum(h[: len(h) - size], h[size:])
            size *= 2
        out.append(np.minimum(h[: len(h) - (w - size)], h[w - size :]) if size < w else h)
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    m = np.concatenate(out)
    valid = np.ones(len(m) + 1, np.int8)
    lengths = np.diff(offsets)
    for back in range(1, LENGTH):  # strings that would cross an end
        at = offsets[1:] - back
        valid[at[(lengths >= back) & (at <= len(m))]] = 0
    valid = valid[: len(m)].astype(bool)
    first = valid.copy()
    first[1:] &= (m[1:] != m[:-1]) | ~valid[:-1]
    docs = offsets[:-1][(lengths >= LENGTH)]
    first[docs] = True
    start = np.flatnonzero(first)
    stop = np.r_[start[1:], len(m)]
    bad = np.flatnonzero(~valid)
    if len(bad):
        i = np.searchsorted(bad, start)
        stop = np.minimum(stop, np.where(i < len(bad), bad[np.minimum(i, len(bad) - 1)], len(m)))
    pieces = -(-(stop - start) // 64)
    which = np.repeat(np.arange(len(start)), pieces)
    k = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    s = start[which] + 64 * k
    return s, np.minimum(stop[which] - s, 64), m[start[which]]


def _gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of many stretches, one after the other."""
    total = np.cumsum(length)
    if not len(total) or total[-1] == 0:
        return np.zeros(0, data.dtype)
    i = np.arange(total[-1]) - np.repeat(total - length, length) + np.repeat(start, length)
    return data[i]


def _ordered(content: np.ndarray, offsets: np.ndarray, strings: np.ndarray) -> tuple[np.ndarray, ...]:
    """The strings of all runs: (run, place in the run, a hash of all LENGTH bytes, suffix order, common prefix of each in that order with the one before it, up to LENGTH)."""
    run = np.repeat(np.arange(len(strings)), strings)
    i = np.arange(len(run)) - np.repeat(np.cumsum(strings) - strings, strings)
    at = offsets[run] + i
    padded = np.r_[content, np.zeros(8, np.uint8)]
    # Eight bytes from each place as one big-endian word.
    words = np.zeros(len(padded) - 7, np.uint64)
    for b in range(8):
        words = (words << np.uint64(8)) | padded[b : b + len(words)]
    columns = [words[at + 8 * j] for j in range(LENGTH // 8)] + [words[at + LENGTH - 8]]
    order = np.lexsort(columns[::-1])
    lcp = np.zeros(len(order), np.int64)
    same = np.ones(max(0, len(order) - 1), bool)
    for j, c in enumerate(columns):
        s = c[order]
        x = s[1:] ^ s[:-1]
        end = np.flatnonzero(same & (x != 0))  # the first word that differs, and in it the bytes before that
        lcp[end + 1] = (8 * j if j < LENGTH // 8 else LENGTH - 8) + sum((x[end] < np.uint64(1 << k)).astype(np.int64) for k in range(8, 64, 8))
        same[end] = False
    lcp[1:][same] = LENGTH
    h = np.zeros(len(order), np.uint64)
    for c in columns:
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + c)
    return run, i, h, order, lcp


def _nearest_smaller(document: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each place of a suffix order the common prefix with the nearest earlier place whose document is smaller; exact where it is at least LENGTH, less than LENGTH otherwise.

    All places follow their links at once: from a place with no smaller document to where that one's link
    already leads, as everything between holds none smaller either. A link carries the least common prefix
    on its way, and is given up once that is below LENGTH.
    """
    to, least = np.arange(len(document)) - 1, lcp.copy()
    active = np.flatnonzero(least >= LENGTH)
    while True:
        active = active[document[to[active]] >= document[active]]
        if not len(active):
            return least
        least[active], to[active] = np.minimum(least[active], least[to[active]]), to[to[active]]
        active = active[least[active] >= LENGTH]


def longest_previous_factors(document: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """The longest-previous-factor array in suffix order: how much of each string also starts in a smaller document, from the nearest smaller document before and after it. Exact where it is at least LENGTH, which lcp is cut at."""
    before = _nearest_smaller(document, lcp)
    after = _nearest_smaller(document[::-1], np.r_[0, lcp[:0:-1]])[::-1] if len(lcp) else before
    return np.maximum(before, after)


def previous_factors(content: np.ndarray, offsets: np.ndarray, strings: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each run the mask of its strings (bit i: the i-th) whose longest previous factor, in documents before `first`, has LENGTH bytes."""
    run, i, _, order, lcp = _ordered(content, offsets, strings)
    hit = order[longest_previous_factors(first[run][order], lcp) >= LENGTH]
    mask = np.zeros(len(strings), np.uint64)
    np.bitwise_or.at(mask, run[hit], np.uint64(1) << i[hit].astype(np.uint64))
    return mask


def pack_rows(docs: DataFrame, most: int = CHUNK) -> DataFrame:
    """Chunks of docs, of up to `most` bytes of text or one document: (chunk, bytes, rows as an Arrow stream)."""

    def pack(batches):
        import uuid

        import pyarrow as pa

        option = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))
        pending, size = [], 0

        def row():
            sink = pa.BufferOutputStream()
            t = pa.Table.from_batches(pending).combine_chunks()
            with pa.ipc.new_stream(sink, t.schema, options=option) as w:
                w.write_table(t)
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "bytes", "rows"])

        for batch in batches:
            at = batch.schema.get_field_index("mix_text")
            _, offsets = text_buffers(batch.column(at))
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most - size, "right")) - 1)
                b = min(b, batch.num_rows)
                pending.append(batch.slice(a, b - a))
                size += int(offsets[b] - offsets[a])
                a = b
                if size >= most // 2:
                    yield row()
                    pending, size = [], 0
        if pending:
            yield row()

    return docs.mapInArrow(pack, "chunk string, bytes long, rows binary")


class _Chunk:
    """A chunk's rows with its distinct texts laid out one after the other, each with the smallest id that has it."""

    def __init__(self, rows: bytes) -> None:
        import pyarrow as pa

        self.table = pa.ipc.open_stream(rows).read_all().combine_chunks()
        self.data, self.offsets = text_buffers(self.table["mix_text"])
        ids = self.table["mix_id"].to_numpy()
        self.ids = ids
        order = np.argsort(ids, kind="stable")
        seen: dict[bytes, int] = {}
        self.source = np.zeros(len(ids), np.int64)
        for d in order:
            text = self.data[self.offsets[d] : self.offsets[d + 1]].tobytes()
            self.source[d] = seen.setdefault(text, d)
        self.distinct = np.flatnonzero(self.source == np.arange(len(ids)))
        length = np.diff(self.offsets)[self.distinct]
        self.flat = _gather(self.data, self.offsets[:-1][self.distinct], length)
        self.at = np.r_[0, np.cumsum(length)]
        self.start, self.strings, self.name = names(self.flat, self.at)

    def documents(self) -> np.ndarray:
        return self.ids[self.distinct][np.searchsorted(self.at, self.start, "right") - 1]


def _group_of(name: np.ndarray, groups: int) -> np.ndarray:
    return ((name >> np.uint64(32)) % np.uint64(groups)).astype(np.int64)


def split(key: np.ndarray, groups: int):
    """(group, its rows) for each group that has any; the work doesn't depend on the number of groups."""
    order = np.argsort(key.astype(np.uint16) if groups < 1 << 16 else key, kind="stable")
    sorted_key = key[order]
    cuts = np.r_[np.flatnonzero(np.r_[True, sorted_key[1:] != sorted_key[:-1]]), len(order)] if len(order) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield int(sorted_key[a]), order[a:b]


def _named(part: np.ndarray, short: np.ndarray) -> np.ndarray:
    """A name by its part and its low half, which is what chunks and parts tell each other."""
    return (part.astype(np.uint64) << np.uint64(32)) | short.astype(np.uint64)


def held_elsewhere(name: np.ndarray, groups: int, parts: list[int], blobs: list[bytes]) -> np.ndarray:
    """Which of a chunk's names the parts' replies hold: one membership test over all replies."""
    if not parts:
        return np.zeros(len(name), bool)
    short = [np.frombuffer(b, np.uint32) for b in blobs]
    replies = _named(np.repeat(np.array(parts, np.int64), [len(s) for s in short]), np.concatenate(short))
    return np.isin(_named(_group_of(name, groups), name.astype(np.uint32)), replies)


def _blobs(schema: list[tuple], rows: list[tuple]):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(schema)], [n for n, _ in schema])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans (long), kept_sha256 and kept_text.

    Texts are UTF-8 bytes, null is empty, and matches never cross documents. Every byte covered by a
    50-byte string that also starts in a document with a smaller doc_id is removed, judged on the input.
    A null id is larger than any other, and equal ids are not smaller than each other, so rows that repeat
    an id with the same text lose nothing to each other. Texts under 50 bytes stay. n_spans counts maximal
    removed runs; kept_sha256 is of the bytes left; kept_text is those as text (a character that loses some
    of its bytes is replaced by U+FFFD). An empty table gives an empty table. Extra columns pass through,
    whatever their names; an output replaces an input column of its name.
    """
    outputs = "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"
    hidden, shown = masked(docs, *outputs, "text")
    at = [c for c in docs.columns if c.lower() not in outputs].index("text")
    out = _removed(docs.select("doc_id", "text", *hidden))
    return out.select(*shown[:at], "text", *shown[at:], *outputs)


def _removed(docs: DataFrame) -> DataFrame:
    """remove_repeats() of doc_id, text and columns of plain names."""
    # The text is packed once; mix_null brings back which texts were null.
    others = [c for c in docs.columns if c != "text"]
    d = docs.select(*others, F.coalesce("text", F.lit("")).alias("mix_text"), F.col("text").isNull().alias("mix_null"), F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NULL_ID))).alias("mix_id"))
    chunks = cut(pack_rows(d))
    groups = max(8, int(chunks.agg(F.sum("bytes")).first()[0] or 0) // GROUP)
    fine = groups * 4

    def listed(batches):
        import pyarrow as pa

        for batch in batches:
            for chunk, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c = _Chunk(rows)
                key = np.unique(c.name)
                yield _blobs([("part", pa.int32()), ("chunk", pa.string()), ("names", pa.binary())], [(g, chunk, key[i].astype(np.uint32).tobytes()) for g, i in split(_group_of(key, groups), groups)])

    def shared(t):
        import pyarrow as pa

        blobs = [np.frombuffer(b, np.uint32) for b in t["names"].to_pylist()]
        key, n = np.unique(np.concatenate(blobs), return_counts=True)
        repeated = key[n > 1]
        rows = [(t["part"][0].as_py(), chunk, x.tobytes()) for chunk, b in zip(t["chunk"].to_pylist(), blobs, strict=True) if len(x := b[np.isin(b, repeated, assume_unique=True)])]
        return pa.Table.from_batches([_blobs([("part", pa.int32()), ("chunk", pa.string()), ("names", pa.binary())], rows)])

    lists = chunks.select("chunk", "rows").mapInArrow(listed, "part int, chunk string, names binary")
    replies = cut(lists.groupBy("part").applyInArrow(shared, "part int, chunk string, names binary"))

    RUNS = "part int, chunk string, start binary, strings binary, first binary, content binary, n long, size long"

    def runs(left, right):
        """part -1: strings that go for sure, as another document of the chunk has the same run before."""
        import pyarrow as pa

        schema = [("part", pa.int32()), ("chunk", pa.string()), ("start", pa.binary()), ("strings", pa.binary()), ("first", pa.binary()), ("content", pa.binary()), ("n", pa.int64()), ("size", pa.int64())]
        rows = []
        chunk = left["chunk"][0].as_py() if len(left) else None
        for blob in left["rows"].to_pylist():
            c = _Chunk(blob)
            doc = c.documents()
            # A name in two documents of this chunk, or in another chunk.
            name, at = np.unique(c.name, return_inverse=True)
            low, high = np.full(len(name), NULL_ID), np.full(len(name), np.iinfo(np.int64).min)
            np.minimum.at(low, at, doc)
            np.maximum.at(high, at, doc)
            wanted = (low < high) | held_elsewhere(name, groups, right["part"].to_pylist(), right["names"].to_pylist())
            r = np.flatnonzero(wanted[at])
            start, strings, doc = c.start[r], c.strings[r], doc[r]
            content = _gather(c.flat, start, strings + LENGTH - 1)
            ends = np.r_[0, np.cumsum(strings + LENGTH - 1)]
            seen: dict[bytes, int] = {}
            raw = content.tobytes()
            one = np.zeros(len(r), bool)
            for k in np.argsort(doc, kind="stable"):
                text = raw[ends[k] : ends[k + 1]]
                before = seen.setdefault(text, k)
                one[k] = before == k or doc[before] == doc[k]
            sure = np.flatnonzero(~one)
            if len(sure):
                rows.append((-1, chunk, start[sure].astype(np.uint32).tobytes(), strings[sure].astype(np.uint8).tobytes(), None, None, None, None))
            keep = np.flatnonzero(one)
            for g, i in split(_group_of(c.name[r][keep], fine), fine):
                k = keep[i]
                rows.append((g, chunk, start[k].astype(np.uint32).tobytes(), strings[k].astype(np.uint8).tobytes(), doc[k].tobytes(), _gather(content, ends[k], strings[k] + LENGTH - 1).tobytes(), int(strings[k].sum()), int((strings[k] + LENGTH - 1).sum())))
        return pa.Table.from_batches([_blobs(schema, rows)])

    found = cut(chunks.select("chunk", "rows").groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(runs, RUNS))
    discard(replies)

    def dealt(batches):
        """The strings of heavy parts one by one; part -1: those that go for sure, as another document of the chunk has them before."""
        import pyarrow as pa

        schema = [("part", pa.int32()), ("share", pa.int32()), ("chunk", pa.string()), ("start", pa.binary()), ("strings", pa.binary()), ("first", pa.binary()), ("content", pa.binary())]
        for batch in batches:
            for r in batch.to_pylist():
                strings = np.frombuffer(r["strings"], np.uint8).astype(np.int64)
                start, first, content = np.frombuffer(r["start"], np.uint32), np.frombuffer(r["first"], np.int64), np.frombuffer(r["content"], np.uint8)
                at = np.cumsum(strings + LENGTH - 1) - (strings + LENGTH - 1)
                run, i, h, order, lcp = _ordered(content, at, strings)
                again = longest_previous_factors(first[run][order], lcp) >= LENGTH
                place = (start[run] + i).astype(np.uint32)
                rows = []
                if again.any():
                    sure = order[again]
                    rows.append((-1, 0, r["chunk"], place[sure].tobytes(), np.ones(len(sure), np.uint8).tobytes(), None, None))
                keep = order[~again]
                for share, k in split(_group_of(h[keep], r["shares"]), r["shares"]):
                    k = keep[k]
                    rows.append((r["part"], share, r["chunk"], place[k].tobytes(), np.ones(len(k), np.uint8).tobytes(), first[run[k]].tobytes(), _gather(content, at[run[k]] + i[k], np.full(len(k), LENGTH)).tobytes()))
                yield _blobs(schema, rows)

    def factors(t):
        import pyarrow as pa

        strings = np.frombuffer(b"".join(t["strings"].to_pylist()), np.uint8).astype(np.int64)
        first = np.frombuffer(b"".join(t["first"].to_pylist()), np.int64)
        content = np.frombuffer(b"".join(t["content"].to_pylist()), np.uint8)
        mask = previous_factors(content, np.cumsum(strings + LENGTH - 1) - (strings + LENGTH - 1), strings, first)
        rows, a = [], 0
        for chunk, s in zip(t["chunk"].to_pylist(), t["start"].to_pylist(), strict=True):
            s = np.frombuffer(s, np.uint32)
            m = mask[a : a + len(s)]
            a += len(s)
            hit = np.flatnonzero(m)
            if len(hit):
                rows.append((chunk, s[hit].tobytes(), m[hit].tobytes()))
        return pa.Table.from_batches([_blobs([("chunk", pa.string()), ("start", pa.binary()), ("mask", pa.binary())], rows)])

    ANSWERS = "chunk string, start binary, mask binary"
    weights = found.where("part >= 0").groupBy("part").agg(F.sum("n").alias("n"), F.sum("size").alias("size")).where(F.col("size") > HEAVY)
    heavy = cut(weights.select("part", (1 + F.col("n") / SHARE).cast("int").alias("shares")))
    light, sure, single = found.where("part >= 0"), found.where("part < 0").select("chunk", "start", "strings"), None
    if not heavy.isEmpty():
        single = cut(light.join(heavy, "part").select("part", "chunk", "start", "strings", "first", "content", "shares").mapInArrow(dealt, "part int, share int, chunk string, start binary, strings binary, first binary, content binary"))
        light = light.join(heavy, "part", "left_anti")
        sure = sure.unionByName(single.where("part < 0").select("chunk", "start", "strings"))
    back = light.groupBy("part").applyInArrow(factors, ANSWERS)
    if single is not None:
        back = back.unionByName(single.where("part >= 0").groupBy("part", "share").applyInArrow(factors, ANSWERS))
    answers = cut(back.withColumn("strings", F.lit(None).cast("binary")).unionByName(sure.withColumn("mask", F.lit(None).cast("binary"))))
    if single is not None:
        discard(single)

    def finish(left, right):
        import hashlib

        import pyarrow as pa
        import pyarrow.compute as pc

        tables = []
        for blob in left["rows"].to_pylist():
            c = _Chunk(blob)
            goes = np.zeros(len(c.flat) + LENGTH + 1, np.int32)
            for start, mask, strings in zip(right["start"].to_pylist(), right["mask"].to_pylist(), right["strings"].to_pylist(), strict=True):
                start = np.frombuffer(start, np.uint32).astype(np.int64)
                if mask is None:
                    n = np.frombuffer(strings, np.uint8).astype(np.int64)
                    at = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                else:
                    bits = np.unpackbits(np.frombuffer(mask, np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    run, i = np.nonzero(bits)
                    at = start[run] + i
                np.add.at(goes, at, 1)
                np.add.at(goes, at + LENGTH, -1)
            covered = np.cumsum(goes)[: len(c.flat)] > 0
            place = np.zeros(len(c.ids), np.int64)
            place[c.distinct] = np.arange(len(c.distinct))
            removed, spans, digest, text = [], [], [], []
            done: dict[int, tuple] = {}
            for d, source in enumerate(c.source):
                n = int(c.offsets[d + 1] - c.offsets[d])
                if c.ids[d] > c.ids[source] and n >= LENGTH:  # a copy of a smaller document of this chunk
                    got = (n, 1, hashlib.sha256(b"").hexdigest(), "")
                else:
                    if source not in done:
                        a, b = c.at[place[source]], c.at[place[source] + 1]
                        out = covered[a:b]
                        left_over = c.flat[a:b][~out].tobytes()
                        edges = int(out[0]) + int((out[1:] & ~out[:-1]).sum()) if n else 0
                        done[source] = (int(out.sum()), edges, hashlib.sha256(left_over).hexdigest(), left_over.decode("utf-8", "replace"))
                    got = done[source]
                for column, x in zip((removed, spans, digest, text), got, strict=True):
                    column.append(x)
            whole = pc.if_else(c.table["mix_null"], pa.scalar(None, pa.string()), c.table["mix_text"].cast(pa.string()))
            t = c.table.drop_columns(["mix_text", "mix_id", "mix_null"]).append_column("text", whole)
            n = pa.array(np.diff(c.offsets), pa.int64())
            for name, values in (("n_bytes", n), ("n_removed", pa.array(removed, pa.int64())), ("n_spans", pa.array(spans, pa.int64())), ("kept_sha256", pa.array(digest, pa.string())), ("kept_text", pa.array(text, pa.string()))):
                t = t.append_column(name, values)
            tables.append(t.select(out_schema.names))
        if tables:
            return pa.concat_tables(tables)
        return out_schema.empty_table()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    schema = StructType([StructField(f.name, f.dataType, True) for f in docs.schema] + [StructField(n, LongType()) for n in ("n_bytes", "n_removed", "n_spans")] + [StructField(n, StringType()) for n in ("kept_sha256", "kept_text")])
    out_schema = to_arrow_schema(schema)
    discard(found)
    return chunks.select("chunk", "rows").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, schema)
