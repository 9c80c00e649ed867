"""Token ids in files of range-coded blocks."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.common import shared_folder, slices, text_buffers

#: Ids of a block at most; documents' bytes of a part.
BLOCK, PART = 6 << 20, 10 << 20
#: A block is coded in up to LANES stretches side by side, of SHORTEST ids at least.
LANES, SHORTEST = 4096, 512
#: Bits of the order-2 table's index; what an id adds to its order-0 frequency, which starts at 1.
SLOTS, GAIN = 20, 24
#: The range has up to TOP bits and is refilled below LOW; a choice between candidates has 2**SCALE parts.
TOP, LOW, SCALE = 48, 32, 16

#: What is added to the table's entry of a candidate with a count of 0 to 15 (the entry's bits 4 to 7), by turns when it was wrong and when it was right: half the count goes; one comes, up to 15.
_MOVES = np.array([m for s in range(16) for m in (-16 * (s >> 1), 16 * (s < 15))], np.int32)
#: Whether it stays the candidate: firm enough to lose half its count, or right.
_STAYS = np.array([stays for s in range(16) for stays in (s > 2, True)])


class _Model:
    """What the lanes of a block have learned together, the same in coding and decoding.

    Order 0 is every id's frequency so far; orders 1 and 2 hold for each context a candidate, the id that
    followed, and a count of 0 to 15 of how firmly it did. How often a candidate of a count was right gives
    that order's probability for it, and the rest goes to all ids by order 0. An id's probability is the
    sum of the three orders' with weights that belong to the pair of counts and follow the orders' shares
    in what came true. Order 2 is a hashed table whose rows carry four bits of check.
    """

    def __init__(self, vocabulary: int, lanes: int) -> None:
        self.tables = [np.zeros(vocabulary + 1, np.int32), np.zeros(1 << SLOTS, np.int32)]  # id << 8 | count << 4 | check
        n = np.arange(16)
        self.right = [np.stack([4 * n, np.full(16, 6)], 1).astype(np.int64) for _ in range(2)]
        self.credit = np.tile(np.array([64, 96, 192], np.int64), (256, 1))
        self.count = np.ones(vocabulary, np.int64)
        self.waiting: list[np.ndarray] = []
        self.one = np.full(lanes, vocabulary, np.int32)
        self.two = np.full(lanes, vocabulary, np.int32)
        self.steps = 0
        self.refresh()

    def refresh(self) -> None:
        if self.waiting:
            self.count += GAIN * np.bincount(np.concatenate(self.waiting), minlength=len(self.count))
            self.waiting = []
        upto = np.cumsum(self.count)
        self.below, self.total = (upto - self.count).astype(np.int32), int(upto[-1])
        self.share = self.count.astype(np.float32)
        self.share *= np.float32(1 / self.total)
        p = [r[:, 0] / r.sum(1) for r in self.right]
        w = self.credit / self.credit.sum(1, keepdims=True)
        one, two = np.tile(p[0], 16), np.repeat(p[1], 16)
        self.p = [one.astype(np.float32), two.astype(np.float32)]
        self.weight = [np.ascontiguousarray(w[:, k], np.float32) for k in range(3)]
        whole = np.float32((1 << SCALE) - 136)  # leaves a part to every candidate and some to all other ids
        self.q1, self.q2 = (w[:, 1] * one).astype(np.float32) * whole, (w[:, 2] * two).astype(np.float32) * whole
        self.w0 = self.weight[0] * whole

    def predict(self) -> None:
        """Each lane's candidates a2 and a1 (where t2, t1 hold) and the ends of their parts of 2**SCALE; the rest stands for the other ids."""
        h = self.two.astype(np.uint32)
        h *= np.uint32(0x9E3779B1)
        h += self.one.astype(np.uint32) * np.uint32(0x85EBCA77)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        self.check = (h & np.uint32(15)).astype(np.int32)
        self.slot = (h >> np.uint32(32 - SLOTS)).astype(np.int64)
        v1, v2 = self.tables[0].take(self.one), self.tables[1].take(self.slot)
        v2 *= (v2 & 15) == self.check
        s1, s2 = (v1 >> 4) & 15, (v2 >> 4) & 15
        joint = ((s2 << 4) | s1).astype(np.intp)
        a1, a2 = v1 >> 8, v2 >> 8
        t1, t2 = s1 > 0, s2 > 0
        both = a1 == a2
        both &= t2
        q1, q2, w0 = self.q1.take(joint), self.q2.take(joint), self.w0.take(joint)
        q2 += q1 * both
        q2 += w0 * self.share.take(a2)
        q1 += w0 * self.share.take(a1)
        t1 &= ~both
        e2, e1 = q2.astype(np.int32), q1.astype(np.int32)
        e2 += 1
        e1 += 1
        e2 *= t2
        e1 *= t1
        e1 += e2
        self.v1, self.v2, self.s1, self.s2, self.joint = v1, v2, s1, s2, joint
        self.a1, self.a2, self.t1, self.t2, self.e1, self.e2 = a1, a2, t1, t2, e1, e2

    def learn(self, ids: np.ndarray, right2: np.ndarray) -> None:
        right1 = self.a1 == ids
        right1 &= self.s1 > 0
        fresh = (ids << 8) | 16
        for order, v, s, right in ((1, self.v1, self.s1, right1), (2, self.v2, self.s2, right2)):
            case = (s << 1) | right
            new = np.where(_STAYS.take(case), v + _MOVES.take(case), fresh | self.check if order == 2 else fresh)
            self.tables[order - 1][self.slot if order == 2 else self.one] = new
        self.waiting.append(ids)
        i = self.steps
        if i < 32 or i % 8 == 0:
            self._weigh(ids, right1, right2)
        if i < 32 or i % 8 == 0:
            self.refresh()
        self.steps += 1
        self.two, self.one = self.one, ids

    def _weigh(self, ids: np.ndarray, right1: np.ndarray, right2: np.ndarray) -> None:
        j, by0 = self.joint, self.share.take(ids)
        known = right1 | right2
        part = [self.weight[0].take(j) * by0]
        for k, (right, s) in enumerate(((right1, self.s1), (right2, self.s2))):
            p = self.p[k].take(j)
            miss = (1 - p) * by0
            part.append(self.weight[k + 1].take(j) * np.where(right, p, np.where(known, miss * by0, miss)))
            self.right[k] += np.bincount(s * 2 + ~right, minlength=32).reshape(16, 2)
        scale = 64 / (part[0] + part[1] + part[2])
        for k in range(3):
            self.credit[:, k] += np.bincount(j, (part[k] * scale).astype(np.int64), 256).astype(np.int64)


def _shape(n: int) -> tuple[int, int]:
    """(lanes, ids of each) of a block of n ids."""
    lanes = max(1, min(LANES, n // SHORTEST))
    return lanes, -(-n // lanes)


def encode_block(ids: np.ndarray) -> bytes:
    """Range-code ids of 0 and above: which ids there are, then the words of each lane as counts, then the words, 16 bits each."""
    n = len(ids)
    there = np.flatnonzero(np.bincount(ids))  # the ids are coded as their numbers among these, so that tables stay small
    number = np.zeros(int(there[-1]) + 1, np.int32)
    number[there] = np.arange(len(there))
    ids = number[ids]
    vocabulary = len(there)
    head = zlib.compress(np.diff(there, prepend=0).astype("<u4").tobytes())
    lanes, steps = _shape(n)
    padded = np.zeros(lanes * steps, np.int32)
    padded[:n] = ids
    rows = np.ascontiguousarray(padded.reshape(lanes, steps).T)
    m = _Model(vocabulary, lanes)
    low, rng = np.zeros(lanes, np.int64), np.full(lanes, (1 << TOP) - 1, np.int64)
    width = steps * 3 + 8
    out, at = np.zeros(lanes * width, np.uint16), np.arange(lanes) * width
    first = at.copy()

    def carry(k: np.ndarray) -> None:
        low[k] &= (1 << TOP) - 1
        p = at[k] - 1
        while len(p):
            out[p] += np.uint16(1)
            p = p[out[p] == 0] - 1

    def emit(k: np.ndarray) -> np.ndarray:
        x, y, p = low[k], rng[k], at[k]
        out[p] = x >> LOW
        x <<= 16
        x &= (1 << TOP) - 1
        y <<= 16
        p += 1
        low[k], rng[k], at[k] = x, y, p
        return k[y < 1 << LOW]

    for i in range(steps):
        ids = rows[i]
        m.predict()
        is2 = m.a2 == ids
        is2 &= m.t2
        is1 = m.a1 == ids
        is1 &= m.t1
        other = ~(is1 | is2)
        r = rng >> SCALE
        start = m.e2 * is1 + m.e1 * other
        size = np.where(is2, m.e2, np.where(is1, m.e1, 1 << SCALE)) - start
        low += r * start
        rng = r * size
        k = np.flatnonzero(other)
        if len(k):  # what neither candidate is, by the frequencies of order 0
            few = k[rng[k] < 1 << LOW]
            while len(few):
                over = few[low[few] >> TOP > 0]
                if len(over):
                    carry(over)
                few = emit(few)
            r, x = (rng[k] / m.total).astype(np.int64), ids[k]
            low[k] += r * m.below.take(x)
            rng[k] = r * m.count.take(x)
        over = np.flatnonzero(low >> TOP)
        if len(over):
            carry(over)
        few = np.flatnonzero(rng < 1 << LOW)
        while len(few):
            few = emit(few)
        m.learn(ids, is2)
    low += (1 << 16) - 1  # two more words name a stretch inside the range, whatever follows them
    over = np.flatnonzero(low >> TOP)
    if len(over):
        carry(over)
    out[at], out[at + 1] = low >> LOW, (low >> 16) & 0xFFFF
    size = at + 2 - first
    words = out.reshape(lanes, width)[np.arange(width) < size[:, None]]
    return np.array([len(head)], "<u4").tobytes() + head + size.astype("<u4").tobytes() + words.astype("<u2").tobytes()


def decode_block(data: bytes, n: int) -> np.ndarray:
    """The n ids of a block; ValueError where the bytes can't be such a block."""
    lanes, steps = _shape(n)
    cut = 4 + int.from_bytes(data[:4], "little")
    try:
        there = np.cumsum(np.frombuffer(zlib.decompress(data[4:cut]), "<u4"), dtype=np.int64)
    except zlib.error as e:
        raise ValueError("a block's list of ids does not match its checksum") from e
    data, vocabulary = data[cut:], len(there)
    size = np.frombuffer(data[: 4 * lanes], "<u4").astype(np.int64)
    if len(size) != lanes or len(data) != 4 * lanes + 2 * size.sum() or size.min() < 2:
        raise ValueError("a block has another length than its lanes")
    words = np.r_[np.frombuffer(data, "<u2", offset=4 * lanes), np.zeros(4, np.uint16)]
    at = np.cumsum(size) - size
    value = words[at].astype(np.int64) << 32 | words[at + 1].astype(np.int64) << 16 | words[at + 2]
    at += 3
    rng = np.full(lanes, (1 << TOP) - 1, np.int64)
    m = _Model(vocabulary, lanes)
    rows = np.zeros((steps, lanes), np.int32)

    def refill(k: np.ndarray) -> np.ndarray:
        v, y, p = value[k], rng[k], at[k]
        v <<= 16
        v |= words.take(p, mode="clip")
        p += 1
        y <<= 16
        rng[k], at[k], value[k] = y, p, v
        return k[y < 1 << LOW]

    for i in range(steps):
        m.predict()
        r = rng >> SCALE
        v = (value / r).astype(np.int32)  # exact: both are below 2**48
        is2, in1 = v < m.e2, v < m.e1
        other = ~in1
        start = m.e2 * (in1 & ~is2) + m.e1 * other
        size = np.where(is2, m.e2, np.where(in1, m.e1, 1 << SCALE)) - start
        value -= r * start
        rng = r * size
        ids = np.where(is2, m.a2, m.a1)
        k = np.flatnonzero(other)
        if len(k):
            few = k[rng[k] < 1 << LOW]
            while len(few):
                few = refill(few)
            r, v = (rng[k] / m.total).astype(np.int64), value[k]
            x = np.searchsorted(m.below, (v / r).astype(np.int32), "right") - 1
            ids[k] = x
            value[k] = v - r * m.below.take(x)
            rng[k] = r * m.count.take(x)
        few = np.flatnonzero(rng < 1 << LOW)
        while len(few):
            few = refill(few)
        rows[i] = ids
        m.learn(ids, is2)
    return there.astype(np.int32)[rows.T.ravel()[:n]]


def crc32_joined(a: int, b: int, n: int) -> int:
    """crc32 of two strings joined, from theirs and the second one's length: a's remainder times x**(8n), plus b's."""

    def times(m: list[int], v: int) -> int:
        r = 0
        for row in m:
            if not v:
                break
            if v & 1:
                r ^= row
            v >>= 1
        return r

    m = [0xEDB88320] + [1 << i for i in range(31)]  # one zero bit
    for _ in range(3):
        m = [times(m, row) for row in m]
    while n:
        if n & 1:
            a = times(m, a)
        m = [times(m, row) for row in m]
        n >>= 1
    return a ^ b



FILE = "part int, block long, doc_id array<long>, seq array<long>, piece array<int>, length array<int>, crc32 long, coded binary"
PIECES = "part int, block long, seq long, piece int, doc_id long, length int, crc long"


class _Pending:
    """Ids that wait for a block, with the pieces of documents that they are."""

    def __init__(self) -> None:
        self.ids, self.doc, self.null = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool)
        self.seq, self.piece, self.length = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.documents = 0

    def add(self, ids: np.ndarray, length: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        k = len(length)
        self.ids, self.doc, self.null = np.r_[self.ids, ids], np.r_[self.doc, doc], np.r_[self.null, null]
        self.seq, self.piece, self.length = np.r_[self.seq, self.documents + np.arange(k)], np.r_[self.piece, np.zeros(k, np.int32)], np.r_[self.length, length]
        self.documents += k

    def take(self, n: int) -> tuple:
        """Take out the first n ids: (ids, doc, null, seq, piece, length)."""
        upto = np.cumsum(self.length)
        whole = int(np.searchsorted(upto, n, "right"))
        rest = n - (int(upto[whole - 1]) if whole else 0)  # ids of a document that goes on in the next block
        k = whole + (rest > 0)
        length = self.length[:k].copy()
        if rest:
            length[-1] = rest
        out = self.ids[:n], self.doc[:k], self.null[:k], self.seq[:k], self.piece[:k], length
        self.ids = self.ids[n:].copy()
        self.doc, self.null, self.seq, self.piece, self.length = (x[whole:].copy() for x in (self.doc, self.null, self.seq, self.piece, self.length))
        if rest:
            self.piece[0] += 1
            self.length[0] -= rest
        return out


def write_ids(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2) -> None:
    """Encode every text and write its ids, end_id after each document, to `folder` in ascending doc_id order.

    A file row is a block of up to BLOCK ids: the pieces of documents in it, a crc32 of its ids as
    little-endian unsigned 32-bit integers, and its range-coded bytes. A block starts from a fresh model and
    is decoded without any other. It is cut into lanes of equal length that are coded side by side, so that
    one step of array arithmetic codes an id of every lane, and all lanes teach the one model.

    Null texts are empty and give end_id alone; null ids come first; rows that repeat an id follow each
    other in an order set by their texts. Documents are dealt by ranges of (doc_id, digest of text, place
    in the input), so neither one id nor equal rows have to fit a part; a task holds a block and a batch of
    documents, however large its part is.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, int(total) // PART)
    d = d.withColumns({"mix_tie": F.xxhash64("text"), "mix_place": F.monotonically_increasing_id()})
    d = d.repartitionByRange(parts, "doc_id", "mix_tie", "mix_place").sortWithinPartitions("doc_id", "mix_tie", "mix_place")

    def encode(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        from panelwright.llm.tokens import encoder

        use = encoder(tokenizer)
        part, n_blocks, waiting = TaskContext.get().partitionId(), 0, _Pending()

        def block(n):
            ids, doc, null, seq, piece, length = waiting.take(n)
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            arrays = [
                pa.array([part], pa.int32()), pa.array([n_blocks], pa.int64()), one(pa.array(doc, mask=null)), one(pa.array(seq)), one(pa.array(piece)),
                one(pa.array(length.astype(np.int32))), pa.array([zlib.crc32(ids.astype("<u4").tobytes())], pa.int64()), pa.array([encode_block(ids)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in FILE.split(", ")])

        for batch in batches:
            null = np.asarray(batch.column(0).is_null())
            doc = np.asarray(pc.fill_null(batch.column(0), 0))
            for a, b in slices(text_buffers(batch.column(1))[1], 16 << 20):
                ids, length = use.flat(batch.column(1)[a:b])
                to = np.cumsum(length + 1)
                flat = np.full(int(to[-1]), end_id, np.int32)
                inner = np.ones(len(flat), bool)
                inner[to - 1] = False
                flat[inner] = ids
                waiting.add(flat, length + 1, doc[a:b], null[a:b])
                while len(waiting.ids) >= BLOCK:
                    yield block(BLOCK)
                    n_blocks += 1
        if len(waiting.ids):
            yield block(len(waiting.ids))

    d.select("doc_id", "text").mapInArrow(encode, FILE).write.option("compression", "none").parquet(folder)


def read_ids(df: DataFrame, folder: str) -> DataFrame:
    """Per document of the files under `folder`: doc_id, start (ids of all documents before it), n_tokens and ids_crc32. Blocks whose bytes or checksum fail raise ValueError."""
    spark = df.sparkSession
    blocks = spark.read.schema(FILE).parquet(folder)

    def decode(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                part, block, crc = (batch.column(c)[i].as_py() for c in ("part", "block", "crc32"))
                doc, seq, piece, length = (batch.column(c)[i].values for c in ("doc_id", "seq", "piece", "length"))
                to = np.cumsum(np.asarray(length), dtype=np.int64)
                n = int(to[-1])
                flat = decode_block(batch.column("coded")[i].as_py(), n).astype("<u4").tobytes()
                if zlib.crc32(flat) != crc:
                    raise ValueError(f"block {block} of part {part} does not match its checksum")
                view = memoryview(flat)
                own = [zlib.crc32(view[a:b]) for a, b in zip([0, *(4 * to[:-1]).tolist()], (4 * to).tolist(), strict=True)]
                k = len(to)
                arrays = [pa.array(np.full(k, part, np.int32)), pa.array(np.full(k, block)), seq, piece, doc, length, pa.array(own, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in PIECES.split(", ")])

    pieces = blocks.mapInArrow(decode, PIECES)
    docs = pieces.groupBy("part", "seq").agg(F.first("doc_id").alias("doc_id"), F.sum("length").cast("long").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("piece", "crc", "length"))).alias("pieces"))

    @F.pandas_udf("long")
    def joined(column):
        def one(p):
            crc = int(p[0]["crc"])
            for x in p[1:]:
                crc = crc32_joined(crc, int(x["crc"]), 4 * int(x["length"]))
            return crc

        return column.map(one)

    crc = joined(F.when(F.size("pieces") > 1, F.col("pieces")).otherwise(F.slice("pieces", 1, 1)))
    in_part = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    # One row a part, from the blocks' headers alone.
    sizes = blocks.groupBy("part").agg(F.sum(F.aggregate("length", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    docs = docs.withColumn("inside", F.coalesce(in_part, F.lit(0))).join(sizes, "part")
    return docs.select("doc_id", (F.col("before") + F.col("inside")).cast("long").alias("start"), "n_tokens", crc.alias("ids_crc32"))


def id_files(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 2) -> DataFrame:
    """write_ids() into `folder` (a new one in the shared folder), then read_ids(). An empty table gives no files' rows."""
    folder = folder or f"{shared_folder(docs.sparkSession)}/ids-{uuid.uuid4().hex}"
    write_ids(docs, tokenizer, folder, end_id)
    return read_ids(docs, folder)
