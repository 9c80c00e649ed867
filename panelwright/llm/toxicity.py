"""Toxicity by class-conditional Kneser-Ney models over bytes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import cut, discard, masked, mix64, slices, text_buffers
from panelwright.llm.labels import training_rows
from panelwright.llm.suffix import pack_rows, split

#: A byte is predicted from the four before it. The model is a table of 64 parts that holds every counted sequence and context with its key, and so grows with what was counted.
ORDER, PARTS = 5, 64
#: A model of up to so many entries (12 bytes each) is broadcast; a larger one stays in its table, to which the documents' distinct sequences are joined.
BROADCAST_ENTRIES = 2_000_000
#: For that join: bytes of text in a chunk, and of all chunks whose sequences meet a part in one task.
CHUNK, TOGETHER = 8 << 20, 4 << 30
#: What an entry of the model is, above the 40 bits of the longest sequence.
WHOLE, CONTEXT4, BYTES4, CONTEXT3, BYTES3, CONTEXT2 = (np.uint64(i << 40) for i in range(6))
#: What is taken off a class's counts where there are too few counts of 1 and 2 to estimate it; what is freed goes to the next shorter sequence.
DISCOUNT = 0.75
#: A document is judged by the highest mean over windows of so many bytes, half a window apart.
WINDOW = 32


def _grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte the five bytes that end there, as an integer: upper case folded, white space as a space, spaces before a document's start."""
    fold = np.arange(256, dtype=np.uint64)
    fold[65:91] += 32
    fold[[*range(9, 14)]] = 32
    x = fold[data]
    starts = offsets[:-1][np.diff(offsets) > 0]
    key = x.copy()
    for back in range(1, ORDER):
        y = np.full(len(x), 32, np.uint64)
        y[back:] = x[:-back] if back < len(x) else y[back:]
        for i in range(back):
            y[starts[starts + i < len(x)] + i] = 32
        key |= y << np.uint64(8 * back)
    # A document shorter than four bytes lets the next one's first bytes see it; those were reset above.
    return key


def _part_of(key: np.ndarray) -> np.ndarray:
    """By the two bytes before the last: all that a context and its shorter ones need is in one part."""
    return (mix64((key >> np.uint64(8)) & np.uint64(0xFFFF)) >> np.uint64(58)).astype(np.int64)


def _counts(batches):
    """Per task, part and class: the distinct sequences and their counts."""
    import pyarrow as pa

    kept: list[list[np.ndarray]] = [[], []]
    found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * 2

    def settle(c: int) -> None:
        if kept[c]:
            keys, at = np.unique(np.concatenate([found[c][0], *[k for k, _ in kept[c]]]), return_inverse=True)
            found[c] = keys, np.bincount(at, np.concatenate([found[c][1], *[n for _, n in kept[c]]]), len(keys)).astype(np.int64)
            kept[c].clear()

    for batch in batches:
        data, at = text_buffers(batch.column(0))
        label = np.asarray(batch.column(1)).astype(int)
        for a, b in slices(at, 1 << 20):
            key = _grams(data[at[a] : at[b]], at[a : b + 1] - at[a])
            of = np.repeat(label[a:b], np.diff(at[a : b + 1]))
            for c in (0, 1):
                kept[c].append(np.unique(key[of == c], return_counts=True))
                if sum(len(k) for k, _ in kept[c]) > 2_000_000:
                    settle(c)
    for c in (0, 1):
        settle(c)
        keys, n = found[c]
        part = _part_of(keys)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(PARTS + 1))
        rows = [(p, c, keys[order[i:j]].tobytes(), n[order[i:j]].astype(np.uint32).tobytes()) for p, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.binary())], ["part", "label", "keys", "n"])


def discount(n: np.ndarray) -> float:
    """The usual estimate from the counts of 1 and of 2: ones / (ones + 2 twos), of the counts above 0."""
    ones, twos = int((n == 1).sum()), int((n == 2).sum())
    return ones / (ones + 2 * twos) if ones and twos else DISCOUNT


def _part(pdf):
    """The log ratios, toxic over ordinary, of all of one part's sequences, and of what its contexts free.

    p(byte | four bytes) = max(count - discount, 0) / total of the context + freed mass * p(byte | three
    bytes), which counts in how many different contexts of its class the shorter sequence occurs; so down to
    two bytes, whose backoff is counted in both classes together and shared by them.
    """
    import pandas as pd

    keys = [np.frombuffer(b"".join(pdf.loc[pdf.label == c, "keys"]), np.uint64) for c in (0, 1)]
    n = [np.frombuffer(b"".join(pdf.loc[pdf.label == c, "n"]), np.uint32) for c in (0, 1)]
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    k = len(keys[0])
    count = np.stack([np.bincount(at[:k], n[0], len(key)), np.bincount(at[k:], n[1], len(key))])
    context, to = np.unique(key >> np.uint64(8), return_inverse=True)
    total = np.stack([np.bincount(to, count[c], len(context)) for c in (0, 1)])
    short, s4 = np.unique(key & np.uint64(0xFFFFFFFF), return_inverse=True)
    shorter, s3 = np.unique(short & np.uint64(0xFFFFFF), return_inverse=True)
    follows4 = np.stack([np.bincount(s4, count[c] > 0, len(short)) for c in (0, 1)])
    follows3 = np.stack([np.bincount(s3, follows4[c] > 0, len(shorter)) for c in (0, 1)])

    def level(n, of, below):
        """Discounted shares of n within the contexts `of`, and below for what was freed."""
        _, group = np.unique(of, return_inverse=True)
        total = np.stack([np.bincount(group, n[c]) for c in (0, 1)])
        own = np.maximum(n - np.array([discount(n[c]) for c in (0, 1)])[:, None], 0)
        freed = 1 - np.stack([np.bincount(group, own[c]) for c in (0, 1)]) / np.maximum(total, 1)
        return own / np.maximum(total, 1)[:, group] + freed[:, group] * below, freed

    both = np.bincount(s3, minlength=len(shorter)).astype(float)
    _, pair = np.unique(shorter >> np.uint64(8), return_inverse=True)
    p3, freed2 = level(follows3, shorter >> np.uint64(8), (both / np.bincount(pair, both)[pair])[None, :])
    p4, freed3 = level(follows4, short >> np.uint64(8), p3[:, s3])
    p, freed = level(count, key >> np.uint64(8), p4[:, s4])
    of = {WHOLE: (key, p), CONTEXT4: (context, freed), BYTES4: (short, p4), CONTEXT3: (np.unique(short >> np.uint64(8)), freed3), BYTES3: (shorter, p3), CONTEXT2: (np.unique(shorter >> np.uint64(8)), freed2)}
    keys = np.concatenate([kind | k for kind, (k, _) in of.items()])
    values = np.concatenate([np.log(x[1]) - np.log(x[0]) for _, x in of.values()]).astype(np.float32)
    seen = [int(x.sum()) for x in total]
    return pd.DataFrame([{"part": int(pdf.part.iloc[0]), "keys": keys.tobytes(), "values": values.tobytes(), "entries": len(keys), "ordinary": seen[0], "toxic": seen[1]}])


class Model:
    """The log ratio, toxic over ordinary, of every byte after the four before it.

    Entries are found by their whole key. A sequence that was not counted has what its context frees and
    the ratio of the next shorter sequence; a context that was not counted frees everything in both classes.
    """

    def __init__(self, parts: list) -> None:
        keys = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(r["keys"], np.uint64) for r in parts]])
        values = np.concatenate([np.zeros(0, np.float32), *[np.frombuffer(r["values"], np.float32) for r in parts]])
        # mix64 maps no two keys to one number, so those numbers stand for the keys.
        h = mix64(keys)
        order = np.argsort(h)
        self.h, self.values = np.r_[h[order], np.uint64(2**64 - 1)], np.r_[values[order], np.float32(np.nan)]
        bits = len(keys).bit_length() + 1
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.h, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The entries' values, NaN for keys without one."""
        h = mix64(key)
        i = self.first[(h >> self.shift).astype(np.int64)]
        more = np.flatnonzero(self.h[i] < h)
        while len(more):
            i[more] += 1
            more = more[self.h[i[more]] < h[more]]
        return np.where(self.h[i] == h, self.values[i], np.float32(np.nan))

    def ratios(self, key: np.ndarray) -> np.ndarray:
        out = self.find(WHOLE | key)
        rest = np.flatnonzero(np.isnan(out))
        out[rest] = 0
        for context, shorter, size in ((CONTEXT4, BYTES4, 4), (CONTEXT3, BYTES3, 3), (CONTEXT2, None, 2)):
            k = key[rest] & np.uint64((1 << 8 * (size + 1)) - 1)
            out[rest] += np.nan_to_num(self.find(context | (k >> np.uint64(8))))
            if shorter is not None:
                r = self.find(shorter | (k & np.uint64((1 << 8 * size) - 1)))
                out[rest] += np.nan_to_num(r)
                rest = rest[np.isnan(r)]
        return out

    def windows(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each document the mean ratio of its whole text and the highest mean over its windows; shorter documents are one window, empty ones have 0."""
        out = np.zeros((len(offsets) - 1, 2))
        for a, b in slices(offsets, 1 << 20):
            at = offsets[a : b + 1] - offsets[a]
            n = np.diff(at)
            total = np.r_[0, np.cumsum(self.ratios(_grams(data[offsets[a] : offsets[b]], at)), dtype=np.float64)]
            pieces = np.maximum(1, -(-(n - WINDOW) // (WINDOW // 2)) + 1)
            doc = np.repeat(np.arange(b - a), pieces)
            i = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = at[doc] + np.maximum(0, np.minimum(i * (WINDOW // 2), n[doc] - WINDOW))
            stop = np.minimum(start + WINDOW, at[doc + 1])
            mean = (total[stop] - total[start]) / np.maximum(stop - start, 1)
            out[a:b, 0] = (total[at[1:]] - total[at[:-1]]) / np.maximum(n, 1)
            out[a:b, 1] = np.maximum.reduceat(mean, np.cumsum(pieces) - pieces)
        return out


def fit(train: DataFrame, most: int = BROADCAST_ENTRIES) -> Model | DataFrame | None:
    """Count (text, label) rows on the executors. The model's table, or with up to `most` entries the model itself; None without both classes."""
    counts = train.select("text", "label").mapInArrow(_counts, "part int, label int, keys binary, n binary")
    parts = cut(counts.groupBy("part").applyInPandas(_part, "part int, keys binary, values binary, entries long, ordinary long, toxic long"))
    size, *seen = parts.agg(F.sum("entries"), F.sum("ordinary"), F.sum("toxic")).first()
    if all(seen) and size > most:
        return parts.select("part", "keys", "values")
    model = Model(parts.select("keys", "values").collect()) if all(seen) else None
    discard(parts)
    return model


def ratios(docs: DataFrame, model: Model | DataFrame, *keep: str) -> DataFrame:
    """docs' columns `keep`, mix_ratio (the log ratio a byte of the whole text) and mix_worst (of its worst window)."""
    d = docs.select(*keep, F.col("text").alias("mix_text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema if f.name != "mix_text"]
    schema = ", ".join([*fields, "mix_ratio double", "mix_worst double"])
    if isinstance(model, DataFrame):
        return _joined(d, model, schema)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            yield _scored(batch, held.value)

    return d.mapInArrow(score, schema)


def _scored(batch, model: Model):
    """A record batch with mix_ratio and mix_worst in the place of mix_text."""
    import pyarrow as pa

    at = batch.schema.get_field_index("mix_text")
    r = model.windows(*text_buffers(batch.column(at)))
    return pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(batch.num_columns) if i != at], pa.array(r[:, 0]), pa.array(r[:, 1])], [*[n for n in batch.schema.names if n != "mix_text"], "mix_ratio", "mix_worst"])


def _joined(d: DataFrame, model: DataFrame, schema: str) -> DataFrame:
    """ratios() where the model is too large to hold: chunks of documents ask its parts for their distinct sequences."""
    chunks = cut(pack_rows(d, CHUNK))
    salts = 1 + int(chunks.agg(F.sum("bytes")).first()[0] or 0) // TOGETHER

    def asked(batches):
        import pyarrow as pa

        for batch in batches:
            for chunk, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data, at = text_buffers(pa.ipc.open_stream(rows).read_all()["mix_text"])
                found = [np.unique(_grams(data[at[a] : at[b]], at[a : b + 1] - at[a])) for a, b in slices(at, 1 << 20)]
                key = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]))
                out = [(p, chunk, key[i].tobytes()) for p, i in split(_part_of(key), PARTS)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], pa.binary())], ["part", "chunk", "keys"])

    def answered(left, right):
        import pyarrow as pa

        m = Model(right.select(["keys", "values"]).to_pylist())
        values = [m.ratios(np.frombuffer(k, np.uint64)).tobytes() for k in left["keys"].to_pylist()]
        return pa.table({"chunk": left["chunk"].cast(pa.string()), "keys": left["keys"].cast(pa.binary()), "values": pa.array(values, pa.binary())})

    def score(left, right):
        import pyarrow as pa

        # What the parts answered is whole: nothing is left to a shorter sequence.
        m = Model(right.select(["keys", "values"]).to_pylist())
        done = [_scored(b, m) for rows in left["rows"].to_pylist() for b in pa.ipc.open_stream(rows).read_all().to_batches()]
        return pa.Table.from_batches(done)

    salt = (F.crc32(F.col("chunk").cast("binary")) % salts).cast("int")
    keys = chunks.select("chunk", "rows").mapInArrow(asked, "part int, chunk string, keys binary").withColumn("salt", salt)
    parts = model.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    answers = keys.groupBy("part", "salt").cogroup(parts.groupBy("part", "salt")).applyInArrow(answered, "chunk string, keys binary, values binary")
    return chunks.select("chunk", "rows").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, schema)


def calibration(scored: DataFrame) -> tuple[float, float, float]:
    """(intercept, slopes) of a logistic curve of the label on mix_ratio and mix_worst, from counts in cells of 1/64 by 1/16 within 4 and 10."""
    cell = lambda c, unit, most: F.greatest(F.lit(-most), F.least(F.lit(most), F.round(F.col(c) * unit))).cast("int")
    bins = scored.groupBy(cell("mix_ratio", 64, 256).alias("r"), cell("mix_worst", 16, 160).alias("w"), "label").agg(F.count("*").alias("n")).collect()
    x = np.array([(r["r"] / 64, r["w"] / 16) for r in bins]).reshape(-1, 2)
    y = np.array([float(r["label"]) for r in bins])
    n = np.array([float(r["n"]) for r in bins])
    if len(set(y)) < 2:
        return (4.0 if y.sum() else -4.0, 0.0, 1.0) if len(y) else (0.0, 0.0, 1.0)
    mu = np.average(x, 0, weights=n)
    sd = np.maximum(1e-6, np.sqrt(np.average((x - mu) ** 2, 0, weights=n)))
    z = np.c_[np.ones(len(x)), (x - mu) / sd]
    beta, shrink = np.zeros(3), np.diag([0.0, 0.5, 0.5])
    for _ in range(50):  # Newton, with a little shrinkage so that separable data stay finite
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        w = n * p * (1 - p) + 1e-9
        step = np.linalg.solve((z * w[:, None]).T @ z + shrink, z.T @ (n * (y - p)) - shrink @ beta)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    slope = beta[1:] / sd
    return float(beta[0] - slope @ mu), float(slope[0]), float(slope[1])


def toxicity(docs: DataFrame, labels: DataFrame, most: int = BROADCAST_ENTRIES) -> DataFrame:
    """docs with score (double, 0 to 1: probability that the text is toxic) and predicted (int).

    The models are compared on the log-likelihood a byte, of the whole text and, so that a long text is not
    excused by its length, of the worst of windows of 32 bytes that cover it; both follow as ratio and worst,
    and a logistic curve of the two gives the score. Counts cover every labelled document whose id's crc32 mod 5 is 1, 2 or 3 and so grow with the input;
    those of remainder 4 only set the curve from the log ratio to a probability; remainder 0 is never
    read for labels. Texts are scored whole. Null and empty texts have ratio 0.
    Without labels of both classes every score is 0. Repeated rows are scored alike; an empty table gives
    an empty table. Extra columns pass through, whatever their names; an output replaces an input column of
    its name. A model of over `most` entries is joined, not broadcast,
    with the same scores.
    """
    train = training_rows(docs, labels, "toxic")
    model = fit(train.where("fold < 4"), most)
    hidden, shown = masked(docs, "ratio", "worst", "score", "predicted")
    if model is None:
        return docs.select(*hidden).select(*shown, F.lit(0.0).alias("ratio"), F.lit(0.0).alias("worst"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    a, whole, worst = calibration(ratios(train.where("fold = 4"), model, "label"))
    d = ratios(docs.select(*hidden, "text"), model, *[f"mix_c{i}" for i in range(len(hidden))])
    score = 1 / (1 + F.exp(-(F.lit(a) + F.lit(whole) * F.col("mix_ratio") + F.lit(worst) * F.col("mix_worst"))))
    return d.select(*shown, F.col("mix_ratio").alias("ratio"), F.col("mix_worst").alias("worst"), score.alias("score"), F.when(score >= 0.5, 1).otherwise(0).alias("predicted"))
