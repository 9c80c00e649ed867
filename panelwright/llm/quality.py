"""Text quality by a byte-level convolutional network in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import masked, slices, text_buffers
from panelwright.llm.labels import training_rows

#: Bytes in a step, steps in half a chunk, sizes of the byte vectors and of the filter bank. A filter sees two steps, a chunk two halves; chunks overlap by half.
STEP, HALF, EMBED, FILTERS = 4, 64, 8, 32
#: Training reads at most so many labelled documents of each class, chosen by a hash of the id.
SAMPLE = 1500


class Network:
    """Byte vectors, filters over 8 bytes every 4, the maximum over chunks of 512 bytes; the mean and the maximum over all chunks give one probability."""

    def __init__(self, seed: int = 0) -> None:
        r = np.random.default_rng(seed)
        f = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"e": (r.standard_normal((256, EMBED)) * 0.5).astype(np.float32), "wa": f(STEP * EMBED, FILTERS), "wb": f(STEP * EMBED, FILTERS), "b": np.zeros(FILTERS, np.float32), "u": np.zeros(2 * FILTERS, np.float32), "c": np.zeros(1, np.float32)}
        self.p["e"][0] = 0  # padding

    @staticmethod
    def layout(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents padded with zeros to whole halves (one at least), and the first half of each."""
        n = np.diff(offsets)
        halves = np.maximum(1, -(-n // (STEP * HALF)))
        first = np.r_[0, np.cumsum(halves)]
        x = np.zeros(first[-1] * STEP * HALF, np.uint8)
        doc = np.repeat(np.arange(len(n)), n)
        x[np.arange(len(data)) - offsets[doc] + first[doc] * STEP * HALF] = data
        return x, first

    def forward(self, x: np.ndarray, first: np.ndarray, keep: bool = False):
        p = self.p
        v = p["e"][x].reshape(-1, STEP * EMBED)
        z = v @ p["wa"] + p["b"]
        after = v @ p["wb"]
        z[:-1] += after[1:]
        ends = first[1:] * HALF - 1
        inner = ends[ends < len(z) - 1]
        z[inner] -= after[inner + 1]  # the step after a document's last is not its own
        blocks = z.reshape(-1, HALF, FILTERS)
        peak = blocks.max(1)
        m = np.maximum(peak, 0)
        chunk = m.copy()
        chunk[:-1] = np.maximum(m[:-1], m[1:])
        last = first[1:] - 1
        chunk[last] = m[last]
        start = first[:-1]
        mean = np.add.reduceat(chunk, start) / np.diff(first)[:, None]
        top = np.maximum.reduceat(chunk, start)
        feature = np.hstack([mean, top])
        prob = 1 / (1 + np.exp(-np.clip(feature @ p["u"] + p["c"], -30, 30)))
        return (prob, feature, v, blocks, peak, m, chunk, top) if keep else prob

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict:
        prob, feature, v, blocks, peak, m, chunk, top = self.forward(x, first, True)
        p, n = self.p, len(y)
        d = ((prob - y) / n).astype(np.float32)
        g = {"u": feature.T @ d, "c": np.array([d.sum()], np.float32)}
        df = d[:, None] * p["u"]
        doc = np.repeat(np.arange(n), np.diff(first))
        tie = chunk == top[doc]  # neighbours share a half, so that one peak may be the top of both
        dc = (df[:, :FILTERS] / np.diff(first)[:, None])[doc] + df[:, FILTERS:][doc] * tie / np.add.reduceat(tie, first[:-1], dtype=np.float32)[doc]
        dm = np.zeros_like(m)
        last = first[1:] - 1
        following = np.zeros(len(m), bool)
        following[:-1] = True
        following[last] = False
        take = following[:, None] & (np.roll(m, -1, 0) > m)
        dm += np.where(take, 0, dc)
        dm[1:] += np.where(take, dc, 0)[:-1]
        dm *= peak > 0
        at = blocks.argmax(1)
        dz = np.zeros_like(blocks)
        i, j = np.meshgrid(np.arange(len(m)), np.arange(FILTERS), indexing="ij")
        dz[i, at, j] = dm
        dz = dz.reshape(-1, FILTERS)
        back = np.zeros_like(dz)
        back[1:] = dz[:-1]
        starts = first[:-1] * HALF
        back[starts] = 0
        g |= {"wa": v.T @ dz, "wb": v.T @ back, "b": dz.sum(0)}
        dv = (dz @ p["wa"].T + back @ p["wb"].T).reshape(-1, EMBED)
        g["e"] = np.stack([np.bincount(x, dv[:, k], 256) for k in range(EMBED)], 1).astype(np.float32)
        g["e"][0] = 0
        return g

    def train(self, texts: list[bytes], y: np.ndarray, passes: int = 5, batch: int = 16, rate: float = 0.01, seed: int = 0) -> None:
        """Adam over whole documents. One that is longer than 64 KB is split into pieces of 64 KB with its label for training only."""
        pieces = [(t[i : i + 65536], v) for t, v in zip(texts, y, strict=True) for i in range(0, max(1, len(t)), 65536)]
        r = np.random.default_rng(seed)
        one = {k: np.zeros_like(v) for k, v in self.p.items()}
        two = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        total = max(1, passes * -(-len(pieces) // batch))
        for _ in range(passes):
            order = r.permutation(len(pieces))
            for at in range(0, len(order), batch):
                some = [pieces[i] for i in order[at : at + batch]]
                x, first = self.layout(np.frombuffer(b"".join(s[0] for s in some), np.uint8), np.r_[0, np.cumsum([len(s[0]) for s in some])])
                t += 1
                for k, g in self.gradients(x, first, np.array([s[1] for s in some], np.float32)).items():
                    one[k] += 0.1 * (g - one[k])
                    two[k] += 0.01 * (g * g - two[k])
                    self.p[k] -= rate * (1 - 0.9 * t / total) * (one[k] / (1 - 0.9**t)) / (np.sqrt(two[k] / (1 - 0.99**t)) + 1e-8)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.zeros(len(offsets) - 1)
        for a, b in slices(offsets, 1 << 19):
            out[a:b] = self.forward(*self.layout(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
        return out


def fit(train: DataFrame, sample: int = SAMPLE, passes: int = 5) -> Network | None:
    """Train on `sample` documents of each class at most, in one task; None without both classes.

    The result leans on equal classes; its offset is then set back to the shares of all labelled rows.
    """
    ids = train.groupBy("label").agg(F.count("*").alias("n")).collect()
    n = {r["label"]: r["n"] for r in ids if r["label"] in (0, 1)}
    if len(n) < 2:
        return None
    chosen = [train.where(F.col("label") == c).select("doc_id", "label").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    few = F.broadcast(chosen[0].unionByName(chosen[1]).select("doc_id"))  # 2 * sample rows at most
    rows = train.join(few, "doc_id", "left_semi").select("text", "label").repartition(1)

    def learn(batches):
        import pickle

        import pyarrow as pa

        texts, y = [], []
        for batch in batches:
            texts += [(t or "").encode() for t in batch.column(0).to_pylist()]
            y += batch.column(1).to_pylist()
        order = sorted(range(len(y)), key=lambda i: (texts[i], y[i]))
        net = Network()
        net.train([texts[i] for i in order], np.array(y, np.float32)[order], passes)
        net.p["c"] += np.float32(np.log(n[1] / n[0]) - np.log(max(1, sum(y)) / max(1, len(y) - sum(y))))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net.p)], pa.binary())], ["weights"])

    import pickle

    net = Network()
    net.p = pickle.loads(rows.mapInArrow(learn, "weights binary").first()["weights"])
    return net


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs with score (double, 0 to 1: probability of good quality) and predicted (1 if score >= threshold).

    Learns from at most 1,500 documents of each class of labels.quality whose id's crc32 mod 5 is not 0
    (the class shares come from all of those); every text is scored whole. A null text is an empty one and
    has the score of a chunk of padding. Without labels of both classes every score is 0. Repeated rows
    are scored alike; an empty table gives an empty table. Extra columns pass through, whatever their
    names; an output replaces an input column of its name.
    """
    net = fit(training_rows(docs, labels, "quality"))
    hidden, shown = masked(docs, "score", "predicted")
    if net is None:
        return docs.select(*hidden).select(*shown, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    held = docs.sparkSession.sparkContext.broadcast(net)

    def score(batches):
        import pyarrow as pa

        for batch in batches:
            at = batch.schema.get_field_index("mix_text")
            keep = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], pa.array(held.value.scores(*text_buffers(batch.column(at))), pa.float64())], [*[batch.schema.names[i] for i in keep], "score"])

    d = docs.select(*hidden, F.col("text").alias("mix_text"))
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in d.schema if f.name != "mix_text"]
    scored = d.mapInArrow(score, ", ".join([*fields, "score double"]))
    return scored.select(*shown, "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
