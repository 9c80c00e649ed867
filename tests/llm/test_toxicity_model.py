"""The toxicity model against its definition, where there is more to hold than any fixed table."""

from collections import Counter

import numpy as np
import pandas as pd

from panelwright.llm import toxicity


def test_every_sequence_keeps_its_own_ratio():
    r = np.random.default_rng(7)
    u = np.uint64
    middle = u((ord("b") << 8 | ord("a")) << 8)
    tail = lambda n, low: (r.integers(low, low + 80, n).astype(u) << u(32)) | (r.integers(low, low + 80, n).astype(u) << u(24)) | middle | r.integers(33, 113, n).astype(u)
    ordinary, toxic = np.unique(tail(150_000, 33)), np.unique(tail(300, 120))
    n = [r.integers(5, 50, len(ordinary)), r.integers(3, 6, len(toxic))]
    rows = [{"part": 0, "label": c, "keys": k.tobytes(), "n": m.astype(np.uint32).tobytes()} for c, (k, m) in enumerate(zip((ordinary, toxic), n, strict=True))]
    part = int(toxicity._part_of(ordinary[:1])[0])
    model = toxicity.Model(toxicity._part(pd.DataFrame(rows).assign(part=part)).to_dict("records"))

    count = [dict(zip(k.tolist(), m.tolist(), strict=True)) for k, m in zip((ordinary, toxic), n, strict=True)]
    def taken(c):
        ones, twos = (sum(v == k for v in c.values()) for k in (1, 2))
        return ones / (ones + 2 * twos) if ones and twos else 0.75

    levels = [(5, count)]
    for size in (4, 3):
        mask = (1 << 8 * size) - 1
        levels.append((size, [Counter(k & mask for k in c) for c in levels[-1][1]]))
    levels = [(size, c, [taken(x) for x in c]) for size, c in levels]
    both = Counter(k & 0xFFFFFF for k in {k & 0xFFFFFFFF for c in count for k in c})
    groups = []
    for _, found, discount in levels:
        total, own = [Counter(), Counter()], [Counter(), Counter()]
        for c in (0, 1):
            for k, m in found[c].items():
                total[c][k >> 8] += m
                own[c][k >> 8] += max(m - discount[c], 0)
        groups.append((total, own))

    def p(key, c, level=0):
        if level == 3:
            return both.get(key, 1) / both.total()
        size, found, discount = levels[level]
        total, own = groups[level]
        t = max(total[c][key >> 8], 1)
        below = p(key & ((1 << 8 * (size - 1)) - 1), c, level + 1) if level < 2 else p(key, c, 3)
        return max(found[c].get(key, 0) - discount[c], 0) / t + (1 - own[c][key >> 8] / t) * below

    # What was counted, mixtures with a counted context or a counted end alone, and what was never seen.
    ask = [*toxic.tolist(), *ordinary[::500].tolist(), *(toxic[:99] ^ u(1)).tolist(), *((toxic[:99] & u(0xFFFFFF)) | u(3 << 32 | 5 << 24)).tolist(), *(toxic[:99] | u(0x7F)).tolist(), *((ordinary[:99] & u(0xFFFFFF00)) | u(250)).tolist()]
    want = [np.log(p(k, 1)) - np.log(p(k, 0)) for k in ask]
    assert np.allclose(model.ratios(np.array(ask, u)), want, atol=1e-4)


def test_a_joined_model_scores_as_a_broadcast_one(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "CHUNK", 4000)
    monkeypatch.setattr(toxicity, "TOGETHER", 20_000)
    r = np.random.default_rng(9)
    word = lambda: "".join(r.choice(list("abcdefg")) for _ in range(r.integers(2, 7)))
    rows = [(i, " ".join([word() for _ in range(r.integers(1, 40))] + ["grubnik"] * (i % 3 == 0)), "kept") for i in range(600)] + [(700, None, "kept"), (701, "", "kept"), (None, "é" * 99, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, mix string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    plain = lambda t: sorted((str(x["doc_id"]), str(x["text"]), str(x["mix"]), x["score"], x["predicted"]) for x in t.collect())
    a, b = plain(toxicity.toxicity(d, labels)), plain(toxicity.toxicity(d, labels, most=0))
    assert [x[:3] + x[4:] for x in a] == [x[:3] + x[4:] for x in b]
    assert np.allclose([x[3] for x in a], [x[3] for x in b], atol=1e-5) and len({x[3] for x in a}) > 50
    assert toxicity.toxicity(d.limit(0), labels, most=0).count() == 0
