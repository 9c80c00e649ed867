"""The quality network against a plain convolution, and its gradients against differences."""

import numpy as np

from panelwright.llm.quality import EMBED, FILTERS, HALF, STEP, Network


def network():
    net = Network(3)
    r = np.random.default_rng(4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["u"], net.p["b"], net.p["c"] = r.standard_normal(2 * FILTERS) * 0.3, r.standard_normal(FILTERS) * 0.1, np.array([0.2])
    return net


def texts():
    r = np.random.default_rng(5)
    return [b"", b"abc", bytes(r.integers(32, 127, STEP * HALF).tolist()), bytes(r.integers(32, 127, 700).tolist()), "é and ü".encode() * 90, bytes(r.integers(32, 127, 5000).tolist())]


def plain(p, text: bytes) -> float:
    """One document, one filter position at a time."""
    halves = max(1, -(-len(text) // (STEP * HALF)))
    x = text + bytes(halves * STEP * HALF - len(text))
    steps = [p["e"][list(x[i : i + STEP])].reshape(STEP * EMBED) for i in range(0, len(x), STEP)]
    z = [s @ p["wa"] + (steps[i + 1] @ p["wb"] if i + 1 < len(steps) else 0) + p["b"] for i, s in enumerate(steps)]
    peak = [np.maximum(0, np.max(z[h * HALF : (h + 1) * HALF], axis=0)) for h in range(halves)]
    chunks = [np.maximum(peak[h], peak[h + 1]) if h + 1 < halves else peak[h] for h in range(halves)]
    feature = np.r_[np.mean(chunks, axis=0), np.max(chunks, axis=0)]
    return 1 / (1 + np.exp(-(feature @ p["u"] + p["c"][0])))


def laid(some):
    return Network.layout(np.frombuffer(b"".join(some), np.uint8), np.r_[0, np.cumsum([len(t) for t in some])])


def test_forward_against_a_plain_convolution():
    net, some = network(), texts()
    assert np.allclose(net.forward(*laid(some)), [plain(net.p, t) for t in some], atol=1e-9)
    data, at = np.frombuffer(b"".join(some), np.uint8), np.r_[0, np.cumsum([len(t) for t in some])]
    assert np.allclose(net.scores(data, at), [plain(net.p, t) for t in some], atol=1e-9)


def test_gradients_against_differences():
    net, some = network(), texts()
    x, first = laid(some)
    y = np.array([0, 1, 1, 0, 1, 0], np.float64)

    def loss():
        p = net.forward(x, first)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    r, g = np.random.default_rng(6), net.gradients(x, first, y)
    for name, value in net.p.items():
        places = [tuple(r.integers(0, s) for s in value.shape) for _ in range(12)]
        if name == "e":  # bytes that occur; 0 is padding and stays
            places = [(int(b), int(r.integers(0, EMBED))) for b in r.choice(np.frombuffer(some[5], np.uint8), 12)]
        for at in places:
            kept, step = value[at], 1e-5
            value[at] = kept + step
            up = loss()
            value[at] = kept - step
            down = loss()
            value[at] = kept
            assert abs((up - down) / (2 * step) - g[name][at]) < 2e-4 + 0.02 * abs(g[name][at]), (name, at)
