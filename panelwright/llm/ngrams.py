"""A trie of word triples as flat arrays: monotone sequences in Elias-Fano form and quantised probabilities.

A trie is one run of bytes that is used where it lies: over a buffer, or mapped from a file. Levels:

* contexts' last words (sorted), each with pointers to its successors and to the words before it;
* successors of a word, as numbers of the trie's own dictionary of predicted words;
* pairs (last word, word before);
* triples: the third word is not its number but its place among the successors of the pair's last word, which
  is a far smaller number. To find one the place is searched first, then the triple.

Groups of one level are laid end to end, group number times the group's universe plus the value, so that a whole
level is one rising sequence and a search needs no pointer.
"""

from __future__ import annotations

import functools
from pathlib import Path

import numpy as np

#: Bits of the word before the last of a context.
BEFORE_BITS = 21
#: Steps of a probability's code in one power of ten; 16 bits reach down to 1e-15.
STEPS = 4096
NOTHING = 65535


def quantise(p: np.ndarray) -> np.ndarray:
    """Codes of probabilities; 0 has its own."""
    with np.errstate(divide="ignore"):
        code = np.rint(-np.log10(p) * STEPS)
    return np.where(p > 0, np.clip(code, 0, NOTHING - 1), NOTHING).astype(np.uint16)


@functools.cache
def _decoded() -> np.ndarray:
    out = 10.0 ** (-np.arange(NOTHING + 1) / STEPS)
    out[NOTHING] = 0
    return out


def probability(code: np.ndarray) -> np.ndarray:
    return _decoded()[code]


class EliasFano:
    """A rising sequence of n 64-bit integers: the low bits of each packed, the high parts in unary."""

    def __init__(self, head: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.n, self.bits = int(head[0]), int(head[1])
        self.low, self.high, self.buckets = low, high, int(head[2])

    @staticmethod
    def arrays(values: np.ndarray) -> list[np.ndarray]:
        """(head, low, high) of a non-decreasing sequence."""
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = ((values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        packed = np.packbits(low.ravel(), bitorder="little")
        packed = np.r_[packed, np.zeros(16 - len(packed) % 8, np.uint8)].view(np.uint64)
        buckets = (top >> bits) + 1
        unary = np.zeros(n + buckets, np.uint8)
        unary[(values >> np.uint64(bits)).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(unary, bitorder="little")
        return [np.array([n, bits, buckets], np.int64), packed, high]

    @functools.cached_property
    def starts(self) -> np.ndarray:
        """How many values have a high part below h, for each h; read off the unary part on first use."""
        zero = np.flatnonzero(np.unpackbits(self.high, count=self.n + self.buckets, bitorder="little") == 0)
        return np.r_[0, zero - np.arange(len(zero))]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if self.bits == 0:
            return np.zeros(len(i), np.uint64)
        at = i * self.bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        value = self.low[word] >> shift
        value |= np.where(shift > 0, self.low[word + 1] << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
        return value & np.uint64((1 << self.bits) - 1)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of each x, -1 where it is absent: its bucket by the high part, then the successor of its low part there."""
        x = x.astype(np.uint64)
        h = (x >> np.uint64(self.bits)).astype(np.int64)
        inside = (h >= 0) & (h < self.buckets)
        h = np.where(inside, h, 0)
        a, end = self.starts[h], self.starts[h + 1]
        own = x & np.uint64((1 << self.bits) - 1)
        b = end.copy()
        open_ = np.flatnonzero(a < b)
        while len(open_):
            m = (a[open_] + b[open_]) >> 1
            less = self._low(m) < own[open_]
            a[open_[less]] = m[less] + 1
            b[open_[~less]] = m[~less]
            open_ = open_[a[open_] < b[open_]]
        hit = np.flatnonzero(inside & (a < end))
        out = np.full(len(x), -1, np.int64)
        same = self._low(a[hit]) == own[hit]
        out[hit[same]] = a[hit[same]]
        return out

    def values(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        high = np.searchsorted(self.starts, i, "right") - 1
        return ((high.astype(np.uint64) << np.uint64(self.bits)) | self._low(i)).astype(np.int64)


class Trie:
    """Interpolated absolute discounting over triples (before, last, word).

    P(w | before, last) = a(before, last, w) + b(before, last) * (a(last, w) + b(last) * P(w)), where a is the
    discounted share of a count and b the mass that the discounts leave; P(w) is the caller's.
    """

    _SEQUENCES = ("last", "successor_at", "pair_at", "word", "successor", "pair", "triple_at", "triple")
    _CODES = ("last_left", "successor_share", "pair_left", "triple_share")

    def __init__(self, buffer):
        """buffer holds what build() returned; nothing is copied."""
        data = np.frombuffer(buffer, np.uint8)
        count = int(data[:8].view(np.int64)[0])
        at = data[8 : 8 + 16 * count].view(np.int64).reshape(count, 2)
        parts = [data[a : a + n] for a, n in at.tolist()]
        for i, name in enumerate(self._SEQUENCES):
            head, low, high = parts[3 * i : 3 * i + 3]
            setattr(self, name, EliasFano(head.view(np.int64), low.view(np.uint64), high))
        for name, part in zip(self._CODES, parts[3 * len(self._SEQUENCES) :], strict=True):
            setattr(self, name, part.view(np.uint16))

    @classmethod
    def open(cls, path: str | Path) -> Trie:
        """The trie of a file, mapped into memory."""
        return cls(np.memmap(path, np.uint8, "r"))

    @staticmethod
    def build(last: np.ndarray, before: np.ndarray, word: np.ndarray, count: np.ndarray, discount: float) -> bytes:
        """Bytes of the trie of distinct triples with counts, ordered by (last, before, word). before has 21 bits, last 42."""
        lasts, g = np.unique(last, return_inverse=True)
        words = np.unique(word)
        t = np.searchsorted(words, word)
        size = len(words)
        pair = (g << BEFORE_BITS) | before.astype(np.int64)
        pairs, p = np.unique(pair, return_inverse=True)
        of = pairs >> BEFORE_BITS
        successors, s = np.unique(g * size + t, return_inverse=True)
        owner = successors // max(size, 1)
        n_successors, n_pairs = np.bincount(owner, minlength=len(lasts)), np.bincount(of, minlength=len(lasts))
        successor_at, pair_at = np.r_[0, np.cumsum(n_successors)], np.r_[0, np.cumsum(n_pairs)]
        triple_at = np.r_[0, np.cumsum(n_successors * n_pairs)]
        triple = triple_at[g] + (p - pair_at[g]) * n_successors[g] + s - successor_at[g]
        by_successor = np.bincount(s, count, len(successors))
        by_pair, n_by_pair = np.bincount(p, count, len(pairs)), np.bincount(p, minlength=len(pairs))
        by_last = np.bincount(g, count, len(lasts))
        codes = [quantise(discount * n_successors / by_last), quantise((by_successor - discount) / by_last[owner]), quantise(discount * n_by_pair / by_pair), quantise((count - discount) / by_pair[p])]
        parts = [a for x in (lasts, successor_at, pair_at, words, successors, pairs, triple_at, triple) for a in EliasFano.arrays(x)] + codes
        at, place = [], 8 + 16 * len(parts)
        for x in parts:
            at.append((place, x.nbytes))
            place += -(-x.nbytes // 8) * 8
        out = np.zeros(place, np.uint8)
        out[:8] = np.array([len(parts)], np.int64).view(np.uint8)
        out[8 : 8 + 16 * len(parts)] = np.array(at, np.int64).ravel().view(np.uint8)
        for (a, n), x in zip(at, parts, strict=True):
            out[a : a + n] = np.ascontiguousarray(x).view(np.uint8)
        return out.tobytes()

    def query(self, last: np.ndarray, before: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(A, B) with P(word | before, last) = A + B * P(word)."""
        share, left, more, own = self.parts(last, before, word)
        return share * more + own, left * more

    def parts(self, last: np.ndarray, before: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(a(last, word), b(last), b(before, last), a(before, last, word)); 0, 1, 1, 0 where the context was not learned."""
        share, left, more, own = np.zeros(len(last)), np.ones(len(last)), np.ones(len(last)), np.zeros(len(last))
        lasts, which = np.unique(last, return_inverse=True)
        g = self.last.find(lasts)[which]
        known = np.flatnonzero(g >= 0)
        g = g[known]
        places, which = np.unique(g, return_inverse=True)
        successor_at, pair_at, triple_at, after = (x[which] for x in (self.successor_at.values(places), self.pair_at.values(places), self.triple_at.values(places), self.successor_at.values(places + 1)))
        words, which = np.unique(word[known], return_inverse=True)
        t = self.word.find(words)[which]
        s = np.where(t >= 0, self.successor.find(g * self.word.n + np.maximum(t, 0)), -1)
        share[known] = np.where(s >= 0, probability(self.successor_share[np.maximum(s, 0)]) if self.successor.n else 0.0, 0.0)
        left[known] = probability(self.last_left[g])
        p = self.pair.find((g << BEFORE_BITS) | before[known].astype(np.int64))
        both = np.flatnonzero(p >= 0)
        more[known[both]] = probability(self.pair_left[p[both]])
        seen = both[s[both] >= 0]
        i = self.triple.find(triple_at[seen] + (p[seen] - pair_at[seen]) * (after[seen] - successor_at[seen]) + s[seen] - successor_at[seen])
        hit = i >= 0
        own[known[seen[hit]]] = probability(self.triple_share[i[hit]])
        return share, left, more, own
