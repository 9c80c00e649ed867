"""Log probabilities of texts under a word model learned from the same table's training rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import column, cut, discard, mix64, slices, text_buffers
from panelwright.llm.ngrams import BEFORE_BITS, Trie, probability, quantise
from panelwright.llm.words import hashed

#: Words of more than this share of all tokens are known to every task: at most 1,048,576 words, 16 bytes each.
KNOWN = 1 / (1 << 20)
#: As contexts, words of at most this share of all tokens are so many classes, by hash; with 0 each is a context of its own.
SHARE, CLASSES = 0.0, 4096
#: Tokens after a word beyond which its contexts back up to their own part alone; never, unless a caller wants it.
SPLIT = 1 << 62
#: Tokens that one group learns from and scores, on average, and of one last word at most (beyond, several groups work on it).
TASK, SPREAD = 500_000, 400_000
#: How many of these groups' pairs one group adds up.
_ADDED = 16
#: Bytes of text whose tokens a task deals out at a time.
CHUNK = 8 << 20
#: What each discount takes off a count.
DISCOUNT = 0.8
_END, _SEED = np.uint64(0x2545F4914F6CDD1D), np.uint64(0xD1342543DE82EF95)
_RARE = np.uint64(1 << 63)
_START, _NONE = (1 << BEFORE_BITS) - 1, (1 << BEFORE_BITS) - 2
_PLACES = 1 << BEFORE_BITS
_SPREAD_SEED = np.uint64(0x9FB21C651E98DF25)


def _lower() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


def _tokens(batch, text: int):
    """For each chunk of a batch: (first row, token hashes with an end after each document, document of each token, tokens of each document)."""
    data, off = text_buffers(batch.column(text))
    lower = _lower()
    for a, b in slices(off, CHUNK):
        words = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for c, d in slices(off[a : b + 1], 1 << 20):
            h, doc = hashed(lower[data[off[a + c] : off[a + d]]], off[a + c : a + d + 1] - off[a + c], spaces=True)
            words[0].append(h)
            words[1].append(doc + c)
        h, doc = (np.concatenate(w) for w in words)
        n = np.bincount(doc, minlength=b - a)
        token = np.full(len(h) + b - a, _END)
        token[np.arange(len(h)) + doc] = h
        yield a, token, np.repeat(np.arange(b - a, dtype=np.int32), n + 1), n + 1


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed run of bytes, equal bytes of the elements side by side."""
    import pyarrow as pa

    head = np.array([x for a in arrays for x in (len(a), ord(a.dtype.char))], np.uint32)
    raw = head.tobytes() + b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    return len(raw).to_bytes(4, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack(blob: bytes, count: int) -> list[np.ndarray]:
    import pyarrow as pa

    raw = np.frombuffer(pa.decompress(memoryview(blob)[4:], int.from_bytes(blob[:4], "little"), "zstd"), np.uint8)
    head, at, out = raw[: 8 * count].view(np.uint32).reshape(count, 2), 8 * count, []
    for n, char in head.tolist():
        kind = np.dtype(chr(char))
        out.append(np.ascontiguousarray(raw[at : at + n * kind.itemsize].reshape(kind.itemsize, n).T).view(kind).ravel())
        at += n * kind.itemsize
    return out


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint16 if len(x) == 0 or int(x.max()) < 1 << 16 else np.uint32)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    n = len(keys[0])
    if n == 0:
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])


def _ranks(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values in order, place of each x among them)."""
    import pandas as pd

    code, values = pd.factorize(x)
    order = np.argsort(values)
    place = np.empty(len(values), np.int64)
    place[order] = np.arange(len(values))
    return values[order], place[code]


def _rows(schema: str, rows: list[tuple]):
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])


_EVENTS = "shard long, chunk long, blob binary, ids array<long>"
_STEP = "kind int, key long, chunk long, blob binary, ids array<long>"


def _few(parts: np.ndarray) -> np.ndarray:
    """Numbers of parts up to the last one above 1, then a 1 that stands for all that follow: every task gets these."""
    more = np.flatnonzero(parts > 1)
    return np.r_[parts[: more[-1] + 1 if len(more) else 0], 1].astype(np.int32)


def _of(parts: np.ndarray, last: np.ndarray) -> np.ndarray:
    return parts[np.minimum(last, np.uint64(len(parts) - 1)).astype(np.int64)]


class _Words:
    """What all tasks know: frequent words with their counts, the sums, and how the tokens are dealt."""

    def __init__(self, frequent: np.ndarray, train: np.ndarray, every: np.ndarray, n: int, distinct: int, total: int, classes: bool, task: int, split: int, spread: int):
        order = np.argsort(frequent)
        self.frequent, self.train = frequent[order], train[order]
        self.base, self.classes = n + 0.1 * (distinct + 1), classes
        self.shards = max(1, -(-total // task))
        own = -(-every[order] // split)
        rest = max(0, total - int(every.sum()))
        self.split = _few(np.r_[own, np.full(CLASSES if classes else 0, max(1, -(-rest // (CLASSES * split))))])
        self.spread = _few(np.where(own == 1, -(-every[order] // spread), 1))
        self.heavy = len(self.spread) > 1

    def places(self, h: np.ndarray) -> np.ndarray:
        """The number of each frequent word, -1 for others."""
        if len(self.frequent) == 0:
            return np.full(len(h), -1, np.int64)
        at = np.minimum(np.searchsorted(self.frequent, h), len(self.frequent) - 1)
        return np.where(self.frequent[at] == h, at, -1)

    def contexts(self, h: np.ndarray, place: np.ndarray) -> np.ndarray:
        """What words are as contexts: numbers below _PLACES, or a rare word's own hash."""
        other = np.uint64(len(self.frequent)) + mix64(h) % np.uint64(CLASSES) if self.classes else h | _RARE
        return np.where(place >= 0, place.astype(np.uint64), other)

    def part(self, last: np.ndarray, before: np.ndarray, of: np.ndarray, seed: np.uint64) -> np.ndarray:
        """Which of its last word's parts a context is in."""
        return mix64(before + seed) % _of(of, last).astype(np.uint64)

    def many(self, last: np.ndarray) -> np.ndarray:
        """Whether several groups work on a last word's contexts."""
        return _of(self.spread, last) > 1

    def backed(self, last: np.ndarray, count: np.ndarray, followers: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """(a(last, word), b(last)) as a trie has them, for words with `count` after last words by place."""
        lasts, which = np.unique(last, return_inverse=True)
        n, kinds = self.train[lasts].astype(float), np.array([followers.get(x, 0) for x in lasts.tolist()], float)
        with np.errstate(divide="ignore", invalid="ignore"):
            left = np.where(n > 0, probability(quantise(DISCOUNT * kinds / n)), 1.0)[which]
            share = np.where(count > 0, probability(quantise((count - DISCOUNT) / n[which])), 0.0)
        return share, left


def log_probabilities(docs: DataFrame, share: float = SHARE, task: int = TASK, split: int = SPLIT, spread: int = SPREAD, known: float = KNOWN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs.

    Reads doc_id and text, whole. A-Z are lower-cased; tokens are runs of characters other than ASCII white
    space, then one end. A null text is empty; equal rows count and are scored each by itself; a null id is
    held out. Rows whose crc32(doc_id as text) mod 10 is 0 are held out, the others are learned from.
    base_score is the unigram score with c + 0.1 over N + 0.1 (V + 1), n_known the tokens with c > 0.

    score is the log10 probability of the tokens under word triples with interpolated absolute discounting
    (ngrams.Trie), on top of that unigram; a document's first token has the unigram alone. The model is the same
    for tables of any size: every word is a context, and what backs a pair of words up is all that followed its last
    word. With share > 0 words of at most that share of all tokens stand, as contexts, for one of 4,096 classes; with
    a split, the contexts of a last word with more tokens than that back up to their own part of them.

    task, spread and known say how the work is dealt and leave results as they are. One pass counts words; those
    above `known` go to all tasks. In a second one tokens are dealt by their context's last word, once for learning
    and scoring: a group builds the trie of its training triples, looks up all of its triples, and finishes the tokens
    that are frequent words. The others go to groups by the word itself, where its count is known. Contexts of a last
    word with more than `spread` tokens are dealt by the word before, too: what a group then lacks are the counts of
    words after that last word, which are added up between groups, while its tokens wait. Sums come back by the chunk
    of documents that they belong to. A group grows with the most frequent pair of words alone.
    """
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    docs = docs.select(column("doc_id").cast("long").alias("doc_id"), column("text").alias("text")).withColumn("train", ~held)
    words, n = _frequent(docs, share, task, split, spread, known)

    dealt = docs.mapInArrow(lambda batches: _deal(batches, words), _EVENTS)
    step = cut(dealt.groupBy("shard").applyInArrow(lambda t: _learn(t, words), _STEP))
    sums, followers = step.where("kind < 2"), {}
    if words.heavy:
        added = cut(step.where("kind = 4").groupBy("key").applyInArrow(lambda t: _added(t), _STEP))
        # one row for each of the last words that several groups work on
        followers = {r["key"]: r["n"] for r in added.where("kind = 7").groupBy("key").agg(F.sum(F.col("ids")[0]).alias("n")).collect()}
        waiting = step.where("kind = 5").unionByName(added.where("kind = 6"))
        sums = sums.unionByName(waiting.groupBy("key").applyInArrow(lambda t: _finished(t, words, followers), _STEP))
    rare = step.where("kind = 2").groupBy("key").applyInArrow(lambda t: _rare(t, words, followers), _STEP)
    sums = sums.unionByName(rare)
    done = sums.groupBy("chunk").applyInArrow(lambda t: _summed(t, words), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return done.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def _frequent(docs: DataFrame, share: float, task: int, split: int, spread: int, known: float) -> tuple[_Words, int]:
    def counted(batches):
        import pyarrow as pa

        for batch in batches:
            train = np.asarray(batch.column(1))
            for a, token, doc, _ in _tokens(batch, 0):
                own = train[a + doc]
                for kind, part in ((1, token[own]), (0, token[~own])):
                    word, n = np.unique(part, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n * kind), pa.array(n)], ["word", "c", "n"])

    counts = docs.select("text", "train").mapInArrow(counted, "word long, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))
    counts = cut(counts)
    sums = counts.agg(F.sum("c").alias("c"), F.sum("n").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v")).first()
    n, total, distinct = sums["c"] or 0, sums["n"] or 0, sums["v"] or 0
    known = max(share if share > 0 else known, 1 / (_PLACES - CLASSES - 2))
    often = counts.where(F.col("n") > known * total).toPandas()  # fewer than 1 / known rows
    discard(counts)
    return _Words(often["word"].to_numpy(np.int64).view(np.uint64), often["c"].to_numpy(np.int64), often["n"].to_numpy(np.int64), n, distinct, total, share > 0, task, split, spread), n


def _short(context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts in 32 bits, with those that need more in a list beside."""
    own = context >= np.uint64(_PLACES)
    return np.where(own, np.uint64(_PLACES), context).astype(np.uint32), context[own]


def _long(short: np.ndarray, own: np.ndarray) -> np.ndarray:
    out = short.astype(np.uint64)
    out[short == _PLACES] = own
    return out


def _deal(batches, words: _Words):
    """Tokens with their contexts, by shard; a row with the ids of a chunk goes along with what is known of its frequent words."""
    import pandas as pd
    from pyspark import TaskContext

    chunk = TaskContext.get().partitionId() << 32
    for batch in batches:
        ids, train = batch.column(0), np.asarray(batch.column(2))
        for a, token, doc, n in _tokens(batch, 1):
            code, distinct = pd.factorize(token)
            place = words.places(distinct)
            context = words.contexts(distinct, place)[code]
            place = place.astype(np.int32)[code]
            del code, distinct
            begin = np.cumsum(n) - n
            zero = np.zeros(1, np.uint64)
            last, before = np.r_[zero, context[:-1]], np.r_[zero, zero, context[:-2]][: len(token)]
            del context
            last[begin] = _NONE
            second = begin[n > 1] + 1
            before[second] = _START
            before[begin] = (np.arange(len(n)) & 0xFFFF) if len(n) else 0  # spreads the first tokens
            part = words.part(last, before, words.split, _SEED)
            part[begin] = before[begin]
            part = mix64(mix64(last) + part)
            if words.heavy:
                part += words.part(last, before, words.spread, _SPREAD_SEED)
            shard = (mix64(part) % np.uint64(words.shards)).astype(np.uint16 if words.shards < 1 << 16 else np.int64)
            del part
            order = np.argsort(shard, kind="stable")
            edge = np.r_[_runs(shard[order]), len(order)]
            rows = []
            for i, j in zip(edge[:-1], edge[1:], strict=True):
                own = order[i:j]
                w = place[own]
                start = _runs(doc[own])
                who = doc[own[start]]
                blob = _pack(_narrow(who), _narrow(np.diff(np.r_[start, len(own)])), train[a + who].view(np.uint8), *_short(last[own]), *_short(before[own]), (w + 1).astype(np.uint32), token[own[w < 0]])
                rows.append((int(shard[own[0]]), chunk, blob, None))
            often = place >= 0
            c = words.train[place[often]]
            base, known = np.bincount(doc[often], np.log10(c + 0.1), len(n)), np.bincount(doc[often], c > 0, len(n))
            rows.append((chunk % words.shards, chunk, _pack(n.astype(np.uint32), base, known.astype(np.uint32)), ids.slice(a, len(n)).to_pylist()))
            yield _rows(_EVENTS, rows)
            chunk += 1


def _learn(table, words: _Words):
    """The group's trie, and its tokens' probabilities: sums for frequent words, (A, B) for the others, dealt by the word.

    Of last words that other groups work on as well, tokens wait with what their own context gives, and the
    counts of words after the last word go where they are added up.
    """
    import pyarrow as pa

    out, parts, chunks = [], [], []
    for chunk, blob, ids in zip(table["chunk"].to_pylist(), table["blob"].to_pylist(), table["ids"].to_pylist(), strict=True):
        if ids is not None:
            out.append((0, chunk, chunk, blob, ids))
            continue
        who, count, train, last, last_own, before, before_own, w, rare = _unpack(blob, 9)
        word = w.astype(np.uint64)
        word[w == 0] = rare | _RARE
        parts.append((np.full(len(w), len(chunks), np.int32), np.repeat(who.astype(np.uint32), count), np.repeat(train, count), _long(last, last_own), _long(before, before_own), word))
        chunks.append(chunk)
    if parts:
        shard = table["shard"][0].as_py()
        del table
        of, doc, train, last, before, word = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        first = last == _NONE
        part = words.part(last, before, words.split, _SEED).astype(np.int64)
        width = int(part.max()) + 1
        lasts, pair = _ranks(last)
        pair *= width
        pair += part
        befores, b = _ranks(before)
        del part, last, before
        pair <<= BEFORE_BITS
        pair |= b
        pairs, pair = _ranks(pair)
        distinct, w = _ranks(word)
        pair *= len(distinct)
        pair += w
        del w, b, befores
        triples, triple = _ranks(pair)
        pair, w = np.divmod(triples, len(distinct))
        group, before = pairs[pair] >> BEFORE_BITS, pairs[pair] & (_PLACES - 1)
        del pair, pairs
        count = np.bincount(triple[~first], train[~first], len(triples))
        learned = count > 0
        trie = Trie(Trie.build(group[learned].astype(np.uint64), before[learned], distinct[w[learned]], count[learned], DISCOUNT))
        share, left, more, own = trie.parts(group.astype(np.uint64), before, distinct[w])
        del trie, before, learned, triples
        last = lasts[group // width]
        many, alone = words.many(last), last == _NONE
        a, b = np.where(many, own, share * more + own), np.where(many, more, left * more)
        a[alone], b[alone] = 0, 1
        a, b = quantise(a), quantise(b)
        del share, left, more, own
        wait = np.zeros(len(word), bool)
        if many.any():
            heavy = np.flatnonzero(many)
            keys, key = np.unique(last[heavy] * np.uint64(len(distinct)) + w[heavy].astype(np.uint64), return_inverse=True)
            key_last, key_word = keys // np.uint64(len(distinct)), distinct[(keys % np.uint64(len(distinct))).astype(np.int64)]
            total = np.bincount(key, count[heavy], len(keys)).astype(np.int64)
            to = mix64(key_word) % (-(-words.spread[key_last.astype(np.int64)] // _ADDED)).astype(np.uint64)
            to = (mix64(mix64(key_last) + to) % np.uint64(words.shards)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            order = order[((key_word < _RARE) | (total > 0))[order]]
            edge = np.r_[_runs(to[order]), len(order)]
            for i, j in zip(edge[:-1], edge[1:], strict=True):
                own = order[i:j]
                out.append((4, int(to[order[i]]), shard, _pack(key_last[own].astype(np.uint32), key_word[own], total[own]), None))
            often = key_word < _RARE
            place = np.full(len(w), -1, np.int64)
            place[heavy] = np.where(often, np.cumsum(often) - 1, -1)[key]
            at = place[triple]
            wait = at >= 0
            own = np.flatnonzero(wait)
            own = own[np.lexsort((a[triple[own]], b[triple[own]], at[own]))]  # equal ones side by side take less room
            blob = _pack(np.array(chunks, np.int64), _narrow(of[own]), _narrow(doc[own]), a[triple[own]], b[triple[own]], _narrow(np.diff(at[own], prepend=0)), key_last[often].astype(np.uint32), key_word[often].astype(np.uint32))
            out.append((5, shard, None, blob, None))
            del place, at, key, keys, heavy
        near = np.where(many, last + np.uint64(1), np.uint64(0)).astype(np.uint32)[triple]
        a, b = a[triple], b[triple]
        del triple, w, count, last, group
        often = np.flatnonzero((word < _RARE) & ~wait)
        p = (words.train[word[often].astype(np.int64) - 1] + 0.1) / words.base
        out += _by_chunk(np.array(chunks, np.int64)[of[often]], doc[often], np.log10(probability(a[often]) + probability(b[often]) * p))
        rest = np.flatnonzero(word >= _RARE)
        to = (mix64(word[rest]) % np.uint64(words.shards)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        edge = np.r_[_runs(to[order]), len(order)]
        for i, j in zip(edge[:-1], edge[1:], strict=True):
            own = rest[order[i:j]]
            there, which = np.unique(of[own], return_inverse=True)
            blob = _pack(np.array([chunks[c] for c in there], np.int64), _narrow(which), _narrow(doc[own]), train[own], a[own], b[own], word[own], near[own])
            out.append((2, int(to[order[i]]), None, blob, None))
    return pa.Table.from_batches([_rows(_STEP, out)])


def _by_chunk(chunk: np.ndarray, doc: np.ndarray, score: np.ndarray) -> list[tuple]:
    """Sums by document of tokens in the order of chunks and documents, a row a chunk."""
    start = _runs(chunk, doc)
    total = np.add.reduceat(score, start) if len(score) else np.zeros(0)
    chunk, doc = chunk[start], doc[start]
    edge = np.r_[_runs(chunk), len(chunk)]
    return [(1, int(chunk[i]), int(chunk[i]), _pack(_narrow(doc[i:j]), total[i:j].astype(np.float32)), None) for i, j in zip(edge[:-1], edge[1:], strict=True)]


def _added(table):
    """Counts of words after last words, of all groups together: back to each group, and how many words there are."""
    import pyarrow as pa

    parts, out = [], []
    for group, blob in zip(table["chunk"].to_pylist(), table["blob"].to_pylist(), strict=True):
        last, word, count = _unpack(blob, 3)
        parts.append((np.full(len(last), group, np.int64), last, word, count))
    group, last, word, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    distinct, w = _ranks(word)
    keys, key = _ranks(last.astype(np.int64) * len(distinct) + w)
    total = np.bincount(key, count, len(keys)).astype(np.int64)
    lasts, n = np.unique((keys // len(distinct))[total > 0], return_counts=True)
    out += [(7, a, None, None, [b]) for a, b in zip(lasts.tolist(), n.tolist(), strict=True)]
    often = np.flatnonzero(word < _RARE)
    order = often[np.argsort(group[often], kind="stable")]
    edge = np.r_[_runs(group[order]), len(order)]
    for i, j in zip(edge[:-1], edge[1:], strict=True):
        own = order[i:j]
        out.append((6, int(group[own[0]]), None, _pack(last[own], word[own].astype(np.uint32), total[key[own]]), None))
    return pa.Table.from_batches([_rows(_STEP, out)])


def _finished(table, words: _Words, followers: dict[int, int]):
    """Sums of the tokens that waited for the counts of other groups."""
    import pyarrow as pa

    kinds, blobs = table["kind"].to_pylist(), table["blob"].to_pylist()
    chunks, of, doc, a, b, at, last, word = _unpack(blobs[kinds.index(5)], 8)
    answers = [_unpack(blob, 3) for kind, blob in zip(kinds, blobs, strict=True) if kind == 6]
    del table, blobs
    at = np.cumsum(at, dtype=np.int64)
    total = np.zeros(len(last), np.int64)
    asked = (last.astype(np.int64) << 32) | word
    for near, w, count in answers:
        total[np.searchsorted(asked, (near.astype(np.int64) << 32) | w)] = count
    share, left = words.backed(last, total, followers)
    p = ((words.train[word.astype(np.int64) - 1] + 0.1) / words.base)[at]
    own, more = probability(a), probability(b)
    a, b = quantise(share[at] * more + own), quantise(left[at] * more)
    order = np.lexsort((doc, of))
    return pa.Table.from_batches([_rows(_STEP, _by_chunk(chunks[of[order]], doc[order], np.log10(probability(a) + probability(b) * p)[order]))])


def _rare(table, words: _Words, followers: dict[int, int]):
    """Tokens that are rare words, all of a word in one group: its count gives the unigram, and its counts after last words of many groups are there."""
    import pyarrow as pa

    parts = []
    for blob in table["blob"].to_pylist():
        chunks, which, doc, train, a, b, word, near = _unpack(blob, 8)
        parts.append((chunks[which], doc.astype(np.uint32), train, a, b, word, near))
    chunk, doc, train, a, b, word, near = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    distinct, w = _ranks(word)
    c = np.bincount(w, train, len(distinct))[w]
    many = np.flatnonzero(near)
    if len(many):
        keys, key = _ranks(near[many].astype(np.int64) * len(distinct) + w[many])
        share, left = words.backed(near[many].astype(np.int64) - 1, np.bincount(key, train[many], len(keys))[key], followers)
        own, more = probability(a[many]), probability(b[many])
        a[many], b[many] = quantise(share * more + own), quantise(left * more)
    score = np.log10(probability(a) + probability(b) * ((c + 0.1) / words.base))
    base, known = np.log10(c + 0.1), (c > 0).astype(np.int64)
    order = np.lexsort((doc, chunk))
    chunk, doc = chunk[order], doc[order]
    start = _runs(chunk, doc)
    score, base, known = (np.add.reduceat(x[order], start) for x in (score, base, known))
    chunk, doc = chunk[start], doc[start]
    edge = np.r_[_runs(chunk), len(chunk)]
    out = [(3, int(chunk[i]), int(chunk[i]), _pack(_narrow(doc[i:j]), score[i:j].astype(np.float32), base[i:j], _narrow(known[i:j])), None) for i, j in zip(edge[:-1], edge[1:], strict=True)]
    return pa.Table.from_batches([_rows(_STEP, out)])


def _summed(table, words: _Words):
    """A chunk's documents with all that came back for them."""
    import pyarrow as pa

    kinds, blobs = table["kind"].to_pylist(), table["blob"].to_pylist()
    at = kinds.index(0)
    n, base, known = _unpack(blobs[at], 3)
    base, known, score = base.copy(), known.astype(np.int64), np.zeros(len(n))
    for kind, blob in sorted(zip(kinds, blobs, strict=True)):  # sums in the same order in each run
        if kind == 1:
            doc, s = _unpack(blob, 2)
            score[doc] += s
        elif kind == 3:
            doc, s, b, k = _unpack(blob, 4)
            score[doc] += s
            base[doc] += b
            known[doc] += k
    base -= n * np.log10(words.base)
    return pa.table({"doc_id": pa.array(table["ids"][at].as_py(), pa.int64()), "n_tokens": pa.array(n.astype(np.int64)), "n_known": pa.array(known), "base_score": pa.array(base), "score": pa.array(score)})
