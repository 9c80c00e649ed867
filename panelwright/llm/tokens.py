"""Token counts kept in a cache of digests, and the tokenizer that fills it."""

from __future__ import annotations

import functools
import hashlib
import json
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import cut, discard, passed, text_buffers

#: Up to so many missing digests (32 bytes each) are broadcast to fetch their texts.
BROADCAST_DIGESTS = 200_000
#: How byte-level vocabularies write a space.
_SPACE = chr(0x120)
#: A space at an end or beside other white space, and white space at a word's end, in the regular expressions of Arrow.
_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{180e}\p{Z}]"
_ODD, _EDGE = rf"^ | $| {_WHITE}|{_WHITE} ", rf"^{_WHITE}|{_WHITE}$"
#: Words that are encoded as one text.
TOGETHER = 2000
#: Words whose ids a worker remembers at most (some 40 bytes each), and the longest of them in bytes.
REMEMBERED, WORD = 1 << 20, 32


def splits_at_spaces(path: str) -> bool:
    """Whether the file's rules never join what a single space between two other characters separates: plain byte-level splitting, no normalizer, no added token that takes white space along."""
    rules = json.loads(Path(path).read_bytes())
    before = rules.get("pre_tokenizer") or {}
    model = rules.get("model") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex") is True and before.get("add_prefix_space") is False
    alone = not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or " " in t["content"] for t in rules.get("added_tokens") or [])
    return plain and alone and not rules.get("normalizer") and model.get("type") == "BPE" and not model.get("dropout") and not rules.get("truncation") and not rules.get("padding")


class Encoder:
    """Ids of whole texts as the library gives them.

    Where the tokenizer's rules allow it, texts are cut at single spaces between other characters, and a
    text's ids are those of its words in order, each with the space before it. Words come back often, so
    the distinct ones of a batch are encoded, many of them in one text, where each starts with a token that
    starts with a space; the first REMEMBERED of them are kept for the worker's later batches. Texts with other white space around a space, and other tokenizers' texts, are
    encoded whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.whole = not splits_at_spaces(path)
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for token, i in vocabulary.items() if token.startswith(_SPACE)]] = True
        self.forget()

    def forget(self) -> None:
        """Start anew without remembered words."""
        import pyarrow as pa

        self.known = pa.array([], pa.large_string())
        self.known_ids, self.known_start, self.known_length = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, length of each)."""
        found = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate(found) if found else np.zeros(0, np.int32), np.fromiter(map(len, found), np.int64, len(found))

    def _words(self, words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, length) of the distinct Arrow strings `words`, each after a space: remembered ones are looked up, the others encoded."""
        import pyarrow as pa
        import pyarrow.compute as pc

        at = np.asarray(pc.fill_null(pc.index_in(words, value_set=self.known), -1))
        new = np.flatnonzero(at < 0)
        fresh = words.take(pa.array(new))
        ids, first, n = self._encode_words(fresh)
        start, length = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        old = at >= 0
        start[old], length[old] = self.known_start[at[old]], self.known_length[at[old]]
        start[new], length[new] = len(self.known_ids) + first, n
        both = np.r_[self.known_ids, ids]
        keep = np.flatnonzero(np.asarray(pc.less_equal(pc.binary_length(fresh), WORD)))[: REMEMBERED - len(self.known)]
        if len(keep):
            to = np.cumsum(n[keep])
            place = np.repeat(first[keep] - (to - n[keep]), n[keep]) + np.arange(to[-1])
            self.known = pa.concat_arrays([self.known, fresh.take(pa.array(keep))])
            self.known_start = np.r_[self.known_start, len(self.known_ids) + to - n[keep]]
            self.known_length, self.known_ids = np.r_[self.known_length, n[keep]], np.r_[self.known_ids, ids[place]]
        return both, start, length

    def _encode_words(self, words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """_words() through the library."""
        import pyarrow as pa
        import pyarrow.compute as pc

        start, length = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        edgy = np.asarray(pc.match_substring_regex(words, _EDGE))
        easy = np.flatnonzero(~edgy)
        some = words.take(pa.array(easy)) if edgy.any() else words
        data, at = text_buffers(some)
        joined, letter = np.full(len(data) + len(some), ord(" "), np.uint8), np.ones(len(data) + len(some), bool)
        letter[at[:-1] + np.arange(len(some))] = False
        joined[letter] = data
        cuts = [*(at[:-1] + np.arange(len(some)))[::TOGETHER].tolist(), len(joined)]
        ids, _ = self._encode([joined[i:j].tobytes().decode() for i, j in zip(cuts[:-1], cuts[1:], strict=True)])
        edge = np.flatnonzero(self.spaced[ids])
        if len(edge) == len(some):
            start[easy], length[easy] = edge, np.diff(np.r_[edge, len(ids)])
        else:  # a token list that spells spaces otherwise
            ids, length[easy] = self._encode([" " + w for w in some.to_pylist()])
            start[easy] = np.cumsum(length[easy]) - length[easy]
        if edgy.any():
            more, n = self._encode([" " + w for w in words.take(pa.array(np.flatnonzero(edgy))).to_pylist()])
            start[edgy], length[edgy] = len(ids) + np.cumsum(n) - n, n
            ids = np.r_[ids, more]
        return ids, start, length

    def _parts(self, column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start of each part, its length, parts of each text): an Arrow string array's texts as stretches of ids."""
        import pyarrow as pa
        import pyarrow.compute as pc

        odd = np.asarray(pc.match_substring_regex(column, _ODD)) | self.whole
        plain, other = np.flatnonzero(~odd), np.flatnonzero(odd)
        split = pc.split_pattern(column.take(pa.array(plain)) if len(other) else column, " ")
        words, size = split.flatten(), np.diff(np.asarray(split.offsets))
        first = np.cumsum(size) - size
        coded = words.dictionary_encode()
        ids, at, length = self._words(coded.dictionary)
        heads, n_heads = self._encode(words.take(pa.array(first)).to_pylist())
        whole, n_whole = self._encode(column.take(pa.array(other)).to_pylist())
        row = np.asarray(coded.indices)
        starts, lengths = at[row], length[row]
        starts[first], lengths[first] = len(ids) + np.cumsum(n_heads) - n_heads, n_heads
        parts = np.ones(len(column), np.int64)
        parts[plain] = size
        if len(other):  # the whole texts' stretches come in where they stand
            place = np.cumsum(parts) - parts
            own = np.ones(int(parts.sum()), bool)
            own[place[other]] = False
            s, n = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
            s[own], n[own] = starts, lengths
            s[~own], n[~own] = len(ids) + len(heads) + np.cumsum(n_whole) - n_whole, n_whole
            starts, lengths = s, n
        return np.concatenate([ids, heads, whole]), starts, lengths, parts

    def flat(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, length of each text) of an Arrow string array; null is empty."""
        column = _strings(column)
        if not len(column):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        ids, start, n, parts = self._parts(column)
        to = np.cumsum(n)
        place = np.repeat((start - (to - n)).astype(np.int32), n)  # a batch has fewer than 2**31 ids
        place += np.arange(len(place), dtype=np.int32)
        return ids[place], np.diff(np.r_[0, to[np.cumsum(parts) - 1]])

    def counts(self, column) -> np.ndarray:
        """The number of ids of each text of an Arrow string array; null is empty."""
        column = _strings(column)
        if not len(column):
            return np.zeros(0, np.int64)
        _, _, n, parts = self._parts(column)
        return np.diff(np.r_[0, np.cumsum(n)[np.cumsum(parts) - 1]])


def _strings(column):
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "").cast(pa.large_string())
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def version(path: str) -> str:
    """The tokenizer's digest: the file's sha256."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


@functools.cache
def encoder(path: str) -> Encoder:
    """One per worker: the file is read once."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def token_counts(docs: DataFrame, path: str, cache: str, limit: int = 512) -> DataFrame:
    """docs with n_bytes, n_tokens (long) and over_limit (n_tokens > limit).

    The content is the text as it stands, null as empty: the tokenizer's counts depend on every byte, so
    normalising removes nothing else. `cache` is a folder of the cluster's shared storage; its rows
    (content digest, n_tokens) stand in one folder for each tokenizer version. Digests are sha256. Digests
    that are not there are found first, without the texts; then only their texts are fetched (up to
    BROADCAST_DIGESTS digests by broadcasting them, more by dealing both sides by digest), encoded once
    each, and appended. So a full cache moves no text. Null ids, repeated rows and empty tables give rows
    alike; extra columns pass through, except that an output replaces an input column of its name.
    """
    spark = docs.sparkSession
    place = f"{cache.rstrip('/')}/tokenizer={version(path)}"
    content = F.coalesce(F.col("text"), F.lit(""))
    digest = F.unhex(F.sha2(content.cast("binary"), 256))
    texts = docs.select(digest.alias("digest"), content.alias("content"))
    schema = "digest binary, tokens long"
    folder = spark._jvm.org.apache.hadoop.fs.Path(place)
    missing = None
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        stored = spark.read.schema(schema).parquet(place)
        missing = cut(docs.select(digest.alias("digest")).distinct().join(stored, "digest", "left_anti"))
        texts = texts.join(F.broadcast(missing) if missing.count() <= BROADCAST_DIGESTS else missing, "digest", "left_semi")

    def count(batches):
        import pyarrow as pa

        use = encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(use.counts(batch.column(1)), pa.int64())], ["digest", "tokens"])

    texts.dropDuplicates(["digest"]).mapInArrow(count, schema).write.mode("append").parquet(place)
    if missing is not None:
        discard(missing)
    known = spark.read.schema(schema).parquet(place).dropDuplicates(["digest"]).select(F.struct("digest", "tokens").alias("mix_known"))
    outputs = "n_bytes", "n_tokens", "over_limit"
    narrow = docs.select(*passed(docs, *outputs, "mix_digest", "mix_bytes", "mix_known"), F.octet_length(content).cast("long").alias("mix_bytes"), digest.alias("mix_digest"))
    out = narrow.join(known, F.col("mix_digest") == F.col("mix_known.digest"))
    n = F.col("mix_known.tokens")
    return out.select(*passed(docs, *outputs, "mix_digest", "mix_bytes", "mix_known"), F.col("mix_bytes").alias("n_bytes"), n.alias("n_tokens"), (n > limit).alias("over_limit"))


__all__ = ["Encoder", "encoder", "splits_at_spaces", "token_counts", "version"]
