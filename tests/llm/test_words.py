"""Remembered words: the same ids as the library's, whatever came before and however little is kept."""

import random

import pyarrow as pa
import pytest

from panelwright.llm import tokens


@pytest.mark.parametrize("kept", [0, 7, 1 << 20])
def test_later_batches_have_the_librarys_ids(monkeypatch, kept):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "REMEMBERED", kept)
    path = public.path("byte_bpe_50k.json")
    library, own, r = Tokenizer.from_file(path), tokens.Encoder(path), random.Random(4)
    vocabulary = ["plain", "Asñ", "don't", "x" * 40, "\N{SNOWMAN}", "\x85edge", "42,000", "it's", "<|endoftext|>", "日本語", "tab\tin"]
    for _ in range(6):
        texts = [" ".join(r.choice(vocabulary) + r.choice(["", "", str(r.randint(0, 9))]) for _ in range(r.randint(0, 12))) for _ in range(20)]
        ids, n = own.flat(pa.array(texts))
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == [i for w in want for i in w] and n.tolist() == [len(w) for w in want]
        assert own.counts(pa.array(texts)).tolist() == n.tolist()
    assert len(own.known) == len(own.known_start) == len(own.known_length) == min(kept, len(own.known))
    assert kept == 0 or 0 < len(own.known) <= kept
    assert "x" * 40 not in own.known.to_pylist()
