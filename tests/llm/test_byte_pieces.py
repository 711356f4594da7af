"""Byte-level ids by rank arrays against the library."""

from __future__ import annotations

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from creaseline.llm import bpe, id_store

TEXTS = [
    "Plain words, don't   stop; it's 12345 o'clock!!\n\n  tab\there\r\nend ",
    "",
    " ",
    "\n",
    "<|endoftext|>",
    "a<|endoftext|> b <|endoftext",
    "Größe naïve Éauxréç,, Ωμέγα привет 漢字 \U0001f600 x\x1cy\x85z\xa0w \xad͸",
    "a" * 300 + " " + "ab" * 128 + " " + "é" * 128,
    "'s'tis 'll\n'd ''re x's",
]


def _expected(texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("limit", [1, 5, 700_000])
def test_ids_equal_the_library(limit):
    memo, width = id_store._library(public_tokenizers.path("byte_bpe_50k.json"))
    small = bpe.Memo(memo.compute, memo.chunks_of, limit)
    for _ in range(2):
        own = [id_store.np.frombuffer(b"".join(parts), dtype=width).tolist() for parts in small(TEXTS)]
        assert own == _expected(TEXTS)


def test_common_words_do_not_reach_the_library(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert bpe.BytePieces.fits(path)
    encoder = bpe.BytePieces(path, id_store.np.dtype("uint16"), limit=3)
    chunks = [" words,", "Größe", " a", " words,", "don't", "12!"]
    assert bpe.BytePieces.PLAIN("\n".join([*chunks, " ", "漢字"])) == chunks
    library = Tokenizer.from_file(path)
    for _ in range(2):
        own = [id_store.np.frombuffer(x, dtype="uint16").tolist() for x in encoder(chunks)]
        assert own == [library.encode(c, add_special_tokens=False).ids for c in chunks]


def test_words_of_every_width_equal_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), bpe.RankArrayEncoder(path)
    words = [w * k for w in ("a", "ab", "the", "xq", "é") for k in (1, 2, 3, 7, 8, 9, 16, 31, 64, 128, 200)]
    ids = [id_store.np.frombuffer(x, dtype="<u4").tolist() for x in own.encode_chunks(words)]
    assert ids == [library.encode(w, add_special_tokens=False).ids for w in words]
