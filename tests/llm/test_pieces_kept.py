"""A full table of pieces keeps those that come back, so the library sees those once."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from recordvol.llm.queries import tokenizer_file
from recordvol.llm.tokenization import PieceEncoder

KINDS = [("byte_bpe_50k.json", "joined"), ("word_bpe_49k.json", "dropped")]


def letters(n):
    return "".join(chr(ord("a") + int(d)) for d in str(n))


def counted(monkeypatch):
    """How often the library gets each piece."""
    given, was = Counter(), PieceEncoder._encoded
    monkeypatch.setattr(PieceEncoder, "_encoded", lambda self, pieces, *a, **k: given.update(pieces.to_pylist()) or was(self, pieces, *a, **k))
    return given


def same_as_library(name, texts, found):
    library = Tokenizer.from_file(tokenizer_file(name))
    library.encode_special_tokens = True
    return [np.frombuffer(x, "<u4").tolist() for x in found] == [library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize(("name", "spaces"), KINDS)
def test_frequent_pieces_outlive_rare_ones(monkeypatch, name, spaces):
    given, enc = counted(monkeypatch), PieceEncoder(tokenizer_file(name), spaces, most=100)
    often = ["often" + letters(i) for i in range(40)]
    for n in range(20):
        texts = [" ".join(["the", *often]), " ".join(["the", *("rare" + letters(1000 * (n + 1) + i) for i in range(30))])]
        assert same_as_library(name, texts, enc.encode(pa.array(texts)))
        assert len(enc.known) == len(enc.table.starts) <= 100
    assert {given[w] for w in often} == {1}


@pytest.mark.parametrize(("name", "spaces"), KINDS)
def test_more_pieces_at_once_than_are_kept(name, spaces):
    enc = PieceEncoder(tokenizer_file(name), spaces, most=10)
    for n in range(5):
        texts = [" ".join("word" + letters(20 * n + i) for i in range(35)), "word" + letters(20 * n), "x" * 100 + " é\n\nb, c", "", None]
        found = enc.encode(pa.array(texts))
        assert same_as_library(name, [t or "" for t in texts], found)
        assert len(enc.known) == len(enc.table.starts)


def test_words_of_letters_go_to_the_model_as_they_are():
    enc, runs = PieceEncoder(tokenizer_file("byte_bpe_50k.json"), "joined"), []
    library = enc.tokenizer
    enc.tokenizer = type("Seen", (), {"encode_batch_fast": lambda self, texts, **k: runs.extend(texts) or library.encode_batch_fast(texts, **k)})()
    letters = [chr(i) for a, b in [("A", "Z"), ("a", "z"), ("À", "Ö"), ("Ø", "ö"), ("ø", "į"), ("ı", "ſ"), ("Ѐ", "џ")] for i in range(ord(a), ord(b) + 1)]
    words = [x + y for x, y in zip(letters, letters[1:] + letters[:1])] + letters
    texts = [" ".join(["the", *words]), "the'll don't 12 a1 éé ªº ­日本 x y <|endoftext|>"]
    assert same_as_library("byte_bpe_50k.json", texts, enc.encode(pa.array(texts)))
    assert not any(w in run.split(" ") for run in runs for w in words if len(w) > 1)
