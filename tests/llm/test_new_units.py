"""Units that an encoder has not met: op4's and op10's ids are the library's own, and new words cost no call of Python each."""

import random
import sys

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from emberline.llm import tokens

LETTERS = "É ß İ Σ ς ﬁ ᄀ ᅡ 각 א ا क ि 𝒜 Ⅷ ª ǅ Å 漢 ー ́ ſ 1 _ - ⓐ a b X Y".split()


def _words(n: int, letters: list[str]) -> list[str]:
    rng = random.Random(8)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) + rng.choice(["", ".", ",", "!", "|", ";"]) for _ in range(n)]


def _texts(words: list[str]) -> list[str]:
    rng = random.Random(9)
    return [rng.choice([" ", "\n"]).join(words[lo : lo + 40]) for lo in range(0, len(words), 40)]


def _are_the_library_s(name: str) -> None:
    texts = _texts(_words(6000, LETTERS))
    flat, bounds = tokens.Encoder(tokens.vocabulary(name)).encode_column(pa.array(texts))
    library = Tokenizer.from_file(tokens.vocabulary(name))
    assert [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def _calls(name: str) -> float:
    """Calls of Python functions, built-in ones too, for each new word of letters."""
    words = _words(20_000, list("abcdefghijklmnopqrstuvwxyzéß"))
    own, column, calls = tokens.Encoder(tokens.vocabulary(name)), pa.array(_texts(words)), [0]
    own.encode_column(pa.array(["é warm"]))  # tables that are made once

    def count(_frame, event, _arg):
        calls[0] += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        own.encode_column(column)
    finally:
        sys.setprofile(None)
    return calls[0] / len(set(words))


@pytest.mark.parametrize("check", [_are_the_library_s, lambda name: _calls(name) < 0.5 or pytest.fail("a call for each word")])
def test_op4_units(check):
    check("byte_bpe_50k.json")


@pytest.mark.parametrize("check", [_are_the_library_s, lambda name: _calls(name) < 0.5 or pytest.fail("a call for each word")])
def test_op10_units(check):
    check("word_bpe_49k.json")
