"""Counts of every prefix against the library, and of very long pieces."""

import random
import time

import public_tokenizers
import pytest

from setloom.llm import token_counts as T

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tool():
    return T.Counter(PATH, public_tokenizers.PATTERN)


def library(tool, text):
    return [len(x.ids) for x in tool.library.encode_batch([text[:i] for i in range(len(text) + 1)], add_special_tokens=False)]


DRAW = random.Random(5)
TEXTS = [
    "Hello world, it's they'll we're I've 'restored !'s x'", "   three  spaces\n\n\n and\tlines \n", "naïve Straße 漢字かな한국어 русский \U0001f600\U0001f600", "internationalization antidisestablishmentarianism",
    "a <|endoftext|> b!!<|endoftext|>", "<|endoftext|><|endoftext|>  <|endoftext|>tail", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa 1234567890123 ----====----", "   wide　space \x85 x", "",
    *["".join(DRAW.choice("abeilnorst") for _ in range(60)) for _ in range(20)],
    *["".join(DRAW.choice("ab 'sl\n!é<|") for _ in range(60)) for _ in range(40)],
    *["".join(DRAW.choice(["ing", "tion", " the", "er", "s", "x", "'ll", " ", "\n", "11"]) for _ in range(30)) for _ in range(40)],
]


@pytest.mark.parametrize("i", range(len(TEXTS)))
def test_every_prefix(tool, i):
    text, want = TEXTS[i], library(tool, TEXTS[i])
    table = tool.tables([text])[0]
    assert table.every().tolist() == want
    assert [table.at(n) for n in range(len(text) + 1)] == want
    for budget in range(0, want[-1], 3):
        assert table.fits(budget) == max(n for n, c in enumerate(want) if c <= budget)


def test_long_pieces_take_one_pass(tool):
    text = "".join(DRAW.choice("etaoinshrdlucmfw") for _ in range(1_000_000))
    began = time.time()
    table = tool.tables([text])[0]
    counts = table.every()
    assert time.time() - began < 120 and len(counts) == len(text) + 1
    for n in (1, 17, 4_000, 99_999, len(text)):
        assert counts[n] == len(tool.library.encode(text[:n], add_special_tokens=False).ids)
    assert table.total == counts[-1] and counts[table.fits(5_000)] <= 5_000
