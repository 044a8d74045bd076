import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tapeloom.llm import token_counts as tc

PATH = public_tokenizers.path(tc.DEFAULT_FILE)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def length(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def test_pieces_are_safe(library, texts):
    rng = random.Random(5)
    made = ["".join(rng.choice(" \t\n ab'stIé1<|endoftext|>") for _ in range(400)) for _ in range(100)]
    made += ["a <|endoftext|> b " * 40, "don't we'll it's " * 30, "x  y   z " * 40]
    for text in [*texts.values(), *made]:
        cut = list(tc.pieces(text, 30))
        assert "".join(cut) == text
        assert sum(length(library, p) for p in cut) == length(library, text)
    assert max(map(len, tc.pieces("word and " * 10_000))) <= tc.PIECE_CHARS + 20
    assert list(tc.pieces("x" * 100, 10)) == ["x" * 100]


def test_batches_do_not_matter(monkeypatch, library, texts):
    some = [*texts.values(), ""]
    want = [length(library, t) for t in some]
    assert tc.count_all(some, PATH).tolist() == want
    monkeypatch.setattr(tc, "BATCH_BYTES", 100)
    assert tc.count_all(some, PATH).tolist() == want


def test_odd_rows(odd, library):
    got = sorted(map(tuple, tc.token_counts(odd).collect()), key=repr)
    want = []
    for r in odd.collect():
        n = length(library, r["text"] or "")
        want.append((r["doc_id"], len((r["text"] or "").encode()), n, n > 1024))
    assert got == sorted(want, key=repr)
    assert tc.token_counts(odd.where("false")).count() == 0
