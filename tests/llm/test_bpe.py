import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tapeloom.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same(library, texts):
    coder = bpe.WordBpe(PATH)
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text[:60]
        assert coder.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_random_texts(library):
    letters = "aAbBzZ 019\t\n\x0b\x0c\r\x1c\x1f\x85\xa0 ​'sdtrevml.,!?-_ßİΣσςé中文\U0001f44d\U0001f3fd\x00"
    rng = random.Random(1)
    same(library, ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)])


def test_special_strings_and_long_pieces(library):
    same(library, ["", "<|endoftext|>", "a<|endoftext|><|startoftext|>b", "<|ENDOFTEXT|>", "a" * 5001, "ab" * 4000,
                   "aaa aaaa aaaaa " * 30, "x" * 999 + "y" * 998, "don't WE'LL it's 'S"])


def test_documents(library, texts):
    same(library, list(texts.values()))


def test_texts_encoded_apart_or_together_agree(texts):
    coder = bpe.WordBpe(PATH)
    some = list(texts.values())[:20]
    assert coder.encode(some) == [coder.encode([t])[0] for t in some]


def test_ranks_must_be_applicable_in_bulk():
    with pytest.raises(ValueError):
        bpe.PairMerger([(5, 1, 6), (1, 2, 5)])


def test_overlapping_equal_pairs():
    merger = bpe.PairMerger([(1, 1, 2), (2, 2, 3)])
    ids, counts = merger.merge(np.array([1] * 7 + [1] * 4), np.array([7, 4]))
    assert ids.tolist() == [3, 2, 1, 3] and counts.tolist() == [3, 1]


def test_odd_rows(odd, library, monkeypatch):
    rows = bpe.round_trip(odd).collect()
    want = []
    for r in odd.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        packed = np.array(ids, dtype="<u4").tobytes()
        want.append((r["doc_id"], len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
    assert bpe.round_trip(odd.where("false")).count() == 0


def test_other_columns_stay(clashing):
    out = clashing.withColumn("tokens", bpe.encode(F.col("text"), PATH))
    assert out.columns == [*clashing.columns, "tokens"] and out.select("row").first()[0] == "mine row"


def test_every_code_point_is_read_as_the_library_reads_it(library):
    """Alone, between letters, between digits and between signs."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for at in range(0, len(points), 1 << 16):
        texts = [f"{c} a{c}b 1{c}2 -{c}-" for c in points[at : at + (1 << 16)]]
        coder = bpe.loaded(PATH)
        want = library.encode_batch_fast(texts, add_special_tokens=False)
        for text, ids, w in zip(texts, coder.encode(texts), want, strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == w.ids, f"U+{ord(text[0]):04X}"


def test_newer_letters_in_longer_texts(library):
    newer = [chr(c) for c in sorted(bpe._points(bpe.NEWER_LETTERS) | bpe._points(bpe.NEWER_DIGITS) | set(bpe._small_letters()))]
    rng = random.Random(4)
    same(library, ["".join(rng.choice([rng.choice(newer), "a", "B", " ", "1", "-", "é"]) for _ in range(40)) for _ in range(500)])
