"""BPE encoding and decoding with a pair occurrence index.

A task takes texts until it holds ``CHUNK_CHARS`` and encodes their distinct pieces
together.  The index maps each mergeable pair, by its rank, to all its positions.
The lowest active rank is applied to all of its positions at once, and the lists of
the pairs that this makes or breaks are updated: broken ones are recognised when
their turn comes, new ones are added to their rank.  Pieces are chained lists of
symbols, so pieces of any length cost what their merges cost.

Reads the public tokenizer files of the word kind: NFC, lower case, one pattern,
byte symbols, an end-of-word mark, special strings cut out of the raw text first.
Ids are kept as little-endian unsigned 32-bit integers in one BINARY value.  The installed text,
pattern and tokenizer libraries know different Unicode versions: of the points that are
unassigned to the text library exactly those of the tables below are letters, digits or capitals.

Defined cases: a NULL or empty text has no ids and decodes to the empty text; ids
that are NULL decode like none; repeated rows each give their result; an empty
table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from tapeloom.llm.common import small_batches, table

DEFAULT_FILE = "word_bpe_49k.json"
#: Characters whose distinct pieces share one index.
CHUNK_CHARS = 8_000_000
_SPACES = r"\t-\r \x85\xa0  -     　"


# Code points unassigned in Unicode 15.1 that the tokenizers library takes as letters and as digits,
# and the capitals among such points with their small letters, as its own splitter and normaliser answer for each.
NEWER_LETTERS = """
    1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B 1138E 11390-113B5
    113B7 113D1 113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF 1E5D0-1E5ED 1E5F0
"""
NEWER_DIGITS = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"
NEWER_CAPITALS = "1C89:1C8A A7CB:264 A7CC:A7CD A7CE:A7CF A7D2:A7D3 A7D4:A7D5 A7DA:A7DB A7DC:19B 10D50-10D65:10D70 16EA0-16EB8:16EBB"


def _points(table: str) -> set[int]:
    ranges = [[int(end, 16) for end in part.split("-")] for part in table.split()]
    return {point for part in ranges for point in range(part[0], part[-1] + 1)}


def _small_letters() -> dict[int, int]:
    """The small letter of each newer capital."""
    out = {}
    for entry in NEWER_CAPITALS.split():
        capitals, small = entry.split(":")
        out |= {point: int(small, 16) + k for k, point in enumerate(sorted(_points(capitals)))}
    return out


def _unknown(kind: str, known: str) -> list[int]:
    """Points that the pattern library counts as ``kind``, and the tokenizer neither by version nor by table."""
    everything = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    found = [c for c in regex.findall(rf"\p{{{kind}}}", everything) if unicodedata.category(c) == "Cn"]
    return sorted({ord(c) for c in found} - _points(known))


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class PairMerger:
    """Merges pieces of symbols by ascending rank over one pair occurrence index."""

    def __init__(self, merges: list[tuple[int, int, int]]):
        made = {new: rank for rank, (_, _, new) in enumerate(merges)}
        if any(made.get(a, -1) >= rank or made.get(b, -1) >= rank for rank, (a, b, _) in enumerate(merges)):
            raise ValueError("a merge uses a symbol that a later merge makes: ranks cannot be applied in bulk")
        self.left, self.right, self.new = (np.array(c, dtype=np.int64) for c in zip(*merges, strict=True))
        keys = self.left << 32 | self.right
        self._order = np.argsort(keys)
        self._keys = keys[self._order]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, -1 where it is no merge."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[at] == keys, self._order[at], -1)

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and lengths of the pieces after all merges."""
        n = len(symbols)
        symbols = symbols.astype(np.int32)
        ends = np.cumsum(lengths)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[ends - 1] = -1
        before[ends - lengths] = -1
        lists: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(positions: np.ndarray) -> None:
            """List the pairs that begin at these positions under their ranks."""
            positions = positions[after[positions] >= 0]
            ranks = self._ranks(symbols[positions], symbols[after[positions]])
            positions, ranks = positions[ranks >= 0], ranks[ranks >= 0]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for rank, part in zip(
                ranks[np.concatenate(([0], cuts))].tolist(), np.split(positions, cuts), strict=True
            ):
                if rank in lists:
                    lists[rank].append(part)
                else:
                    lists[rank] = [part]
                    heapq.heappush(active, rank)

        if n:
            add(np.arange(n, dtype=np.int32))
        while active:
            rank = heapq.heappop(active)
            left, right = self.left[rank], self.right[rank]
            at = lists.pop(rank)
            at = at[0] if len(at) == 1 else np.concatenate(at)
            at = at[(symbols[at] == left) & (after[at] >= 0)]
            at = at[symbols[after[at]] == right]
            if left == right:
                at = self._apart(np.unique(at), after)
            elif len(at) > 1:
                at = np.unique(at)
            if not len(at):
                continue
            gone = after[at]
            following = after[gone]
            symbols[at], symbols[gone] = self.new[rank], -1
            after[at] = following
            inner = following >= 0
            before[following[inner]] = at[inner]
            ahead = before[at]
            add(np.unique(np.concatenate((ahead[ahead >= 0], at))))
        kept = symbols >= 0
        counts = np.add.reduceat(kept, ends - lengths) if n else lengths
        return symbols[kept], counts

    @staticmethod
    def _apart(at: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Of pairs of equal symbols, those that a left-to-right pass takes."""
        taken, blocked = [], -1
        for position in at.tolist():
            if position != blocked:
                taken.append(position)
                blocked = int(after[position])
        return np.array(taken, dtype=np.int64)


class _Numbered(dict):
    """Numbers its keys in the order of their first use."""

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        return number


class WordBpe:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in (vocab | self.special).items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.merger = PairMerger([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges])
        chars = _byte_symbols()
        self._inner = np.array([vocab[c] for c in chars])
        self._last = np.array([vocab[c + suffix] for c in chars])
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = split["pattern"]["Regex"].replace(r"[^\s", f"[^{_SPACES}")
        self._pieces = regex.compile(pattern).findall
        # Texts with points that are too new take a pattern without them; for all others it would only be slow.
        self._capitals = _small_letters()
        unknown = {kind: _unknown(kind, known) for kind, known in (("L", NEWER_LETTERS), ("N", NEWER_DIGITS))}
        self._newest = min([*self._capitals, *unknown["L"], *unknown["N"]])
        for kind, points in unknown.items():
            listed = "".join(f"\\U{point:08x}" for point in points)
            pattern = pattern.replace(rf"\p{{{kind}}}", rf"[\p{{{kind}}}--[{listed}]]" if listed else rf"\p{{{kind}}}")
        self._new_pieces = regex.compile(pattern, regex.VERSION1).findall
        self._cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        self._marks = tuple(self.special)

    def pieces(self, text: str) -> list[str]:
        """Pieces of a text in order; special strings are pieces of their own."""
        if any(mark in text for mark in self._marks):
            parts = self._cut(text)
            return [p for i, part in enumerate(parts) for p in ([part] if i % 2 else self._plain(part))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        # Lower case is taken letter by letter: a capital sigma has one form at every place.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if text.isascii() or np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").max() < self._newest:
            return self._pieces(text)
        return self._new_pieces(text.translate(self._capitals))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, over one index of all their distinct pieces."""
        numbers = _Numbered()
        numbered = [np.fromiter(map(numbers.__getitem__, self.pieces(t)), np.int32) for t in texts]
        encoded = self._encode_pieces(list(numbers))
        return [b"".join(map(encoded.__getitem__, row.tolist())) for row in numbered]

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        raw = [b"" if p in self.special else p.encode("utf-8") for p in pieces]
        lengths = np.array([len(r) for r in raw], dtype=np.int64)
        octets = np.frombuffer(b"".join(raw), dtype=np.uint8)
        symbols = self._inner[octets]
        full = lengths > 0
        last = np.cumsum(lengths)[full] - 1
        symbols[last] = self._last[octets[last]]
        ids, counts = self.merger.merge(symbols, lengths[full])
        buffer = ids.astype("<u4").tobytes()
        sizes = np.zeros(len(raw), dtype=np.int64)
        sizes[full] = 4 * counts
        ends = np.cumsum(sizes).tolist()
        return [
            buffer[end - size : end] if size else self.special[piece].to_bytes(4, "little")
            for piece, end, size in zip(pieces, ends, sizes.tolist(), strict=True)
        ]

    def decode(self, ids: bytes | None) -> str:
        """The text of ids: their strings, a space between them (the file names no decoder)."""
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids or b"", dtype="<u4").tolist()))


@functools.cache
def loaded(path: str) -> WordBpe:
    return WordBpe(path)


def encode(text: Column, path: str) -> Column:
    """Ids of each text as BINARY."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder, waiting, held = loaded(path), [], 0
        for batch in batches:
            waiting.append(["" if t is None else t for t in batch])
            held += sum(map(len, waiting[-1]))
            if held >= CHUNK_CHARS:
                yield from _encoded(coder, waiting)
                waiting, held = [], 0
        yield from _encoded(coder, waiting)

    return F.pandas_udf(run, BinaryType())(text)


def _encoded(coder: WordBpe, batches: list[list[str]]) -> Iterator[pd.Series]:
    ids = iter(coder.encode([text for batch in batches for text in batch]))
    for batch in batches:
        yield pd.Series([next(ids) for _ in batch], dtype=object)


def decode(ids: Column, path: str) -> Column:
    """Text of each row of ids."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = loaded(path)
        for batch in batches:
            yield pd.Series([coder.decode(row) for row in batch], dtype=object)

    return F.pandas_udf(run, StringType())(ids)


def n_tokens(ids: Column) -> Column:
    return F.floor(F.octet_length(ids) / 4).cast("bigint")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, and digests of the ids and of the text decoded from them."""
    path = path or public_tokenizers.path(DEFAULT_FILE)
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", encode(F.col("text"), path).alias("ids"))
    rows = rows.withColumn("decoded", decode(F.col("ids"), path))
    return rows.select(
        "doc_id",
        n_tokens(F.col("ids")).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
