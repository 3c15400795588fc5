"""Encoding texts by a public byte-level BPE, fragment by fragment.

Forced boundaries: a pair of neighbouring bytes that occurs inside no token of the vocabulary can
never be merged over, so the text may be cut there and the fragments encoded on their own; the
concatenated ids equal those of the whole text. The pre-tokenizer looks beyond a cut in two cases
only, so two kinds of place are no cut: after white space (a run's last character joins the next
word) and before an apostrophe (it may start a contraction).

In the vocabulary used here nothing but white space ever precedes a space inside a token, so each
space after another character is a forced boundary. Most fragments are thus words, which recur;
each worker encodes a distinct fragment once and looks the others up.

Null and empty texts get an empty list of ids. Texts are encoded whole, however long.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the public pre-tokenizer pattern of the byte_bpe_50k vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space of Unicode and the four separators that Python also counts as such.
SPACES = np.array([c for c in range(0x3001) if chr(c).isspace()], dtype=np.uint32)
CACHED = 400_000


def pairs_inside(tokens: Iterable[bytes]) -> np.ndarray:
    """Which of the 65,536 byte pairs occur inside some token."""
    inside = np.zeros(65536, dtype=bool)
    for t in tokens:
        b = np.frombuffer(t, dtype=np.uint8).astype(np.int64)
        inside[b[:-1] * 256 + b[1:]] = True
    return inside


def only_space_before_space(tokens: Iterable[bytes]) -> bool:
    """Whether nothing but a white-space character ever precedes a space inside a token."""
    spaces = tuple(chr(c).encode() for c in SPACES.tolist())
    return all(t[:i].endswith(spaces) for t in tokens for i in range(1, len(t)) if t[i] == 32)


class _Fragments(dict):
    """Ids by fragment; what is not known is encoded. Emptied when full, which costs time and changes no result."""

    def __init__(self, encode, lead: str) -> None:
        super().__init__()
        self.encode, self.lead = encode, lead

    def __missing__(self, fragment: str) -> tuple[int, ...]:
        ids = tuple(self.encode(self.lead + fragment))
        if len(fragment) <= 40:
            if len(self) >= CACHED:
                self.clear()
            self[fragment] = ids
        return ids


class Encoder:
    """Encodes texts by the ranks of a vocabulary file."""

    def __init__(self, ranks_file: str) -> None:
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bpe = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.inside = pairs_inside(ranks)
        self.space_cuts = only_space_before_space(ranks)
        self.unsafe = re.compile(r"\s ").search
        self.first, self.spaced = _Fragments(self.by_cuts, ""), _Fragments(self.by_cuts, " ")

    def cuts(self, text: str) -> list[int]:
        """Places of ``text`` where it may be cut."""
        cp = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        last = np.where(cp < 0x80, cp, 0x80 | (cp & 0x3F))
        lead = np.select([cp < 0x80, cp < 0x800, cp < 0x10000], [cp, 0xC0 | (cp >> 6), 0xE0 | (cp >> 12)], 0xF0 | (cp >> 18))
        ok = ~self.inside[last[:-1].astype(np.int64) * 256 + lead[1:]]
        ok &= ~np.isin(cp[:-1], SPACES) & (cp[1:] != 39)
        return (np.flatnonzero(ok) + 1).tolist()

    def by_cuts(self, text: str) -> list[int]:
        """Ids of ``text``; a long one is first cut at all forced boundaries."""
        if len(text) < 64:
            return self.bpe.encode_ordinary(text)
        at = [0, *self.cuts(text), len(text)]
        return list(chain.from_iterable(self.bpe.encode_ordinary(text[i:j]) for i, j in zip(at, at[1:])))

    def fragments(self, text: str) -> Iterator[tuple[int, ...]]:
        """The ids of ``text``, fragment by fragment."""
        if not self.space_cuts or self.unsafe(text):
            return iter((self.by_cuts(text),))
        parts = text.split(" ")
        return chain((self.first[parts[0]],), map(self.spaced.__getitem__, parts[1:]))


_encoders: dict[str, Encoder] = {}


def encoder(ranks_file: str) -> Encoder:
    """The worker's encoder for a file."""
    if ranks_file not in _encoders:
        _encoders[ranks_file] = Encoder(ranks_file)
    return _encoders[ranks_file]


def encode(df: DataFrame, key: str, text: str, *, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``key`` and ``ids`` (ARRAY<INT>) of each row of ``df``."""
    ranks_file = f"{folder}/{name}.tiktoken"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_file)
        for batch in batches:
            flat, ends = array("i"), array("i", [0])
            for t in batch.column(1).to_pylist():
                if t:
                    flat.extend(chain.from_iterable(enc.fragments(t)))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, dtype=np.int32)), pa.array(np.frombuffer(flat, dtype=np.int32) if flat else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(df: DataFrame, key: str, text: str, *, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``key`` and ``tokens`` (BIGINT) of each row of ``df``; 0 for null and empty texts."""
    ranks_file = f"{folder}/{name}.tiktoken"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_file)
        for batch in batches:
            n = [sum(map(len, enc.fragments(t))) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=[key, "tokens"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, f"`{key}` {kind}, tokens bigint")
