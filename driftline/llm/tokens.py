"""Exact byte-level BPE by prefix dynamic programming.

For every prefix of a byte string the encoding by the merge rules is unique, hence so is its last token.  The
table of these last tokens is filled from left to right: a token may follow a prefix exactly when it is
compatible with that prefix's last token, i.e. when no merge across their border would have come before the
merges that made the two.  Following the table backwards gives the encoding of *any* prefix, so appending text
continues the table and an edit only needs the table rewritten until it falls in step again.

Texts are first cut by the tokenizer's pattern.  Pieces recur, so each worker keeps the ids of those already met in a
bounded cache.
"""

from __future__ import annotations

import base64
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

DEFAULT_VOCABULARY = "byte_bpe_50k"
#: Folder of the public vocabulary files; a parameter of every function.
DEFAULT_FOLDER = os.environ.get("TOKENIZER_FOLDER", "/opt/tokenizers")
# The pattern by which the vocabulary's texts are cut, with white space spelled out.
WHITE = r"\t-\r \x85\xa0  -     　"
PATTERN = (
    r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^" + WHITE + r"\p{L}\p{N}]+"
    r"|[" + WHITE + r"]+(?![^" + WHITE + r"])|[" + WHITE + r"]+"
)
PLAIN_PATTERN = (
    PATTERN.replace(r"[^" + WHITE + r"\p{L}\p{N}]", r"(?:[^" + WHITE + r"\w]|_)")
    .replace(r"\p{L}", r"[^\W\d_]")
    .replace(r"\p{N}", r"\d")
)
MAX_CACHED = 400_000
MAX_CACHED_CHARS = 256


class Vocabulary:
    """Tokens, merges and the compatibility test of a byte-level BPE vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        #: id of each token, and -1 for byte strings with which only longer tokens begin
        self.table = {b[:n]: -1 for b in ranks for n in range(1, len(b) + 1)} | ranks
        self._pair_rank: dict[int, int] = {}
        self._parts: dict[int, tuple[int, int]] = {}
        for token, rank in ranks.items():
            if len(token) > 1:
                pair = self._made_from(token, rank)
                if pair is not None:
                    self._parts[rank] = pair
                    self._pair_rank[pair[0] << 20 | pair[1]] = rank
        self._fits: dict[int, bool] = {}
        #: tokens that are the encoding of their own bytes
        self.whole = {b: i for b, i in ranks.items() if len(b) == 1 or i in self._parts}

    def _made_from(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives ``token``, by applying the earlier merges to its bytes."""
        ranks, parts = self.ranks, [bytes([b]) for b in token]
        while len(parts) > 2:
            best, at = rank, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1], rank)
                if r < best:
                    best, at = r, i
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (ranks[parts[0]], ranks[parts[1]])

    def fits(self, a: int, b: int) -> bool:
        """Whether the encoding of the joined bytes of ``a`` and ``b`` is [a, b].

        Goes back through the merges that made the two, the latest first; at each moment two tokens stand at the
        border, and they must not have been merged before one of them went into a larger token.
        """
        known = self._fits.get(a << 20 | b)
        if known is None:
            pair, parts, p, q = self._pair_rank.get, self._parts.get, a, b
            ended_p = ended_q = 1 << 30
            known = True
            while True:
                r = pair(p << 20 | q)
                # of equal ranks the merge further left comes first
                if r is not None and r < ended_p and r <= ended_q:
                    known = False
                    break
                of_p, of_q = parts(p), parts(q)
                if of_p is not None and (of_q is None or p > q):
                    ended_p, p = p, of_p[1]
                elif of_q is not None:
                    ended_q, q = q, of_q[0]
                else:
                    break
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            self._fits[a << 20 | b] = known
        return known

    def encode(self, data: bytes) -> list[int]:
        """Encoding of a byte string: its table of last tokens, followed backwards."""
        one = self.whole.get(data)
        if one is not None:
            return [one]
        n = len(data)
        last = self.fill([-1] + [-2] * n, data, 0, n)
        out, at, size = [], n, self.bytes_of
        while at > 0:
            t = last[at]
            out.append(t)
            at -= len(size[t])
        return out[::-1]

    def fill(self, last: list[int], data: bytes, start: int, stop: int) -> list[int]:
        """Sets last[start + 1 .. stop] (-2 where unknown) from the entries up to ``start``."""
        table, known, fits = self.table.get, self._fits.get, self.fits
        for s in range(max(0, start - self.longest + 1), stop):
            before = last[s]
            for e in range(s + 1, stop + 1):
                t = table(data[s:e])
                if t is None:
                    break
                if t >= 0 and last[e] == -2 and e > start:
                    fit = before == -1 or known(before << 20 | t)
                    if fit is None:
                        fit = fits(before, t)
                    if fit:
                        last[e] = t
        return last


class PrefixTable:
    """Last tokens of all prefixes of a byte string; grows by ``append`` and is patched by ``edit``."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data = vocabulary, b""
        self.last: list[int] = [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        start = len(self.data)
        self.data += more
        self.last += [-2] * len(more)
        self.vocabulary.fill(self.last, self.data, start, len(self.data))

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Replaces data[start:stop]; gives the number of table entries that had to be computed again."""
        tail, old_tail = self.data[stop:], self.last[stop + 1 :]
        self.data = self.data[:start] + new + tail
        self.last = self.last[: start + 1] + [-2] * (len(new) + len(tail))
        done, step, shift = start, 64, len(new) - (stop - start)
        reach = self.vocabulary.longest  # as many equal entries in a row and the rest is as before
        while done < len(self.data):
            to = min(len(self.data), done + step)
            self.vocabulary.fill(self.last, self.data, done, to)
            done, agreed = to, 0
            for i in range(to, start + len(new), -1):
                old = i - shift - stop - 1
                if old < 0 or self.last[i] != old_tail[old]:
                    break
                agreed += 1
            if agreed >= reach:
                self.last[done + 1 :] = old_tail[done - shift - stop :]
                break
        return done - start

    def ids(self, length: int | None = None) -> list[int]:
        """Encoding of the first ``length`` bytes (all by default)."""
        out, at, size = [], len(self.data) if length is None else length, self.vocabulary.bytes_of
        while at > 0:
            t = self.last[at]
            out.append(t)
            at -= len(size[t])
        return out[::-1]


#: Numbers other than decimal digits; to the standard engine they are word characters but no digits.
ODD_NUMBERS = frozenset(c for c in map(chr, range(0x20000)) if unicodedata.category(c) in ("Nl", "No"))


class _Pieces(dict):
    """Ids (as bytes of 32-bit integers) of the pieces met so far; a missing one is encoded by its prefix table."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, text: str) -> bytes:
        ids = array("i", self.vocabulary.encode(text.encode("utf-8", "surrogatepass"))).tobytes()
        if len(text) <= MAX_CACHED_CHARS:
            if len(self) >= MAX_CACHED:
                self.clear()
            self[text] = ids
        return ids


_LOADED: dict[tuple[str, str], Encoder] = {}


class Encoder:
    """Texts to ids: pattern, then the prefix table of each distinct piece."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._any, self._plain = regex.compile(PATTERN).findall, re.compile(PLAIN_PATTERN).findall
        self.pieces = _Pieces(vocabulary)

    @classmethod
    def load(cls, name: str = DEFAULT_VOCABULARY, folder: str = DEFAULT_FOLDER) -> Encoder:
        """The encoder of a vocabulary file, once per process."""
        if (name, folder) not in _LOADED:
            with open(f"{folder}/{name}.tiktoken", "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            _LOADED[name, folder] = cls(Vocabulary(ranks))
        return _LOADED[name, folder]

    def split(self, text: str) -> list[str]:
        """Pieces of a text.  The faster standard engine knows no classes of letters and numbers, but without
        numbers that are no decimal digits its word characters are the same."""
        return (self._plain if text.isascii() or ODD_NUMBERS.isdisjoint(text) else self._any)(text)

    @staticmethod
    def stretches_of(text: str) -> Iterator[str]:
        """Cuts before every blank with no white space beside it: there the pattern cuts in any case."""
        parts = text.split(" ")
        held = parts[0]
        for p in parts[1:]:
            if p and held and not p[0].isspace() and not held[-1].isspace():
                yield held
                held = " " + p
            else:
                held += " " + p
        yield held

    def packed(self, text: str | None) -> bytes:
        """Ids of a text as bytes of 32-bit integers; empty for empty and null texts."""
        return b"".join(map(self.pieces.__getitem__, self.split(text))) if text else b""

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), dtype=np.int32).tolist()


class TokenTape:
    """An encoded text that follows appends and edits by encoding again only near the change."""

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.parts = encoder, []
        self.append(text)

    @property
    def text(self) -> str:
        return "".join(self.parts)

    def append(self, more: str) -> int:
        """Gives the number of characters encoded again."""
        held = self.parts.pop() if self.parts else ""
        new = [s for s in self.encoder.stretches_of(held + more) if s]
        self.parts += new
        return len(held) + len(more)

    def edit(self, start: int, stop: int, new: str) -> int:
        """Replaces text[start:stop]; gives the number of characters encoded again."""
        at, first = 0, 0
        while first < len(self.parts) and at + len(self.parts[first]) < start:
            at += len(self.parts[first])
            first += 1
        first, at = (first - 1, at - len(self.parts[first - 1])) if first else (0, 0)
        last, end = first, at
        while last < len(self.parts) and end <= stop:
            end += len(self.parts[last])
            last += 1
        if last < len(self.parts):
            end += len(self.parts[last])
            last += 1
        old = "".join(self.parts[first:last])
        fresh = old[: start - at] + new + old[stop - at :]
        self.parts[first:last] = [s for s in self.encoder.stretches_of(fresh) if s]
        return len(fresh)

    def ids(self) -> list[int]:
        return [i for s in self.parts for i in self.encoder.encode(s)]


def encode_documents(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = DEFAULT_VOCABULARY,
    folder: str = DEFAULT_FOLDER,
) -> DataFrame:
    """``id_col`` and ``ids`` (array<int>) of every row, without special tokens.

    A narrow pass: no shuffle, whole texts, one row out per row in (repeated rows stay repeated).
    Empty and null texts give an empty list; the strings of special tokens are ordinary text; further columns
    are ignored.
    """

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.load(vocabulary, folder)
        for b in batches:
            ids = [encoder.packed(text) for text in b.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int64) // 4
            values = pa.array(np.frombuffer(b"".join(ids), dtype=np.int32))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(f, f"`{id_col}` {kind}, ids array<int>")


def count_tokens(
    docs: DataFrame,
    keep: list[str],
    *,
    text_col: str = "text",
    vocabulary: str = DEFAULT_VOCABULARY,
    folder: str = DEFAULT_FOLDER,
) -> DataFrame:
    """The columns ``keep`` and ``tokens`` (bigint), the number of ids of the row's text; 0 for empty and null texts."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.load(vocabulary, folder)
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            n = [len(encoder.packed(t)) // 4 for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*keep, "tokens"])

    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return docs.select(*keep, docs[text_col].alias("__text")).mapInArrow(f, f"{schema}, tokens bigint")
