"""Byte-level BPE by longest matches and backtracking.

Bytes are mapped to Latin-1, so that an Aho-Corasick automaton over all tokens finds the
longest token at any place. From the left, the longest token is taken, or the longest of
its prefixes that fits its neighbour; where none fits, the last token is taken back. Two neighbours fit if
merging their bytes by rank gives just these two, and a row of tokens that all fit is what
the merges make of the whole (each prefix has one such row, so a place that failed once
fails always). The verdict on two neighbours is kept, and the work is linear in the piece.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from callgauge.llm import rows, units

NEVER = 1 << 62
#: Verdicts on neighbours that are kept before they are forgotten.
PAIRS = 1_000_000


class Bpe:
    """The tokenizer of a rank file: lines of a base64 token and its rank."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        if any(bytes([x]) not in self.rank for x in range(256)):
            raise ValueError("the rank file lacks a byte")
        self.bytes_of = {rank: token for token, rank in self.rank.items()}
        self.pattern = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.rank.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.size = {rank: len(token) for token, rank in self.rank.items()}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.prefix: dict[int, int | None] = {}
        self.fitting: dict[int, bool] = {}
        self.cached = units.UnitEncoder(self._encode_units)

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; None for a single byte."""
        if token not in self.halves:
            piece = [bytes([x]) for x in self.bytes_of[token]]
            while len(piece) > 2:
                ranks = [self.rank.get(a + b, NEVER) for a, b in zip(piece, piece[1:])]
                low = min(ranks)
                if low >= token:
                    raise ValueError(f"token {token} can't be made by merges of lower rank")
                k = ranks.index(low)
                piece[k : k + 2] = [piece[k] + piece[k + 1]]
            self.halves[token] = (self.rank[piece[0]], self.rank[piece[1]]) if len(piece) == 2 else None
        return self.halves[token]

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens that stand at one edge while this token is made, oldest first, each with the rank that ends it."""
        chain, until = [], NEVER
        while True:
            chain.append((token, until))
            parts = self.parts(token)
            if parts is None:
                return chain[::-1]
            until, token = token, parts[side]

    def fits(self, left: int, right: int) -> bool:
        """True if no merge over the border comes before both tokens are whole."""
        known = self.fitting.get(left << 32 | right)
        if known is None:
            known = self._fits(left, right)
            if len(self.fitting) >= PAIRS:
                self.fitting.clear()
            self.fitting[left << 32 | right] = known
        return known

    def _fits(self, left: int, right: int) -> bool:
        ends, begins = self._edge(left, 1), self._edge(right, 0)
        i = j = 0
        while True:
            (a, a_until), (b, b_until) = ends[i], begins[j]
            over = self.rank.get(self.bytes_of[a] + self.bytes_of[b], NEVER)
            # Of equal merges the leftmost comes first: the one inside left, then the one over the border.
            if over < a_until and over <= b_until and over < NEVER:
                return False
            if a_until == b_until == NEVER:
                return True
            if a_until <= b_until:
                i += 1
            else:
                j += 1

    def shorter(self, token: int) -> int | None:
        """The next longest token that this one begins with."""
        if token not in self.prefix:
            word = self.bytes_of[token]
            self.prefix[token] = next((r for k in range(len(word) - 1, 0, -1) if (r := self.rank.get(word[:k])) is not None), None)
        return self.prefix[token]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        text = piece.decode("latin-1")
        taken: list[int] = []
        fitting = self.fitting
        for _, token in self.automaton.iter_long(text):
            if taken and not (fitting.get(taken[-1] << 32 | token) or self.fits(taken[-1], token)):
                return self._backtrack(piece, text, taken)
            taken.append(token)
        return taken

    def _backtrack(self, piece: bytes, text: str, taken: list[int]) -> list[int]:
        """Go on from tokens that fit each other, of which the last has no fitting longest successor."""
        sizes, longest, n = self.size, self.automaton.iter_long, len(piece)
        dead = bytearray(n + 1)
        place = sum(sizes[token] for token in taken)
        token = next(longest(text, place))[1]
        while place < n:
            while token is not None and (dead[place + sizes[token]] or taken and not self.fits(taken[-1], token)):
                token = self.shorter(token)
            if token is None:
                dead[place] = 1
                token = taken.pop()
                place -= sizes[token]
                token = self.shorter(token)
                continue
            taken.append(token)
            place += sizes[token]
            if place < n:
                token = next(longest(text, place))[1]
        return taken

    def _encode_units(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            # A space and letters are one match of any such pattern; only others need a search.
            pieces = (text,) if text[0] == " " and text[1:].isalpha() else self.pattern.findall(text)
            ids: list[int] = []
            for piece in pieces:
                ids += self.encode_piece(piece.encode("utf-8"))
            yield packed(ids)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.cached.encode(text), dtype="<u4")

    def forget(self) -> None:
        """Give back what grew with the texts."""
        self.cached = units.UnitEncoder(self._encode_units)
        self.fitting = {}

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


def packed(ids: list[int]) -> bytes:
    values = array("I", ids)
    if sys.byteorder == "big":
        values.byteswap()
    return values.tobytes()


@cache
def tokenizer(path: str, pattern: str) -> Bpe:
    """One per Python worker."""
    return Bpe(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, keep_ids: bool = True) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns doc_id, ids (array<int>, unless keep_ids is false), n_tokens, ids_sha256 of the
    ids as little-endian unsigned 32-bit integers, and decoded_sha256 of the decoded bytes.
    A null or empty text has no ids and the digests of nothing. Repeated rows and ids give
    a row each; other columns are left out. Work is row by row: no shuffle. path is read on
    every executor.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in rows.slices(batches):
            all_ids = [bpe.encode(text or "") for text in batch.column("text").to_pylist()]
            columns = {
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array([len(ids) for ids in all_ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(ids).hexdigest() for ids in all_ids], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(bpe.decode(ids)).hexdigest() for ids in all_ids], pa.string()),
            }
            if keep_ids:
                offsets = np.cumsum([0, *map(len, all_ids)], dtype=np.int32)
                values = np.concatenate([*all_ids, np.zeros(0, "<u4")]).astype(np.int32)
                columns["ids"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_pydict(columns)
        bpe.forget()  # the worker may serve other stages

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.texts(docs).mapInArrow(work, schema + ", ids array<int>" * keep_ids)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and decoded (binary) of rows with ids; null ids give null."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            lists = batch.column("ids").to_pylist()
            out = [None if ids is None else bpe.decode(np.array(ids, dtype="<u4")) for ids in lists]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "decoded": pa.array(out, pa.binary())})

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id long, decoded binary")
