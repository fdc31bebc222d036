"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie.

A model file gives pieces with log scores. Normalised text is cut before each run of whitespace markers, where no
piece goes across; each distinct segment is solved once by Viterbi over the pieces that start at each character. A
character that no piece covers costs the least score less ``UNKNOWN_COST``, and is written as its UTF-8 bytes where
the model has byte pieces, else as the unknown piece. On equal scores the earlier start of the last piece wins.

Decoding joins pieces, turns runs of byte pieces back into characters (invalid bytes become U+FFFD), turns
markers into spaces and drops the one space that encoding put in front.

Only models whose normaliser maps nothing are accepted; whitespace flags are honoured. Nulls: a null text gives null
ids and null text; an empty text gives no ids. Very long texts are one row; their segments are cached with a
bound. Repeated rows are encoded each. Other columns are ignored.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokens import slices, vocabulary

MARK = "▁"
UNKNOWN_COST = 10.0
CACHE_ENTRIES = 300_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Field numbers and values of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + size]
            at += size


@dataclass
class DoubleArray:
    """A trie over bytes: the child of state s by byte b is t = base[s] + b + 1 where check[t] = s."""

    base: list[int] = field(default_factory=list)
    check: list[int] = field(default_factory=list)
    value: list[int] = field(default_factory=list)

    @classmethod
    def of(cls, keys: dict[bytes, int]) -> DoubleArray:
        root: dict = {}
        for key, value in keys.items():
            node = root
            for byte in key:
                node = node.setdefault(byte, {})
            node[-1] = value
        size = 1 << 12
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0] = -2
        todo, search = [(0, root)], 1
        while todo:
            state, node = todo.pop()
            value[state] = node.get(-1, -1)
            children = sorted(b for b in node if b >= 0)
            if not children:
                continue
            at, tried, first, last = max(search, children[0] + 1), 0, children[0], children[-1]
            while True:
                if at - first + last + 1 > len(check):
                    base += [0] * len(check)
                    value += [-1] * len(value)
                    check += [-1] * len(check)
                if check[at] == -1:
                    start = at - first - 1
                    if all(check[start + b + 1] == -1 for b in children):
                        break
                at, tried = at + 1, tried + 1
            if tried > 64:  # what lies before is nearly full: later searches start here
                search = at - 32
            base[state] = start
            for b in children:
                check[start + b + 1] = state
                todo.append((start + b + 1, node[b]))
        # a state's base plus any byte stays inside the arrays
        pad = max(0, max(base) + 258 - len(check))
        return cls(base + [0] * pad, check + [-1] * pad, value + [-1] * pad)


@dataclass
class Model:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    dummy_prefix: bool = True
    squeeze: bool = False
    trie: DoubleArray = field(default_factory=DoubleArray)
    bytes_at: list[int] = field(default_factory=list)
    unknown: int = 0
    unknown_score: float = 0.0
    crossing: bool = False
    apart: str = ""

    @classmethod
    def parse(cls, data: bytes) -> Model:
        pieces, scores, kinds, spec = [], [], [], {3: 1, 4: 1}
        for number, value in _fields(data):
            if number == 1:
                one = dict(_fields(value))
                pieces.append(one[1].decode())
                scores.append(struct.unpack("<f", one.get(2, b"\0\0\0\0"))[0])
                kinds.append(one.get(3, NORMAL))
            elif number == 3:
                spec |= dict(_fields(value))
        if spec.get(2):
            raise ValueError("the model's normaliser maps characters, which is not supported")
        return cls(pieces, scores, kinds, bool(spec[3]), bool(spec[4])).ready()

    def ready(self) -> Model:
        usable = [i for i, k in enumerate(self.kinds) if k in (NORMAL, USER)]
        self.trie = DoubleArray.of({self.pieces[i].encode(): i for i in usable})
        self.unknown = self.kinds.index(UNKNOWN)
        self.unknown_score = min(self.scores[i] for i in usable) - UNKNOWN_COST
        at = {self.pieces[i]: i for i, k in enumerate(self.kinds) if k == BYTE}
        self.bytes_at = [at[f"<0x{b:02X}>"] for b in range(256)] if len(at) == 256 else []
        self.crossing = any(MARK in self.pieces[i].lstrip(MARK) for i in usable)
        # marks that no piece holds behind a letter: a word and such a mark are best cut between them
        behind = {b for i in usable for a, b in zip(self.pieces[i], self.pieces[i][1:]) if a.isalpha()}
        self.apart = "".join(c for c in ".,!?;:" if c not in behind)
        return self


class Codec:
    def __init__(self, model: Model, cache_entries: int = CACHE_ENTRIES):
        self.model, self._limit, self._known = model, cache_entries, {}
        self._segments = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self._text = [p if k != BYTE else None for p, k in zip(model.pieces, model.kinds)]
        self._text = [" ⁇ " if k == UNKNOWN else "" if k == CONTROL else t for t, k in zip(self._text, model.kinds)]
        self._byte = {i: b for b, i in enumerate(model.bytes_at)}

    def viterbi(self, segment: str) -> list[int]:
        data, m = segment.encode(), self.model
        base, check, value, scores = m.trie.base, m.trie.check, m.trie.value, m.scores
        n = len(data)
        best, start, piece = [float("-inf")] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            first = data[i]
            if first & 0xC0 == 0x80:
                continue
            width = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            here, state, covered, j = best[i], 0, False, i
            while j < n:
                t = base[state] + data[j] + 1
                if check[t] != state:
                    break
                state, j = t, j + 1
                v = value[state]
                if v >= 0:
                    covered |= j - i == width
                    score = here + scores[v]
                    if score > best[j]:
                        best[j], start[j], piece[j] = score, i, v
            if not covered and here + m.unknown_score > best[i + width]:
                best[i + width], start[i + width], piece[i + width] = here + m.unknown_score, i, -1
        out: list[int] = []
        end = n
        while end:
            i, v = start[end], piece[end]
            if v >= 0:
                out.append(v)
            elif m.bytes_at:
                out += [m.bytes_at[b] for b in reversed(data[i:end])]
            elif not out or out[-1] != m.unknown:  # a run of unknown characters is one unknown piece
                out.append(m.unknown)
            end = i
        return out[::-1]

    def normal(self, text: str) -> str:
        if self.model.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (MARK if self.model.dummy_prefix else "") + text.replace(" ", MARK)

    def encode(self, text: str) -> bytes:
        """Ids as native 32-bit integers."""
        text = self.normal(text)
        if not text:
            return b""
        if self.model.crossing:
            return array("i", self.viterbi(text)).tobytes()
        words = text[1:].split(MARK) if text[0] == MARK else None
        if words is None or "" in words:
            words = self._segments.findall(text)
        else:
            words = [MARK + w for w in words]
        known = self._known
        for w in set(words).difference(known):
            known[w] = self._segment(w)
        out = b"".join(map(known.__getitem__, words))
        if len(known) > self._limit:  # frequent segments come early
            self._known = dict(islice(known.items(), self._limit // 2))
        return out

    def _segment(self, w: str) -> bytes:
        if w[-1] in self.model.apart and len(w) > 1 and w[-2].isalpha():
            stem = self._known.get(w[:-1])
            if stem is None:
                stem = self._known[w[:-1]] = array("i", self.viterbi(w[:-1])).tobytes()
            return stem + array("i", self.viterbi(w[-1])).tobytes()
        return array("i", self.viterbi(w)).tobytes()

    def decode(self, ids: list[int]) -> str:
        parts = list(map(self._text.__getitem__, ids))
        lead = next((p for p in parts if p != ""), None)
        prefixed = self.model.dummy_prefix and lead is not None and lead.startswith(MARK)
        if None in parts:
            joined, run = [], bytearray()
            for i, part in zip(ids, parts):
                if part is None:
                    run.append(self._byte[i])
                    continue
                if run:
                    joined.append(_characters(bytes(run)))
                    run.clear()
                joined.append(part)
            parts = [*joined, _characters(bytes(run))]
        text = "".join(parts).replace(MARK, " ")
        return text[1:] if prefixed else text


def _characters(run: bytes) -> str:
    """UTF-8 with one U+FFFD for each byte that belongs to no character."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(run):
            for width in (1, 2, 3, 4):
                try:
                    out.append(run[at : at + width].decode())
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out, width = [*out, "�"], 1
            at += width
        return "".join(out)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec a worker process. The model file is small and lies on every machine, as tokenizer files do."""
    with open(vocabulary(path), "rb") as file:
        return Codec(Model.parse(file.read()))


def encoded(df: DataFrame, model: str = "piece_bpe_32k.model", decode: bool = True, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, ids (array<int>), n_ids, n_bytes (byte pieces) and, if asked for, the text decoded from the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        is_byte = np.zeros(len(c.model.pieces), bool)
        is_byte[c.model.bytes_at] = True
        for part in slices(batches, 256):
            texts = part[1].to_pylist()
            packed = [None if t is None else c.encode(t) for t in texts]
            ids = [None if x is None else np.frombuffer(x, np.int32) for x in packed]
            ends = np.cumsum([0, *(len(x or b"") // 4 for x in packed)]).astype(np.int32)
            offsets = pa.array(ends, mask=np.array([*(x is None for x in packed), False]))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(x for x in packed if x), np.int32)))
            columns = [part[0], lists, pa.array([None if x is None else len(x) for x in ids], pa.int32()), pa.array([None if x is None else int(is_byte[x].sum()) for x in ids], pa.int32())]
            if decode:
                columns.append(pa.array([None if x is None else c.decode(x.tolist()) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "n_ids", "n_bytes", "decoded"][: len(columns)])

    schema = "doc_id long, ids array<int>, n_ids int, n_bytes int" + ", decoded string" * decode
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def decoded(df: DataFrame, model: str = "piece_bpe_32k.model", ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """doc_id and text of rows of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for part in slices(batches, 256):
            yield pa.RecordBatch.from_arrays([part[0], pa.array([None if x is None else c.decode(x) for x in part[1].to_pylist()], pa.string())], ["doc_id", "text"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))
