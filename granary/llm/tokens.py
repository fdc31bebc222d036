"""Token ids as packed bytes, through the ``tokenizers`` library with a bounded cache of words.

Whole texts are cut at places that no pre-token of the vocabulary spans, each distinct piece is
encoded by the library once, and the pieces' ids are joined. A piece of Latin letters is one pre-token, so it goes
straight to the library's BPE model; all others take the library's whole chain. A text that holds the literal of an
added token (``<|endoftext|>``) is encoded whole: the library gives such a literal the token's own id. The result
equals the library's on the whole text; ``tests/llm/test_tokens.py`` holds it against a tokenizer loaded afresh.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa

CACHE_ENTRIES = 250_000


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, others follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(0x100 + i) for i, b in enumerate(rest)}


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file by name, looked up where the task runs; a path stays itself."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class _Pieces(dict):
    """Ids of pieces; a new piece is encoded when it is first looked up. Frequent pieces come early, so
    the older half stays when the bound is reached."""

    def __init__(self, encode: Callable[[str], bytes], most: int):
        super().__init__()
        self._encode, self._most = encode, most

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self._most:
            for key in list(islice(self, self._most // 2, None)):
                del self[key]
        ids = self[piece] = self._encode(piece)
        return ids


class PieceEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    ``space_prefixed``: byte-level vocabularies, where a word carries the one space before it.
    Texts with a space beside other white space are then encoded whole, because runs of white
    space make pre-tokens of their own. Otherwise white space only separates words and is dropped.
    """

    def __init__(self, path: str, space_prefixed: bool, cache_entries: int = CACHE_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already use every core
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        self._tok.no_padding()
        self._tok.no_truncation()
        self._spaced, self._lead = space_prefixed, "\u0120" if space_prefixed else ""
        self.size = self._tok.get_vocab_size(with_added_tokens=True)
        self._added = [t.content for t in self._tok.get_added_tokens_decoder().values()]
        self._mark = os.path.commonprefix(self._added)  # one search rules all of them out
        self._tokenize, self._letters = self._tok.model.tokenize, byte_letters()
        self._ends = {c: self.whole(c) for c in ".,"}
        self._line_end = self.whole("\n")
        self._inner = _Pieces(self._piece, cache_entries)  # pieces after a space
        self._first = _Pieces(self._bare, cache_entries // 8)  # pieces at the start of a text or line

    def whole(self, text: str) -> bytes:
        return array("I", self._tok.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _simple(self, word: str, lead: str) -> bytes | None:
        """Ids of Latin letters, one pre-token, with or without a full stop or comma behind, which is another."""
        end = word[-1:]
        stem = word[:-1] if end in self._ends else word
        if not stem.isalpha():
            return None
        if not self._spaced:
            stem = stem.lower()
        if not stem.isascii():
            if max(word) >= "\u0250" or "\u0130" in word:
                return None
            stem = stem.encode().decode("latin-1").translate(self._letters)
        ids = array("I", [t.id for t in self._tokenize(lead + stem)]).tobytes()
        return ids + self._ends[end] if end in self._ends else ids

    def _bare(self, word: str) -> bytes:
        ids = self._simple(word, "")
        return self.whole(word) if ids is None else ids

    def _piece(self, word: str) -> bytes | None:
        """A piece after a space; None where white space lies beside that space or the next.

        Line ends between two words are pre-tokens of their own.
        """
        ids = self._simple(word, self._lead)
        if ids is None and self._spaced:
            if not word or word[0].isspace() or word[-1].isspace():
                return None
            head, *lines = word.split("\n")
            if lines and all(lines) and not any(c.isspace() for c in word.replace("\n", "")):
                return self._line_end.join((self._inner[head], *map(self._first.__getitem__, lines)))
        if ids is None:
            ids = self.whole(" " + word if self._spaced else word)
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self._mark in text and any(t in text for t in self._added):
            return self.whole(text)
        if not self._spaced:
            return b"".join(map(self._inner.__getitem__, text.replace("\n", " ").split(" ")))
        head, *words = text.split(" ")
        if not head or head[-1].isspace():
            return self.whole(text)
        parts = [self._first[head] if "\n" not in head else self.whole(head)]
        last = words.pop() if words and words[-1][-1:].isspace() and not words[-1][0].isspace() else None
        parts += map(self._inner.__getitem__, words)
        if last is not None:
            parts.append(self.whole(" " + last))
        try:
            return b"".join(parts)
        except TypeError:  # runs of white space are pre-tokens across pieces
            return self.whole(text)

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        return [self.encode(t) for t in texts]


@lru_cache(maxsize=2)
def encoder(name: str, space_prefixed: bool) -> PieceEncoder:
    """One encoder a worker process: later tasks find its words known."""
    return PieceEncoder(vocabulary(name), space_prefixed)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller record batches: Spark's default of 10,000 long texts is much for a worker's memory.

    At the end of the task, memory that the worker has freed goes back to the system: workers stay for later tasks.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)
