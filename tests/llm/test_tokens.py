"""Cached encoding, records and packing against the library on whole texts."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granary.llm import packing, token_records
from granary.llm.common import shared_folder
from granary.llm.tokens import PieceEncoder, vocabulary
from tokenizers import Tokenizer

VOCABULARIES = [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)]
ENCODERS = {n: PieceEncoder(vocabulary(n), s, cache_entries=300) for n, s in VOCABULARIES}
FRESH = {n: Tokenizer.from_file(vocabulary(n)) for n, _ in VOCABULARIES}  # as the contract calls it: no setting changed
PARTS = ["<|startoftext|>", "<|EndOfText|>", "<|", "endoftext", "a", "B", "the", " ", "  ", "\n", "\n\n", "\t", ".", ",", "é", "ß", "İ", "Σ", "ς", "ª", "1", "23", "'s", "'", " ", "　", "é", "中", "😀", "\x01", "\r", "-", "<|endoftext|>"]


@pytest.mark.parametrize("name", list(ENCODERS))
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(PARTS), max_size=25).map("".join) | st.text(max_size=30), max_size=8))
def test_equals_the_library(name, texts):
    got = [np.frombuffer(x, "<u4").tolist() for x in ENCODERS[name].encode_many(texts)]
    assert got == [FRESH[name].encode(t, add_special_tokens=False).ids for t in texts]


def test_literals_of_added_tokens():
    for name, end in (("word_bpe_49k.json", 49407), ("byte_bpe_50k.json", 50256)):
        assert end in np.frombuffer(ENCODERS[name].encode("a <|endoftext|> b"), "<u4")


def whole(name, text, end):
    return np.array([*FRESH[name].encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize("records", [token_records.RECORDS, 7])
def test_records_hold_all_ids_in_order(spark, docs, corpus, monkeypatch, records):
    monkeypatch.setattr(token_records, "RECORDS", records)
    folder = shared_folder(spark)
    token_records.write_records(docs, folder)
    index = token_records.scan_records(spark, folder)
    got = {r.doc_id: r for r in token_records.with_starts(index).collect()}
    start = 0
    for doc_id, text in sorted(corpus):
        ids = whole("byte_bpe_50k.json", text, 0)
        r = got[doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    some = index.where("doc_id in (0, 300, 306)").orderBy(F.rand(3))
    read = {r.doc_id: r.ids for r in token_records.read_records(spark, folder, some).collect()}
    assert {i: list(whole("byte_bpe_50k.json", dict(corpus)[i], 0)) for i in (0, 300, 306)} == read


def test_damage_is_found():
    data = bytearray(token_records.frame(7, np.arange(9, dtype="<u4").tobytes(), True) + b"\n")  # as the writer ends it
    doc_id, ids, end = token_records.unframe(bytes(data), 0)
    assert (doc_id, ids.tolist(), end) == (7, list(range(9)), len(data))
    for at in (0, 9, 20, len(data) - 4):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            token_records.unframe(bytes(bad), 0)


def test_records_keep_null_ids_and_empty_tables(spark, nothing):
    folder = shared_folder(spark)
    token_records.write_records(spark.createDataFrame([(None, "x y"), (3, None), (3, None)], "doc_id long, text string"), folder)
    rows = token_records.scan_records(spark, folder).orderBy("path", "offset").collect()
    assert [r.doc_id for r in rows] == [None, 3, 3] and rows[1].n_tokens == 1
    empty = shared_folder(spark)
    token_records.write_records(nothing, empty)
    assert token_records.scan_records(spark, empty).count() == 0


def check_packing(rows, corpus):
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for doc_id, text in corpus:
        ids, at = whole("word_bpe_49k.json", text, 1), 0
        for r in sorted(by[doc_id], key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes()) and r.doc_tokens == len(ids)
            at += r.length
        assert at == len(ids)
    seq = {}
    for r in rows:
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    padded = 0
    for parts in seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        padded += 0 if at & (at - 1) == 0 else 2048 - at
    return padded / sum(r.length for r in rows)


def test_packing_keeps_every_id_once(spark, docs, corpus):
    packed = packing.pack_documents(docs, shared_folder(spark))
    rows = packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset").collect()
    assert check_packing(rows, corpus) < 0.01


def test_packing_of_nothing_and_cuts(spark, nothing):
    assert packing.pack_documents(nothing, shared_folder(spark)).count() == 0
    big = 9_007_199_254_740_993  # beyond a double's integers, beside a null
    rows = packing.pack_documents(spark.createDataFrame([(big, "a b c"), (None, "d <|endoftext|>"), (5, None)], "doc_id long, text string"), shared_folder(spark)).collect()
    assert {r.doc_id for r in rows} == {big, None, 5}
    rng = random.Random(2)
    for n in [0, 1, 63, 64, 2047, 2048, 2049, *(rng.randint(0, 90_000) for _ in range(200))]:
        parts = packing.cuts(n, 2048, 64)
        assert sum(parts) == n and all(x == 2048 or x < 64 or x & (x - 1) == 0 for x in parts)
        assert all(x & (x - 1) == 0 for x in packing.binary_cuts(n, 2048))
