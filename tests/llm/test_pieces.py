from __future__ import annotations

import hashlib

import cases
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from flowloom.llm import pieces, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")
TABLE = pieces.PieceTable()
ODD = [
    "", " ", "a  b", "  a", "a\tb\n", "a▁b", "a ", "x\0y", "é中𐍈", "</s> <s>a<unk>", "   ", "\n",
    "﻿a", "▁▁", "▁ a", " ▁", "x" * 3000, "a b", "ﬁ Å ½", "<0x41> <0xC3>", "\U0010ffff",
]


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


def _lists(ids, bounds):
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(" ▁ab\té中𐍈<s>.\n0") | st.characters(codec="utf-8"), max_size=60)))
def test_ids_and_texts_equal_the_librarys(batch):
    table = TABLE
    ids, bounds = table.encode(batch + ODD, 2)
    want = table.model.encode(batch + ODD, add_eos=True)
    assert _lists(ids, bounds) == want
    assert table.decode(ids, bounds) == [table.model.decode(w) for w in want]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 31_999) | st.integers(3, 258) | st.integers(190, 258), max_size=12))
def test_any_ids_decode_as_the_library_does(ids):
    table = TABLE
    got = table.decode(np.array(ids, np.int32), np.array([0, len(ids)]))
    assert got == [table.model.decode(ids)]


def test_each_word_is_segmented_once_and_the_table_starts_anew(library):
    table = pieces.PieceTable(PATH, 3)
    asked = []
    encode = table.model.encode
    table.model = type("Counting", (), {"encode": lambda s, w, **k: asked.extend(w) or encode(w, **k)})()
    table.encode(["one two one", "two  two"], None)
    assert sorted(asked) == ["one", "two", "▁two"]
    table.encode(["one four"], None)
    assert asked[3:] == ["four"]
    ids, bounds = table.encode(["one five one"], None)
    assert asked[4:] == ["one", "five"] and _lists(ids, bounds) == library.encode(["one five one"])


def test_vocabularies_whose_pieces_cross_markers_take_whole_texts(library):
    table = pieces.PieceTable(PATH, 100)
    table.apart = False
    ids, bounds = table.encode(ODD, 2)
    assert _lists(ids, bounds) == library.encode(ODD, add_eos=True)


def test_awkward_rows(spark, library):
    docs = cases.documents(spark).repartition(3)
    rows = pieces.decode(pieces.encode(docs, most_words=50)).collect()
    want = sorted((repr(r[0]), library.encode(r[1] or "", add_eos=True)) for r in cases.ROWS)
    assert sorted((repr(r.doc_id), r.ids) for r in rows) == want
    assert sorted(r.text for r in rows) == sorted(library.decode(w[1]) for w in want)
    assert pieces.decode(pieces.encode(cases.empty(spark))).count() == 0
    none = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [(r.ids, r.text) for r in pieces.decode(none).collect()] == [([], "")] * 2


def test_query_equals_the_library(spark, library):
    found = {r.doc_id: r for r in queries.op11_pieces(spark, cases.SF).collect()}
    docs = spark.read.parquet(f"{cases.SF}/documents.parquet").collect()
    assert len(found) == len(docs)
    for doc in docs:
        ids = library.encode(doc.text or "", add_eos=True)
        row = found[doc.doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
