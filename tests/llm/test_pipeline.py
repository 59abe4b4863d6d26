"""The stages one after another, each against its decision by brute force."""

from __future__ import annotations

import re

import cases
import corpus_pipeline
from test_near_dedup import _brute

from flowloom.llm import decontaminate, queries
from flowloom.llm.common import table

SF = cases.SF


def test_stages_and_their_decisions(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality", "exact_dedup", "near_dedup", "decontamination", "packing"
    ]

    good = stage["quality"](spark, docs, SF).cache()
    wanted = {r.doc_id for r in queries.op2_quality(spark, SF).collect() if r.predicted}
    assert good.columns == columns and {r.doc_id for r in good.collect()} == wanted

    distinct = stage["exact_dedup"](spark, good, SF).cache()
    first = {}
    for r in good.collect():
        plain = re.sub(r"[\x20\x09-\x0D]+", " ", r.text)
        first[plain] = min(first.get(plain, r.doc_id), r.doc_id)
    assert distinct.columns == columns
    assert {r.doc_id for r in distinct.collect()} == set(first.values())

    apart = stage["near_dedup"](spark, distinct, SF).cache()
    brute = _brute([(r.doc_id, r.text) for r in distinct.collect()])
    assert apart.columns == columns
    assert {r.doc_id for r in apart.collect()} == {i for i, (_, root) in brute.items() if i == root}

    clean = stage["decontamination"](spark, apart, SF).cache()
    phrases = set()
    for r in table(spark, SF, "benchmark").collect():
        words = decontaminate.words_of(r.text.encode())
        phrases |= {tuple(words[i : i + 10]) for i in range(max(len(words) - 10, 0) + 1)}
    sizes = {len(p) for p in phrases}

    def dirty(text):
        words = decontaminate.words_of(text.encode())
        return any(tuple(words[i : i + n]) in phrases for n in sizes for i in range(len(words)))

    assert clean.columns == columns
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in apart.collect() if not dirty(r.text)}

    packed = stage["packing"](spark, clean, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in clean.collect()}
    tokens = {r.doc_id: r.doc_tokens for r in packed}
    assert sum(r.length for r in packed) == sum(tokens.values())

    whole = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in whole} == set(tokens)


def test_awkward_rows_pass_every_stage(spark):
    docs = cases.documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        for source in (docs, cases.empty(spark)):
            out = stage(spark, source, SF)
            rows = out.collect()
            assert name == "packing" or out.columns == docs.columns
            if source is not docs:
                assert rows == []
            elif name == "exact_dedup":
                assert {r.doc_id for r in rows} == {1, 3, 5, 6, 8, 9, 11, 12, 13, None}
            elif name == "near_dedup":
                assert 7 not in {r.doc_id for r in rows} and 4 in {r.doc_id for r in rows}
