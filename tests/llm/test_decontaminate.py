from __future__ import annotations

import itertools
import random

import cases

from flowloom.llm import decontaminate as d


def _phrases(items, window):
    for item, text in items:
        words = d.words_of((text or "").encode())
        for at in range(max(len(words) - window, 0) + 1 if words else 0):
            yield str(item), words[at : at + window]


def _random_tables():
    draw = random.Random(8)
    items = [(n, " ".join(draw.choice("abcdefgh") for _ in range(draw.randrange(0, 9)))) for n in range(12)]
    docs = [(n, " ".join(draw.choice("abcdefghij") for _ in range(draw.randrange(0, 60)))) for n in range(50)]
    return docs, items


def test_phrases_equal_brute_force_in_blocks_and_segments(spark):
    docs, items = _random_tables()
    index = d.build_index(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3), segment_words=100
    )
    found = d.search(index, spark.createDataFrame(items, "item_id long, text string"), 4, most_words=10)
    got = {(r.doc_id, m.item_id, m.start, m.length) for r in found.collect() for m in r.matches}
    want = set()
    for doc_id, text in docs:
        words = d.words_of(text.encode())
        for item, phrase in _phrases(items, 4):
            for at in range(len(words) - len(phrase) + 1):
                if words[at : at + len(phrase)] == phrase:
                    want.add((doc_id, item, at, len(phrase)))
    assert got == want and want


def test_proximity_finds_all_documents_with_the_words_close(spark):
    docs, items = _random_tables()
    docs, items = docs[:20], [i for i in items if len(i[1].split()) >= 3][:4]
    index = d.build_index(spark.createDataFrame(docs, "doc_id long, text string"), segment_words=150)
    found = d.search(index, spark.createDataFrame(items, "item_id long, text string"), 3, slop=2)
    got = {(r.doc_id, m.item_id) for r in found.collect() for m in r.matches}
    want = set()
    for doc_id, text in docs:
        words = d.words_of(text.encode())
        for item, phrase in _phrases(items, 3):
            for at, size in itertools.product(range(len(words)), range(len(phrase), len(phrase) + 3)):
                part = words[at : at + size]
                if all(part.count(w) >= phrase.count(w) for w in phrase):
                    want.add((doc_id, item))
    assert got == want and want
    for r in found.collect():
        words = d.words_of(dict(docs)[r.doc_id].encode())
        for m in r.matches:
            part = words[m.start : m.start + m.length]
            assert len(part) == m.length <= 5
            own = [ph for i, ph in _phrases(items, 3) if i == m.item_id]
            assert any(all(part.count(w) >= ph.count(w) for w in ph) for ph in own)


def test_awkward_rows(spark):
    items = spark.createDataFrame(
        [
            (1, cases.PASSAGE), (2, None), (3, ""), (4, "only four words here"), (5, cases.PASSAGE),
            (None, "the cat sat on the mat and looked at the dog"), (6, "ünïcödé ß WORDS 中文 и"),
        ],
        "item_id long, text string",
    )
    rows = d.contamination(cases.documents(spark), items).collect()
    assert len(rows) == len(cases.ROWS)
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[11].items == ["1", "5"] and by[11].n_hit == 60 and by[11].n_words == 62
    assert by[9].items == by[10].items == ["4"] and by[9].n_hit == 4
    assert by[1].n_hit == 0 and by[4].n_words == 0 and by[6].n_words == 24_000
    assert by[13].n_hit == 0  # letters beyond ASCII keep their case
    assert d.contamination(cases.empty(spark), items).count() == 0
    clean = d.contamination(cases.documents(spark), items.limit(0)).collect()
    assert all(r.n_hit == 0 and r.items == [] for r in clean)


def test_items_without_an_id_are_found_by_query_and_pipeline(spark, tmp_path):
    import corpus_pipeline

    from flowloom.llm.queries import op8_decontamination

    items = [(1, cases.PASSAGE), (None, "the cat sat on the mat and looked at the dog"), (None, cases.PASSAGE)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(cases.ROWS, cases.SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    by = {r.doc_id: r for r in op8_decontamination(spark, str(tmp_path)).collect()}
    assert (by[1].n_hit, by[1].n_items, by[1].contaminated) == (11, 1, True)
    assert by[1].items_sha256 == by[3].items_sha256 and by[3].n_items == 0  # as the SQL twin has it
    assert (by[11].n_hit, by[11].n_items) == (60, 2)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = {r.doc_id for r in corpus_pipeline.clean_documents(spark, docs, str(tmp_path)).collect()}
    assert not left & {1, 2, 11, 12} and {3, 9, 10} <= left
