from __future__ import annotations

import json
import zlib
from collections import defaultdict

import cases
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from flowloom.llm import packing, queries
from flowloom.llm.common import table


def _check(rows, texts, size):
    """Pieces cover every document's ids exactly; sequences are gapless."""
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, np.uint32)
        assert len(ids) == r.length > 0
        pieces[r.doc_id].append((r.start, ids, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(list)
    for doc_id, text in texts:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [2]
        want[doc_id].append(ids)
    for doc_id, copies in want.items():
        found = sorted((start, tuple(ids), total) for start, ids, total in pieces.pop(doc_id))
        assert sum(len(f[1]) for f in found) == sum(map(len, copies))
        if len(copies) == 1:
            at = 0
            for start, ids, total in found:
                assert (start, total) == (at, len(copies[0]))
                assert list(ids) == copies[0][at : at + len(ids)]
                at += len(ids)
    assert not pieces
    padding = 0
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding


def test_word_cache_gives_the_tokenizers_ids():
    own = packing.WordTokenizer.of(None)
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["It's we'll  I'D 3.14²", "<|endoftext|> x", "é Å İ ﬁ", "a b​c", "", "¿Qué? «x» 100€"]
    got = own.encode(odd)
    assert [list(g) for g in got] == [whole.encode(t, add_special_tokens=False).ids for t in odd]


def test_documents_round_trip(spark):
    docs = table(spark, cases.SF, "documents")
    rows = packing.pack(docs.repartition(9, "doc_id"), open_windows=4, fan_in=3).collect()
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    padding = _check(rows, texts, 4096)
    assert padding <= 32 * len({r.sequence_id for r in rows})


def test_small_windows_and_awkward_rows(spark):
    rows = packing.pack(cases.documents(spark).repartition(3), size=64, open_windows=2, least_cut=4).collect()
    _check(rows, [(r[0], r[1]) for r in cases.ROWS], 64)
    assert packing.pack(cases.empty(spark)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(cases.empty(spark), size=100)


def test_best_fit_and_emission_of_the_fullest():
    packer = packing.Packer(16, 2, 4, 0, 0)
    for n, length in enumerate((10, 12, 4, 9, 9)):
        packer.place((n, 0, np.zeros(length, np.uint32), length))
    # 4 fills the window with 12; of 10 and 9 the fuller is emitted, filled up.
    done = packer.table().to_pydict()
    assert done["doc_id"] == [1, 2, 0, 4]
    assert done["length"] == [12, 4, 10, 6]
    packer.finish()
    rest = packer.table().to_pydict()
    assert sum(rest["length"]) == 12
    sizes = {}
    for sequence, length in zip(rest["sequence_id"], rest["length"], strict=True):
        sizes[sequence] = sizes.get(sequence, 0) + length
    assert sorted(sizes.values()) == [4, 8]  # powers of two


def test_query_columns(spark):
    rows = queries.op5_packing(spark, cases.SF).collect()
    assert rows[0].asDict().keys() == {
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    }
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in table(spark, cases.SF, "documents").collect()}
    for r in rows[:50]:
        ids = whole.encode(texts[r.doc_id], add_special_tokens=False).ids + [2]
        part = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
        assert zlib.crc32(part) == r.ids_crc32


def test_a_worker_forgets_words_beyond_its_tables():
    tokenizer = packing.WordTokenizer.of(None)
    texts = [" ".join(f"w{i:x}" for i in range(at, at + 5_000)) for at in range(0, 300_000, 5_000)]
    first = [ids.tolist() for ids in tokenizer.encode(texts[:1])]
    most = 0
    for text in texts:
        tokenizer.encode([text])
        most = max(most, len(tokenizer._words.number))
    assert most <= 105_000
    assert [ids.tolist() for ids in tokenizer.encode(texts[:1])] == first


def test_merges_of_many_parts_give_the_librarys_ids():
    own = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    draw = np.random.default_rng(5)
    latin = [chr(c) for c in [*range(33, 127), *range(0xA1, 0x100)] if packing._PLAIN.fullmatch(chr(c))]
    syllables = ["th", "er", "in", "an", "on", "ung", "tion", "s", "e", "'s", "'ll", "!'t", "7", "ß", "é", "À", "×", "."]
    words = latin + ["".join(draw.choice(latin, n)) for n in draw.integers(1, 12, 3000)]
    words += ["".join(draw.choice(syllables, n)) for n in draw.integers(1, 14, 3000)]
    words += ["a" * n for n in (63, 64, 65, 300)] + ["é" * 40, "ab'" * 50, "x'll" * 30, "=" * 200]
    texts = [" ".join(draw.choice(words, 20)) for _ in range(300)] + words + ["\t", " \n x ", "a\r\nb"]
    whole_texts = own._whole
    asked = []
    own._whole = type("Asked", (), {"encode": lambda _, t, **k: asked.append(t) or whole_texts.encode(t, **k)})()
    got = own.encode(texts)
    assert [g.tolist() for g in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    # Only words with a part beyond the width go to the library, each once.
    assert len(asked) == len(set(asked)) <= 6
    assert [g.tolist() for g in own.encode(texts)] == [g.tolist() for g in got]
    assert len(asked) <= 6


def test_a_vocabulary_of_another_kind_is_read_whole(tmp_path):
    model = {"type": "WordLevel", "vocab": {"a": 0, "b": 1, "?": 3}, "unk_token": "?"}
    shape = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None}
    shape |= {"pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "decoder": None, "model": model}
    path = tmp_path / "words.json"
    path.write_text(json.dumps(shape))
    assert [g.tolist() for g in packing.WordTokenizer(str(path)).encode(["a b A", ""])] == [[0, 1, 3], []]
