"""Gradients of both networks against finite differences; accuracy; edges."""

from __future__ import annotations

import cases
import numpy as np
import pytest

from flowloom.llm import language, queries, toxicity
from flowloom.llm.common import table


def _close(array, at, slope, loss, step=1e-2):
    kept = array[at]
    array[at] = kept + step
    above = loss()
    array[at] = kept - step
    below = loss()
    array[at] = kept
    assert abs((above - below) / (2 * step) - slope) < 2e-4


def test_language_slopes():
    draw = np.random.default_rng(0)
    model = language.ByteTagger(["a", "b", "c"], hidden=4)
    bytes_ = draw.integers(0, 256, (7, 5)).astype(np.uint8)
    known = np.ones((7, 5))
    known[5:, 1] = known[3:, 2] = 0
    target = np.array([0, 1, 2, 0, 1])
    lengths = known.sum(0).astype(int)

    def loss():
        total = 0.0
        for c in range(5):
            shares = model.positions(bytes_[: lengths[c], c : c + 1], lengths[c : c + 1])
            total -= np.log(shares[:, target[c], 0]).sum()
        return total / known.sum()

    slopes = model._slopes(bytes_, known, target)
    arrays = {"weights": model.layer.weights, "output": model.output, "bias": model.bias}
    for name, array in arrays.items():
        for _ in range(5):
            at = tuple(draw.integers(0, s) for s in array.shape)
            _close(array, at, slopes[name][at], loss)
    for row in range(3):
        at = (row % 2, row, int(bytes_[row, row]))
        _close(model.inputs, at, slopes["inputs"][at], loss)


def test_toxicity_slopes():
    draw = np.random.default_rng(1)
    model = toxicity.ToxicReader(width=5, hidden=3, attend=4)
    inputs = toxicity.word_inputs([b"hello", b"a", b"b\xc3\xa4r", b"xyzzy", b"q1"])
    numbers = draw.integers(0, 5, (6, 4))
    known = np.ones((6, 4), np.float32)
    known[4:, 1] = known[1:, 3] = 0
    target = np.array([0, 1, 1, 0.0])

    def loss():
        logit = model.logits(model.word_gates(model.word_vectors(*inputs)), numbers, known)
        return np.mean(np.log1p(np.exp(np.where(target == 1, -logit, logit))))

    slopes = model.slopes(inputs, numbers, known, target, np.ones(4))
    for name, array in model.arrays.items():
        for _ in range(4):
            at = tuple(int(draw.integers(0, s)) for s in array.shape)
            if name == "grams":
                at = (int(inputs[0][draw.integers(len(inputs[0]))]), at[1])
            _close(array, at, slopes[name][at], loss)


def test_runs_of_all_positions_are_labelled():
    model = language.ByteTagger(["x", "y"], hidden=4)
    texts = [b"abc" * 200, b"", b"q", b"z" * 256, b"z" * 257]
    flat = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    got = model.documents(flat, offsets)
    for n, text in enumerate(texts):
        parts = [text[a : a + language.RUN] for a in range(0, len(text), language.RUN)]
        sums = np.zeros(2)
        for part in parts:
            column = np.frombuffer(part, np.uint8)[:, None]
            sums += model.positions(column, np.array([len(part)]))[:, :, 0].sum(0)
        assert np.allclose(got[n], sums / max(len(text), 1), atol=1e-4)
    spans = model.spans(texts[0])
    assert spans[0][0] == 0 and spans[-1][1] == len(texts[0])


def test_windows_cover_all_words():
    for words in range(1, 200):
        starts = list(toxicity.window_starts(words))
        covered = {w for s in starts for w in range(s, min(s + toxicity.SPAN, words))}
        assert covered == set(range(words))
    model = toxicity.ToxicReader()
    scorer = toxicity.Scorer(model)
    text = b" ".join(b"w%d" % (n % 37) for n in range(150))
    whole = scorer.highest([text, b"", b"one"])
    words = text.split()
    each = [scorer.highest([b" ".join(words[s : s + 32])])[0] for s in toxicity.window_starts(150)]
    assert abs(whole[0] - max(each)) < 1e-4 and whole[1] == -np.inf and np.isfinite(whole[2])


@pytest.fixture(scope="module")
def folder():
    return "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark, folder):
    rows = queries.op4_language(spark, folder).collect()
    lang = {r.doc_id: r.lang for r in table(spark, folder, "documents").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and len(held) > 150
    assert np.mean([lang[r.doc_id] == r.lang_pred for r in held]) > 0.97


def test_toxicity_held_out_ranking(spark, folder):
    rows = queries.op10_toxicity(spark, folder).collect()
    label = {r.doc_id: r.toxic for r in table(spark, folder, "labels").collect()}
    assert len(rows) == 1000
    held = [(r.score, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    toxic = [s for s, k in held if k]
    clean = [s for s, k in held if not k]
    ranks = np.mean([[t > c for c in clean] for t in toxic])
    assert ranks > 0.6  # only some 40 toxic documents to learn from


def test_toxicity_learns_words_and_beginnings_of_words():
    draw = np.random.default_rng(6)
    vowels = [b"a", b"e", b"ti", b"on", b"er", b"sa", b"lo", b"mi"]

    def word():
        return b"".join(vowels[i] for i in draw.integers(0, 8, draw.integers(1, 6)))

    def doc(toxic):
        words = [word() for _ in range(draw.integers(20, 90))]
        for _ in range(2 if toxic else 0):
            bad = b"zorg" if draw.random() < 0.5 else b"kwax" + word()
            words.insert(draw.integers(len(words)), bad)
        return words, int(toxic)

    docs = [doc(n % 4 == 0) for n in range(500)]
    model = toxicity.ToxicReader()
    model.train(docs[:400], steps=200)
    logit = toxicity.Scorer(model).highest([b" ".join(w) for w, _ in docs[400:]])
    label = np.array([k for _, k in docs[400:]])
    assert np.mean([[t > c for c in logit[label == 0]] for t in logit[label == 1]]) > 0.9


def test_awkward_rows(spark):
    docs = cases.documents(spark)
    model = language.fit(docs)
    got = sorted(language.predict(docs, model).collect(), key=repr)
    assert len(got) == len(cases.ROWS)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert [by[i].lang_pred for i in (3, 4, 5)] == ["und"] * 3 and by[4].score == 0
    assert {by[i].lang_pred for i in (1, 6, 13)} <= {"de", "en"}
    assert {r.lang_pred for r in language.predict(docs, None).collect()} == {"und"}
    assert language.predict(cases.empty(spark), model).count() == 0
    assert language.fit(cases.empty(spark)) is None
    labels = spark.createDataFrame(
        [(1, 1, 0), (3, 0, 0), (6, 0, 1), (6, 0, None), (9, 1, 0), (10, 1, 0), (11, 1, 1), (None, 0, 1)],
        "doc_id long, quality int, toxic int",
    )
    own = toxicity.toxic_labels(labels)
    reader = toxicity.fit(docs, own)
    scores = toxicity.toxic_scores(docs, reader).collect()
    assert len(scores) == len(cases.ROWS) and all(0 <= r.score <= 1 for r in scores)
    assert {r.score for r in scores if r.doc_id in (3, 4, 5)} == {0.0}
    assert {r.score for r in toxicity.toxic_scores(docs, None).collect()} == {0.0}
    assert toxicity.toxic_scores(cases.empty(spark), reader).count() == 0
    assert toxicity.fit(docs, own.limit(0)) is None


def _plain_logit(model, gates, numbers):
    """A window's logit by loops over words and directions, in double precision."""
    size = model.layer.hidden
    a = {k: v.astype(float) for k, v in model.arrays.items()}
    states = np.zeros((len(numbers), 2 * size))
    for d, order in ((0, range(len(numbers))), (1, reversed(range(len(numbers))))):
        state = np.zeros(size)
        for t in order:
            given = gates[d][:, numbers[t]].astype(float)
            inner = model.layer.weights[d].astype(float) @ state
            reset, update = (
                1 / (1 + np.exp(-(given[k * size : (k + 1) * size] + inner[k * size : (k + 1) * size])))
                for k in (0, 1)
            )
            fresh = np.tanh(given[2 * size :] + reset * inner[2 * size :])
            state = update * state + (1 - update) * fresh
            states[t, d * size : (d + 1) * size] = state
    force = np.array([a["focus"] @ np.tanh(a["look"] @ s) for s in states])
    shares = np.exp(force - force.max())
    return float(a["output"] @ (shares / shares.sum() @ states) + a["bias"][0])


def test_window_logits_equal_a_plain_network():
    model = toxicity.ToxicReader(seed=11)
    words = [b"w%d" % n for n in range(50)]
    gates = model.all_gates(*toxicity.word_inputs(words))
    draw = np.random.default_rng(5)
    flat = draw.integers(0, 50, 400)
    lengths = np.sort(np.concatenate([draw.integers(1, 33, 40), [32, 32, 1]]))[::-1]
    starts = draw.integers(0, 360, len(lengths))
    rows = np.ascontiguousarray(gates.transpose(2, 0, 1))
    got = model.window_logits(rows, flat, starts, lengths)
    want = [_plain_logit(model, gates, flat[s : s + n]) for s, n in zip(starts, lengths, strict=True)]
    assert np.abs(got - want).max() < 1e-5
    windows = [flat[s : s + n] for s, n in zip(starts, lengths, strict=True)]
    assert np.abs(model.logits(gates, *toxicity._columns(windows)) - want).max() < 1e-5


def test_toxic_training_texts_are_read_whole(spark):
    long = " ".join(f"word{n}" for n in range(3000))
    rows = spark.createDataFrame([(1, long, 1), (2, long, 0)], "doc_id long, text string, label int")
    sizes = {r.label: len(r.text) for r in toxicity._cropped(rows, 8000).collect()}
    assert sizes == {1: len(long), 0: 8000}
