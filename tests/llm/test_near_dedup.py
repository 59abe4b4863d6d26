from __future__ import annotations

import random

import cases
import numpy as np
import pytest

from flowloom.llm import near_dedup as near
from flowloom.llm.components import components


def _shingles(text):
    words = near.words_of((text or "").encode())
    width = min(5, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def _brute(rows):
    """Least reachable id of every document, by all pairs of sets."""
    sets = {i: _shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def _corpus():
    draw = random.Random(5)
    rows = []
    for family in range(12):
        base = [f"f{family}w{draw.randrange(400)}" for _ in range(draw.choice((40, 90, 160)))]
        for _ in range(draw.choice((1, 3, 30))):
            words = list(base)
            for _ in range(draw.randrange(0, 6)):
                words[draw.randrange(len(words))] = f"x{draw.random()}"
            rows.append((len(rows), " ".join(words)))
    rows.append((len(rows), rows[0][1].upper() + "\n"))
    return rows


@pytest.mark.parametrize("limits", [{}, {"crowd": 2, "block": 7}, {"crowd": 10_000}])
def test_classes_equal_brute_force(spark, limits):
    rows = _corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = near.near_duplicates(docs, **limits).collect()
    want = _brute(rows)
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_posterior_bound():
    fewest = near.fewest_matches(200, 0.75, 1e-6, 20)
    assert len(fewest) == 10 and fewest == sorted(fewest) and 0 < fewest[-1] < 150
    draw = np.random.default_rng(1)
    equal = draw.random((20_000, 200)) < 0.75
    kept = np.ones(len(equal), bool)
    for n, least in enumerate(fewest):
        kept &= equal[:, : (n + 1) * 20].sum(1) >= least
    assert kept.mean() > 0.999
    far = draw.random((2000, 200)) < 0.3
    assert (far[:, :40].sum(1) >= fewest[1]).mean() < 0.5


def test_signatures_estimate_similarity():
    known = near.WordHashes()
    words = [b"%d" % n for n in range(600)]
    a = near.shingle_set(words[:500], known)
    b = near.shingle_set(words[100:], known)
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    share = (near.signature(a) == near.signature(b)).mean()
    assert abs(share - true) < 0.12


def test_components(spark):
    draw = random.Random(3)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)]
    links += [(1000 + n, 1001 + n) for n in range(70)] + [(5, 5)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {i: find(i) for i in root}
    assert len(got) == len(root)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_awkward_rows(spark):
    got = near.near_duplicates(cases.documents(spark)).collect()
    assert len(got) == len(cases.ROWS)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[2].component_id == 1 and by[7].component_id == 6 and by[10].component_id == 9
    for n in (3, 4, 5):
        assert (by[n].n_shingles, by[n].component_id, by[n].kept) == (0, n, True)
    assert by[8].n_shingles == 1 and by[9].n_shingles == 1 and by[11].kept
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert near.near_duplicates(cases.empty(spark)).count() == 0
