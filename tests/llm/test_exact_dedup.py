from __future__ import annotations

import hashlib
import random
import re

import cases

from flowloom.llm.exact_dedup import CuckooIndex, CuckooShard, exact_duplicates, text_keys


def _digest(n):
    return hashlib.sha256(str(n).encode()).hexdigest()


def test_shard_keeps_a_set_through_growth_and_removal():
    draw, shard, live = random.Random(1), CuckooShard(buckets=2), set()
    for _ in range(4000):
        n = draw.randrange(1500)
        known = shard.find(_digest(n), 1) is not None
        assert known == (n in live)
        if known and draw.random() < 0.4:
            assert shard.remove(_digest(n), 1)[0] == _digest(n)
            live.discard(n)
        elif not known:
            shard.insert([_digest(n), 1, n, 1])
            live.add(n)
    assert shard.size == len(live)
    assert all(shard.maybe(_digest(n)) for n in live)
    false = sum(shard.maybe(_digest(n)) for n in range(10_000, 14_000))
    assert false < 40  # the filter alone answers nearly all absent keys
    assert len(shard.rows) * 4 >= len(live)


def test_hit_is_verified_against_the_stored_key():
    shard = CuckooShard()
    shard.insert([_digest(1), 5, 1, 1])
    twin = _digest(1)[:32] + "0" * 32  # same place and fingerprint, other digest
    assert shard.maybe(twin) and shard.find(twin, 5) is None
    assert shard.find(_digest(1), 6) is None


def test_index_takes_and_forgets_keys(spark):
    keys = spark.createDataFrame(
        [(_digest(n % 40), 1, n) for n in range(100)], "digest string, length long, doc_id long"
    )
    index = CuckooIndex.sized_for(100, shard_keys=8, least=3).update(add=keys)
    assert {(r.digest, r.keep_id, r.copies) for r in index.keys().collect()} == {
        (_digest(n), n, 3 if n < 20 else 2) for n in range(40)
    }
    drop = spark.createDataFrame([(_digest(n), 1) for n in range(10)], "digest string, length long")
    again = spark.createDataFrame([(_digest(3), 1, 500)], "digest string, length long, doc_id long")
    index = index.update(drop=drop).update(add=again)
    got = {r.digest: (r.keep_id, r.copies) for r in index.keys().collect()}
    assert len(got) == 31 and got[_digest(3)] == (500, 1) and got[_digest(15)] == (15, 3)
    assert index.filters().count() == index.shards


def test_awkward_rows(spark):
    rows = [tuple(r) for r in exact_duplicates(cases.documents(spark)).collect()]
    plain = {}
    for doc_id, text, *_ in cases.ROWS:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", text or "")
        plain.setdefault(norm, []).append(doc_id)
    want = []
    for norm, ids in plain.items():
        keep = min((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(norm.encode()).hexdigest()
        want += [(i, keep, len(ids), i == keep, digest) for i in ids]
    assert sorted(rows, key=repr) == sorted(want, key=repr)
    assert exact_duplicates(cases.empty(spark)).count() == 0
    assert text_keys(cases.empty(spark)).count() == 0
