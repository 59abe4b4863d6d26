"""Hash trees over files."""

from __future__ import annotations

import hashlib
import random

import pytest
from flowloom.operators.validate import ContractError
from flowloom.sources import artifacts, content


def write(folder, files):
    for name, data in files.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(data)


def tree(spark, folder, size=7):
    return content.content_tree(content.content_ranges(spark, str(folder), range_bytes=size))


def plain_root(files, size):
    """The root by a loop over all digests."""

    def up(nodes):
        groups = [nodes[i : i + content.FAN] for i in range(0, len(nodes), content.FAN)]
        return [hashlib.sha256("".join(g).encode()).hexdigest() for g in groups]

    levels = []
    for data in files.values():
        cuts = range(0, len(data), size)
        levels.append([hashlib.sha256(data[i : i + size]).hexdigest() for i in cuts])
    while True:
        levels = [up(nodes) for nodes in levels]
        if max(map(len, levels)) == 1:
            break
    tops = sorted(nodes[0] for nodes in levels)
    while len(tops := up(tops)) > 1:
        pass
    return tops[0]


def test_trees(spark, tmp_path):
    draw = random.Random(1)
    files = {f"a{n % 3}/part-{n}": draw.randbytes(draw.randint(1, 900)) for n in range(9)}
    files["part-long"] = draw.randbytes(7 * 64 * 3 + 5)
    files["part-short"] = b"abc"
    write(tmp_path / "one", files)
    before = tree(spark, tmp_path / "one")
    root = content.tree_root(before)
    assert root == plain_root(files, 7)
    # Neither the deal of the work nor file names matter.
    write(tmp_path / "two", {f"part-{n}": data for n, data in enumerate(files.values())})
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert content.tree_root(tree(spark, tmp_path / "two")) == root
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    changed = dict(files)
    long = bytearray(files["part-long"])
    long[7 * 130] ^= 1
    changed["part-long"] = bytes(long)
    changed["part-new"] = b"x"
    del changed["part-short"]
    write(tmp_path / "three", changed)
    after = tree(spark, tmp_path / "three")
    assert content.tree_root(after) != root
    found = {tuple(r) for r in content.changed_ranges(before, after).collect()}
    assert found == {("part-long", 130, "changed"), ("part-new", 0, "added"), ("part-short", 0, "removed")}
    assert content.changed_ranges(before, before).count() == 0


def test_fingerprint(spark, tmp_path):
    write(tmp_path / "t", {"part-1": b"abc"})
    held = artifacts.content_fingerprint(spark, str(tmp_path / "t"))
    assert artifacts.require_fingerprint(spark, str(tmp_path / "t"), held.upper()) == held
    (tmp_path / "t" / "part-1").write_bytes(b"abd")
    with pytest.raises(ContractError):
        artifacts.require_fingerprint(spark, str(tmp_path / "t"), held)
    write(tmp_path, {"none/part-1": b""})
    with pytest.raises(ContractError):
        artifacts.content_fingerprint(spark, str(tmp_path / "none"))
