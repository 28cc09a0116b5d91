"""The manifest against a plain Merkle tree."""

import hashlib

import pytest
from pyspark.sql import functions as F

from prioscope.llm import manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i:i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def climbed(tree, at, node, steps):
    for nodes in tree[:-1]:
        run = nodes[at // 8 * 8:at // 8 * 8 + 8]
        slot = at % 8
        steps.append((slot, run[:slot] + run[slot + 1:]))
        node, at = digest(*run[:slot], node, *run[slot + 1:]), at // 8
    return node


def brute(rows):
    """(key, leaf) to the other columns; rows are (key, group, leaf, replacement)."""
    groups = {}
    for key, group, leaf, other in rows:
        groups.setdefault(group, []).append((key is not None, key or 0, leaf, other or leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([r[2] for r in sorted(groups[g])]) for g in names}
    top = levels([trees[g][-1][0] for g in names])
    out = []
    for i, g in enumerate(names):
        for at, (known, key, leaf, other) in enumerate(sorted(groups[g])):
            steps = []
            node = climbed(top, i, climbed(trees[g], at, other, steps), steps)
            out.append((key if known else None, g, leaf, trees[g][-1][0], top[-1][0], steps, node))
    return out


def plain(rows):
    return sorted(map(str, rows))


@pytest.mark.parametrize("sizes", [
    {"a": 1}, {"a": 8, None: 9}, {"é": 1, "z": 64, "": 65, "big": 513}, {f"g{i}": 2 for i in range(70)},
])
def test_manifest(spark, sizes):
    rows = [(i, g, digest(str(g), str(i)), digest("x") if i % 3 == 0 else None) for g, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, leaf string, replacement string").repartition(3)
    got = [(r.doc_id, r.lang, r.leaf, r.subroot, r.root, [(s.slot, s.siblings) for s in r.proof], r.folded_root)
           for r in manifest.manifest(df, block_levels=2).collect()]
    assert plain(got) == plain(brute(rows))
    checked = manifest.manifest(df).select(manifest.siblings_digest().alias("s"), "proof").collect()
    assert all(r.s == digest(*[x for step in r.proof for x in step.siblings]) for r in checked)


def test_manifest_of_odd_rows(spark):
    same = digest("same")
    rows = [(None, None, digest("n"), None, "c"), (7, "a", same, None, "c"), (7, "a", same, None, "d"), (None, "a", same, same, "c"),
            (2**40, "a", digest("t"), digest("u"), "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, leaf string, replacement string, root string").withColumn(
        "m", F.create_map(F.lit("k"), "root"))
    got = [(r.doc_id, r.lang, r.leaf, r.subroot, r.root, [(s.slot, s.siblings) for s in r.proof], r.folded_root)
           for r in manifest.manifest(df).collect()]
    assert plain(got) == plain(brute([r[:4] for r in rows]))
    none = manifest.manifest(df.limit(0))
    assert none.count() == 0 and none.columns == ["doc_id", "lang", "leaf", "subroot", "root", "proof", "folded_root"]


def test_folding_resumes_the_state_of_the_slot():
    parent = manifest.Parent(["a", "b", "c"])
    assert parent.digest == digest("abc") and parent.folded(1, "x") == digest("axc") and parent.folded(2, "") == digest("ab")


def test_record_digest(spark):
    df = spark.createDataFrame([("é", None, 5)], "a string, b string, c bigint")
    got = df.select(manifest.record_digest([F.col("a"), F.col("b"), F.col("c")])).first()[0]
    assert got == digest("2:é", "-", "1:5")
