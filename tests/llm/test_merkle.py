"""Hash trees against SQL and a plain build."""

import hashlib

import pytest
from comparing import DATA, same
from pyspark.sql import functions as F

from brindle.llm import merkle
from brindle.llm.queries import op13_merkle_manifest, oracle_sql


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """The root, and each node's siblings from below."""
    paths, own = [[] for _ in nodes], list(range(len(nodes)))
    level = nodes
    while len(level) > 1:
        above = [H(*level[k : k + 8]) for k in range(0, len(level), 8)]
        for n, at in enumerate(own):
            start = at // 8 * 8
            paths[n].append(("".join(level[start:at]), "".join(level[at + 1 : start + 8])))
        own = [at // 8 for at in own]
        level = above
    return level[0], paths


def plain(rows, group, order):
    """{(order, leaf): (subroot, root, path)} of rows (group, order, leaf)."""
    groups = sorted({r[0] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    trees, roots = {}, []
    for g in groups:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        root, paths = tree([r[2] for r in own])
        trees[g] = own, root, paths
        roots.append(root)
    top, above = tree(roots)
    return sorted((str(r[1]), r[2], root, top, path + up) for (own, root, paths), up in zip(trees.values(), above) for r, path in zip(own, paths))


def found(df):
    return sorted((str(r.doc_id), r.digest, r.subroot, r.root, [tuple(p) for p in r.proof]) for r in df.collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    same(op13_merkle_manifest(spark, f"{DATA}/{sf}"), f"{DATA}/{sf}", oracle_sql()["op13_merkle_manifest"])


@pytest.mark.parametrize("sizes", [[1], [8, 9, 1], [65, 64, 63, 7, 1, 2, 513, 1, 1, 1]])
def test_shapes(spark, sizes):
    """Groups of one leaf, of whole and of broken runs; nulls, ties and repeated rows; columns with clashing names."""
    rows = [(None if g == 0 else f"g{g}" if g < 5 else f"É{g}", None if k == 3 else k // 2, f"text {g} {k // 4}", g) for g, n in enumerate(sizes) for k in range(n)]
    df = spark.createDataFrame(rows, "lang string, doc_id long, text string, _i long").repartition(5)
    leaves = df.select("lang", "doc_id", merkle.leaf([F.col("lang"), F.col("doc_id"), F.col("text")]).alias("digest"))
    want = plain([(r[0], r[1], leaf(r[:3])) for r in rows], 0, 1)
    got = merkle.manifest(leaves, "lang", [F.col("doc_id").asc_nulls_first()], ["doc_id"])
    assert found(got) == want
    assert got.filter(merkle.folded(F.col("digest"), F.col("proof")) == F.col("root")).count() == len(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "lang string, doc_id long, digest string")
    assert merkle.manifest(df, "lang", [F.col("doc_id")], ["doc_id"]).collect() == []


def test_leaves_of_edges(spark, edge):
    """Null, empty and very long values: null differs from empty and from a dash."""
    columns = ["doc_id", "source", "lang", "text"]
    got = sorted(r.h for r in edge.select(merkle.leaf([F.col(c) for c in columns]).alias("h")).collect())
    assert got == sorted(leaf([r[c] for c in columns]) for r in edge.collect())
    texts = spark.createDataFrame([("ABC Z[`@",), ("ÀÉ A",), (None,), ("",)], "t string")
    assert [r.t for r in texts.select(merkle.lower_ascii(F.col("t")).alias("t")).collect()] == ["abc z[`@", "ÀÉ a", None, ""]


def test_verify(spark, tmp_path):
    """Changed, repeated, lost and new rows, and an entry whose digest was replaced."""
    rows = [(k, "en" if k % 3 else None, f"text {k}") for k in range(100)] + [(None, "de", "no id")]
    schema = "doc_id long, lang string, text string"
    listed = spark.createDataFrame(rows, schema)
    columns = ["doc_id", "lang", "text"]
    leaves = listed.select("doc_id", "lang", merkle.leaf([F.col(c) for c in columns]).alias("digest"))
    merkle.write(merkle.manifest(leaves, "lang", [F.col("doc_id").asc_nulls_first()], ["doc_id"]), f"{tmp_path}/m")
    entries = spark.read.parquet(f"{tmp_path}/m")
    now = [r if r[0] != 5 else (5, "fr", r[2]) for r in rows if r[0] != 7] + [(200, "en", "new"), rows[9]]
    now = [r if r[0] != 11 else (11, "en", "forged") for r in now]
    forged = leaf((11, "en", "forged"))
    entries = entries.withColumn("digest", F.when(F.col("doc_id") == 11, forged).otherwise(F.col("digest")))
    got = {r.doc_id: r.verdict for r in merkle.verify(spark.createDataFrame(now, schema), entries, "doc_id", columns).collect()}
    want = {r[0]: "ok" for r in rows} | {5: "changed", 7: "missing", 200: "unlisted", 9: "changed", 11: "forged"}
    assert got == want
