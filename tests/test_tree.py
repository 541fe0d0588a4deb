import hashlib
import json

import pytest
from pyspark.sql import functions as F

from derivata.operators import registry, tree
from test_registry import AT, MARKS_PEM, PEM, SEED, sha, stored, world  # noqa: F401

h = lambda x: hashlib.sha256(x.encode()).hexdigest()


def plain_nodes(leaves, depth):
    """Every node of a tree over {id: digest}, by recursion."""
    out = {}

    def node(prefix):
        inside = {i: d for i, d in leaves.items() if h(str(i)).startswith(prefix)}
        if not inside:
            return None
        if len(prefix) == depth:
            lines = sorted(f"{h(str(i))}:{d}" for i, d in inside.items())
        else:
            lines = [f"{c}:{d}" for c in "0123456789abcdef" if (d := node(prefix + c))]
        out[prefix] = (h("\n".join(lines)), len(inside))
        return out[prefix][0]

    node("")
    return out


@pytest.mark.parametrize("n,depth", [(0, 1), (1, 0), (1, 2), (300, 0), (300, 1), (300, 2)])
def test_nodes_and_proofs_equal_plain_ones(spark, n, depth):
    leaves = {i: h(f"d{i}") for i in range(n)}
    df = spark.createDataFrame(list(leaves.items()) * 2, "id bigint, digest string")
    nodes = tree.nodes_of(df, depth).persist()
    want = plain_nodes(leaves, depth)
    assert {r.prefix: (r.digest, r.n) for r in nodes.collect()} == want
    top = tree.root(nodes).first()
    assert (top.n_assets, top.root) == (n, want[""][0] if n else None)
    asked = spark.createDataFrame([(i,) for i in (0, 7, 299, 5000)], "id bigint")
    got = tree.proofs(nodes, df, asked, depth).withColumn("root", tree.proven_root(F.col("digest"), F.col("path"))).withColumn("own", tree.names_place(F.col("id"), F.col("path"))).withColumn("other", tree.names_place(F.col("id") + 1, F.col("path"))).collect()
    assert {r.id for r in got} == {0, 7, 299} & set(leaves) and len(got) == len({r.id for r in got})
    assert all(r.root == want[""][0] and r.own and not r.other and len(r.path) == depth + 1 for r in got)


def test_an_update_is_a_new_tree(spark):
    before = {i: h(f"d{i}") for i in range(200)}
    after = {**{i: d for i, d in before.items() if i not in (3, 4)}, 9: h("new"), 500: h("more")}
    table = lambda x: spark.createDataFrame(list(x.items()), "id bigint, digest string")
    changed = spark.createDataFrame([(i,) for i in (3, 4, 9, 500)], "id bigint")
    got = tree.updated(tree.nodes_of(table(before), 2), table(after), changed, 2)
    assert {r.prefix: (r.digest, r.n) for r in got.collect()} == plain_nodes(after, 2)
    lone = tree.updated(tree.nodes_of(table({1: "a"}), 1), table({}), spark.createDataFrame([(1,)], "id bigint"), 1)
    assert lone.collect() == []


def test_a_forged_leaf_is_named(spark):
    leaves = {i: h(f"d{i}") for i in range(300)}
    nodes = tree.nodes_of(spark.createDataFrame(list(leaves.items()), "id bigint, digest string"), 2)
    spoilt = spark.createDataFrame(list({**leaves, 42: h("forged")}.items()), "id bigint, digest string")
    named = {r.id for r in tree.forged(nodes, spoilt, 2).collect()}
    assert 42 in named and len(named) < 10 and {h(str(i))[:2] for i in named} == {h("42")[:2]}
    assert tree.depth_for(1) == 0 and tree.depth_for(256) == 1 and tree.depth_for(257) == 2


def test_checks_verify_what_they_touch_only(spark, world, stored, monkeypatch):  # noqa: F811
    assets, depth = world["assets"], 1
    leaves = stored(registry.tree_leaves(assets))
    nodes = stored(tree.nodes_of(leaves, depth))
    head = registry.tree_head(nodes, depth, SEED, AT).first().envelope
    rows = [("k1", sha("film"), "film.mp4", None), ("k2", sha("child"), "child.mp4", None), ("k4", sha("new"), "new.mp4", None)]
    candidates = spark.createDataFrame(rows, "candidate_id string, sha256 string, filename string, features_sha256 string")

    def check(assets=assets, leaves=leaves, nodes=nodes, head=head):
        return stored(registry.check_by_proofs(candidates, assets, nodes, leaves, head, world["derivatives"], world["auth"], SEED, PEM, AT))

    done = check()
    whole = registry.check(candidates, assets, world["derivatives"], world["auth"], SEED, PEM, AT)
    assert sorted(map(tuple, done.select("candidate_id", "n_exact", "n_lineage", "n_authorized", *registry.CLAIMS).collect())) == sorted(map(tuple, whole.select("candidate_id", "n_exact", "n_lineage", "n_authorized", *registry.CLAIMS).collect()))
    assert registry.unproven_receipts(done, PEM).collect() == [] and registry.unproven_receipts(done, MARKS_PEM).count() == 3
    # A record that no candidate touches is not verified.
    other = assets.withColumn("manifest", F.when(F.col("filename") == "c.mp4", "{}").otherwise(F.col("manifest")))
    assert check(assets=other).count() == 3
    for spoilt in (assets.withColumn("manifest", F.when(F.col("filename") == "a.mp4", "{}").otherwise(F.col("manifest"))), assets.withColumn("sha256", F.when(F.col("filename") == "c.mp4", sha("film")).otherwise(F.col("sha256")))):
        with pytest.raises(Exception, match="not sound"):
            check(assets=spoilt)
    with pytest.raises(Exception, match="not the registered manifest"):
        check(leaves=leaves.withColumn("digest", F.sha2("digest", 256)))
    with pytest.raises(Exception, match="not the registered manifest"):
        check(leaves=leaves.where("false"))
    with pytest.raises(ValueError, match="head"):
        registry.check_by_proofs(candidates, assets, nodes, leaves, head.replace('"n_assets":3', '"n_assets":4'), world["derivatives"], world["auth"], SEED, PEM, AT)
    # Receipts signed over another root, or with the proof of another asset, prove nothing.
    payload = json.loads(done.where("candidate_id = 'k1'").first().receipt)["payload"]
    from derivata.functions import signatures

    for change in ({"registry_root": sha("x")}, {"proofs": {**payload["proofs"], "exact_proof": {**payload["proofs"]["exact_proof"], "asset_id": "asset_other"}}}, {"proofs": {"exact_proof": None, "parent_proof": None}}):
        forged = signatures.canonical_json(signatures.envelope(SEED, {**payload, **change}))
        assert registry.unproven_receipts(done.where("candidate_id = 'k1'").withColumn("receipt", F.lit(forged)), PEM).count() == 1
