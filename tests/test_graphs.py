import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.operators import graphs as G
from assaykit.operators import structures as S

NODES = [(1, 1, 1.0, 0.5), (1, 2, 2.0, 0.0), (1, 3, 3.0, 1.0), (1, 4, 4.0, 2.0),  # path 1-2-3 plus 2-4
         (2, 7, 5.0, 5.0)]                                                          # single-node graph
EDGES = [(1, 1, 2), (1, 2, 3), (1, 2, 4)]


@pytest.fixture
def graph(spark):
    n = spark.createDataFrame(NODES, "gid long, nid int, f0 double, f1 double")
    e = spark.createDataFrame(EDGES, "gid long, src int, dst int")
    return n, e


def test_degree_and_isolated(graph):
    n, e = graph
    got = {(r.gid, r.nid): r.degree for r in G.node_degree(n, e).collect()}
    assert got == {(1, 1): 1, (1, 2): 3, (1, 3): 1, (1, 4): 1, (2, 7): 0}


def test_assemble_graphs(graph):
    n, e = graph
    got = {r.gid: r for r in G.assemble_graphs(n, e, ("f0", "f1")).collect()}
    assert got[1].node_features == [[1.0, 0.5], [2.0, 0.0], [3.0, 1.0], [4.0, 2.0]]
    src, dst = got[1].edge_index
    pairs = list(zip(src, dst))
    assert pairs == [(0, 1), (1, 0), (1, 2), (2, 1), (1, 3), (3, 1)]
    assert got[2].edge_index == [[], []] and got[2].node_features == [[5.0, 5.0]]


def _numpy_propagate(k, act, residual):
    ids = [(g, i) for g, i, _, _ in NODES]
    idx = {x: j for j, x in enumerate(ids)}
    A = np.eye(len(ids))
    for g, s, d in EDGES:
        A[idx[(g, s)], idx[(g, d)]] = A[idx[(g, d)], idx[(g, s)]] = 1
    deg = A.sum(1)
    Ahat = A / np.sqrt(np.outer(deg, deg))
    h = np.array([[f0, f1] for _, _, f0, f1 in NODES])
    for r in range(k):
        new = Ahat @ h
        if act == "silu":
            new = new / (1 + np.exp(-new))
        h = h + new if (residual and r > 0) else new
    return {x: h[j] for x, j in idx.items()}


@pytest.mark.parametrize("k,act,res", [(1, None, False), (2, "silu", True), (3, "relu", False)])
def test_propagate_matches_dense(graph, k, act, res):
    n, e = graph
    got = {(r.gid, r.nid): (r.f0, r.f1) for r in G.propagate(n, e, ("f0", "f1"), k, act, res).collect()}
    exp = _numpy_propagate(k, "silu" if act == "silu" else None, res) if act != "relu" else None
    if exp is not None:
        for key, v in exp.items():
            assert got[key] == pytest.approx(tuple(v))
    assert len(got) == len(NODES)


def test_propagate_checkpointed_equals_plain(graph):
    n, e = graph
    a = sorted(tuple(r) for r in G.propagate(n, e, ("f0", "f1"), 3, "silu", True).collect())
    b = sorted(tuple(r) for r in G.propagate(n, e, ("f0", "f1"), 3, "silu", True, checkpoint_every=1).collect())
    assert [x[:2] for x in a] == [x[:2] for x in b]
    assert [x[2:] for x in a] == [pytest.approx(x[2:]) for x in b]


def test_fingerprint_deterministic_and_bounded(graph):
    n, e = graph
    fp = G.circular_fingerprint(n, e, ("f0", "f1"), radius=2, n_bits=64).collect()
    again = G.circular_fingerprint(n.repartition(3), e.repartition(2), ("f0", "f1"), radius=2, n_bits=64).collect()
    assert sorted(map(tuple, fp)) == sorted(map(tuple, again))
    for r in fp:
        assert r.bits == sorted(set(r.bits)) and all(0 <= b < 64 for b in r.bits)
    single = [r for r in fp if r.gid == 2][0]
    assert 1 <= len(single.bits) <= 3


def test_fingerprint_isomorphic_graphs_equal(spark):
    # same chain with relabelled node ids -> same bits
    n1 = spark.createDataFrame([(1, 1, 1.0, 0.0), (1, 2, 2.0, 0.0), (1, 3, 1.0, 0.0)], "gid long, nid int, f0 double, f1 double")
    e1 = spark.createDataFrame([(1, 1, 2), (1, 2, 3)], "gid long, src int, dst int")
    n2 = spark.createDataFrame([(2, 10, 2.0, 0.0), (2, 20, 1.0, 0.0), (2, 30, 1.0, 0.0)], "gid long, nid int, f0 double, f1 double")
    e2 = spark.createDataFrame([(2, 20, 10), (2, 10, 30)], "gid long, src int, dst int")
    a = G.circular_fingerprint(n1, e1, ("f0", "f1")).collect()[0].bits
    b = G.circular_fingerprint(n2, e2, ("f0", "f1")).collect()[0].bits
    assert a == b


def test_densify_bits(spark):
    df = spark.createDataFrame([(1, [0, 3, 7])], "gid long, bits array<int>")
    row = G.densify_bits(df, n_bits=8).collect()[0]
    assert list(row.fingerprint) == [1, 0, 0, 1, 0, 0, 0, 1]


def test_mean_pool_and_width(graph):
    n, e = graph
    pooled = {r.gid: r.pooled for r in G.mean_pool(G.node_vectors(n, ("f0", "f1"))).collect()}
    assert pooled[1] == pytest.approx([2.5, 0.875]) and pooled[2] == [5.0, 5.0]
    w = G.feature_width(G.assemble_graphs(n, e, ("f0", "f1"))).collect()[0]
    assert (w.min_width, w.max_width, w.consistent) == (2, 2, True)


def test_token_kernel_and_tables(spark):
    df = spark.createDataFrame([(1, "red big ring"), (2, ""), (3, None), (4, "solo")], "molregno long, canonical_smiles string")
    g = {r.molregno: r for r in S.token_graphs(df).collect()}
    assert set(g) == {1, 4}
    assert g[1].edge_index == [[0, 1, 1, 2], [1, 0, 2, 1]] and len(g[1].node_features) == 3
    assert g[4].edge_index == [[], []]
    nodes, edges = S.graph_tables(S.token_graphs(df), feature_names=["a", "b", "c", "d", "e", "f"])
    assert nodes.count() == 4 and sorted(tuple(r) for r in edges.collect()) == [(1, 0, 1), (1, 1, 2)]
    v = {r.molregno: r for r in S.validate_tokens(df).collect()}
    assert v[1].is_valid and v[1].canonical == "red big ring" and not v[2].is_valid and v[2].issue


def test_fingerprint_tells_null_places_and_small_differences_apart(spark):
    e = spark.createDataFrame([], "gid long, src int, dst int")
    n = spark.createDataFrame([(1, 0, None, 5.0), (2, 0, 5.0, None), (3, 0, 0.12341, 1.0), (4, 0, 0.12342, 1.0)],
                              "gid long, nid int, f0 double, f1 double")
    bits = {r.gid: r.bits for r in G.circular_fingerprint(n, e, ("f0", "f1"), radius=0, n_bits=1 << 30).collect()}
    assert len({tuple(b) for b in bits.values()}) == 4
    rounded = {r.gid: r.bits for r in G.circular_fingerprint(n, e, ("f0", "f1"), radius=0, n_bits=1 << 30, decimals=4).collect()}
    assert rounded[3] == rounded[4] and rounded[1] != rounded[2]


def test_densify_bits(spark):
    df = spark.createDataFrame([([0, 3, 7],), ([],), ([7],), ([5, 2, 2, 9],), (list(range(8)),)], "bits array<int>")
    got = [r.fingerprint for r in G.densify_bits(df, n_bits=8).collect()]
    assert got == [[1, 0, 0, 1, 0, 0, 0, 1], [0] * 8, [0] * 7 + [1], [0, 0, 1, 0, 0, 1, 0, 0], [1] * 8]


def test_propagate_with_weights(spark):
    n = spark.createDataFrame([(1, 0, 1.0, 2.0), (1, 1, 3.0, 4.0)], "gid long, nid int, f0 double, f1 double")
    e = spark.createDataFrame([(1, 0, 1)], "gid long, src int, dst int")
    swap = ([[0.0, 1.0], [1.0, 0.0]], [10.0, 0.0])
    got = {r.nid: (r.f0, r.f1) for r in G.propagate(n, e, ("f0", "f1"), k=1, weights=[swap]).collect()}
    # two nodes, both of degree 2 with their self-loop: each gets the mean of the dense layer's values
    assert got[0] == pytest.approx((13.0, 2.0)) and got[1] == pytest.approx((13.0, 2.0))


def test_assembly_is_one_shuffle_and_finds_every_place(spark):
    """Ids with gaps, in any order, of any size of graph; edges to nowhere, twice, to oneself; NULL and repeated ids."""
    rng = np.random.default_rng(6)
    nodes, edges, want = [], [], {}
    for g in range(12):
        ids = sorted(rng.choice(1000, g * 5 + 1, replace=False).tolist())
        feats = {n: float(n) / 8 for n in ids}
        nodes += [(g, n, feats[n]) for n in rng.permutation(ids).tolist()]
        own = [tuple(rng.choice(ids, 2).tolist()) for _ in range(g * 4)] + ([(ids[0], ids[0]), (ids[0], ids[0])] if g % 3 == 0 else [])
        edges += [(g, *e) for e in own] + [(g, ids[0], 5000), (g, -1, ids[0]), (g, None, ids[0])]
        place = sorted((ids.index(a), ids.index(b)) for a, b in own)
        want[g] = ([[feats[n]] for n in ids], [[x for p in place for x in p], [x for p in place for x in p[::-1]]])
    nodes += [(50, None, 1.0), (50, 7, 2.0), (50, 7, 2.0), (50, 9, 3.0)]
    edges += [(50, 7, 9), (77, 1, 2), (None, 1, 2)]
    want[50] = ([[1.0], [2.0], [2.0], [3.0]], [[1, 3], [3, 1]])
    n = spark.createDataFrame(nodes, "gid long, nid long, f double")
    e = spark.createDataFrame(edges, "gid long, src long, dst long").repartition(4)
    out = G.assemble_graphs(n, e, ["f"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert {r.gid: (r.node_features, r.edge_index) for r in out.collect()} == want
    assert plan.count("hashpartitioning(gid") == 1 and "Join" not in plan and "Window" not in plan
