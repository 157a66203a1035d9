"""Graph tables: assembly, degree, pooling, propagation, circular fingerprints.

Graphs are kept normalised as ``nodes(gid, nid, features...)`` and
``edges(gid, src, dst)`` (each undirected bond stored once). Iterative
operators run a fixed number of join + groupBy rounds on these tables, so a
single very large graph is spread over many tasks instead of living in one
row. Only ``assemble_graphs`` builds the nested per-graph row the training
format needs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.functions import numeric

FINGERPRINT_BITS = 2048
FINGERPRINT_RADIUS = 2
NULL_INVARIANT = "-"


def directed_edges(edges: DataFrame, gid: str = "gid") -> DataFrame:
    """Both directions of every stored edge: (gid, src, dst)."""
    both = F.explode(F.array(
        F.struct(F.col("src").alias("s"), F.col("dst").alias("d")),
        F.struct(F.col("dst").alias("s"), F.col("src").alias("d"))))
    return edges.select(gid, both.alias("e")).select(gid, F.col("e.s").alias("src"), F.col("e.d").alias("dst"))


def _link_table(nodes: DataFrame, edges: DataFrame, gid: str, nid: str, materialize: bool) -> DataFrame:
    """Directed edges plus one self-loop per node: the message table of every round.

    With ``materialize`` the table is written once with a reliable checkpoint,
    so the rounds read it instead of re-deriving it from its sources each time
    (and a lost executor never forces that derivation again).
    """
    from assaykit.session import stored

    links = directed_edges(edges, gid).select(gid, "src", "dst").unionByName(
        nodes.select(gid, F.col(nid).alias("src"), F.col(nid).alias("dst")))
    return stored(links, "graph") if materialize else links


def node_degree(nodes: DataFrame, edges: DataFrame, gid: str = "gid", nid: str = "nid") -> DataFrame:
    """Degree of every node; isolated nodes get 0."""
    deg = (directed_edges(edges, gid).groupBy(gid, F.col("src").alias(nid))
           .agg(F.count(F.lit(1)).alias("degree")))
    return (nodes.select(gid, nid).join(deg, [gid, nid], "left")
            .select(gid, nid, F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree")))


def _place(ids: Column, first: Column, x: Column) -> Column:
    """Place of ``x`` in the sorted ``ids`` from ``first`` on, by binary search; NULL if it isn't there."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(ids) + F.lit(1))).cast("int"))

    def halve(at: Column, _: Column) -> Column:
        low, high = at["low"], at["high"]
        mid = F.floor((low + high) / 2).cast("int")
        right = (low < high) & (F.get(ids, mid) < x)
        return F.struct(F.when(right, mid + 1).otherwise(low).alias("low"), F.when(right, high).otherwise(F.least(mid, high)).alias("high"))

    found = F.aggregate(steps, F.struct(first.alias("low"), F.size(ids).alias("high")), halve)["low"]
    return F.when(F.get(ids, found) == x, found).cast("bigint")


def assemble_graphs(nodes: DataFrame, edges: DataFrame, feature_cols: Sequence[str],
                    gid: str = "gid", nid: str = "nid") -> DataFrame:
    """One row per graph: node_features array<array<float>> by node order and a
    COO edge_index [[src...],[dst...]] with both directions of each bond (N4, N5).

    Node ids are renumbered 0..n-1 in node order. Edge-free graphs get [[],[]];
    an edge to a node that isn't there is left out, and one to a repeated node
    id goes to the first of them. Nodes and edges meet in one shuffle, as rows
    of one table; places come from a binary search in the graph's sorted ids.
    """
    node = F.struct(F.col(nid).alias("n"), F.array(*[F.col(c).cast("float") for c in feature_cols]).alias("f"))
    bond = F.struct(F.col("src").alias("s"), F.col("dst").alias("d"))
    rows = nodes.select(gid, node.alias("_n")).unionByName(
        edges.where(F.col(gid).isNotNull()).select(gid, bond.alias("_b")), allowMissingColumns=True)
    both = rows.groupBy(gid).agg(F.array_sort(F.collect_list("_n")).alias("_n"), F.collect_list("_b").alias("_b")).where(F.size("_n") > 0)
    ids = both.withColumn("_ids", F.transform("_n", lambda x: x["n"]))
    ids = ids.withColumn("_first", F.size(F.filter("_ids", lambda x: x.isNull())))

    def at(x: Column) -> Column:
        return _place(F.col("_ids"), F.col("_first"), x)

    placed = F.transform("_b", lambda b: F.struct(at(b["s"]).alias("i"), at(b["d"]).alias("j")))
    known = F.filter(placed, lambda b: b["i"].isNotNull() & b["j"].isNotNull())
    ids = ids.withColumn("_e", F.array_sort(known))
    return ids.select(
        gid, F.transform("_n", lambda x: x["f"]).alias("node_features"),
        F.array(F.flatten(F.transform("_e", lambda b: F.array(b["i"], b["j"]))),
                F.flatten(F.transform("_e", lambda b: F.array(b["j"], b["i"])))).alias("edge_index"))


def feature_width(df: DataFrame, col: str = "node_features") -> DataFrame:
    """Width of the inner feature vectors: min and max over all rows (N7); equal when consistent."""
    w = df.select(F.explode(col).alias("_v")).select(F.size("_v").alias("_w"))
    return w.agg(F.min("_w").alias("min_width"), F.max("_w").alias("max_width"),
                 (F.min("_w") == F.max("_w")).alias("consistent"))


def decode_features(df: DataFrame, col: str, keys: Sequence[str]) -> DataFrame:
    """Nested array -> long rows (keys..., position, value)."""
    return df.select(*keys, F.posexplode(col).alias("position", "value"))


def node_vectors(nodes: DataFrame, feature_cols: Sequence[str], out: str = "x") -> DataFrame:
    return nodes.withColumn(out, F.array(*[F.col(c).cast("double") for c in feature_cols]))


def mean_pool(nodes: DataFrame, vec: str = "x", gid: str = "gid") -> DataFrame:
    """Element-wise mean of the node vectors of each graph.

    Exploded per position and averaged with partial aggregation; the pooled
    vector (one value per feature position) is reassembled afterwards.
    """
    long = nodes.select(gid, F.posexplode(vec).alias("_p", "_x"))
    avg = long.groupBy(gid, "_p").agg(F.avg("_x").alias("_m"))
    return avg.groupBy(gid).agg(F.array_sort(F.collect_list(F.struct("_p", "_m"))).alias("_s")).select(
        gid, F.transform("_s", lambda s: s["_m"]).alias("pooled"))


def mean_pool_columns(nodes: DataFrame, feature_cols: Sequence[str], gid: str = "gid",
                      out: str = "pooled") -> DataFrame:
    """Mean of each feature column per graph as one vector (A17): one partial aggregate, one shuffle."""
    return nodes.groupBy(gid).agg(F.array(*[F.avg(F.col(c).cast("double")) for c in feature_cols]).alias(out))


def propagate(nodes: DataFrame, edges: DataFrame, feature_cols: Sequence[str], k: int = 1,
              activation: str | None = None, residual: bool = False,
              gid: str = "gid", nid: str = "nid", checkpoint_every: int = 0,
              materialize_links: bool = True, weights: Sequence[tuple] | None = None) -> DataFrame:
    """k rounds of symmetric-normalised neighbour averaging with self-loops.

    h'_i = sum over j in N(i) + {i} of h_j / sqrt(d_i * d_j), d = degree + 1,
    computed as d_i^-1/2 * sum_j (h_j * d_j^-1/2). Every round has the same
    shape: one join of the link table with the node values and one aggregate
    to the destination node. Because the links include a self-loop, that
    aggregate also yields d_i (its row count) and the node's own previous
    value (the self-loop row), so neither a degree table nor the previous
    round is joined again and no round is planned twice. A first pass of the
    same shape attaches the degrees. ``activation`` ('silu' or 'relu')
    follows each round; ``residual`` adds the round's input from the second
    round on, as in stacked layers. ``weights`` gives a (matrix, bias) for each
    round, applied to the node values before they are passed on (matrices are
    square: the number of features stays). ``checkpoint_every`` > 0 cuts lineage every that many rounds;
    ``materialize_links`` writes the link table once (see ``_link_table``).
    """
    from assaykit.session import stored

    width = len(feature_cols)
    links = _link_table(nodes, edges, gid, nid, materialize_links)
    own = F.col("src") == F.col("dst")
    h_cols = [f"_h{i}" for i in range(width)]

    def step(values: DataFrame, scale: bool) -> DataFrame:
        """Join node values onto links by source, aggregate by destination."""
        if scale:
            passed = [f"_w{i}" for i in range(width)] if f"_w{width - 1}" in values.columns else h_cols
            send = [(F.col(c) / F.sqrt("_d")).alias(f"_s{i}") for i, c in enumerate(passed)]
        else:
            send = [F.col(h).alias(f"_s{i}") for i, h in enumerate(h_cols)]
        src_vals = values.select(gid, F.col(nid).alias("src"), *send, *[F.col(h) for h in h_cols])
        return (links.join(src_vals, [gid, "src"]).groupBy(gid, F.col("dst").alias(nid))
                .agg(*[F.sum(f"_s{i}").alias(f"_s{i}") for i in range(width)],
                     *[F.max(F.when(own, F.col(h))).alias(f"_p{i}") for i, h in enumerate(h_cols)],
                     F.count(F.lit(1)).cast("double").alias("_d")))

    start = nodes.select(gid, nid, *[F.col(c).cast("double").alias(h) for c, h in zip(feature_cols, h_cols)])
    # Degree pass: the self-loop row returns each node's own features, the row count its degree.
    h = step(start, scale=False).select(gid, nid, *[F.col(f"_p{i}").alias(h) for i, h in enumerate(h_cols)], "_d")
    for r in range(k):
        if weights is not None:
            matrix, bias = weights[r]
            dense = [sum((F.col(h_cols[i]) * F.lit(float(matrix[i][j])) for i in range(width)), F.lit(float(bias[j])))
                     for j in range(width)]
            # The round's own input stays for the residual.
            h = h.select(gid, nid, *[c.alias(f"_w{i}") for i, c in enumerate(dense)], *h_cols, "_d")
        agg = step(h, scale=True)
        new = [F.col(f"_s{i}") / F.sqrt("_d") for i in range(width)]
        if activation == "silu":
            new = [numeric.silu(c) for c in new]
        elif activation == "relu":
            new = [numeric.relu(c) for c in new]
        if residual and r > 0:
            new = [F.col(f"_p{i}") + c for i, c in enumerate(new)]
        h = agg.select(gid, nid, *[c.alias(h) for c, h in zip(new, h_cols)], "_d")
        if checkpoint_every and (r + 1) % checkpoint_every == 0 and r + 1 < k:
            h = stored(h, "graph")
    return h.select(gid, nid, *[F.col(h).alias(c) for h, c in zip(h_cols, feature_cols)])


def _md5_int(s: Column) -> Column:
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint")


def circular_fingerprint(nodes: DataFrame, edges: DataFrame, feature_cols: Sequence[str],
                         radius: int = FINGERPRINT_RADIUS, n_bits: int = FINGERPRINT_BITS,
                         gid: str = "gid", nid: str = "nid", materialize_links: bool = True,
                         decimals: int | None = None) -> DataFrame:
    """Morgan-style circular fingerprint folded to ``n_bits``.

    Round 0 hashes each node's invariants: the features as they are, or rounded
    to ``decimals`` where the caller wants near values to be the same; a NULL
    feature has a mark of its own, so it holds its position.
    round r hashes (r, own id, sum and count of neighbour ids from round r-1).
    Each round is one join of the link table (edges both ways plus a
    self-loop per node) with the previous ids and one aggregate per node: the
    self-loop row supplies the node's own id, the other rows the neighbour
    sum and count. The neighbour summary is commutative, so it is partially
    aggregated and a hub node of any degree costs a fixed-size buffer. Every
    round's id travels along as a column (radius + 1 of them), so no round
    is recomputed. Output per graph: the sorted distinct set bits (at most
    ``n_bits``), the sparse form.
    """
    def invariant(c: str) -> Column:
        value = F.col(c) if decimals is None else F.round(F.col(c) * F.lit(10 ** decimals)).cast("bigint")
        return F.coalesce(value.cast("string"), F.lit(NULL_INVARIANT))

    inv = F.concat_ws("|", *[invariant(c) for c in feature_cols])
    ids = nodes.select(gid, nid, _md5_int(F.concat(F.lit("0:"), inv)).alias("_b0"))
    links = _link_table(nodes, edges, gid, nid, materialize_links)
    for r in range(1, radius + 1):
        cur, hist = f"_b{r - 1}", [f"_b{i}" for i in range(r)]
        src_ids = ids.select(gid, F.col(nid).alias("src"), *hist)
        own = F.col("src") == F.col("dst")
        agg = (links.join(src_ids, [gid, "src"]).groupBy(gid, F.col("dst").alias(nid))
               .agg(*[F.max(F.when(own, F.col(h))).alias(h) for h in hist],
                    F.sum(F.when(~own, F.col(cur))).alias("_s"),
                    F.count(F.when(~own, F.lit(1))).alias("_c")))
        key = F.concat_ws(":", F.lit(str(r)), F.col(cur).cast("string"),
                          F.coalesce(F.col("_s"), F.lit(0)).cast("string"), F.col("_c").cast("string"))
        ids = agg.select(gid, nid, *hist, _md5_int(key).alias(f"_b{r}"))
    every = F.array(*[F.col(f"_b{i}") for i in range(radius + 1)])
    bits = ids.select(gid, F.explode(every).alias("_id")).select(
        gid, (F.col("_id") % n_bits).cast("int").alias("_bit"))
    # collect_set holds at most n_bits values per graph, whatever the graph size.
    return bits.groupBy(gid).agg(F.array_sort(F.collect_set("_bit")).alias("bits"))


def densify_bits(df: DataFrame, col: str = "bits", n_bits: int = FINGERPRINT_BITS,
                 out: str = "fingerprint") -> DataFrame:
    """Sparse set-bit list -> dense 0/1 byte array of width ``n_bits``.

    Linear in the width: a run of zeros and a one for each set bit, then the
    last zeros. Bits outside the width are left out.
    """
    bits = F.array_sort(F.array_distinct(F.filter(col, lambda b: (b >= 0) & (b < n_bits))))
    df = df.withColumn("_bits", bits).withColumn(
        "_prev", F.concat(F.array(F.lit(-1)), F.slice("_bits", 1, F.greatest(F.size("_bits") - 1, F.lit(0)))))
    zero, one = F.lit(0).cast("byte"), F.lit(1).cast("byte")
    runs = F.transform(F.arrays_zip("_bits", "_prev"), lambda p: F.when(p["_bits"].isNotNull(), F.concat(
        F.array_repeat(zero, p["_bits"] - p["_prev"] - 1), F.array(one))).otherwise(F.array().cast("array<tinyint>")))
    last = F.coalesce(F.get("_bits", F.size("_bits") - 1), F.lit(-1))
    dense = F.concat(F.flatten(runs), F.array_repeat(zero, F.lit(n_bits - 1) - last))
    return df.withColumn(out, dense).drop("_bits", "_prev")
