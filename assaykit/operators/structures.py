"""Structure strings as tables (N1, F14, R3), with Spark expressions.

Parsing chemistry needs a toolkit and isn't done here: a structure is read as a
chain of white-space separated tokens, which gives the pipelines behind it
(graph tables, fingerprints, propagation) rows of the training layout.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.functions.text import strip_text


def token_graphs(df: DataFrame, key: str = "molregno", text: str = "canonical_smiles") -> DataFrame:
    """(key, node_features, edge_index): tokens are nodes, neighbours are linked; blank texts have no row.

    Node features: token length, degree, 0, vowels, 1 if the first letter is a
    capital, digits.
    """
    clean = F.regexp_replace(strip_text(F.coalesce(F.col(text), F.lit(""))), r"\s+", " ")
    rows = df.select(F.col(key).cast("bigint").alias(key), clean.alias("_t")).where(F.col("_t") != "")
    rows = rows.select(key, F.split("_t", " ").alias("_t")).withColumn("_n", F.size("_t"))

    def features(t, i):
        degree = (i > 0).cast("int") + (i < F.col("_n") - 1).cast("int")
        values = (F.length(t), degree, F.lit(0), F.regexp_count(F.lower(t), F.lit("[aeiou]")),
                  t.rlike("^[A-Z]").cast("int"), F.regexp_count(t, F.lit("[0-9]")))
        return F.array(*[v.cast("float") for v in values])

    steps = F.filter(F.sequence(F.lit(0), F.col("_n")), lambda k: k < F.col("_n") - 1)

    def ends(first: int, second: int):
        return F.flatten(F.transform(steps, lambda k: F.array((k + first).cast("bigint"), (k + second).cast("bigint"))))

    return rows.select(key, F.transform("_t", features).alias("node_features"),
                       F.array(ends(0, 1), ends(1, 0)).alias("edge_index"))


def validate_tokens(df: DataFrame, key: str = "molregno", text: str = "canonical_smiles") -> DataFrame:
    """(key, is_valid, canonical, issue): letters and white space only; canonical is lower-case, single blanks."""
    s = strip_text(F.coalesce(F.col(text), F.lit("")))
    blank, bad = s == "", s.rlike(r"[^\p{L}\s]")
    issue = F.when(blank, F.lit("SMILES is empty.")).when(bad, F.lit("unsupported characters"))
    return df.select(F.col(key).cast("bigint").alias(key), issue.isNull().alias("is_valid"),
                     F.when(issue.isNull(), F.regexp_replace(F.lower(s), r"\s+", " ")).alias("canonical"),
                     issue.alias("issue"))


def graph_tables(graphs: DataFrame, key: str = "molregno",
                 feature_names: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nested graph rows -> normalised ``nodes`` and ``edges`` tables (each bond once).

    Lets the iterative graph operators run as joins over the whole table
    instead of per-row Python.
    """
    nodes = graphs.select(F.col(key).alias("gid"), F.posexplode("node_features").alias("nid", "_f"))
    width = len(feature_names) if feature_names else None
    if width:
        nodes = nodes.select("gid", "nid", *[F.col("_f")[i].cast("double").alias(n)
                                             for i, n in enumerate(feature_names)])
    else:
        nodes = nodes.withColumnRenamed("_f", "features")
    pairs = F.arrays_zip(F.col("edge_index")[0].alias("s"), F.col("edge_index")[1].alias("d"))
    edges = (graphs.select(F.col(key).alias("gid"), F.explode(pairs).alias("_e"))
             .select("gid", F.col("_e.s").cast("int").alias("src"), F.col("_e.d").cast("int").alias("dst"))
             .where(F.col("src") < F.col("dst")).distinct())
    return nodes, edges
