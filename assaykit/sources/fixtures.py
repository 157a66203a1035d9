"""Domain views over the driver tables.

The reference reads bioactivity tables (activity, assay, compound structures,
targets), graph tables, metric logs and chat transcripts. Here the same
shapes are derived from the TPC-H-style test tables with plain column
expressions, so every view scales with its source table and stays lazy.
The DuckDB twin of each view lives in ``assaykit.plans.oracle_views``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaykit.sources.tables import read_table


def _case_flag(c: Column) -> Column:
    return (F.when(c == "A", "IC50").when(c == "R", "Ki").otherwise("Kd"))


def activity(spark: SparkSession, base: str) -> DataFrame:
    """13-column activity table (one row per lineitem)."""
    li = read_table(spark, base, "lineitem")
    price = F.col("l_extendedprice")
    supp4 = F.col("l_suppkey") % 4
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("activity_id"),
        F.col("l_orderkey").alias("assay_id"),
        F.col("l_partkey").alias("molregno"),
        _case_flag(F.col("l_returnflag")).alias("standard_type"),
        price.alias("standard_value"),
        F.when(F.col("l_suppkey") % 5 == 0, "ug.mL-1").otherwise("nM").alias("standard_units"),
        F.when(F.col("l_discount") > 0.085, ">").otherwise("=").alias("standard_relation"),
        F.lit(1).cast("bigint").alias("standard_flag"),
        F.when(F.col("l_linenumber") == 7, F.lit(None).cast("double"))
        .otherwise(9 - F.log10(price)).alias("pchembl_value"),
        _case_flag(F.col("l_returnflag")).alias("type"),
        # One row in 97 holds a value that doesn't agree with its standard value.
        (F.when(supp4 == 0, price / 1000).when(supp4 == 1, price / 1000)
         .when(supp4 == 2, price).otherwise(price * 1000)
         * F.when(F.col("l_orderkey") % 97 == 0, 1.25).otherwise(1.0)).alias("value"),
        F.when(supp4 == 0, " µM ").when(supp4 == 1, "umol/L")
        .when(supp4 == 2, "10^-9M").otherwise("pM").alias("units"),
        F.when(F.col("l_tax") > 0.075, 1).otherwise(0).cast("bigint").alias("potential_duplicate"),
    )


def assay(spark: SparkSession, base: str) -> DataFrame:
    """7-column assay table (one row per order)."""
    o = read_table(spark, base, "orders")
    prio = F.col("o_orderpriority")
    return o.select(
        F.col("o_orderkey").alias("assay_id"),
        F.col("o_orderstatus").alias("assay_type"),
        F.when(prio.isin("1-URGENT", "2-HIGH", "3-MEDIUM"), "Homo sapiens")
        .when(prio == "4-NOT SPECIFIED", "Mus musculus").otherwise("Danio rerio")
        .alias("assay_organism"),
        F.when(prio.isin("1-URGENT", "2-HIGH"), 9606)
        .when(prio == "4-NOT SPECIFIED", 10090).cast("bigint").alias("assay_tax_id"),
        F.col("o_custkey").alias("tid"),
        (F.col("o_orderkey") % 100).alias("doc_id"),
        F.concat(F.lit("A"), F.col("o_orderkey").cast("string")).alias("chembl_id"),
    )


def compound_struct(spark: SparkSession, base: str) -> DataFrame:
    """molregno + canonical_smiles; 2% blank and 2% null structures."""
    p = read_table(spark, base, "part")
    k = F.col("p_partkey") % 50
    return p.select(
        F.col("p_partkey").alias("molregno"),
        F.when(k == 0, "").when(k == 1, F.lit(None).cast("string"))
        .otherwise(F.col("p_name")).alias("canonical_smiles"),
    )


def target_dictionary(spark: SparkSession, base: str) -> DataFrame:
    c = read_table(spark, base, "customer")
    return c.where(F.col("c_custkey") % 10 != 0).select(F.col("c_custkey").alias("tid"))


def target_components(spark: SparkSession, base: str) -> DataFrame:
    """One to four components for each target: linear in the customers. Keys of suppliers count from 0."""
    c = read_table(spark, base, "customer").select("c_custkey")
    n = read_table(spark, base, "supplier").agg(F.count(F.lit(1)).alias("n")).scalar()
    picks = c.select(F.col("c_custkey").alias("tid"), F.explode(F.sequence(F.lit(0), F.col("c_custkey") % 4)).alias("j"))
    return picks.select("tid", ((F.col("tid") * (F.col("j") * 7 + 3) + F.col("j")) % n).alias("component_id")).distinct()


def component_sequences(spark: SparkSession, base: str) -> DataFrame:
    s = read_table(spark, base, "supplier")
    k = F.col("s_suppkey") % 3
    return s.select(
        F.col("s_suppkey").alias("component_id"),
        F.when(k == 0, "PROTEIN").when(k == 1, "DNA").otherwise("RNA").alias("component_type"),
    )


# --- graph views -------------------------------------------------------------

def nodes(spark: SparkSession, base: str) -> DataFrame:
    """One node per (order, line number); two float features."""
    li = read_table(spark, base, "lineitem")
    return li.groupBy(
        F.col("l_orderkey").alias("gid"), F.col("l_linenumber").alias("nid")
    ).agg(F.max("l_quantity").alias("f0"), F.max("l_discount").alias("f1"))


def edges(spark: SparkSession, base: str) -> DataFrame:
    """Chain graph: each node linked to the next line number of its order, stored once."""
    n = nodes(spark, base).select("gid", "nid")
    nxt = F.lead("nid").over(Window.partitionBy("gid").orderBy("nid"))
    return (n.withColumn("dst", nxt).where(F.col("dst").isNotNull())
            .select("gid", F.col("nid").alias("src"), "dst"))


# --- run, metric and vector views ----------------------------------------------

def metrics(spark: SparkSession, base: str) -> DataFrame:
    """Metric log: (run_id, name, value, step); step counts from 0 per run and name.

    Steps are numbered with ``group_row_number`` rather than a window per run,
    so a run holding a large share of all events is still numbered by many tasks.
    """
    from assaykit.operators.ranking import group_row_number

    e = read_table(spark, base, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_type").alias("name"), "value", "ts", "event_id")
    numbered = group_row_number(e, ["run_id", "name"], ["ts", "event_id"], "step")
    return numbered.select("run_id", "name", "value", "step", "ts")


EPOCH_METRIC = "click"


def epochs(spark: SparkSession, base: str) -> DataFrame:
    """Validation loss per run and epoch: the metric stream of one name."""
    m = metrics(spark, base).where(F.col("name") == EPOCH_METRIC)
    return m.select("run_id", F.col("step").alias("epoch"), F.col("value").alias("valid_loss"))


def params(spark: SparkSession, base: str) -> DataFrame:
    """Run parameters in long form (run_id, key, value)."""
    p = read_table(spark, base, "part")
    return p.select(
        F.col("p_partkey").alias("run_id"),
        F.explode(F.array(
            F.struct(F.lit("brand").alias("key"), F.col("p_brand").alias("value")),
            F.struct(F.lit("type").alias("key"), F.col("p_type").alias("value")),
            F.struct(F.lit("name").alias("key"), F.col("p_name").alias("value")),
            F.struct(F.lit("size").alias("key"), F.col("p_size").cast("string").alias("value")),
        )).alias("kv"),
    ).select("run_id", "kv.key", "kv.value")


def tensors(spark: SparkSession, base: str) -> DataFrame:
    e = read_table(spark, base, "embeddings")
    return e.select(F.col("label").cast("string").alias("name"),
                    F.col("embedding").alias("values"), "vec_id")


def predictions(spark: SparkSession, base: str) -> DataFrame:
    li = read_table(spark, base, "lineitem")
    return li.select(
        F.col("l_linenumber").alias("epoch"),
        F.col("l_suppkey").alias("batch_id"),
        F.log10("l_extendedprice").alias("truth"),
        (F.lit(3.0) + F.col("l_quantity") / 25).alias("pred"),
    )


# --- text and resolution views ---------------------------------------------------

def messages(spark: SparkSession, base: str) -> DataFrame:
    return read_table(spark, base, "conversations").select("conv_id", "turn", "role", "text")


def inputs(spark: SparkSession, base: str) -> DataFrame:
    """Structure-resolution inputs: raw text plus the outcomes of each resolution step.

    canonical: null when doc_id % 3 = 0 (input did not parse), else the source tag;
    fixed: repair proposal, null when doc_id % 9 = 0; canonical_fixed: null when
    doc_id % 6 = 0, else lang; repair_error: set when the document is labelled toxic.
    Some texts are NULL or blank, some numbers lie halfway between two roundings.
    """
    d = read_table(spark, base, "documents").select("doc_id", "text", "lang", "source")
    lab = read_table(spark, base, "labels").select("doc_id", "toxic")
    j = d.join(lab, "doc_id", "left")
    k = F.col("doc_id")
    return j.select(
        "doc_id",
        F.when(k % 17 == 0, F.lit(None).cast("string")).when(k % 19 == 0, F.lit(" \t"))
        .otherwise(F.col("text")).alias("input_text"),
        F.when(k % 3 == 0, F.lit(None).cast("string")).otherwise(F.col("source")).alias("canonical"),
        F.when(k % 9 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.col("lang"), F.lit(":"), F.col("source"))).alias("fixed"),
        F.when(k % 6 == 0, F.lit(None).cast("string")).otherwise(F.col("lang")).alias("canonical_fixed"),
        F.when(F.col("toxic") == 1, F.lit("repair service unavailable")).alias("repair_error"),
        F.concat(F.lit("proposal from "), F.col("source")).alias("repair_explanation"),
        F.when(k % 5 == 0, 0.125).when(k % 5 == 1, 1.005)
        .otherwise((F.length("text") % 100).cast("double") / 100).alias("repair_confidence"),
        F.when(k % 7 == 1, 6.03125).otherwise(
            F.lit(4.0) + (F.length("text") % 600).cast("double") / 100).alias("prediction"),
    )
