"""Sources and sinks: dataset export, JDBC/Parquet reads, metric log.

Writers go through Spark's file committer, so a failed job leaves no
partial output behind (``_SUCCESS`` marks a complete dataset), and the
save mode is always explicit.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from assaykit.functions.numeric import is_finite
from assaykit.operators.cleaning import enforce_schema

EXPORT_CHUNK_ROWS = 100_000
FORMATS = ("parquet", "orc", "csv", "json")
#: Folders that the runs of a metric table are dealt to, so that their number doesn't grow with the runs.
RUN_PARTS = 64
RUN_PART = "run_part"


def export_dataset(df: DataFrame, name: str, base: str, fmt: str = "parquet",
                   mode: str = "errorifexists", schema: StructType | None = None,
                   max_records_per_file: int = EXPORT_CHUNK_ROWS) -> str:
    """Write ``df`` as dataset ``{base}/{name}`` in ``fmt``; returns the path.

    ``schema`` enforces column order and types first; files hold at most
    ``max_records_per_file`` rows, like the reference's fixed-size chunks.
    """
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}, got {fmt!r}")
    out = enforce_schema(df, schema) if schema is not None else df
    path = f"{base.rstrip('/')}/{name}"
    writer = out.write.format(fmt).mode(mode).option("maxRecordsPerFile", max_records_per_file)
    if fmt == "csv":
        writer = writer.option("header", "true")
    writer.save(path)
    return path


def jdbc_options(url: str, table: str | None = None, query: str | None = None,
                 fetch_size: int = EXPORT_CHUNK_ROWS, partition_column: str | None = None,
                 lower_bound: int | None = None, upper_bound: int | None = None,
                 num_partitions: int | None = None, **extra: str) -> dict[str, str]:
    """Options for a parallel JDBC scan.

    ``fetchsize`` plays the role of the reference's chunked cursor; a
    numeric ``partition_column`` with bounds splits the scan into
    ``num_partitions`` range queries that run in parallel.
    """
    if (table is None) == (query is None):
        raise ValueError("give exactly one of table or query")
    opts = {"url": url, "fetchsize": str(fetch_size)}
    if table is not None:
        opts["dbtable"] = table
    else:
        opts["query"] = query
    if partition_column is not None:
        if query is not None:
            # Spark only partitions a dbtable; wrap the query as a subquery.
            opts.pop("query")
            opts["dbtable"] = f"({query}) AS src"
        if None in (lower_bound, upper_bound, num_partitions):
            raise ValueError("partition_column needs lower_bound, upper_bound and num_partitions")
        opts.update(partitionColumn=partition_column, lowerBound=str(lower_bound),
                    upperBound=str(upper_bound), numPartitions=str(num_partitions))
    opts.update({k: str(v) for k, v in extra.items()})
    return opts


def read_source(spark: SparkSession, kind: str, path: str | None = None,
                schema: StructType | None = None, **opts) -> DataFrame:
    """Read a table from ``parquet``/``orc``/``csv``/``json`` files or ``jdbc``."""
    if kind == "jdbc":
        return spark.read.format("jdbc").options(**jdbc_options(**opts)).load()
    if kind not in FORMATS:
        raise ValueError(f"unknown source kind {kind!r}")
    reader = spark.read.format(kind)
    if schema is not None:
        reader = reader.schema(schema)
    if kind == "csv":
        reader = reader.option("header", "true")
    return reader.options(**{k: str(v) for k, v in opts.items()}).load(path)


def run_part(run: Column, parts: int = RUN_PARTS) -> Column:
    """The folder of a run, the same for an int and a long: a reader of one run who filters on it opens no other folder."""
    return F.pmod(F.xxhash64(run.cast("string")), F.lit(parts)).cast("int")


def append_metrics(df: DataFrame, path: str, run: str = "run_id", parts: int | None = RUN_PARTS) -> None:
    """Append finite metric rows (run_id, name, value, step) partitioned by run.

    Runs are dealt to ``parts`` folders by ``run_part``, which a reader sees as a
    column, and lie in order inside the files; ``parts=None`` makes a folder a
    run, for tables that have this form already.
    Rows are dealt by folder first, so a folder's rows make few files; the hint
    lets AQE split one that holds a large share of them.
    """
    rows = df.where(is_finite("value"))
    if parts is None:
        rows.hint("rebalance", F.col(run)).write.mode("append").partitionBy(run).parquet(path)
        return
    dealt = rows.withColumn(RUN_PART, run_part(F.col(run), parts)).hint("rebalance", F.col(RUN_PART))
    dealt.sortWithinPartitions(RUN_PART, run).write.mode("append").partitionBy(RUN_PART).parquet(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite",
                partition_by: str | list[str] | None = None,
                options: Mapping[str, str] | None = None) -> None:
    """Plain Parquet sink with an explicit mode."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    if options:
        w = w.options(**options)
    w.parquet(path)
