"""Interaction of document filters: coalition removals, exact Shapley values, and every order of applying them.

Each row gets one bit per filter that it fails, and rows are counted by part
and mask, so all that follows reads at most 2 ** n rows a part. The removals
of all coalitions of filters are tabulated from these counts. Shapley values
come from them by constrained least squares: the additive model that is
closest to the coalition values under the Shapley kernel's weights, bound to
give all filters together exactly what they remove (efficiency); its normal
equations are solved in rationals. What a filter does at a step of an order is
a difference of two coalitions.

Defined results: a null text is an empty one, a null part the empty string; a
null condition doesn't fail; a row without doc_id is no copy and no original;
repeated rows of one doc_id are one document as originals, so none of them
fails for the others; a document with several label rows has a mark if one of
them has it; a table without rows has no parts. Further columns are ignored.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.llm.common import col

#: Orders of more filters than this (720 a part) are not listed.
MOST_FILTERS = 6

RATIONALS = T.ArrayType(T.StructType([T.StructField("num", T.LongType()), T.StructField("den", T.LongType())]))


def words(text: Column) -> Column:
    """All maximal runs without blanks (space, tab, line feed, vertical tab, form feed, carriage return)."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def too_short(text: Column, least: int = 100) -> Column:
    return F.size(words(text)) < least


def too_repetitive(text: Column, percent: int = 80) -> Column:
    return 100 * F.size(F.array_distinct(words(text))) < percent * F.size(words(text))


def too_many_capitals(text: Column, percent: int = 10) -> Column:
    return 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > percent * F.length(text)


def has_signs(text: Column, signs: str = "#$%&*|") -> Column:
    return text.rlike("[" + "".join("\\" + s for s in signs) + "]")


def mask_of(conditions: list[Column]) -> Column:
    """Bit i is set where condition i holds."""
    bits = [F.when(F.coalesce(c, F.lit(False)), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(conditions)]
    return sum(bits[1:], bits[0]) if bits else F.lit(0)


def with_marks(df: DataFrame, labels: DataFrame, marks: dict[str, Column], key: str) -> DataFrame:
    """``df`` with 0/1 columns ``marks``, conditions on the label rows of the same key."""
    by_key = labels.where(col(key).isNotNull()).groupBy(col(key).alias("_key")).agg(
        *[F.max(F.coalesce(c, F.lit(False)).cast("int")).alias(m) for m, c in marks.items()])
    joined = df.join(by_key, df[key] == by_key["_key"], "left").drop("_key")
    return joined.withColumns({m: F.coalesce(m, F.lit(0)) for m in marks})


def count_masks(df: DataFrame, conditions: list[Column], *, text: str = "text", key: str = "doc_id", part: str = "lang",
                labels: DataFrame, marks: dict[str, Column]) -> DataFrame:
    """Rows by part and mask: n and the sum of each mark. The last bit is that of later copies.

    A row is a later copy if a smaller key has the same text, anywhere in the
    table. Copies are told apart after two aggregations of one small row per
    document, both with partial sums, so that a text which a third of the rows
    hold is a few rows when its copies meet.
    """
    content = F.coalesce(col(text), F.lit(""))
    rows = df.select(col(key).alias("_id"), F.coalesce(col(part), F.lit("")).alias("part"), content.alias("_text")).select(
        "_id", "part", F.sha2("_text", 256).alias("_digest"), mask_of(conditions).alias("_mask"))
    rows = with_marks(rows.withColumnRenamed("_id", key), labels, marks, key).withColumnRenamed(key, "_id")
    alike = ["_digest", "part", "_mask", *marks]
    by_id = rows.groupBy(*alike, "_id").agg(F.count(F.lit(1)).alias("_n"))
    known = F.col("_id").isNotNull()
    groups = by_id.groupBy(*alike).agg(
        F.sum("_n").alias("_n"), F.sum(F.when(known, F.col("_n"))).alias("_known"),
        F.min(F.when(known, F.struct("_id", "_n"))).alias("_least"))
    first = F.min("_least._id").over(Window.partitionBy("_digest"))
    later = F.coalesce(F.col("_known") - F.when(F.col("_least._id") == first, F.col("_least._n")).otherwise(0), F.lit(0))
    split = groups.withColumn("_later", later).select("part", *marks, F.explode(F.array(
        F.struct(F.col("_mask").alias("mask"), (F.col("_n") - F.col("_later")).alias("n")),
        F.struct((F.col("_mask") + (1 << len(conditions))).alias("mask"), F.col("_later").alias("n")))).alias("_x"))
    return split.select("part", *marks, "_x.*").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col(m)).alias(m) for m in marks])


def coalitions(counts: DataFrame, n_filters: int, sums: list[str]) -> DataFrame:
    """One row a part: ``total``, and per sum an array of what each of the 2 ** n_filters coalitions removes."""
    def removed(name: str, s: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("mask").bitwiseAND(F.lit(s)) != 0, F.col(name))), F.lit(0)).cast("long")

    return counts.groupBy("part").agg(
        F.sum("n").alias("total"),
        *[F.array(*[removed(name, s) for s in range(1 << n_filters)]).alias(f"removed_{name}") for name in sums])


def solve(rows: list[list[Fraction]]) -> list[Fraction]:
    """The solution of a regular system; each row ends with its right-hand side."""
    rows, n = [list(r) for r in rows], len(rows)
    for i in range(n):
        p = next(r for r in range(i, n) if rows[r][i])
        rows[i], rows[p] = rows[p], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for r in range(n):
            if r != i and rows[r][i]:
                rows[r] = [x - rows[r][i] * y for x, y in zip(rows[r], rows[i])]
    return [r[n] for r in rows]


def shapley(values: list[int]) -> list[Fraction]:
    """Shapley values from all coalition values (index: bit mask) by kernel-weighted, efficiency-constrained least squares."""
    full = len(values) - 1
    n = full.bit_length()
    gram = [[Fraction(0)] * n for _ in range(n)]
    right = [Fraction(0)] * n
    for s in range(1, full):
        size = s.bit_count()
        weight = Fraction(n - 1, comb(n, size) * size * (n - size))
        inside = [i for i in range(n) if s >> i & 1]
        for i in inside:
            right[i] += weight * (values[s] - values[0])
            for j in inside:
                gram[i][j] += weight
    bound = [[*gram[i], Fraction(1), right[i]] for i in range(n)]
    bound.append([*[Fraction(1)] * n, Fraction(0), Fraction(values[full] - values[0])])
    return solve(bound)[:n]


def with_shapley(table: DataFrame, value: str = "removed_n") -> DataFrame:
    """``table`` (one row a part) with ``shapley``: one exact rational per filter."""
    @F.udf(RATIONALS)
    def exact(values):
        return [(x.numerator, x.denominator) for x in shapley(values)]

    return table.withColumn("shapley", exact(value))


def steps(table: DataFrame, names: str, marks: list[str]) -> DataFrame:
    """Each part, order of the filters and step, with the counts of the filter that is applied there."""
    n = len(names)
    if n > MOST_FILTERS:
        raise ValueError(f"orders of more than {MOST_FILTERS} filters are not listed")
    orders = F.lit([list(p) for p in permutations(range(n))])
    every = table.withColumn("_order", F.explode(orders)).select(
        "*", F.posexplode("_order").alias("_at", "_filter"))
    before = F.aggregate(F.slice("_order", F.lit(1), F.col("_at")), F.lit(0), lambda a, i: a + F.call_function("shiftleft", F.lit(1), i))
    every = every.withColumn("_before", before).withColumn("_bit", F.call_function("shiftleft", F.lit(1), F.col("_filter")))

    def removed(name: str, coalition: Column) -> Column:
        return F.get(f"removed_{name}", coalition)

    after, full = F.col("_before") + F.col("_bit"), F.lit((1 << n) - 1)
    here = {m: removed(m, after) - removed(m, F.col("_before")) for m in ["n", *marks]}
    return every.select(
        "part", F.array_join(F.transform("_order", lambda i: F.substring(F.lit(names), i + 1, F.lit(1))), "").alias("filter_order"),
        (F.col("_at") + 1).alias("step"), (F.col("total") - removed("n", after)).alias("kept"), here["n"].alias("removed"),
        (removed("n", F.col("_bit")) - here["n"]).alias("redundant"),
        (removed("n", full) - removed("n", full - F.col("_bit"))).alias("unique_fails"),
        *[here[m].alias(f"{m}_lost") for m in marks], F.get("shapley", F.col("_filter")).alias("shapley"))
