"""Filters, projections and the activity clean step.

Everything here is a narrow transformation (no shuffle). Filters are written
as plain comparisons and ``isin`` so Catalyst pushes them into the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from assaykit.functions import numeric, units

# Fixed values that must match the reference's job defaults.
STANDARD_TYPES = ("IC50", "GI50", "Ki", "EC50")
POTENTIAL_DUPLICATE = 0
ORGANISMS = ("Homo sapiens",)
TAX_IDS = (9606,)
EXPLORATION_ORGANISMS = ("Homo sapiens", "Mus musculus", "Rattus norvegicus")
EXPLORATION_TAX_IDS = (9606, 10090, 10116)
GRAPH_STANDARD_TYPE = "IC50"
GRAPH_STANDARD_RELATION = "="

ACTIVITY_COLUMNS = (
    "activity_id", "assay_id", "molregno", "standard_type", "standard_value",
    "standard_units", "standard_relation", "standard_flag", "pchembl_value", "type",
    "value", "units", "potential_duplicate",
)
ASSAY_COLUMNS = ("assay_id", "assay_type", "assay_organism", "assay_tax_id", "tid",
                 "doc_id", "chembl_id")


# --- schema and projections ---------------------------------------------------------

def enforce_schema(df: DataFrame, schema: StructType, safe: bool = False) -> DataFrame:
    """Project ``df`` onto ``schema``: column order, names and types (S3).

    A value that doesn't fit its type fails the job, as an enforced schema
    should; ``safe=True`` turns it into NULL instead.
    """
    cols = []
    for field in schema.fields:
        c = F.col(field.name)
        cols.append((c.try_cast(field.dataType) if safe else c.cast(field.dataType)).alias(field.name))
    return df.select(*cols)


def project_activity(df: DataFrame) -> DataFrame:
    """The 13 activity columns; the three numeric measures as doubles."""
    doubles = {"standard_value", "pchembl_value", "value"}
    longs = {"activity_id", "assay_id", "molregno", "standard_flag", "potential_duplicate"}
    out = []
    for name in ACTIVITY_COLUMNS:
        c = F.col(name)
        if name in doubles:
            c = c.try_cast("double")
        elif name in longs:
            c = c.try_cast("bigint")
        else:
            c = c.cast("string")
        out.append(c.alias(name))
    return df.select(*out)


def project_assay(df: DataFrame) -> DataFrame:
    """The 7 assay columns."""
    longs = {"assay_id", "assay_tax_id", "tid", "doc_id"}
    return df.select(*[(F.col(c).try_cast("bigint") if c in longs else F.col(c).cast("string")).alias(c)
                       for c in ASSAY_COLUMNS])


def project_structure(df: DataFrame, id_col: str = "molregno",
                      structure_col: str = "canonical_smiles") -> DataFrame:
    """molregno + canonical_smiles under their export names."""
    return df.select(F.col(id_col).cast("bigint").alias("molregno"),
                     F.col(structure_col).cast("string").alias("canonical_smiles"))


# --- filters -------------------------------------------------------------------------

def filter_activity(df: DataFrame, types: Sequence[str] = STANDARD_TYPES,
                    duplicate: int = POTENTIAL_DUPLICATE) -> DataFrame:
    """standard_type in ``types`` and potential_duplicate == ``duplicate`` (F1)."""
    return df.where(F.col("standard_type").isin(*types)
                    & (F.col("potential_duplicate") == duplicate))


def filter_assay(df: DataFrame, organisms: Sequence[str] = ORGANISMS,
                 tax_ids: Sequence[int] = TAX_IDS, mode: str = "and") -> DataFrame:
    """Organism rule: both lists must match (``and``, Spark jobs) or either (``or``, exploration)."""
    org = F.col("assay_organism").isin(*organisms)
    tax = F.col("assay_tax_id").isin(*tax_ids)
    if mode == "and":
        return df.where(org & tax)
    if mode == "or":
        return df.where(org | tax)
    raise ValueError(f"mode must be 'and' or 'or', got {mode!r}")


def filter_structures(df: DataFrame, col: str = "canonical_smiles") -> DataFrame:
    """Drop null and empty structures when the column exists."""
    if col not in df.columns:
        return df
    return df.where(F.col(col).isNotNull() & (F.col(col) != ""))


def filter_exact_labels(df: DataFrame, standard_type: str = GRAPH_STANDARD_TYPE,
                        relation: str = GRAPH_STANDARD_RELATION) -> DataFrame:
    """Only exact measurements of one type."""
    return df.where((F.col("standard_type") == standard_type)
                    & (F.col("standard_relation") == relation))


def drop_incomplete(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Drop rows with a NULL (or NaN) in any of ``cols``; all columns by default."""
    return df.na.drop(how="any", subset=list(cols) if cols is not None else None)


def finite_only(df: DataFrame, col: str = "value") -> DataFrame:
    """Keep rows whose ``col`` is a finite number."""
    return df.where(numeric.is_finite(col))


def value_mismatches(df: DataFrame, a: str, b: str, tol: float,
                     unit_col: str | None = None, unit: str | None = None) -> DataFrame:
    """Rows where |a - b| >= tol, optionally for one unit only."""
    out = df.where(F.abs(F.col(a) - F.col(b)) >= F.lit(tol))
    if unit_col is not None:
        out = out.where(F.col(unit_col) == unit)
    return out


# --- potency -----------------------------------------------------------------------

def add_pic(df: DataFrame, value: str = "standard_value", unit: str = "standard_units",
            scale: float = numeric.NANOMOLAR, out: str = "pIC",
            unit_value: str = "nM") -> DataFrame:
    """Keep positive nM measurements and add ``pIC = -log10(value * 1e-9)``."""
    return (df.where((F.col(unit) == unit_value) & (F.col(value) > 0))
            .withColumn(out, numeric.pic(value, scale)))


def preprocess_activity(df: DataFrame) -> DataFrame:
    """Default clean step: drop any incomplete row, then add pIC.

    The null drop spans every column, so a row without pchembl_value goes too.
    """
    return add_pic(drop_incomplete(df))


def to_nanomolar(df: DataFrame, value: str = "value", unit: str = "units") -> DataFrame:
    """Add ``units_norm`` and ``value_nM`` from a raw value and free-text unit."""
    norm = units.normalize_unit(unit)
    factor = units.unit_multiplier(units.unit_base(norm)) * F.pow(F.lit(10.0), units.unit_exponent(norm))
    return (df.withColumn("units_norm", norm)
            .withColumn("value_nM", (F.col(value) * factor).cast("double")))


def consistent_measurements(df: DataFrame, value: str = "value", unit: str = "units",
                            std_value: str = "standard_value", std_unit: str = "standard_units",
                            out: str = "molar") -> DataFrame:
    """Rows whose raw and standard values convert to the same molar value."""
    raw = units.to_molar(value, unit)
    std = units.to_molar(std_value, std_unit)
    complete = (F.col(value).isNotNull() & F.col(unit).isNotNull()
                & F.col(std_value).isNotNull() & F.col(std_unit).isNotNull())
    return (df.where(complete).withColumn(out, raw).withColumn("_std_molar", std)
            .where(F.col(out).isNotNull() & F.col("_std_molar").isNotNull()
                   & (F.col(out) == F.col("_std_molar")))
            .drop("_std_molar"))


def molar_log(df: DataFrame, molar: str = "molar", out: str = "log_value") -> DataFrame:
    """Keep positive molar values and add -log10."""
    return df.where(F.col(molar) > 0).withColumn(out, units.neg_log10(molar))
