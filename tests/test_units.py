import math

from pyspark.sql import functions as F

from assaykit.functions import units as U
from assaykit.operators import cleaning as C


def test_normalize_exponent_base(spark):
    rows = [(" µM ",), ("μM",), ("microM",), ("10'-9M",), ("x10^-10M",), ("10^-9M",), ("umol/L",),
            ("NM",), ("10'8pm",), ("furlong",), ("",), (None,)]
    df = spark.createDataFrame(rows, "u string").withColumn("n", U.normalize_unit("u"))
    df = df.select("u", "n", U.unit_exponent("n").alias("e"), U.unit_base("n").alias("b"),
                   U.unit_multiplier(U.unit_base("n")).alias("m"))
    got = {r.u: (r.n, r.e, r.b, r.m) for r in df.collect()}
    assert got[" µM "] == ("um", 0, "um", 1e3)
    assert got["μM"] == ("um", 0, "um", 1e3)
    assert got["microM"] == ("um", 0, "um", 1e3)
    assert got["10'-9M"][1:3] == (-9, "m")
    assert got["x10^-10M"][1:3] == (-10, "m")
    assert got["umol/L"][2:] == ("umol/l", 1e3)
    assert got["NM"][3] == 1.0
    # A prefixed unit such as 10'8pm parses as exponent 8, base pm (kept as in the source).
    assert got["10'8pm"][1:] == (8, "pm", 1e-3)
    assert got["furlong"][3] is None
    assert got[""][3] is None
    assert got[None][0] is None


def test_to_nanomolar_values(spark):
    df = spark.createDataFrame([(1.5, " µM "), (2.0, "10^-9M"), (3.0, "pM"), (4.0, "??")], "value double, units string")
    out = {r.units: r.value_nM for r in C.to_nanomolar(df).collect()}
    assert math.isclose(out[" µM "], 1500.0)
    assert math.isclose(out["10^-9M"], 2.0)
    assert math.isclose(out["pM"], 3e-3)
    assert out["??"] is None


def test_to_molar_and_consistency(spark):
    df = spark.createDataFrame(
        [(1, 1.0, "uM", 1000.0, "nM"), (2, 1.0, "uM", 999.0, "nM"), (3, 5.0, "furlong", 5.0, "nM"),
         (4, None, "nM", 1.0, "nM"), (5, 2.0, " µM ", 2000.0, "nM")],
        "id long, value double, units string, standard_value double, standard_units string")
    got = sorted(r.id for r in C.consistent_measurements(df).collect())

    def molar(v, u):  # brute force: plain Python floats, as the exploration code computes
        m = U.MOLAR_MULTIPLIER.get(u.strip().lower()) if u is not None else None
        return None if v is None or m is None else float(v) * m

    expect = sorted(i for i, v, u, sv, su in df.collect()
                    if v is not None and molar(v, u) is not None and molar(sv, su) is not None
                    and molar(v, u) == molar(sv, su))
    assert got == expect


def test_molar_log_keeps_positive(spark):
    df = spark.createDataFrame([(1e-9,), (0.0,), (-1.0,), (None,)], "molar double")
    out = C.molar_log(df).collect()
    assert len(out) == 1 and math.isclose(out[0].log_value, 9.0)
