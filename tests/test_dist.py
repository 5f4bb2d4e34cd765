"""Distribution tails against closed forms and the standard library."""

import math

import pytest
from pyspark.sql import functions as F

from surveyfx.functions import dist


def test_normal_tail(spark):
    z = [(k / 7,) for k in range(-60, 61)] + [(12.0,), (25.0,)]
    for r in spark.createDataFrame(z, "z double").select("z", dist.normal_p("z").alias("p")).collect():
        assert r.p == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)), rel=1e-12, abs=1e-300)


def closed_t_p(t, df):
    """Two-sided tail for 1, 2, 3 and 4 degrees of freedom."""
    t = abs(t)
    if df == 1:
        return 1 - 2 / math.pi * math.atan(t)
    if df == 2:
        return 1 - t / math.sqrt(2 + t * t)
    if df == 3:
        return 1 - 2 / math.pi * (math.atan(t / math.sqrt(3)) + t / math.sqrt(3) / (1 + t * t / 3))
    return 1 - 0.75 * t / math.sqrt(1 + t * t / 4) * (1 - t * t / 12 / (1 + t * t / 4))


def test_t_tail_closed_forms(spark):
    rows = [(t, float(df)) for df in (1, 2, 3, 4) for t in (0.0, 0.05, 0.7, 1.5, 2.2, -3.0, 9.0)]
    for r in spark.createDataFrame(rows, "t double, df double").select("t", "df", dist.t_p("t", "df").alias("p")).collect():
        assert r.p == pytest.approx(closed_t_p(r.t, int(r.df)), rel=1e-9, abs=1e-12)


def simpson_t_p(t, df, steps=20000):
    const = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    h = t / steps
    weights = lambda k: 1 if k in (0, steps) else 4 if k % 2 else 2
    area = sum(weights(k) * (1 + (k * h) ** 2 / df) ** (-(df + 1) / 2) for k in range(steps + 1)) * h / 3
    return 1 - 2 * const * area


def test_t_tail_quadrature(spark):
    rows = [(t, df) for df in (7.3, 55.5, 199.0, 201.0, 5000.5) for t in (0.4, 1.96, 3.3)]
    for r in spark.createDataFrame(rows, "t double, df double").select("t", "df", dist.t_p("t", "df").alias("p")).collect():
        assert r.p == pytest.approx(simpson_t_p(r.t, r.df), abs=1e-9)


@pytest.mark.parametrize("level", [0.9, 0.95, 0.99])
def test_t_quantile_inverts_tail(spark, level):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 4.0, 9.7, 60.0, 199.9, 200.1, 900.0, 1e6)], "df double")
    out = df.withColumn("q", dist.t_quantile(level, "df")).withColumn("p", dist.t_p("q", "df"))
    for r in out.collect():
        assert r.p == pytest.approx(1 - level, abs=1e-10)


def test_large_df_is_normal(spark):
    row = spark.range(1).select(F.lit(1.7).alias("t"), F.lit(1e14).alias("df")).select(dist.t_p("t", "df").alias("p"), dist.normal_p("t").alias("z")).first()
    assert row.p == pytest.approx(row.z, abs=1e-12)
