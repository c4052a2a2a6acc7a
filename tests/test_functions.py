import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import arrays as A
from seqloom.functions import scalar


def _one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_saturation_and_stimulus(spark):
    found = [_one(spark, scalar.saturation(F.lit(float(t))))[0] for t in (1, 2, 3, 4)]
    assert found == pytest.approx([0.334200, 0.165959, 0.082413, 0.040925], abs=1e-6)
    phrases = F.array(F.lit("ab c"), F.lit("d"))
    assert _one(spark, scalar.padded_stimulus(phrases, 2, 1, 3, 1))[0] == "  ab c   d "


def test_widths_are_inverse(spark):
    assert _one(spark, scalar.fwhm_to_sigma(scalar.sigma_to_fwhm(F.lit(1.7))))[0] == pytest.approx(1.7)


def test_softmax_log_and_bits(spark):
    df = spark.createDataFrame([(1, -1.0), (1, -2.0), (1, -3.0)], "k int, x double")
    found = sorted((r["p"] for r in scalar.softmax(df, "x", ["k"]).collect()), reverse=True)
    assert found == pytest.approx([0.900901, 0.090090, 0.009009], abs=1e-6)
    assert _one(spark, scalar.log10_or_minus_infinity(F.lit(0.0)))[0] == -math.inf
    assert _one(spark, scalar.bits_per_selection(F.lit(27), F.lit(0.9)))[0] == pytest.approx(3.815848, abs=1e-6)
    assert _one(spark, scalar.bits_per_selection(F.lit(4), F.lit(1.0)))[0] == 2.0


@pytest.mark.parametrize("name, centre", [("l-c+r", "c"), ("c+r", "c"), ("l-c", "c"), ("c", "c")])
def test_centre_unit(spark, name, centre):
    assert _one(spark, scalar.centre_unit(F.lit(name)))[0] == centre


def test_linear_algebra(spark):
    r = np.random.default_rng(1)
    m, n, v = r.normal(size=(3, 3)), r.normal(size=(3, 4)), r.normal(size=3)
    df = spark.createDataFrame([(m.tolist(), n.tolist(), v.tolist())], "m array<array<double>>, n array<array<double>>, v array<double>")
    row = df.select(
        A.matvec("m", "v").alias("mv"), A.quadratic("v", "m").alias("q"), A.matmul("m", "n").alias("mn"), A.diagonal_of_product("m", "m").alias("d"),
        A.row_scale("m", "v").alias("s"), A.pad("v", F.lit(5)).alias("p"), A.lagged_product("v", 1).alias("l"), A.lagged_product("v", 7).alias("none"),
    ).first()
    assert np.allclose(row["mv"], m @ v) and np.isclose(row["q"], v @ m @ v) and np.allclose(row["mn"], m @ n)
    assert np.allclose(row["d"], np.diag(m @ m)) and np.allclose(row["s"], m * v[:, None]) and row["p"][3:] == [0.0, 0.0]
    assert np.isclose(row["l"], (v[:-1] * v[1:]).sum()) and row["none"] == 0.0


def test_change_from_a_first_value_of_zero(spark):
    row = _one(spark, A.relative_to_first(F.array(F.lit(0.0), F.lit(2.0), F.lit(-2.0))))[0]
    assert math.isnan(row[0]) and row[1:] == [math.inf, -math.inf]
