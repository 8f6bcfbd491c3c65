"""Quantiles by digits against NumPy and Spark's own percentile."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import quantiles

SHARES = (0.0, 0.02, 0.1, 0.5, 0.731, 0.98, 1.0)


def test_bits_are_in_the_order_of_numbers():
    values = np.array([-np.inf, -1e300, -1.5, -1.0, -5e-324, -0.0, 0.0, 5e-324, 1.0, 1.0 + 2**-52, 1e300, np.inf])
    bits = quantiles.ordered_bits(values)
    assert (np.diff(bits.astype(object)) >= 0).all() and bits[5] == bits[6] and len(set(bits.tolist())) == len(values) - 1
    assert [quantiles._value(int(b)) for b in bits] == values.tolist()


@pytest.mark.parametrize("few", [4096, 3, 0])
def test_quantiles_have_the_bits_of_percentile(spark, few):
    r = np.random.default_rng(2)
    a = np.concatenate([r.normal(size=400), [0.0, -0.0, 1e-310, -1e300], np.repeat(0.25, 200), np.exp(r.uniform(-500, 500, 100))])
    b = r.integers(-3, 4, len(a)).astype(float)
    rows = [(float(x), float(y) if k % 5 else None, None) for k, (x, y) in enumerate(zip(a, b, strict=True))]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(5)
    got = quantiles.exact_quantiles(df, {"a": SHARES, "b": SHARES, "c": (0.5,)}, few)
    want = df.agg(*[F.percentile(c, F.array(*[F.lit(s) for s in SHARES])).alias(c) for c in "ab"]).first()
    assert got["a"] == list(want.a) and got["b"] == list(want.b) and got["c"] == [None]
    assert np.allclose(got["a"], np.quantile(a, SHARES), rtol=1e-12)


def test_empty_and_refused(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "a double")
    assert quantiles.exact_quantiles(df.limit(0), {"a": (0.5,)}) == {"a": [None]}
    with pytest.raises(Exception, match="a holds values that are not numbers"):
        quantiles.exact_quantiles(df, {"a": (0.5,)})
    with pytest.raises(ValueError, match="between 0 and 1"):
        quantiles.exact_quantiles(df, {"a": (1.5,)})
    assert quantiles.exact_quantiles(spark.range(10_001).select(F.col("id").alias("a")), {"a": (0.5, 0.25)}, few=10) == {"a": [5000.0, 2500.0]}


def test_one_stream_is_in_order_whatever_the_layout(spark):
    from tilewright.functions.order import one_stream

    df = spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(1000)).alias("a"), "id").repartition(7)
    got = one_stream(df, F.col("a").desc(), "id")
    assert got.rdd.getNumPartitions() == 1
    rows = [(r.a, r.id) for r in got.collect()]
    assert rows == sorted(rows, key=lambda r: (-r[0], r[1])) and len(rows) == 5000
