"""Queries over whole tables that no one task can hold: quantiles of columns, boxes in polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.operators import bootstrap, spatial
from tilewright.operators.quantiles import exact_quantiles
from tilewright.plans.queries import _delta_rows, rounded
from tilewright.plans.registry import said
from tilewright.plans.sql import SQL
from tilewright.plans.tables import table

SHARES = (0.0, 0.02, 0.25, 0.5, 0.9, 0.98, 1.0)
MEASURES = ("l_quantity", "l_extendedprice", "l_discount")


@said(" UNION ALL ".join(f"SELECT '{c}' AS measure, CAST({q} AS DOUBLE) AS share, round(quantile_cont(CAST({c} AS DOUBLE), {q}), 6) AS value FROM lineitem" for c in MEASURES for q in SHARES))
def column_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of three measures of all order lines."""
    found = exact_quantiles(table(spark, sf_dir, "lineitem"), {c: SHARES for c in MEASURES})
    rows = [(c, q, v) for c in MEASURES for q, v in zip(SHARES, found[c], strict=True)]
    return rounded(spark.createDataFrame(rows, "measure string, share double, value double"))


#: Orders as boxes (every ninth customer's has none, every seventh's crosses the antimeridian), nations as frames and a distant part.
_SQUARE = """bx AS (SELECT o_orderkey, unnest(CASE WHEN o_custkey % 7 = 0 THEN [[179.0, y, 180.0, y + 1.25], [-180.0, y, -179.5, y + 1.25]] ELSE [[x, y, x + 1.5, y + 1.25]] END) AS b
  FROM (SELECT o_orderkey, o_custkey, CAST(o_custkey * 7 % 356 AS DOUBLE) - 178 AS x, CAST(o_custkey * 13 % 170 AS DOUBLE) - 85 AS y FROM orders WHERE o_custkey % 9 <> 0)),
sq AS (SELECT n_nationkey AS polygon_id, CAST(n_nationkey * 14 - 175.25 AS DOUBLE) AS x, CAST(n_nationkey * 31 % 120 - 65.5 AS DOUBLE) AS y FROM nation)"""


@said(f"""WITH {_SQUARE} SELECT polygon_id, count(DISTINCT o_orderkey) AS boxes, sum(DISTINCT o_orderkey) AS keys FROM bx, sq
WHERE (b[1] <= x + 20 AND b[3] >= x AND b[2] <= y + 16 AND b[4] >= y AND NOT (b[1] > x + 4 AND b[3] < x + 16 AND b[2] > y + 3 AND b[4] < y + 13))
   OR (b[1] <= -x + 2 AND b[3] >= -x AND b[2] <= -y + 2 AND b[4] >= -y) GROUP BY polygon_id""")
def boxes_by_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many orders' boxes each nation's frame or its distant part meets."""
    key = F.col("o_custkey")
    x, y = (key * 7 % 356).cast("double") - 178, (key * 13 % 170).cast("double") - 85
    crossing = key % 7 == 0
    box = F.array(F.when(crossing, 179.0).otherwise(x), y, F.when(crossing, -179.5).otherwise(x + 1.5), y + 1.25)
    boxes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("box_id"), F.when(key % 9 != 0, box).alias("bbox"))
    left, low = F.col("n_nationkey") * 14 - F.lit(175.25), F.col("n_nationkey") * 31 % 120 - F.lit(65.5)

    def ring(x: Column, y: Column, wide: float, high: float) -> Column:
        return F.array(*[F.struct((x + a).alias("x"), (y + b).alias("y")) for a, b in ((0.0, 0.0), (wide, 0.0), (wide, high), (0.0, high), (0.0, 0.0))])

    rings = F.array(ring(left, low, 20.0, 16.0), ring(left + 4, low + 3, 12.0, 10.0), ring(-left, -low, 2.0, 2.0))
    polygons = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("polygon_id"), rings.alias("rings"))
    met = spatial.boxes_in_polygons(boxes, polygons)
    return rounded(met.groupBy("polygon_id").agg(F.count("*").alias("boxes"), F.sum("box_id").alias("keys")))


_DELTAS = SQL["paired_metric_delta"]


@said(f"""WITH d AS ({_DELTAS}) SELECT false AS macro, CAST(category AS VARCHAR) AS category, paired_query_count, recall_delta, map_delta, true AS held FROM d
UNION ALL SELECT true, NULL, CAST(sum(paired_query_count) AS BIGINT), round(avg(recall_delta), 5), round(avg(map_delta), 5), NULL FROM d HAVING count(*) > 0""")
def paired_delta_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deltas by category with their intervals and the macro mean in one result; ``held`` tells that an interval holds its delta."""
    first, second = _delta_rows(spark, sf_dir)
    fields = first.select("query_id", F.concat(F.lit("f"), F.floor(F.col("query_id").cast("long") / 50).cast("string")).alias("field_id")).distinct()
    found = bootstrap.field_deltas(first, second, fields)
    held = F.col("recall_delta").between(F.col("recall_low") - 1e-9, F.col("recall_high") + 1e-9) & F.col("map_delta").between(F.col("map_low") - 1e-9, F.col("map_high") + 1e-9)
    shown = found.select("macro", "category", "paired_query_count", "recall_delta", "map_delta", held.alias("held"))
    return rounded(shown.withColumns({c: F.when(F.col("macro"), F.round(c, 5)).otherwise(F.col(c)) for c in ("recall_delta", "map_delta")}))
