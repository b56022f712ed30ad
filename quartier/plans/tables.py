"""The driver's tables in the roles that the operators expect, as DataFrames and as SQL.

Areas are nations, lots are customers, inspections are orders (positive with status F), complaints are urgent orders, pest violations
are returned line items, permits are line items by ship date (demolitions with line status F), weather is a daily aggregate of orders, and the area
polygons are unit squares on a five by five grid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import week_start
from ..operators import aggregates, joins, series
from ..sources.work import folder as scratch
from ..sources.work import stored

__all__ = ["scratch", "stored"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def lots(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("bbl"), F.col("c_nationkey").alias("nta_id"), "c_acctbal", "c_mktsegment")


def inspections(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("bbl"), F.col("o_orderdate").cast("date").alias("d"), F.col("o_orderstatus").alias("result"), "o_orderpriority", "o_totalprice"
    )
    return joins.attach_area(orders, lots(spark, d))


def labels(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.weekly_counts(inspections(spark, d), "nta_id", "d", {"positive_count": F.col("result") == "F"})


def complaints(spark: SparkSession, d: str) -> DataFrame:
    urgent = inspections(spark, d).where("o_orderpriority = '1-URGENT'")
    counts = aggregates.weekly_counts(urgent, "nta_id", "d", {}, total="complaints_count")
    return series.lags(counts, "complaints_count")


def _items(spark: SparkSession, d: str, date: str) -> DataFrame:
    items = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", F.col("l_shipdate").cast("date").alias("ship"))
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("bbl"), F.col("o_orderdate").cast("date").alias("ordered"))
    both = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("bbl", "l_returnflag", "l_linestatus", F.col(date).alias("d"))
    return joins.attach_area(both, lots(spark, d).select("bbl", "nta_id"))


def pests(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.weekly_counts(_items(spark, d, "ordered"), "nta_id", "d", {"pest_count": F.col("l_returnflag") == "R"}).drop("total_count")


def permits(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.weekly_counts(_items(spark, d, "ship"), "nta_id", "d", {"demolitions_count": F.col("l_linestatus") == "F"}, total="permits_count")


def items(spark: SparkSession, d: str) -> DataFrame:
    """pests and permits in one: each line item counts in its order's week and in its shipping week, so the three tables are joined once."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", F.col("l_shipdate").cast("date").alias("ship"))
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("bbl"), F.col("o_orderdate").cast("date").alias("ordered"))
    both = joins.attach_area(lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")), lots(spark, d).select("bbl", "nta_id"))
    dated = F.explode(F.array(F.struct(F.lit(True).alias("shipped"), F.col("ship").alias("d")), F.struct(F.lit(False).alias("shipped"), F.col("ordered").alias("d")))).alias("e")
    rows = both.select("nta_id", "l_returnflag", "l_linestatus", dated).select("nta_id", "e.d", "e.shipped", "l_returnflag", "l_linestatus")
    shipped = F.col("shipped")
    counted = {"pest_count": ~shipped & (F.col("l_returnflag") == "R"), "permits_count": shipped, "demolitions_count": shipped & (F.col("l_linestatus") == "F")}
    return aggregates.weekly_counts(rows, "nta_id", "d", counted).drop("total_count")


def daily(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("date"), "o_totalprice")
    return orders.groupBy("date").agg(
        (F.avg("o_totalprice") / 9973).alias("tavg_c"), F.count(F.lit(1)).cast("double").alias("prcp_mm")
    )


def weather(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.numbers import degree_days

    heating, cooling = degree_days(F.col("tavg_c"))
    return aggregates.weekly_weather(daily(spark, d).withColumns({"hdd": heating, "cdd": cooling}))


def static(spark: SparkSession, d: str) -> DataFrame:
    rows = lots(spark, d).withColumn("units", F.lit(1))
    return aggregates.static_profile(
        rows, "nta_id", ["units"], ["c_acctbal"],
        {"residential_pct": ("c_mktsegment", ("BUILDING", "HOUSEHOLD")), "commercial_pct": ("c_mktsegment", ("AUTOMOBILE", "MACHINERY"))},
    )


def panel(spark: SparkSession, d: str) -> DataFrame:
    parts = {"complaints": complaints(spark, d), "items": items(spark, d), "weather": weather(spark, d), "static": static(spark, d)}
    return joins.build_panel(labels(spark, d), parts, ["complaints_count", "pest_count", "permits_count", "demolitions_count"])


def squares(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    x, y = (k % 5).cast("double"), F.floor(k / 5).cast("double")
    corner = lambda i, j: F.struct((x + i).alias("x"), (y + j).alias("y"))
    return table(spark, d, "nation").select(k.alias("nta_id"), F.col("n_name").alias("name"), F.array(F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1))).alias("rings"))


def points(spark: SparkSession, d: str) -> DataFrame:
    """A place for each order, some beyond the grid and none on a side."""
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("inspection_date"), ((k * 37 % 600) / 100.0 + 0.005).alias("lon"), ((k * 53 % 600) / 100.0 + 0.005).alias("lat")
    )


def scored(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, lang, y, p): the quality label and a score in 0..1 with many ties, from the length of the document."""
    p = F.floor(F.col("n_chars") / 40) / (F.floor(F.col("n_chars") / 40) + 40.0)
    docs = table(spark, d, "documents").select("doc_id", "lang", p.alias("p"))
    return table(spark, d, "labels").select("doc_id", F.col("quality").alias("y")).join(docs, "doc_id")


def week_of_events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("week_start", week_start(F.col("ts")))


#: SQL of the same roles, to put after WITH.
INSPECTIONS = """insp AS (SELECT o_orderkey, c_nationkey AS nta_id, CAST(o_orderdate AS DATE) AS d, o_orderstatus AS result, o_orderpriority, o_totalprice
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
LABELS = f"""{INSPECTIONS}, labels AS (SELECT nta_id, CAST(date_trunc('week', d) AS DATE) AS week_start, count(*) AS total_count,
  count(*) FILTER (WHERE result = 'F') AS positive_count FROM insp GROUP BY ALL)"""
COMPLAINTS = """comp AS (SELECT nta_id, CAST(date_trunc('week', d) AS DATE) AS week_start, count(*) AS complaints_count FROM insp
  WHERE o_orderpriority = '1-URGENT' GROUP BY ALL),
complaints AS (SELECT *, lag(complaints_count, 1) OVER w AS complaints_count_lag_1w, lag(complaints_count, 4) OVER w AS complaints_count_lag_4w,
  lag(complaints_count, 12) OVER w AS complaints_count_lag_12w FROM comp WINDOW w AS (PARTITION BY nta_id ORDER BY week_start))"""
ITEMS = """items AS (SELECT c_nationkey AS nta_id, l_returnflag, l_linestatus, CAST(o_orderdate AS DATE) AS ordered, CAST(l_shipdate AS DATE) AS ship
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
pests AS (SELECT nta_id, CAST(date_trunc('week', ordered) AS DATE) AS week_start, count(*) FILTER (WHERE l_returnflag = 'R') AS pest_count FROM items GROUP BY ALL),
permits AS (SELECT nta_id, CAST(date_trunc('week', ship) AS DATE) AS week_start, count(*) AS permits_count,
  count(*) FILTER (WHERE l_linestatus = 'F') AS demolitions_count FROM items GROUP BY ALL)"""
WEATHER = """daily AS (SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) / 9973 AS tavg_c, CAST(count(*) AS DOUBLE) AS prcp_mm FROM orders GROUP BY ALL),
weather AS (SELECT CAST(date_trunc('week', date) AS DATE) AS week_start, round(avg(tavg_c), 4) AS weather_tavg_c, round(sum(prcp_mm), 4) AS weather_prcp_mm,
  round(sum(round(greatest(18.0 - tavg_c, 0.0), 4)), 4) AS weather_hdd, round(sum(round(greatest(tavg_c - 18.0, 0.0), 4)), 4) AS weather_cdd FROM daily GROUP BY ALL)"""
STATIC = """static AS (SELECT c_nationkey AS nta_id, count(*) AS units_total, CAST(round_even(quantile_cont(c_acctbal, 0.5), 0) AS INTEGER) AS c_acctbal_median,
  round(avg(CAST(c_mktsegment IN ('BUILDING', 'HOUSEHOLD') AS INTEGER)), 4) AS residential_pct,
  round(avg(CAST(c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') AS INTEGER)), 4) AS commercial_pct FROM customer WHERE c_nationkey IS NOT NULL GROUP BY ALL)"""
PANEL = f"""{LABELS}, {COMPLAINTS}, {ITEMS}, {WEATHER}, {STATIC}, panel AS (
SELECT l.nta_id, l.week_start, total_count, positive_count, round(positive_count / total_count, 4) AS positive_rate, positive_count > 0 AS positive_ind,
  coalesce(complaints_count, 0) AS complaints_count, complaints_count_lag_1w, complaints_count_lag_4w, complaints_count_lag_12w,
  coalesce(pest_count, 0) AS pest_count, coalesce(permits_count, 0) AS permits_count, coalesce(demolitions_count, 0) AS demolitions_count,
  weather_tavg_c, weather_prcp_mm, weather_hdd, weather_cdd, units_total, c_acctbal_median, residential_pct, commercial_pct
FROM labels l LEFT JOIN complaints USING (nta_id, week_start) LEFT JOIN pests USING (nta_id, week_start) LEFT JOIN permits USING (nta_id, week_start)
  LEFT JOIN weather USING (week_start) LEFT JOIN static USING (nta_id))"""
SCORED = """scored AS (SELECT doc_id, lang, CAST(quality AS INTEGER) AS y, (n_chars // 40) / ((n_chars // 40) + 40.0) AS p FROM labels JOIN documents USING (doc_id))"""
POINTS = """points AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS inspection_date, (o_orderkey * 37 % 600) / 100.0 + 0.005 AS lon,
  (o_orderkey * 53 % 600) / 100.0 + 0.005 AS lat FROM orders)"""
