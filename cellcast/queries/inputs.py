"""Engine inputs derived from the driver's tables, in Spark and as SQL views.

Cells: the customer key gives a place on a 0.25 degree grid (40 columns per block, 360 rows,
8 blocks of columns), top-left centre at latitude 5, longitude 30.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellcast.operators.common import daily_series
from cellcast.sources.polygons import areas_from_wkt

TOP, LEFT, RES = 5.0, 30.0, 0.25
BBOX = (31.1, -3.3, 36.2, 3.9)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def grid_row(key: Column) -> Column:
    return (F.floor(key / 40) % 360).cast("int")


def grid_col(key: Column) -> Column:
    return (key % 40 + 40 * (F.floor(key / 14400) % 8)).cast("int")


def _place(df: DataFrame, key: str) -> DataFrame:
    df = df.withColumn("row", grid_row(F.col(key))).withColumn("col", grid_col(F.col(key)))
    return df.withColumn("lat", F.lit(TOP) - RES * F.col("row")).withColumn(
        "lon", F.lit(LEFT) + RES * F.col("col")
    )


def daily(spark: SparkSession, d: str) -> DataFrame:
    """(gid, fdate, rainf, runoff): one row per supplier and ship date."""
    li = table(spark, d, "lineitem")
    water = F.floor(F.col("l_extendedprice") * F.col("l_discount")).cast("double")
    return daily_series(
        li.select(F.col("l_suppkey").alias("gid"), "l_shipdate", "l_quantity", water.alias("w")),
        ["gid"],
        F.to_date("l_shipdate"),
        rainf=F.sum("l_quantity"),
        runoff=F.sum("w"),
    )


def layered(spark: SparkSession, d: str) -> DataFrame:
    """(gid, fdate, layer, soil_moist) with three layers."""
    li = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("gid"),
        ((F.col("l_linenumber") - 1) % 3 + 1).alias("layer"),
        "l_shipdate",
        "l_quantity",
    )
    return daily_series(
        li, ["gid", "layer"], F.to_date("l_shipdate"), soil_moist=F.sum("l_quantity")
    )


def layer_total(spark: SparkSession, d: str) -> DataFrame:
    """(gid, fdate, soil_moist) over all layers, in one aggregation."""
    li = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("gid"), "l_shipdate", "l_quantity"
    )
    return daily_series(li, ["gid"], F.to_date("l_shipdate"), soil_moist=F.sum("l_quantity"))


def member_series(spark: SparkSession, d: str) -> DataFrame:
    """(gid, layer, ensemble, fdate, value) with five members."""
    li = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("gid"),
        ((F.col("l_linenumber") - 1) % 3 + 1).alias("layer"),
        (F.col("l_orderkey") % 5 + 1).cast("int").alias("ensemble"),
        "l_shipdate",
        "l_quantity",
    )
    return daily_series(
        li, ["gid", "layer", "ensemble"], F.to_date("l_shipdate"), value=F.sum("l_quantity")
    )


def grid_daily(spark: SparkSession, d: str) -> DataFrame:
    """(row, col, lat, lon, fdate, value): whole order value per cell and day."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    out = daily_series(
        o.withColumn("row", grid_row(F.col("o_custkey"))).withColumn(
            "col", grid_col(F.col("o_custkey"))
        ),
        ["row", "col"],
        F.to_date("o_orderdate"),
        value=F.max(F.floor("o_totalprice").cast("double")),
    )
    return out.withColumn("lat", F.lit(TOP) - RES * F.col("row")).withColumn(
        "lon", F.lit(LEFT) + RES * F.col("col")
    )


def grid_static(spark: SparkSession, d: str) -> DataFrame:
    """(row, col, lat, lon, value): floor of the highest balance; below zero is no data."""
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    placed = c.select(
        grid_row(F.col("c_custkey")).alias("row"), grid_col(F.col("c_custkey")).alias("col"),
        F.floor("c_acctbal").cast("double").alias("v"),
    )
    out = placed.groupBy("row", "col").agg(F.max("v").alias("v"))
    return out.select(
        "row", "col", (F.lit(TOP) - RES * F.col("row")).alias("lat"),
        (F.lit(LEFT) + RES * F.col("col")).alias("lon"),
        F.when(F.col("v") >= 0, F.col("v")).alias("value"),
    )


def basin(spark: SparkSession, d: str) -> DataFrame:
    """(gid, lat, lon, elev): suppliers scattered a little off the cell centres."""
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        k.alias("gid"),
        (F.lit(TOP) - RES * (F.floor(k / 8) % 360) - 0.03).alias("lat"),
        (F.lit(LEFT) + RES * ((k * 5) % 40) + 0.04).alias("lon"),
        F.floor("s_acctbal").cast("double").alias("elev"),
    )


def areas(spark: SparkSession, d: str) -> DataFrame:
    """Nation diamonds as polygon texts; no cell centre lies on an edge."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    x = F.lit(31.03) + 2 * (F.col("k") % 5)
    y = F.lit(4.06) - 2 * F.floor(F.col("k") / 5)
    r = F.lit(1.07)
    text = lambda v: F.round(v, 4).cast("string")
    vertex = lambda vx, vy: F.concat(text(vx), F.lit(" "), text(vy))
    ring = [vertex(x - r, y), vertex(x, y - r), vertex(x + r, y), vertex(x, y + r), vertex(x - r, y)]
    wkt = F.concat(F.lit("POLYGON(("), F.concat_ws(",", *ring), F.lit("))"))
    return areas_from_wkt(n.select("k", wkt.alias("wkt")), "k")


def growth(spark: SparkSession, d: str) -> DataFrame:
    """(gid, ensemble, fdate, wsgd, lai, gwad)."""
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("gid"),
        (F.col("l_orderkey") % 5 + 1).cast("int").alias("ensemble"),
        F.to_date("l_shipdate").alias("fdate"),
        F.col("l_discount").alias("wsgd"),
        F.col("l_tax").alias("lai"),
        (F.col("l_quantity") * 100.0).alias("gwad"),
    )


def states(spark: SparkSession, d: str) -> DataFrame:
    """(name, filename, fdate): saved states of simulations (one per customer)."""
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("name"),
        F.format_string("state_%010d", "o_orderkey").alias("filename"),
        F.to_date("o_orderdate").alias("fdate"),
    )


def terciles(spark: SparkSession, d: str) -> DataFrame:
    """(gid, leadtime, tercile, prob): probabilities per supplier from its nation, three
    leads; the three terciles of a lead add up to 100."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("gid"), "s_nationkey")
    probs = F.array(F.lit(25.0), F.lit(35.0), F.lit(40.0))
    names = F.array(F.lit("below"), F.lit("normal"), F.lit("above"))
    out = s.withColumn("leadtime", F.explode(F.sequence(F.lit(1), F.lit(3))))
    out = out.select("gid", "s_nationkey", "leadtime", F.posexplode(names).alias("i", "tercile"))
    at = (F.col("s_nationkey") + F.col("i") + F.col("leadtime")) % 3
    return out.select("gid", "leadtime", "tercile", F.get(probs, at.cast("int")).alias("prob"))


# The same inputs for the oracle.
VIEWS = {
    "daily": """SELECT l_suppkey AS gid, CAST(l_shipdate AS DATE) AS fdate,
        sum(l_quantity) AS rainf, sum(floor(l_extendedprice * l_discount)) AS runoff
        FROM lineitem GROUP BY 1, 2""",
    "layered": """SELECT l_suppkey AS gid, (l_linenumber - 1) % 3 + 1 AS layer,
        CAST(l_shipdate AS DATE) AS fdate, sum(l_quantity) AS soil_moist
        FROM lineitem GROUP BY 1, 2, 3""",
    "member_series": """SELECT l_suppkey AS gid, (l_linenumber - 1) % 3 + 1 AS layer,
        CAST(l_orderkey % 5 + 1 AS INTEGER) AS ensemble, CAST(l_shipdate AS DATE) AS fdate,
        sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2, 3, 4""",
    "grid_daily": """SELECT r AS row, c AS col, 5 - 0.25 * r AS lat, 30 + 0.25 * c AS lon,
        fdate, value FROM (SELECT (o_custkey // 40) % 360 AS r,
        o_custkey % 40 + 40 * ((o_custkey // 14400) % 8) AS c,
        CAST(o_orderdate AS DATE) AS fdate, max(floor(o_totalprice)) AS value
        FROM orders GROUP BY 1, 2, 3)""",
    "grid_static": """SELECT r AS row, c AS col, 5 - 0.25 * r AS lat, 30 + 0.25 * c AS lon,
        CASE WHEN v >= 0 THEN v END AS value FROM (SELECT (c_custkey // 40) % 360 AS r,
        c_custkey % 40 + 40 * ((c_custkey // 14400) % 8) AS c, max(floor(c_acctbal)) AS v
        FROM customer GROUP BY 1, 2)""",
    "basin": """SELECT s_suppkey AS gid, 5 - 0.25 * ((s_suppkey // 8) % 360) - 0.03 AS lat,
        30 + 0.25 * ((s_suppkey * 5) % 40) + 0.04 AS lon, floor(s_acctbal) AS elev FROM supplier""",
    "areas": """SELECT CAST(n_nationkey AS BIGINT) AS area, 31.03 + 2 * (n_nationkey % 5) AS cx,
        4.06 - 2 * (n_nationkey // 5) AS cy, 1.07 AS r FROM nation""",
    "growth": """SELECT l_suppkey AS gid, l_orderkey % 5 + 1 AS ensemble,
        CAST(l_shipdate AS DATE) AS fdate, l_discount AS wsgd, l_tax AS lai,
        l_quantity * 100.0 AS gwad FROM lineitem""",
    "states": """SELECT o_custkey AS name,
        'state_' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS filename,
        CAST(o_orderdate AS DATE) AS fdate FROM orders""",
    "terciles": """SELECT s_suppkey AS gid, lead AS leadtime,
        ['below', 'normal', 'above'][i + 1] AS tercile,
        [25.0, 35.0, 40.0][(s_nationkey + i + lead) % 3 + 1]::DOUBLE AS prob
        FROM supplier, range(1, 4) AS a(lead), range(0, 3) AS b(i)""",
}


def views(*names: str) -> str:
    """WITH clause for the named inputs; further views may follow after a comma."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
