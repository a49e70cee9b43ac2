"""Writes, text sources, flows and streaming on small folders."""

import tempfile
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from cellcast.operators import crops, loads
from cellcast.plans import flows
from cellcast.session import cut_lineage
from cellcast.sources import normalisers, tables, text
from cellcast.sources.polygons import areas_from_wkt
from cellcast.streaming import jobs

DAY0 = date(2001, 1, 1)


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="run-")


def cells(spark, days, value=1.0, n=4):
    rows = [(DAY0 + timedelta(t), i, i, 5.0 - 0.25 * i, 30.0 + 0.25 * i, value) for t in days for i in range(n)]
    return spark.createDataFrame(rows, "fdate date, row int, col int, lat double, lon double, value double")


def test_replacing_a_date_leaves_the_others(spark, folder):
    tables.write_cells(cells(spark, range(3)), folder)
    tables.write_cells(cells(spark, [1], 9.0), folder)
    got = {r["fdate"]: r["s"] for r in spark.read.parquet(folder).groupBy("fdate").agg(F.sum("value").alias("s")).collect()}
    assert got == {DAY0: 4.0, DAY0 + timedelta(1): 36.0, DAY0 + timedelta(2): 4.0}
    plan = tables.scan_dates(spark, folder, "2001-01-02", "2001-01-02")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(fdate" in plan


def test_keyed_upsert_rewrites_touched_dates_only(spark, folder):
    tables.write_cells(cells(spark, range(2)), folder)
    new = cells(spark, [1], 7.0).filter("row = 2")
    loads.upsert_table(spark, folder, new, ["fdate", "row", "col"])
    out = {(r["fdate"], r["row"]): r["value"] for r in spark.read.parquet(folder).collect()}
    assert len(out) == 8 and out[(DAY0 + timedelta(1), 2)] == 7.0 and out[(DAY0 + timedelta(1), 1)] == 1.0


def test_user_dataset_reads_existing_days(spark, folder):
    for t in (0, 2):
        cells(spark, [t]).withColumnRenamed("value", "raw").write.parquet(
            folder + "/" + (DAY0 + timedelta(t)).strftime("%Y%m%d")
        )
    options = {"path": folder + "/{0:04d}{1:02d}{2:02d}", "res": "0.25", "table": "precip.local"}
    out = normalisers.user_dataset(spark, options, DAY0, DAY0 + timedelta(5))
    assert out.count() == 8 and out.first()["dataset"] == "local"
    assert normalisers.user_dataset(spark, {"path": "x"}, DAY0, DAY0) is None
    assert normalisers.user_dataset(spark, options, DAY0 + timedelta(50), DAY0 + timedelta(51)) is None


def test_windows_of_products():
    assert normalisers.smos_window(date(2009, 1, 1), date(2030, 1, 1), 10) == (date(2010, 1, 12), date(2010, 1, 21))


def test_soil_files_keep_their_last_profile(spark, folder):
    profile = "*{0} loam\n@SITE C LAT LONG S\n LOC KE {1} 36.5 SAND\n@ SLB SLMH\n 5 A 0.1 0.2 0.3 1.0\n 15 B 0.1 0.2 0.3 0.9\n"
    with open(folder + "/ke.SOL", "w") as f:
        f.write(profile.format("P1", -1.0) + profile.format("P2", -2.0))
    out = text.read_soil_profiles(spark, folder).orderBy("lat").collect()
    assert [(r["lat"], r["bottoms"]) for r in out] == [(-2.0, [5.0, 15.0]), (-1.0, [5.0, 15.0])]
    lines = out[0]["props"].split("\r\n")
    assert lines[0] == "P2 loam" and lines[1] == "LOC KE -2.0 36.5 SAND" and " A " not in lines[2]


def test_model_series_from_files(spark, folder):
    for lat in (1.25, -0.5):
        with open(f"{folder}/sub_{lat:.2f}_36.75", "w") as f:
            f.write("2001 1 1 0.5 10 20\n2001 1 2 0.6   11 21\n")
    columns = text.output_columns(["rootmoist", "soil_moist"], 2, ["soil_moist"])
    out = text.parse_model_series(text.read_lines(spark, folder), columns, 2, ("soil_moist",))
    assert out.count() == 12
    got = out.filter("var = 'soil_moist' and layer = 2 and lat < 0").orderBy("fdate").collect()
    assert [r["value"] for r in got] == [20.0, 21.0] and got[0]["lon"] == 36.75


def test_sinks(spark, folder):
    wide = spark.createDataFrame([(DAY0, 1.5), (DAY0 + timedelta(1), 2.0)], "fdate date, p1 double")
    tables.write_series_csv(wide, folder + "/csv")
    assert spark.read.option("header", "true").csv(folder + "/csv").columns == ["fdate", "p1"]
    gaps = cells(spark, [0]).withColumn("value", F.when(F.col("row") > 0, F.col("value")))
    tables.write_grids(gaps, folder + "/grids")
    assert spark.read.parquet(folder + "/grids").filter("value = -9999").count() == 1
    areas = areas_from_wkt(spark.createDataFrame([(1, "POLYGON((0 0,1 0,1 1,0 0))")], "k int, wkt string"), "k")
    growth = spark.createDataFrame(
        [(1, 1, DAY0, 5.0), (1, 1, DAY0 + timedelta(1), 8.0), (1, 2, DAY0, 6.0)], "gid int, ensemble int, fdate date, gwad double"
    )
    tables.write_features(crops.yield_export(growth, "maize"), areas, folder + "/features")
    row = spark.read.json(folder + "/features").first()
    assert (row["minimum"], row["maximum"], row["average"]) == (6.0, 8.0, 7.0) and row["wkt"].startswith("POLYGON")


def test_yield_filter_comes_after_the_best(spark):
    growth = spark.createDataFrame(
        [(1, 1, date(2000, 1, 1), 9.0), (1, 1, date(2001, 1, 1), 5.0)], "gid int, ensemble int, fdate date, gwad double"
    )
    assert crops.yield_export(growth, "maize", "2001-01-01").count() == 0
    assert crops.yield_table(growth, "maize").first()["std_yield"] == 0.0


def test_planting_falls_back_to_the_latest_before(spark):
    s = spark.createDataFrame([(1, "maize", 10), (1, "maize", 40), (2, "maize", 200), (2, "rice", 5)], "area int, type string, doy int")
    out = {r["area"]: r["pdate"] for r in crops.planting_dates(s, "maize", "2001-06-01", "2001-12-31").collect()}
    assert out == {1: date(2001, 2, 9), 2: date(2001, 7, 19)}


def test_layers_compat_midpoints(spark):
    df = spark.createDataFrame([([10.0, 60.0, 210.0], [0.1, 0.3, 0.7], [5.0, 25.0, 200.0])],
                               "m array<double>, d array<double>, b array<double>")
    u = df.select(crops.interpolate_layers(F.col("m"), F.col("d"), F.col("b")).alias("u")).first()["u"]
    # Midpoints 5, 25, 75 cm with fractions 0.1, 0.2, 0.3; targets 2.5, 15, 112.5 cm.
    assert u == pytest.approx([0.1, 0.15, 0.3])
    v = df.select(crops.interpolate_layers(F.col("m"), F.col("d"), F.col("b"), compat=True).alias("u")).first()["u"]
    assert v == pytest.approx([0.1, 0.15, 0.3])


def test_update_flow_writes_and_regrids(spark, folder):
    raw = cells(spark, range(2), 10.0, 8).withColumnRenamed("value", "raw").drop("row", "col")
    flows.update(spark, "cmorph", raw, folder, targets=(1.0,), source_res=0.25)
    assert spark.read.parquet(folder + "/cmorph").agg(F.max("value")).first()[0] == 240.0
    coarse = spark.read.parquet(folder + "/cmorph_1")
    assert coarse.filter("value = 240").count() == coarse.count() > 0
    flows.update(spark, "cmorph", raw.filter(F.col("fdate") == DAY0).withColumn("raw", F.lit(1.0)), folder)
    stored = spark.read.parquet(folder + "/cmorph")
    assert {r[0] for r in stored.select("value").distinct().collect()} == {24.0, 240.0}


def test_forecast_and_nowcast_flows(spark):
    days = [(g, date(1998, 1, 1) + timedelta(t)) for g in (1, 2) for t in range(1000)]
    history = spark.createDataFrame(days, "gid int, fdate date").withColumn(
        "prec", (F.dayofyear("fdate") % 7).cast("double")
    ).withColumn("tmax", F.lit(30.0)).withColumn("tmin", F.lit(20.0)).withColumn("wind", F.lit(2.0))
    out = flows.forecast_forcings("esp", history, date(2001, 3, 1), date(2001, 3, 31), 2, 1)
    counts = out.groupBy("ensemble").count().collect()
    assert len(counts) == 2 and all(r["count"] == 62 for r in counts)
    ahead = history.filter("fdate >= date'2000-03-01'").select(
        "gid", (F.col("fdate") + F.expr("interval 1 year")).cast("date").alias("fdate"), F.lit(1).alias("ensemble"), F.lit(10.0).alias("temp")
    )
    nm = flows.forecast_forcings("nmme", history, date(2001, 3, 1), date(2001, 3, 31), 1, 1, forecast=ahead)
    assert {(r["tmax"], r["tmin"]) for r in nm.collect()} == {(15.0, 5.0)}
    with pytest.raises(ValueError):
        flows.forecast_forcings("other", history, DAY0, DAY0, 1, 1)
    sim = history.select(
        F.lit("s").alias("name"), F.lit("rainf").alias("var"), "fdate", "gid", F.lit(None).cast("int").alias("layer"),
        F.lit(None).cast("int").alias("ensemble"), F.col("prec").alias("value"),
    )
    got = flows.nowcast_products(sim, ["spi1", "dryspells", "spi12"], date(1998, 1, 1), date(1998, 6, 30))
    assert {r[0] for r in got.select("index").distinct().collect()} == {"spi1", "dryspells"}


def test_assimilation_flow(spark):
    sim = spark.createDataFrame(
        [("s", "soil_moist", DAY0 + timedelta(t), g, lay, e, float(g + e * lay)) for t in range(2) for g in range(4)
         for lay in (1, 2) for e in (1, 2, 3)],
        "name string, var string, fdate date, gid int, layer int, ensemble int, value double",
    )
    obs = spark.createDataFrame([(DAY0, [1.0, 2.0, 3.0], 2.5, [0.1, -0.2, 0.1])],
                                "fdate date, ha array<double>, d double, e array<double>")
    out = flows.assimilate(sim, obs)
    assert out.count() == 12 and out.filter("xa is null").count() == 0
    assert out.filter("gid = 1 and ensemble = 2").first()["x"] == 8.0


def test_checkpoint_uses_the_session_setting(spark):
    df = cut_lineage(spark.range(10))
    assert df.count() == 10 and "Range" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_daily_ingest_stream(spark, folder):
    raw = cells(spark, range(2), 10.0).withColumnRenamed("value", "raw").drop("row", "col")
    raw.write.parquet(folder + "/landing")
    normal = lambda df: normalisers.normalise("chirps", df)
    for _ in range(2):
        jobs.daily_ingest(spark, folder + "/landing", raw.schema, normal, folder + "/out", folder + "/cp").awaitTermination(120)
    assert spark.read.parquet(folder + "/out").count() == 8


def run_to_memory(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)


def test_rollup_stream_closes_days(spark, folder):
    spark.range(24 * 6).select(
        (F.timestamp_seconds(F.lit(978307200) + F.col("id") * 3600)).alias("ts"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"),
        (F.lit(273.15) + F.col("id") % 24).alias("t2m"), F.lit(3.0).alias("u10m"), F.lit(4.0).alias("v10m"),
    ).write.parquet(folder + "/h")
    stream = spark.readStream.schema(spark.read.parquet(folder + "/h").schema).parquet(folder + "/h")
    run_to_memory(jobs.daily_rollup(stream), "rolled")
    rows = spark.sql("select * from rolled order by fdate").collect()
    assert len(rows) >= 3
    assert rows[0]["fdate"] == DAY0 and rows[0]["tmax"] == pytest.approx(23.0) and rows[0]["wind"] == pytest.approx(5.0)


def test_dry_spell_stream_matches_batch(spark, folder):
    from cellcast.operators.drought import dry_spells

    rain = spark.range(120).select(
        (F.col("id") % 2).alias("gid"), F.date_add(F.lit(DAY0), (F.col("id") / 2).cast("int")).alias("fdate"),
        F.pmod(F.xxhash64("id"), F.lit(20)).cast("double").alias("rainf"),
    )
    limit = rain.groupBy("gid").agg(F.avg("rainf").alias("threshold"))
    both = rain.join(limit, "gid")
    both.filter(F.col("fdate") < date(2001, 1, 25)).coalesce(1).write.parquet(folder + "/d/a")
    both.filter(F.col("fdate") >= date(2001, 1, 25)).coalesce(1).write.parquet(folder + "/d/b")
    stream = spark.readStream.schema(both.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(folder + "/d")
    run_to_memory(jobs.dry_spell_counter(stream, 4, 2), "spells")
    live = {(r["gid"], r["fdate"]): r["spells"] for r in spark.sql("select * from spells").collect()}
    batch = {(r["gid"], r["fdate"]): r["value"] for r in dry_spells(rain, "rainf", 4, 2).collect()}
    assert len(live) == 120 and live == {k: int(v) for k, v in batch.items()}
