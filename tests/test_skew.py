"""The same answers when one key holds a third of all rows."""

import os
import tempfile

import duckdb
import pytest
from oracle import TABLES, compare, connect

import __spark_entry__ as entry

NAMES = [
    "severity_soil", "dry_spells", "smdi_vector", "yield_table", "season_best", "ensemble_summary",
    "state_month_draw", "nearest_state", "warm_up_choice", "zonal_mean_clip", "zonal_mean_tiles",
    "replace_dates", "tercile_years", "planting_dates", "value_at_cells", "mod10_cells",
    "thinned_dates", "regrid_average", "mosaic_latest", "state_catalog_upsert", "filter_gram",
    "resample_on_grid", "spi1_closed_form",
]


@pytest.fixture(scope="module")
def skewed(small_dir):
    folder = tempfile.mkdtemp(prefix="run-skew-")
    for t in TABLES:
        os.symlink(f"{small_dir}/{t}.parquet", f"{folder}/{t}.parquet")
    hot = {
        "lineitem": "l_orderkey % 3 = 0 THEN 3 ELSE l_suppkey END AS l_suppkey",
        "orders": "o_orderkey % 3 = 0 THEN 41 ELSE o_custkey END AS o_custkey",
        "embeddings": "vec_id % 3 = 0 THEN 1 ELSE label END AS label",
    }
    for t, rule in hot.items():
        os.unlink(f"{folder}/{t}.parquet")
        duckdb.execute(
            f"COPY (SELECT * REPLACE (CASE WHEN {rule}) FROM read_parquet('{small_dir}/{t}.parquet')) "
            f"TO '{folder}/{t}.parquet' (FORMAT parquet)"
        )
    return folder


@pytest.mark.parametrize("name", NAMES)
def test_hot_key(spark, skewed, name):
    df = entry.queries()[name](spark, skewed)
    rows, _, error = compare(df, connect(skewed), entry.oracle_sql()[name])
    assert error is None, error
    assert rows > 0
