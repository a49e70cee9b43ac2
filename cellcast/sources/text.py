"""Line-oriented text sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellcast.functions.dates import doy_to_date


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) rows of text files."""
    return spark.read.text(path).withColumn("path", F.col("_metadata.file_path"))


def _tokens(line: Column) -> Column:
    return F.split(F.trim(line), r"\s+")


def _number(token: Column) -> Column:
    """The token as a double, NULL if it is none.

    A failing cast costs an exception, so tokens that cannot begin a number are not cast; casts strip control characters
    and take 'inf' and 'nan' in either case.
    """
    return F.when(token.rlike(r"^[\x00-\x20+.0-9IiNn-]"), token.try_cast("double"))


def cell_of_path(path: Column) -> tuple[Column, Column]:
    """(lat, lon) from a file name ``prefix_lat_lon``."""
    pattern = r"_(-?\d+(?:\.\d+)?)_(-?\d+(?:\.\d+)?)$"
    return (
        F.regexp_extract(path, pattern, 1).try_cast("double"),
        F.regexp_extract(path, pattern, 2).try_cast("double"),
    )


def output_columns(variables: list[str], layers: int, layered: list[str]) -> dict[str, int]:
    """First column of each variable of an output file; layered ones take ``layers``."""
    at, out = 3, {}
    for name in variables:
        out[name] = at
        at += layers if name in layered else 1
    return out


def parse_model_series(
    lines: DataFrame, columns: dict[str, int], layers: int = 1, layered: tuple[str, ...] = ()
) -> DataFrame:
    """Daily model output, one file per cell, as tall (lat, lon, fdate, var, layer, value).

    Lines start with year, month, day. ``columns`` maps a variable to its first column.
    """
    t = F.col("_t")
    lat, lon = cell_of_path(F.col("path"))
    number = lambda k: F.get(t, k).try_cast("double")
    picks = []
    for name, first in columns.items():
        for layer in range(layers if name in layered else 1):
            tag = F.lit(layer + 1) if name in layered else F.lit(None).cast("int")
            picks.append(
                F.struct(
                    F.lit(name).alias("var"), tag.alias("layer"), number(first + layer).alias("value")
                )
            )
    day = F.make_date(*[F.get(t, k).cast("int") for k in range(3)])
    parsed = lines.withColumn("_t", _tokens(F.col("value")))
    return parsed.select(
        lat.alias("lat"), lon.alias("lon"), day.alias("fdate"), F.explode(F.array(*picks)).alias("_p")
    ).select("lat", "lon", "fdate", "_p.*")


# Token positions in a crop growth line.
GROWTH_COLUMNS = {"doy": 1, "lai": 6, "gwad": 9, "wsgd": 18}


def parse_growth(lines: DataFrame, start_year: Column) -> DataFrame:
    """Crop growth rows with positive grain weight.

    Header lines are recognised by their first token, which is not a number; dates count
    from the start year. ``lines`` carries (gid, ensemble, value).
    """
    t = F.col("_t")
    number = lambda name: _number(F.get(t, GROWTH_COLUMNS[name]))
    # Exploded, so that filters on the tokens stay above and a line is split once.
    parsed = lines.select("gid", "ensemble", F.explode(F.array(_tokens(F.col("value")))).alias("_t"))
    parsed = parsed.filter(_number(F.get(t, 0)).isNotNull())
    return parsed.select(
        "gid",
        "ensemble",
        doy_to_date(start_year, number("doy").cast("int")).alias("fdate"),
        number("wsgd").alias("wsgd"),
        number("lai").alias("lai"),
        number("gwad").alias("gwad"),
    ).filter(F.col("gwad") > 0)


def read_soil_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Profiles of soil files: a record starts with an asterisk at the start of a line."""
    return parse_soil_profiles(spark.read.option("lineSep", "\n*").text(path))


def parse_soil_profiles(records: DataFrame) -> DataFrame:
    """(lat, lon, props, bottoms) from profile records.

    Lines starting with '@' are headings. The five-token line holds the position; other
    lines are layers or settings. In layer lines (first token a number) the second token is
    blanked out. Each record is complete in itself, so the last of a file is kept too. When
    two records share a position one is kept (the greatest text).
    """
    text = F.regexp_replace(F.regexp_replace("value", r"^\*", ""), "\r", "")
    lines = F.filter(F.split(text, "\n"), lambda s: F.length(F.trim(s)) > 0)
    head = F.trim(F.get(lines, 0))
    body = F.filter(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), lambda s: ~s.startswith("@"))
    is_site = lambda s: F.size(_tokens(s)) == 5
    site = _tokens(F.get(F.filter(body, is_site), 0))
    is_layer = lambda s: F.get(_tokens(s), 0).try_cast("double").isNotNull()

    def shown(s: Column) -> Column:
        second = F.get(_tokens(s), 1)
        hidden = F.replace(s, second, F.repeat(F.lit(" "), F.length(second)))
        return (
            F.when(is_site(s), F.trim(s))
            .when(is_layer(s), F.rtrim(F.when(second.isNotNull(), hidden).otherwise(s)))
            .otherwise(F.concat(F.lit(" "), F.rtrim(s)))
        )

    bottoms = F.transform(
        F.filter(body, lambda s: is_layer(s) & ~is_site(s)),
        lambda s: F.get(_tokens(s), 0).try_cast("double"),
    )
    props = F.concat(F.array_join(F.concat(F.array(head), F.transform(body, shown)), "\r\n"),
                     F.lit("\r\n"))
    parsed = records.select(
        F.get(site, 2).try_cast("double").alias("lat"),
        F.get(site, 3).try_cast("double").alias("lon"),
        F.struct(props.alias("props"), bottoms.alias("bottoms")).alias("_p"),
    ).filter(F.col("lat").isNotNull())
    return parsed.groupBy("lat", "lon").agg(F.max("_p").alias("_p")).select("lat", "lon", "_p.*")
