"""Table contracts. Keys absent from a product stay NULL instead of changing the schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    out = T.StructType()
    for item in spec.split(","):
        name, kind = item.split(":")
        out.add(name.strip(), _TYPES[kind.strip()], True)
    return out


_VERTEX = T.StructType().add("x", T.DoubleType()).add("y", T.DoubleType())
_TYPES = {
    "str": T.StringType(),
    "date": T.DateType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "doubles": T.ArrayType(T.DoubleType()),
    "ring": T.ArrayType(_VERTEX),
}

CELLS = _struct(
    "var:str, dataset:str, fdate:date, row:int, col:int, lat:double, lon:double, value:double"
)
SIM = _struct(
    "name:str, var:str, fdate:date, gid:long, layer:int, ensemble:int, value:double"
)
BASIN = _struct("gid:long, lat:double, lon:double, elev:double, depths:doubles, line:str")
AREAS = _struct("gid:long, wkt:str, ring:ring")
TERCILES = _struct(
    "fdate:date, leadtime:int, tercile:str, row:int, col:int, prob:double"
)
FORCING = _struct(
    "gid:long, fdate:date, prec:double, tmax:double, tmin:double, wind:double"
)
GROWTH = _struct(
    "gid:long, ensemble:int, fdate:date, wsgd:double, lai:double, gwad:double"
)
STATE_CATALOG = _struct("name:long, filename:str, fdate:date")

# Fixed value: the number written to files where a cell has no data.
NODATA = -9999.0


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` on ``schema``: cast present columns, add absent ones as NULL."""
    have = set(df.columns)

    def pick(field: T.StructField) -> Column:
        source = F.col(field.name) if field.name in have else F.lit(None)
        return source.cast(field.dataType).alias(field.name)

    return df.select(*[pick(f) for f in schema.fields])


def null_if_nodata(value: Column, nodata: float = NODATA) -> Column:
    """Sentinel to NULL at ingest."""
    return F.when(value != F.lit(nodata), value)
