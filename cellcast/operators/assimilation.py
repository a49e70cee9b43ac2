"""Ensemble Kalman analyses.

All three filters need the observations only through sums over observations of products of
member columns. Those N x N sums are added up inside every partition and merged per date,
so a date with most of the observations is still spread over all tasks. The algebra on the
merged N x N matrices is one small step per date; each state then meets the matrix of its date, or of its patch.

Column layout: observations carry ``ha`` (array of N predicted values), ``d`` (the
observed value) and ``e`` (array of N error draws); states carry ``a`` (array of N).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellcast.functions import rng
from cellcast.operators.common import salted_join
from cellcast.operators.series import thin_dates
from cellcast.operators.spatial import nearest_join, nearest_on_days

# State variable, observed variable, resolution and error of each product.
# Snow products say 'swq' elsewhere; the state knows the variable as 'swe'.
OBSERVATION_CLASSES = [
    ("amsre", "soilmoist.amsre", "soil_moist", "soil_moist", 0.25, 0.01),
    ("smos", "soilmoist.smos", "soil_moist", "soil_moist", 0.25, 0.01),
    ("smap", "soilmoist.smap", "soil_moist", "soil_moist", 0.36, 0.001),
    ("smape", "soilmoist.smape", "soil_moist", "soil_moist", 0.09, 0.001),
    ("modscag", "snow.modscag", "swe", "snow_cover", 0.01, 0.05),
    ("mod10", "snow.mod10", "swe", "snow_cover", 0.005, 0.05),
    ("mod16", "evap.mod16", "soil_moist", "evap", 0.01, 1.0),
]


def update_gap(update: str | int | None) -> int:
    """Days between analyses: unset 1, week 7, month 30, a number as is, else all dates."""
    if update is None:
        return 1
    if isinstance(update, int):
        return update
    for word, days in (("week", 7), ("month", 30), ("daily", 1)):
        if word in update:
            return days
    return -1


def observation_dates(
    observations: DataFrame,
    product: str,
    start: str,
    end: str,
    update: str | int | None = None,
) -> DataFrame:
    """Analysis dates: thinned per product, united, without the first and last day."""
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    inside = observations.filter(F.col("fdate").between(a, b)).select(product, "fdate")
    kept = thin_dates(inside, [product], update_gap(update)).select("fdate").distinct()
    return kept.filter((F.col("fdate") != a) & (F.col("fdate") != b))


def state_vector(sim: DataFrame, cell: Sequence[str] = ("gid",), day: str = "fdate") -> DataFrame:
    """Sum over layers per cell, date and member, then members as one ordered array."""
    total = sim.groupBy(*cell, day, "ensemble").agg(F.sum("value").alias("value"))
    return member_array(total, [*cell, day], "value", "a")


def member_array(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Members in order as an array; its length is the ensemble size (dozens)."""
    packed = df.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("ensemble", value))).alias("_m")
    )
    return packed.select(*keys, F.transform("_m", lambda m: m[value]).alias(name))


def predicted_moisture(fine: DataFrame, depth: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Top-layer mean on the observation grid as a volume fraction.

    ``fine`` carries the observation cell keys of each model cell; ``depth`` the top-layer
    depth of the model cell nearest to each observation cell.
    """
    mean = fine.filter(F.col("layer") == 1).groupBy(*cell, "fdate", "ensemble").agg(
        F.avg("value").alias("value")
    )
    joined = mean.join(depth, list(cell))
    return joined.select(
        *cell,
        "fdate",
        "ensemble",
        (F.col("value") / F.nullif(1000.0 * F.col("depth"), F.lit(0.0))).alias("value"),
    )


def error_draws(
    observations: DataFrame,
    count: int,
    seed: int,
    keys: Sequence[str],
    stddev: Column,
    distribution: Column | None = None,
) -> DataFrame:
    """Array ``e`` of N error draws per observation.

    Default N(0, stddev). ``distribution`` is a string column 'name,p1,p2': norm, uniform,
    laplace, logistic and expon take (location, scale); any other name falls back.
    """
    at = [F.col(k) for k in keys]

    def one(k: Column) -> Column:
        z = rng.normal(f"{seed}e", *at, k)
        plain = stddev * z
        if distribution is None:
            return plain
        parts = F.split(F.lower(F.trim(distribution)), r"[ ,]+")
        name = F.get(parts, 0)
        loc = F.coalesce(F.get(parts, 1).try_cast("double"), F.lit(0.0))
        scale = F.coalesce(F.get(parts, 2).try_cast("double"), F.lit(1.0))
        u = rng.uniform(f"{seed}u", *at, k)
        safe = F.greatest(u, F.lit(1e-15))
        half = u - 0.5
        laplace = -F.signum(half) * F.log(F.greatest(1 - 2 * F.abs(half), F.lit(1e-15)))
        return (
            F.when(name == "norm", loc + scale * z)
            .when(name == "uniform", loc + scale * u)
            .when(name == "expon", loc - scale * F.log(F.lit(1.0) - u))
            .when(name == "laplace", loc + scale * laplace)
            .when(name == "logistic", loc + scale * F.log(safe / (F.lit(1.0) - u)))
            .otherwise(plain)
        )

    numbers = F.sequence(F.lit(1), F.lit(count))
    return observations.withColumn("e", F.transform(numbers, one))


def combine_products(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Observations or states of several products; the first product of a key is kept."""
    tagged = [p.withColumn("_order", F.lit(i)) for i, p in enumerate(parts)]
    out = tagged[0]
    for part in tagged[1:]:
        out = out.unionByName(part)
    rest = [c for c in out.columns if c not in (*keys, "_order")]
    best = out.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col("_order")).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


# ---------------------------------------------------------------- Gram sums

# Names of the partial sums per date; each is N x N, flattened.
_SUMS = ("yy", "yd", "hh", "he", "hd", "zz", "hz", "zd")


def _batch_sums(ha: np.ndarray, d: np.ndarray, e: np.ndarray, share: np.ndarray | float = 1.0) -> dict[str, np.ndarray]:
    n = ha.shape[1]
    mean = ha.mean(axis=1, keepdims=True)
    anomaly = ha - mean
    variance = (e * e).sum(axis=1) / (n - 1)
    inverse = np.divide(1.0, variance, out=np.zeros_like(variance), where=variance > 0)
    weighted = anomaly * (inverse * share)[:, None]
    residual = d[:, None] - mean
    noisy = anomaly + e
    innovation = d[:, None] + e.mean(axis=1, keepdims=True) - ha
    return {
        "yy": weighted.T @ anomaly,
        "yd": weighted.T @ residual,
        "hh": anomaly.T @ anomaly,
        "he": anomaly.T @ e,
        "hd": anomaly.T @ residual,
        "zz": noisy.T @ noisy,
        "hz": anomaly.T @ noisy,
        "zd": noisy.T @ innovation,
    }


def _listed(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def gram_sums(
    observations: DataFrame, day: str | Sequence[str] = "fdate", share: str | None = None, names: Sequence[str] = _SUMS
) -> DataFrame:
    """Sums over the observations of a date (or of several keys), one row of flattened arrays each.

    ``mapInPandas`` reduces each Arrow batch to one row per key, then an ordinary
    groupBy adds matrices position by position. ``share`` names a factor on each observation's weight.
    """
    keys = _listed(day)
    schema = T.StructType([*[observations.schema[k] for k in keys], T.StructField("nobs", T.LongType())])
    for name in names:
        schema.add(name, T.ArrayType(T.DoubleType()))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, part in batch.groupby(keys, sort=False):
                sums = _batch_sums(
                    np.stack(part["ha"].to_numpy()).astype(float),
                    part["d"].to_numpy(float),
                    np.stack(part["e"].to_numpy()).astype(float),
                    1.0 if share is None else part[share].to_numpy(float),
                )
                row = {**dict(zip(keys, key)), "nobs": len(part)}
                row.update({k: sums[k].ravel() for k in names})
                rows.append(row)
            if rows:
                yield pd.DataFrame(rows)

    needed = [*keys, "ha", "d", "e", *([share] if share else [])]
    parts = observations.select(*needed).mapInPandas(partial, schema)
    tall = parts.select(
        *keys,
        "nobs",
        F.posexplode(F.arrays_zip(*[F.col(n) for n in names])).alias("pos", "_s"),
    )
    # The d-sums have N entries and the rest N*N; arrays_zip pads with NULL and sum skips it.
    added = tall.groupBy(*keys, "pos").agg(
        F.sum("nobs").alias("nobs"), *[F.sum(f"_s.{n}").alias(n) for n in names]
    )
    packed = added.groupBy(*keys).agg(
        F.max("nobs").alias("nobs"),
        F.sort_array(F.collect_list(F.struct("pos", *names))).alias("_m"),
    )
    # An array of structs gives the array of one field by name.
    return packed.select(*keys, "nobs", *[F.col(f"_m.{n}").alias(n) for n in names])


def _matrix(values, n: int) -> np.ndarray:
    flat = np.array([np.nan if v is None else v for v in values], float)
    return flat.reshape(n, n)


def _column(values, n: int) -> np.ndarray:
    return np.array(list(values)[:n], float).reshape(n, 1)


def _symmetric_root(m: np.ndarray) -> np.ndarray:
    w, v = np.linalg.eigh((m + m.T) / 2)
    return (v * np.sqrt(np.clip(w, 0, None))) @ v.T


def _singular(gram: np.ndarray, rank: int):
    """Right singular vectors and values of a tall matrix from its Gram matrix."""
    w, v = np.linalg.eigh((gram + gram.T) / 2)
    order = np.argsort(w)[::-1][:rank]
    return np.sqrt(np.clip(w[order], 0, None)), v[:, order]


def _inverse(s: np.ndarray) -> np.ndarray:
    # Square roots of a Gram matrix's eigenvalues are only good to about 1e-8.
    floor = s.max() * 1e-6 if len(s) else 0.0
    return np.divide(1.0, s, out=np.zeros_like(s), where=s > floor)


def letkf_weights(sums: dict, n: int, nobs: int, seed: int, inflation: float = 1.05) -> np.ndarray:
    """Transform of the local ensemble filter with all observations."""
    del nobs, seed
    p = np.linalg.pinv((n - 1) * np.eye(n) / inflation + sums["yy"])
    return _symmetric_root((n - 1) * p) + p @ sums["yd"]


def enkf_weights(sums: dict, n: int, nobs: int, seed: int, kept: float = 0.999) -> np.ndarray:
    """Update matrix of the perturbed-observation filter (identity included)."""
    del seed
    s, v = _singular(sums["zz"], min(n, nobs))
    inv4 = _inverse(s) ** 4
    inv4[np.cumsum(s) / s.sum() > kept] = 0.0
    x4 = sums["hz"] @ (v * inv4) @ v.T @ sums["zd"]
    return np.eye(n) + x4


def sqrtenkf_weights(sums: dict, n: int, nobs: int, seed: int, kept: float = 0.999) -> np.ndarray:
    """Square-root filter with a seeded random rotation (Evensen 2004)."""
    s, v = _singular(sums["hh"], min(n, nobs))
    # A vanishing singular value (anomalies sum to zero, so there is one whenever there are
    # at least N observations) has all of the inverse's weight: it alone is cut then.
    inv = _inverse(s)
    if np.all(inv > 0):
        share = np.cumsum(inv) / inv.sum()
        inv[np.argmax(share > kept):] = 0.0
    left = (v * inv**2).T
    u1, s1, _ = np.linalg.svd(left @ sums["he"], full_matrices=False)
    x1_d = u1.T @ left @ sums["hd"]
    s_x1 = sums["hh"] @ left.T @ u1
    shrink = 1.0 / (1.0 + s1**2)
    y4 = s_x1 @ (shrink[:, None] * x1_d)
    x2 = np.sqrt(shrink)[:, None] * s_x1.T
    _, s2, v2 = np.linalg.svd(x2, full_matrices=True)
    padded = np.zeros(n)
    padded[: len(s2)] = s2
    remain = np.sqrt(np.clip(1.0 - padded**2, 0.0, None))
    draws = np.random.default_rng(seed).normal(size=(n, n))
    theta = np.linalg.svd(draws)[2]
    return y4 + v2.T @ (remain[:, None] * theta)


FILTERS = {"letkf": letkf_weights, "enkf": enkf_weights, "sqrtenkf": sqrtenkf_weights}
_SQUARE = ("yy", "hh", "he", "zz", "hz", "zd")
#: Sums that each filter reads, a square one first.
_NEEDED = {"letkf": ("yy", "yd"), "enkf": ("zz", "hz", "zd"), "sqrtenkf": ("hh", "he", "hd")}


def filter_weights(
    observations: DataFrame, method: str = "letkf", day: str | Sequence[str] = "fdate", seed: int = 0, share: str | None = None
) -> DataFrame:
    """N x N transform per date (or several keys), flattened: anomalies times it gives the new anomalies
    (plus mean shift). One row of sums goes in, one comes out."""
    keys = _listed(day)
    names = _NEEDED[method.lower()]
    sums = gram_sums(observations, keys, share, names)
    solve = FILTERS[method.lower()]
    schema = T.StructType(
        [*[observations.schema[k] for k in keys], T.StructField("w", T.ArrayType(T.DoubleType()))]
    )

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                n = int(round(len(row[names[0]]) ** 0.5))
                parts = {k: _matrix(row[k], n) if k in _SQUARE else _column(row[k], n) for k in names}
                stable = zlib.crc32(f"{'/'.join(str(row[k]) for k in keys)}/{seed}".encode())
                rows.append({**{k: row[k] for k in keys}, "w": solve(parts, n, int(row["nobs"]), stable).ravel()})
            if rows:
                yield pd.DataFrame(rows)

    return sums.mapInPandas(step, schema)


def transformed(members: Column, weights: Column) -> Column:
    """Mean plus anomalies times a flattened N x N matrix; the members themselves where there is none."""
    n = F.size(members)
    mean = F.aggregate(members, F.lit(0.0), lambda acc, v: acc + v) / n
    add = lambda acc, v: acc + v
    column = lambda j: F.aggregate(
        F.transform(members, lambda v, i: (v - mean) * F.get(weights, i * n + j)), F.lit(0.0), add
    )
    new = F.transform(F.sequence(F.lit(0), n - 1), lambda j: mean + column(j))
    return F.when(weights.isNull() | (n == 0), members).otherwise(new)


def analyse(
    states: DataFrame,
    observations: DataFrame,
    method: str = "letkf",
    day: str = "fdate",
    keys: Sequence[str] = ("gid",),
    salts: int = 16,
    seed: int = 0,
) -> DataFrame:
    """Updated members of every state row, as array ``xa`` next to the original ``a``.

    Each state meets the one matrix of its date; a date with most of the states is spread over ``salts`` by a hash of
    their keys. A date without observations keeps its states.
    """
    weights = filter_weights(observations, method, day, seed).withColumnRenamed("w", "_w")
    met = salted_join(states, weights, [day], salts, spread_by=keys, how="left")
    return met.withColumn("xa", transformed(F.col("a"), F.col("_w"))).select(*states.columns, "xa")


# ---------------------------------------------------------------- localisation


def taper(distance: Column, radius: float) -> Column:
    """Gaspari-Cohn weight: 1 at no distance, falling smoothly to 0 at ``radius``."""
    z = distance / F.lit(radius / 2.0)
    p = lambda k: F.pow(z, F.lit(float(k)))
    near = -p(5) / 4 + p(4) / 2 + 5 * p(3) / 8 - 5 * p(2) / 3 + 1
    far = p(5) / 12 - p(4) / 2 + 5 * p(3) / 8 + 5 * p(2) / 3 - 5 * z + 4 - 2 / (3 * z)
    return F.when(z <= 1, near).when(z < 2, far).otherwise(0.0)


def within_radius(
    patches: DataFrame, observations: DataFrame, radius: float, day: str = "fdate"
) -> DataFrame:
    """Observations with each patch (px, py, x, y) of their date whose centre is nearer than ``radius``, with ``distance``.

    Both meet on squares of ``radius`` degrees; an observation is dealt to its own square and the eight around it, so no patch
    meets observations farther than two squares away.
    """
    square = lambda c: F.floor(F.col(c) / F.lit(radius))
    left = patches.withColumn("_cx", square("x")).withColumn("_cy", square("y"))
    around = F.array(*[F.lit(k).cast("long") for k in (-1, 0, 1)])
    right = observations.filter("lon IS NOT NULL AND lat IS NOT NULL")
    for name, c in (("_cx", "lon"), ("_cy", "lat")):
        right = right.withColumn(name, F.explode(F.transform(around, lambda k: square(c) + k)))  # noqa: B023
    met = right.join(left, [day, "_cx", "_cy"])
    away = F.sqrt(F.pow(F.col("lon") - F.col("x"), 2) + F.pow(F.col("lat") - F.col("y"), 2))
    return met.withColumn("distance", away).filter(F.col("distance") < radius).drop("_cx", "_cy")


def analyse_local(
    states: DataFrame,
    observations: DataFrame,
    radius: float,
    patch: float,
    day: str = "fdate",
    seed: int = 0,
) -> DataFrame:
    """Local transform analysis: states (lat, lon, a) see the observations (lat, lon, ha, d, e) around them only.

    States of one ``patch`` (a square of so many degrees) share one N x N solve. It takes the observations of the date within
    ``radius`` of the patch's centre, their weights tapered by distance. The N x N sums are added up as in the
    analysis with all observations, so a patch with most observations is no single task's work. As ``radius`` grows, the result
    approaches that of ``analyse`` with 'letkf'. States without place or without observations around keep their members.
    """
    place = lambda c: F.floor(F.col(c) / F.lit(patch))
    placed = states.withColumn("_px", place("lon")).withColumn("_py", place("lat"))
    centre = lambda c: (F.col(c) + 0.5) * F.lit(patch)
    patches = placed.filter("_px IS NOT NULL AND _py IS NOT NULL").select(day, "_px", "_py").distinct()
    patches = patches.withColumn("x", centre("_px")).withColumn("y", centre("_py"))
    seen = observations.select(day, "lat", "lon", "ha", "d", "e")
    pairs = within_radius(patches, seen, radius, day).withColumn("_share", taper(F.col("distance"), radius))
    unit = [day, "_px", "_py"]
    weights = filter_weights(pairs, "letkf", unit, seed, "_share").withColumnRenamed("w", "_w")
    met = placed.join(weights, unit, "left")
    return met.withColumn("xa", transformed(F.col("a"), F.col("_w"))).select(*states.columns, "xa")


def nearest_observation(
    states: DataFrame, observations: DataFrame, finest: float = 0.25
) -> DataFrame:
    """Distance from each state to its nearest observation of the same date.

    The filters use every observation whatever its distance, so the full state-by-observation
    matrix is never formed. Inputs carry (fdate, lat, lon) and ``gid`` or ``oid``; states without ``fdate`` are
    asked on every date that has observations.
    """
    if "fdate" not in states.columns:
        return nearest_on_days(states, observations, ("lon", "lat"), ("lon", "lat"), "oid", finest=finest, digits=9)
    return nearest_join(
        states, observations, ("lon", "lat"), ("lon", "lat"), "oid", by=["fdate"], finest=finest, digits=9
    )


# ---------------------------------------------------------------- model state


def unpack_members(analysed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, ensemble, x, xa) rows from the member arrays."""
    pairs = F.posexplode(F.arrays_zip(F.col("a").alias("a"), F.col("xa").alias("xa")))
    out = analysed.select(*keys, pairs.alias("_i", "_p"))
    return out.select(
        *keys,
        (F.col("_i") + 1).alias("ensemble"),
        F.col("_p.a").alias("x"),
        F.col("_p.xa").alias("xa"),
    )


def area_weighted_state(parts: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Cell value from its vegetation and elevation-band parts.

    ``veg_frac`` NULL marks bare soil, whose share is one minus all vegetation shares of
    the cell. The shares ride along in the same aggregation.
    """
    planted = F.col("veg_frac").isNotNull()
    band_value = F.col("band_frac") * F.col(value)
    # Each vegetation share appears once per band; bands add up to one, so weighting a
    # share by its band fraction counts it once.
    sums = parts.groupBy(*keys).agg(
        F.sum(F.when(planted, F.col("veg_frac") * band_value)).alias("_veg"),
        F.sum(F.when(~planted, band_value)).alias("_bare"),
        F.sum(F.when(planted, F.col("veg_frac") * F.col("band_frac"))).alias("_share"),
        F.sum(F.when(~planted, F.col("band_frac"))).alias("_bands"),
    )
    cover = F.coalesce(F.col("_share") / F.nullif("_bands", F.lit(0.0)), F.lit(0.0))
    value_of = F.coalesce("_veg", F.lit(0.0)) + (1.0 - cover) * F.coalesce("_bare", F.lit(0.0))
    return sums.select(*keys, value_of.alias(value))


def update_moisture(layer_value: Column, x: Column, xa: Column) -> Column:
    """Every layer scales by analysis over background."""
    return layer_value * xa / F.nullif(x, F.lit(0.0))


def update_swe(part: Column, x: Column, xa: Column) -> Column:
    """New snow state of one part: struct<swe, coverage, age, density, cold_content, cleared>.

    Negative analyses count as zero. Without background snow the part gets the analysis
    (millimetres to metres), coverage 1, density 150 and a cold content; with an analysis of
    zero, age, coverage and the pack variables are cleared. NULL means 'leave as it is'.
    """
    bounded = F.greatest(xa, F.lit(0.0))
    swe = F.when(x == 0, bounded / 1000.0).otherwise(part * bounded / F.nullif(x, F.lit(0.0)))
    gone = bounded == 0
    fresh = (bounded > 0) & (x == 0)
    return F.struct(
        F.round(swe, 6).alias("swe"),
        F.when(gone, 0.0).when(fresh, 1.0).alias("coverage"),
        F.when(gone, F.lit(0)).alias("age"),
        F.when(gone, 0.0).when(fresh, 150.0).alias("density"),
        F.when(gone, 0.0)
        .when(fresh, F.lit(-2102.0) * 1000.0 * swe * 273.15)
        .alias("cold_content"),
        gone.cast("int").alias("cleared"),
    )


def update_snow_cover(part: Column, x: Column, xa: Column) -> Column:
    """Snow-cover states are left unchanged."""
    del x, xa
    return part
