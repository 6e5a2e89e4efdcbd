"""Coordinate changes of whole layouts."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placemap.constants import (
    CANVAS_CENTRE, CANVAS_HEIGHT, CANVAS_WIDTH, GEODESIC_ORIGIN, KEY, KM_PER_PX, MODEL_FACTOR,
    OVERLAY_OFFSET, OVERLAY_SCALE, REFERENCE_POINT, START_SHRINK, START_X, START_Y, WGS84_A, WGS84_F,
)
from placemap.functions.chance import hash_uniform
from placemap.functions.plane import rotate
from placemap.functions.projection import lcc_lonlat, lcc_xy
from placemap.operators.joins import beside_runs

Box = tuple[float, float, float, float]  # x_min, y_min, x_max, y_max


def random_positions(places: DataFrame, seed: int = 0, x_range=START_X, y_range=START_Y) -> DataFrame:
    """Uniform start positions that depend on seed, run and name only."""

    def draw(axis: str, low: float, high: float) -> Column:
        return F.lit(low) + F.lit(high - low) * hash_uniform(seed, F.col(KEY), F.col("name"), axis)

    return places.select(KEY, "name", draw("x", *x_range).alias("x"), draw("y", *y_range).alias("y"))


def shift(positions: DataFrame, scale: float = START_SHRINK, centre=CANVAS_CENTRE) -> DataFrame:
    """Move each run's mean to ``centre`` and divide its extent by ``scale``."""
    means = positions.groupBy(KEY).agg(F.avg("x").alias("_mx"), F.avg("y").alias("_my"))
    return (
        beside_runs(positions, means, "inner")
        .withColumn("x", (F.col("x") - F.col("_mx")) / scale + F.lit(centre[0]))
        .withColumn("y", (F.col("y") - F.col("_my")) / scale + F.lit(centre[1]))
        .select(*positions.columns)
    )


def apply_anchors(positions: DataFrame, anchors: DataFrame) -> DataFrame:
    """Replace the coordinates of anchored places. Anchors without ``run_id`` hold in every run.

    An anchor without coordinates stops the job; one that is no place is refused at once, by a job of its own.
    """
    on = [KEY, "name"] if KEY in anchors.columns else ["name"]
    fixed = anchors.select(*on, F.struct("x", "y").alias("_at"))
    given = F.col("_at").isNotNull()

    def pick(axis: str) -> Column:
        lost = F.raise_error(F.concat(F.lit("anchor without coordinates: "), F.col("name"))).cast("double")
        return F.when(given, F.coalesce(F.col("_at." + axis), lost)).otherwise(F.col(axis)).alias(axis)

    rest = [c for c in positions.columns if c not in ("x", "y")]
    lost = fixed.join(positions.select(*on), on, "left_anti").select("name").limit(5).collect()
    if lost:
        raise ValueError(f"anchor is no place: {', '.join(str(row['name']) for row in lost)}")
    moved = positions.join(fixed, on, "left").select(*rest, pick("x"), pick("y"))
    return moved.select(*positions.columns)


def anchor_rows(table: DataFrame, name: str, **columns: str) -> DataFrame:
    """One row per run with the given columns of the place ``name``."""
    wanted = [F.col(source).alias(target) for target, source in columns.items()]
    return table.filter(F.col("name") == name).select(KEY, *wanted)


def _anchored(table: DataFrame, values: DataFrame, name: str, known: str) -> DataFrame:
    """Put each run's anchor values beside its rows; a run whose anchor lacks them stops the job."""
    lost = F.raise_error(F.concat(F.lit(f"no anchor {name} in run "), F.col(KEY).cast("string"))).cast("double")
    return beside_runs(table, values).withColumn(known, F.coalesce(known, lost))


def lcc_forward(points: DataFrame, anchor: str) -> DataFrame:
    """``lon, lat`` to ``x_km, y_km`` about the anchor place, y growing southwards."""
    x, y = lcc_xy(F.col("lon"), F.col("lat"))
    projected = points.withColumn("_x", x).withColumn("_y", y)
    origin = anchor_rows(points, anchor, _lon="lon", _lat="lat")
    ox, oy = lcc_xy(F.col("_lon"), F.col("_lat"))
    return _anchored(projected, origin.select(KEY, ox.alias("_ox"), oy.alias("_oy")), anchor, "_ox").select(
        *points.columns,
        ((F.col("_x") - F.col("_ox")) / 1000).alias("x_km"),
        (-(F.col("_y") - F.col("_oy")) / 1000).alias("y_km"),
    )


Origin = DataFrame | tuple[float, float]


def lcc_inverse(points: DataFrame, origin: Origin) -> DataFrame:
    """``x_km, y_km`` to ``lon, lat``.

    ``origin`` is the anchor's (lon, lat) for all runs, or a table with ``lon0, lat0`` per run.
    """
    if isinstance(origin, tuple):
        ox, oy = lcc_xy(F.lit(float(origin[0])), F.lit(float(origin[1])))
        placed = points.withColumns({"_ox": ox, "_oy": oy})
    else:
        ox, oy = lcc_xy(F.col("lon0"), F.col("lat0"))
        placed = beside_runs(points, origin.select(KEY, ox.alias("_ox"), oy.alias("_oy")))
    lon, lat = lcc_lonlat(F.col("_x"), F.col("_y"))
    return (
        placed.withColumn("_x", F.col("x_km") * 1000 + F.col("_ox"))
        .withColumn("_y", -F.col("y_km") * 1000 + F.col("_oy"))
        .select(*points.columns, lon.alias("lon"), lat.alias("lat"))
    )


def px_to_km(positions: DataFrame, ref=REFERENCE_POINT) -> DataFrame:
    """Add kilometres from the reference pixel."""
    return positions.withColumns({
        "x_km": (F.col("x") - F.lit(float(ref[0]))) * F.lit(KM_PER_PX),
        "y_km": (F.col("y") - F.lit(float(ref[1]))) * F.lit(KM_PER_PX),
    })


def km_to_px(points: DataFrame, ref=REFERENCE_POINT) -> DataFrame:
    """Add pixels for kilometres from the reference pixel."""
    return points.withColumns({
        "x": F.col("x_km") * F.lit(1.0 / KM_PER_PX) + F.lit(float(ref[0])),
        "y": F.col("y_km") * F.lit(1.0 / KM_PER_PX) + F.lit(float(ref[1])),
    })


def positions_to_lonlat(positions: DataFrame, origin: Origin, ref=REFERENCE_POINT) -> DataFrame:
    """Canvas positions as ``lon, lat``; ``origin`` lies on the reference pixel."""
    return lcc_inverse(px_to_km(positions, ref), origin).drop("x_km", "y_km")


def align_rotate(positions: DataFrame, first: str, second: str, theta: float) -> DataFrame:
    """Kilometres with ``first`` at the origin and the bearing first -> second turned to ``theta``."""

    def at(name: str, axis: str, alias: str) -> Column:
        return F.max(F.when(F.col("name") == name, F.col(axis))).alias(alias)

    ends = positions.filter(F.col("name").isin(first, second)).groupBy(KEY).agg(
        at(first, "x", "_x1"), at(first, "y", "_y1"), at(second, "x", "_x2"), at(second, "y", "_y2")
    )
    turn = F.lit(float(theta)) - F.atan2(F.col("_y2") - F.col("_y1"), F.col("_x2") - F.col("_x1"))
    frames = ends.select(KEY, "_x1", "_y1", turn.alias("_turn"))
    dx = (F.col("x") - F.col("_x1")) * F.lit(KM_PER_PX)
    dy = (F.col("y") - F.col("_y1")) * F.lit(KM_PER_PX)
    x, y = rotate(dx, dy, F.col("_turn"))
    return _anchored(positions, frames, f"{first} or {second}", "_turn").select(KEY, "name", x.alias("x_km"), y.alias("y_km"))


def geodesic_offset(points: DataFrame, lon0=GEODESIC_ORIGIN[0], lat0=GEODESIC_ORIGIN[1], bearing="math") -> DataFrame:
    """``lon, lat`` reached from one fixed point by walking ``(x_km, y_km)`` on the ellipsoid.

    ``math`` takes atan2(y, x) as the azimuth; ``azimuth`` treats y as southwards and measures from north.
    Vincenty's direct formulas with a fixed number of steps; each step gains more than two digits.
    """
    x, y = F.col("x_km"), F.col("y_km")
    if bearing not in ("math", "azimuth"):
        raise ValueError("bearing must be 'math' or 'azimuth'")
    azimuth = F.atan2(y, x) if bearing == "math" else F.atan2(x, -y)
    f, a = WGS84_F, WGS84_A
    b = a * (1 - f)
    u1 = math.atan((1 - f) * math.tan(math.radians(lat0)))
    sin_u1, cos_u1 = F.lit(math.sin(u1)), F.lit(math.cos(u1))
    c = F.col

    def step(table: DataFrame, **values: Column) -> DataFrame:
        return table.withColumns({"_" + k: v for k, v in values.items()})

    t = step(points, s=F.hypot(x, y) * 1000, az=azimuth)
    t = step(t, sin_a=cos_u1 * F.sin(c("_az")), sigma1=F.atan2(F.lit(math.tan(u1)), F.cos(c("_az"))))
    t = step(t, cos2_a=1 - c("_sin_a") * c("_sin_a"))
    t = step(t, uu=c("_cos2_a") * ((a * a - b * b) / (b * b)))
    t = step(
        t,
        A=1 + c("_uu") / 16384 * (4096 + c("_uu") * (-768 + c("_uu") * (320 - 175 * c("_uu")))),
        B=c("_uu") / 1024 * (256 + c("_uu") * (-128 + c("_uu") * (74 - 47 * c("_uu")))),
    )
    t = step(t, sigma0=c("_s") / (F.lit(b) * c("_A")))
    t = step(t, sigma=c("_sigma0"))
    for _ in range(6):
        t = step(t, m=F.cos(2 * c("_sigma1") + c("_sigma")), sn=F.sin(c("_sigma")), cs=F.cos(c("_sigma")))
        m2 = c("_m") * c("_m")
        inner = c("_cs") * (2 * m2 - 1) - c("_B") / 6 * c("_m") * (4 * c("_sn") * c("_sn") - 3) * (4 * m2 - 3)
        t = step(t, sigma=c("_sigma0") + c("_B") * c("_sn") * (c("_m") + c("_B") / 4 * inner))
    t = step(t, m=F.cos(2 * c("_sigma1") + c("_sigma")), sn=F.sin(c("_sigma")), cs=F.cos(c("_sigma")))
    cos_az = F.cos(c("_az"))
    across = sin_u1 * c("_sn") - cos_u1 * c("_cs") * cos_az
    lat = F.atan2(sin_u1 * c("_cs") + cos_u1 * c("_sn") * cos_az, (1 - f) * F.hypot(c("_sin_a"), across))
    lam = F.atan2(c("_sn") * F.sin(c("_az")), cos_u1 * c("_cs") - sin_u1 * c("_sn") * cos_az)
    t = step(t, lat=lat, lam=lam, C=f / 16 * c("_cos2_a") * (4 + f * (4 - 3 * c("_cos2_a"))))
    drift = c("_sigma") + c("_C") * c("_sn") * (c("_m") + c("_C") * c("_cs") * (2 * c("_m") * c("_m") - 1))
    lon = F.lit(lon0) + F.degrees(c("_lam") - (1 - c("_C")) * f * c("_sin_a") * drift)
    wrapped = F.pmod(lon + 180, F.lit(360.0)) - 180
    return t.select(*points.columns, wrapped.alias("lon"), F.degrees(c("_lat")).alias("lat"))


def in_box(positions: DataFrame, box: Box) -> DataFrame:
    """Places inside the box, edges included."""
    x_min, y_min, x_max, y_max = (float(v) for v in box)
    return positions.filter(F.col("x").between(x_min, x_max) & F.col("y").between(y_min, y_max))


def zoom_factor(box: Box, width=CANVAS_WIDTH, height=CANVAS_HEIGHT) -> float:
    x_min, y_min, x_max, y_max = box
    return math.sqrt((width * height) / ((x_max - x_min) * (y_max - y_min)))


def zoom(positions: DataFrame, box: Box, width=CANVAS_WIDTH, height=CANVAS_HEIGHT) -> DataFrame:
    """Enlarge about the box centre onto the canvas centre."""
    factor = zoom_factor(box, width, height)
    cx, cy = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2
    return positions.withColumns({
        "x": (F.col("x") - F.lit(cx)) * F.lit(factor) + F.lit(width / 2),
        "y": (F.col("y") - F.lit(cy)) * F.lit(factor) + F.lit(height / 2),
    })


def flip_y(positions: DataFrame, height: float = CANVAS_HEIGHT) -> DataFrame:
    return positions.withColumn("y", F.lit(float(height)) - F.col("y"))


def rescale_about(positions: DataFrame, anchor: str, factor=MODEL_FACTOR, ref=REFERENCE_POINT) -> DataFrame:
    """Scale another model's layout about its anchor and put the anchor on the reference pixel."""
    origin = anchor_rows(positions, anchor, _ax="x", _ay="y")
    return (
        _anchored(positions, origin, anchor, "_ax")
        .withColumn("x", (F.col("x") - F.col("_ax")) * factor + F.lit(float(ref[0])))
        .withColumn("y", (F.col("y") - F.col("_ay")) * factor + F.lit(float(ref[1])))
        .select(*positions.columns)
    )


def to_canvas(points: DataFrame, scale=OVERLAY_SCALE, offset=OVERLAY_OFFSET) -> DataFrame:
    """Integer pixels of kilometre coordinates, truncated towards zero."""
    return points.withColumns({
        "px": (F.col("x_km") * F.lit(scale) + F.lit(offset[0])).cast("int"),
        "py": (F.col("y_km") * F.lit(scale) + F.lit(offset[1])).cast("int"),
    })
