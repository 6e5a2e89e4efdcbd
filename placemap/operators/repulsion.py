"""Repulsion of every place by all others, without ever listing all pairs.

The 1/d law is the field of a two-dimensional charge, so a distant group of places acts through a short
power series about its middle (the fast multipole method of Greengard and Rokhlin). Places are put
into quadratic cells of halving size. Near cells are joined and summed exactly, far cells through their
series; with ``ORDER`` terms the series is exact to about twelve digits. Both parts are equi-joins on cell
keys followed by sums, and a crowded spot only gets smaller cells. Below the limit distance, where the law is linear, crowds act through
sums of their coordinates, beyond it through series again, and only the ring between is met point by point. Every run has
cells of its own size.
"""

import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placemap.constants import KEY, MIN_DISTANCE, REPULSION_STRENGTH
from placemap.operators.joins import beside_runs, spread
from placemap.sources.storage import stored

ORDER = 24  # series terms
NEAR = 2  # cells up to this many steps away are summed exactly
DEEPEST = 52  # halvings after which neighbouring doubles are as far apart as cells
CELL = [KEY, "level", "cx", "cy"]

# A series travels between tasks as the bytes of its ORDER complex numbers.
_SERIES = T.StructType(
    [T.StructField(KEY, T.LongType()), T.StructField("level", T.IntegerType())] + [T.StructField(c, T.LongType()) for c in CELL[2:]]
    + [T.StructField("series", T.BinaryType())]
)
_FIELD = T.StructType([T.StructField(KEY, T.LongType())] + [T.StructField(c, T.DoubleType()) for c in "x y ex ey".split()])

# Executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _points(positions: DataFrame) -> DataFrame:
    """Distinct coordinates of every run with their number of places."""
    spots = positions.groupBy(KEY, "x", "y").agg(F.count(F.lit(1)).cast("double").alias("w"))
    return spread(spots, KEY, "x", "y")


def _rooted(points: DataFrame, min_d: float) -> DataFrame:
    """Add the root square of each run and its deepest level of cells."""
    extent = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))
    # Cells more than NEAR apart must not come closer than min_d, where the law changes.
    side = F.greatest(extent, F.lit(4 * min_d)) * (1 + 1e-9)
    roots = points.groupBy(KEY).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), side.alias("side"))
    deepest = F.least(F.floor(F.log2(2 * F.col("side") / min_d)), F.lit(DEEPEST)).cast("int")
    return beside_runs(points, roots.withColumn("deepest", deepest), "inner")


def _in_cells(points: DataFrame, last: Column) -> DataFrame:
    """One row per point and level from 2 to ``last``."""
    rows = points.withColumn("level", F.explode(F.sequence(F.lit(2), last)))
    return _celled(rows.withColumn("cell", F.col("side") / F.pow(F.lit(2.0), F.col("level"))))


def _celled(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "cx": F.floor((F.col("x") - F.col("x0")) / F.col("cell")).cast("bigint"),
        "cy": F.floor((F.col("y") - F.col("y0")) / F.col("cell")).cast("bigint"),
    })


def _half(cell: Column) -> Column:
    return F.shiftright(cell, 1)


def _centred(rows: DataFrame) -> DataFrame:
    """Offset of each point from its cell's middle, in cells."""
    return rows.withColumns({
        "u": (F.col("x") - F.col("x0")) / F.col("cell") - F.col("cx") - 0.5,
        "v": (F.col("y") - F.col("y0")) / F.col("cell") - F.col("cy") - 0.5,
    })


def _unpack(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=complex).reshape(-1, ORDER)


def _by_cell(batch: pd.DataFrame, series: np.ndarray) -> pd.DataFrame:
    """Sum rows of complex numbers per cell."""
    code = batch.groupby(CELL, sort=False).ngroup().to_numpy()
    order = np.argsort(code, kind="stable")
    starts = np.flatnonzero(np.diff(code[order], prepend=-1))
    sums = np.add.reduceat(series[order], starts, axis=0)
    return batch[CELL].iloc[order[starts]].assign(series=[row.tobytes() for row in sums])


def _start_series(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of w * (offset as a complex number) ** m for the cells of each batch."""
    for batch in batches:
        if len(batch):
            offset = batch["u"].to_numpy() + 1j * batch["v"].to_numpy()
            yield _by_cell(batch, np.vander(offset, ORDER, increasing=True) * batch["w"].to_numpy()[:, None])


def _add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sum neighbouring rows of one cell; the last cell of a batch waits for the next batch."""
    open_cell = None
    for batch in batches:
        if open_cell is not None:
            batch = pd.concat([open_cell, batch])
        if len(batch):
            sums = _by_cell(batch, _unpack(batch["series"]))
            open_cell = sums.iloc[-1:]
            yield sums.iloc[:-1]
    if open_cell is not None:
        yield open_cell


def _total(parts: DataFrame) -> DataFrame:
    """One series per cell from the partial sums of all tasks."""
    return parts.repartition(*CELL).sortWithinPartitions(*CELL).mapInPandas(_add_up, _SERIES)


def _read_field(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Value of the field series at each point."""
    for batch in batches:
        if len(batch):
            offset = batch["u"].to_numpy() + 1j * batch["v"].to_numpy()
            value = (_unpack(batch["series"]) * np.vander(offset, ORDER, increasing=True)).sum(axis=1)
            value /= batch["cell"].to_numpy()
            # The field of 1/z is the conjugate of the force direction.
            yield batch[[KEY, "x", "y"]].assign(ex=value.real, ey=-value.imag)


def _shift_matrix(dx: int, dy: int) -> np.ndarray:
    """Turns the series of a cell into the field series of the cell (dx, dy) steps further on."""
    delta = complex(dx, dy)
    matrix = np.zeros((ORDER, ORDER), dtype=complex)
    for m in range(ORDER):
        entry = delta ** -(m + 1)
        for q in range(ORDER):
            matrix[m, q] = entry
            entry *= -(m + q + 1) / (q + 1) / delta
    return matrix


def _shift_series(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Field series of the target cells, summed over the sources within a batch."""
    matrices: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        if not len(batch):
            continue
        series = _unpack(batch["series"])
        moved = np.empty_like(series)
        for (dx, dy), at in batch.groupby(["dx", "dy"]).indices.items():
            key = (int(dx), int(dy))
            if key not in matrices:
                matrices[key] = _shift_matrix(*key)
            moved[at] = series[at] @ matrices[key]
        yield _by_cell(batch, moved)


def _far_field(active: DataFrame, cells: DataFrame) -> DataFrame:
    """Field of all far cells at every point; ``cells`` are the points of all levels."""
    # Partners: children of the parent's near cells that are not near themselves.
    low, high = -2 * NEAR, 2 * NEAR + 1
    targets = spread(active.select(*CELL).distinct(), *CELL)

    def reach(cell: str) -> Column:
        odd = F.pmod(F.col(cell), F.lit(2))
        return F.explode(F.sequence(low - odd, high - odd))

    near = (F.abs("ox") <= NEAR) & (F.abs("oy") <= NEAR)
    wanted = (
        targets.withColumn("ox", reach("cx")).withColumn("oy", reach("cy")).filter(~near)
        .select(
            *CELL, (-F.col("ox")).alias("dx"), (-F.col("oy")).alias("dy"),
            (F.col("cx") + F.col("ox")).alias("sx"), (F.col("cy") + F.col("oy")).alias("sy"),
        )
    )
    source_keys = [KEY, "level", "sx", "sy"]
    sources = cells.join(wanted.select(*source_keys).distinct().toDF(*CELL), CELL, "left_semi")
    series = _total(_centred(sources).select(*CELL, "u", "v", "w").mapInPandas(_start_series, _SERIES))
    moved = wanted.join(series.toDF(*source_keys, "series"), source_keys).select(*CELL, "dx", "dy", "series")
    fields = _total(moved.mapInPandas(_shift_series, _SERIES))
    here = _centred(active).select(*CELL, "x", "y", "u", "v", "cell").join(fields, CELL)
    return here.drop(*CELL[1:]).mapInPandas(_read_field, _FIELD)


def _push(pairs: DataFrame, min_d: float) -> DataFrame:
    """Push of the source ``sx, sy`` on the point ``x, y`` for unit strength."""
    dx, dy = F.col("x") - F.col("sx"), F.col("y") - F.col("sy")
    weight = F.col("w") / F.greatest(dx * dx + dy * dy, F.lit(min_d * min_d))
    return pairs.select(KEY, "x", "y", (weight * dx).alias("ex"), (weight * dy).alias("ey"))


def _near_field(final: DataFrame, cells: DataFrame, crowded: DataFrame, min_d: float, leaf: int) -> DataFrame:
    """Exact sums over the points of the surrounding cells of the same size."""
    sources = cells.join(crowded, CELL, "left_anti").select(*CELL, F.col("x").alias("sx"), F.col("y").alias("sy"), "w")
    met = _push(_around(final, "x", "y").join(sources, CELL), min_d)
    if not crowded.limit(1).count():
        return met
    return met.unionByName(_crowd_field(final, cells.join(crowded, CELL, "left_semi"), min_d, leaf))


def _around(rows: DataFrame, *columns: str) -> DataFrame:
    """Each row once for every near cell, whose key takes the place of its own."""
    steps = F.explode(F.sequence(F.lit(-NEAR), F.lit(NEAR)))
    return rows.withColumn("_ox", steps).withColumn("_oy", steps).select(
        KEY, "level", (F.col("cx") + F.col("_ox")).alias("cx"), (F.col("cy") + F.col("_oy")).alias("cy"), *columns
    )


PAIR = [KEY, "level", "tx", "ty", "sx", "sy"]


def _children(points: DataFrame, level: Column, x: str, y: str) -> DataFrame:
    """The points of a set of cells one level further down, with the number of points and their sums about the middle."""
    rows = points.withColumn("level", level).withColumn("cell", F.col("side") / F.pow(F.lit(2.0), F.col("level")))
    rows = _centred(_celled(rows))
    return rows.groupBy(*CELL, "cell").agg(
        F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("u")).alias("wu"), F.sum(F.col("w") * F.col("v")).alias("wv")
    ).select(KEY, "level", F.col("cx").alias(x), F.col("cy").alias(y), "cell", "n", "w", "wu", "wv")


def _split_pairs(pairs: DataFrame, targets: DataFrame, sources: DataFrame) -> DataFrame:
    """All pairs of children of the pairs' cells."""
    up = [(F.col("level") - 1).alias("level")]
    t = targets.select(KEY, *up, _half(F.col("tx")).alias("_px"), _half(F.col("ty")).alias("_py"), "tx", "ty", F.col("n").alias("nt"))
    s = sources.select(KEY, *up, _half(F.col("sx")).alias("_qx"), _half(F.col("sy")).alias("_qy"), "sx", "sy", "cell", F.col("n").alias("ns"), "w", "wu", "wv")
    above = pairs.toDF(KEY, "level", "_px", "_py", "_qx", "_qy")
    met = above.join(t, [KEY, "level", "_px", "_py"]).join(s, [KEY, "level", "_qx", "_qy"])
    return met.withColumn("level", F.col("level") + 1).drop("_px", "_py", "_qx", "_qy")


def _crowd_field(final: DataFrame, crowd: DataFrame, min_d: float, leaf: int) -> DataFrame:
    """Push of crowded cells on the points near them, by pairs of ever smaller cells.

    Where a cell lies within min_d of another as a whole the law is linear and sums act; where it lies beyond as a whole and
    more than NEAR cells away its series acts. Only pairs that the circle of min_d passes through, or that are too near
    for a series, are divided again, until they hold few enough points to be met one by one.
    """
    few = leaf * leaf
    held = ["x", "y", "w", "x0", "y0", "side", "level"]
    first_t = final.groupBy(*CELL).agg(F.count(F.lit(1)).alias("nt"))
    first_s = crowd.groupBy(*CELL).agg(F.count(F.lit(1)).alias("ns"))
    begun = _around(first_t, F.col("cx").alias("tx"), F.col("cy").alias("ty"), "nt").join(first_s, CELL)
    begun = stored(begun.select(KEY, "level", "tx", "ty", F.col("cx").alias("sx"), F.col("cy").alias("sy"), "nt", "ns"), "crowd-pairs")
    targets = begun.select(KEY, "level", F.col("tx").alias("cx"), F.col("ty").alias("cy")).distinct()
    targets = stored(final.join(targets, CELL, "left_semi").select(KEY, *held), "crowd-targets")
    sources = stored(crowd.select(KEY, *held), "crowd-sources")

    one_by_one = [begun.filter(F.col("nt") * F.col("ns") <= few).select(*PAIR)]
    linear, apart = [], []
    open_pairs, depth = begun.filter(F.col("nt") * F.col("ns") > few).select(*PAIR), 0
    while open_pairs.limit(1).count():
        depth += 1
        down = F.col("level") + depth
        met = _split_pairs(open_pairs, _children(targets, down, "tx", "ty"), _children(sources, down, "sx", "sy"))
        ox, oy = F.abs(F.col("tx") - F.col("sx")), F.abs(F.col("ty") - F.col("sy"))
        nearest = F.col("cell") * F.hypot(F.greatest(ox - 1, F.lit(0)), F.greatest(oy - 1, F.lit(0)))
        kind = (
            F.when(F.col("cell") * F.hypot(ox + 1, oy + 1) < min_d * (1 - 1e-9), "linear")
            .when((nearest > min_d * (1 + 1e-9)) & (F.greatest(ox, oy) > NEAR), "apart")
            .when(F.col("nt") * F.col("ns") <= few, "few").otherwise("open")
        )
        met = stored(met.withColumn("kind", kind), "crowd-pairs")
        linear.append(met.filter("kind = 'linear'"))
        apart.append(met.filter("kind = 'apart'").select(*PAIR))
        one_by_one.append(met.filter("kind = 'few'").select(*PAIR))
        open_pairs = met.filter("kind = 'open'").select(*PAIR)

    direct = _one_by_one(_union(one_by_one), targets, sources, depth, min_d)
    if not depth:
        return direct
    return direct.unionByName(_linear_field(_union(linear), targets, depth, min_d)).unionByName(_apart_field(_union(apart), targets, sources, depth))


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _below(points: DataFrame, depth: int, first: int = 1) -> DataFrame:
    """One row per crowded point and level of the divided pairs."""
    rows = points.withColumn("level", F.explode(F.sequence(F.col("level") + first, F.col("level") + depth)))
    return _celled(rows.withColumn("cell", F.col("side") / F.pow(F.lit(2.0), F.col("level"))))


def _linear_field(pairs: DataFrame, targets: DataFrame, depth: int, min_d: float) -> DataFrame:
    """Sums of whole cells within min_d, collected per cell and then read at its points."""
    dx, dy = F.col("tx") - F.col("sx"), F.col("ty") - F.col("sy")
    sums = pairs.groupBy(KEY, "level", F.col("tx").alias("cx"), F.col("ty").alias("cy")).agg(
        F.sum("w").alias("_w"), F.sum(F.col("w") * dx - F.col("wu")).alias("_bx"), F.sum(F.col("w") * dy - F.col("wv")).alias("_by")
    )
    here = _centred(_below(targets, depth).join(sums, CELL))
    scale = F.col("cell") / (min_d * min_d)
    return here.select(
        KEY, "x", "y", ((F.col("_w") * F.col("u") + F.col("_bx")) * scale).alias("ex"), ((F.col("_w") * F.col("v") + F.col("_by")) * scale).alias("ey")
    )


def _apart_field(pairs: DataFrame, targets: DataFrame, sources: DataFrame, depth: int) -> DataFrame:
    """Series of whole cells beyond min_d."""
    keys = [KEY, "level", "sx", "sy"]
    wanted = pairs.select(
        KEY, "level", F.col("tx").alias("cx"), F.col("ty").alias("cy"), (F.col("tx") - F.col("sx")).alias("dx"), (F.col("ty") - F.col("sy")).alias("dy"), "sx", "sy"
    )
    started = _centred(_below(sources, depth).join(pairs.select(*keys).distinct().toDF(*CELL), CELL, "left_semi"))
    series = _total(started.select(*CELL, "u", "v", "w").mapInPandas(_start_series, _SERIES))
    moved = wanted.join(series.toDF(*keys, "series"), keys).select(*CELL, "dx", "dy", "series")
    fields = _total(moved.mapInPandas(_shift_series, _SERIES))
    here = _centred(_below(targets, depth)).select(*CELL, "x", "y", "u", "v", "cell").join(fields, CELL)
    return here.drop(*CELL[1:]).mapInPandas(_read_field, _FIELD)


def _one_by_one(pairs: DataFrame, targets: DataFrame, sources: DataFrame, depth: int, min_d: float) -> DataFrame:
    """Points of pairs of small cells, packed per cell, so that a pair is one row."""

    def packed(points: DataFrame, x: str, y: str, name: str) -> DataFrame:
        rows = _below(points, depth, 0).withColumnRenamed("cx", x).withColumnRenamed("cy", y)
        rows = rows.join(pairs.select(KEY, "level", x, y).distinct(), [KEY, "level", x, y], "left_semi")
        return rows.groupBy(KEY, "level", x, y).agg(F.collect_list(F.struct("x", "y", "w")).alias(name))

    both = pairs.join(packed(targets, "tx", "ty", "here"), PAIR[:4]).join(packed(sources, "sx", "sy", "there"), [KEY, "level", "sx", "sy"])
    limit = min_d * min_d

    def push(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, out = [], []
            for run, here, there in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                t, s = ([np.asarray(points.values.field(c)) for c in range(3)] for points in (here, there))
                dx, dy = t[0][:, None] - s[0], t[1][:, None] - s[1]
                weight = s[2] / np.maximum(dx * dx + dy * dy, limit)
                runs.append(np.full(len(t[0]), run))
                out.append((t[0], t[1], (weight * dx).sum(1), (weight * dy).sum(1)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(runs)), *[pa.array(np.concatenate(c)) for c in zip(*out)]], _FIELD.names)

    return both.select(KEY, "here", "there").mapInArrow(push, _FIELD)


def _all_field(positions: DataFrame, min_d: float, leaf: int) -> DataFrame:
    points = _rooted(_points(positions), min_d)
    counts = _in_cells(points, F.col("deepest")).groupBy(*CELL).agg(F.count(F.lit(1)).alias("points"), F.first("deepest").alias("deepest"))
    # Cells still too full; they are at most n / leaf per level. Found once, read by all parts below.
    full = stored(counts.filter(F.col("points") > leaf).select(*CELL, (F.col("level") == F.col("deepest")).alias("_last")), "cells")
    divided, crowded = full.filter("NOT _last").drop("_last"), full.filter("_last").drop("_last")
    depth = divided.groupBy(KEY).agg((F.max("level") + 1).alias("_depth"))
    cells = _in_cells(beside_runs(points, depth), F.coalesce("_depth", F.lit(2))).drop("_depth")
    parents = divided.toDF(KEY, "_up", "_px", "_py")
    deeper = cells.filter(F.col("level") > 2).withColumns(
        {"_up": F.col("level") - 1, "_px": _half(F.col("cx")), "_py": _half(F.col("cy"))}
    )
    split = deeper.join(parents, [KEY, "_up", "_px", "_py"], "left_semi").select(*cells.columns)
    active = cells.filter(F.col("level") == 2).unionByName(split)
    final = active.join(divided, CELL, "left_anti")
    return _far_field(active, cells).unionByName(_near_field(final, cells, crowded, min_d, leaf))


def repulsion(
    positions: DataFrame, strength: float | Column = REPULSION_STRENGTH, min_d: float = MIN_DISTANCE, leaf: int = 32
) -> DataFrame:
    """Sum over all other places of strength / max(d, min_d), pushing away from them.

    ``strength`` may be a column over ``run_id``. ``leaf`` is the number of points a cell may hold before it
    is split; the list of split cells is worked out at once and stored. A place without finite coordinates stops the job.
    """

    def finite(axis: str) -> Column:
        lost = F.raise_error(F.concat(F.lit("place without finite coordinates: "), F.col("name"))).cast("double")
        return F.when(F.abs(axis) < F.lit(float("inf")), F.col(axis)).otherwise(lost).alias(axis)

    places = positions.select(KEY, "name", finite("x"), finite("y"))
    field = _all_field(places, min_d, leaf).groupBy(KEY, "x", "y").agg(F.sum("ex").alias("ex"), F.sum("ey").alias("ey"))
    force = strength if isinstance(strength, Column) else F.lit(float(strength))
    return places.join(field, [KEY, "x", "y"], "left").select(
        KEY, "name",
        (force * F.coalesce("ex", F.lit(0.0))).alias("fx"), (force * F.coalesce("ey", F.lit(0.0))).alias("fy"),
    )
