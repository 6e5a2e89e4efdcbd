"""Gaussian kernel densities of each place's samples, with Scott's bandwidth.

No pair of samples is ever formed: in coordinates where the kernel is round and of unit width, samples are
summed into small square cells (as power sums about the cell's middle), the cells are carried over to their
surroundings one axis at a time with a Taylor series of the kernel, and each point reads its own
cell (the fast Gauss transform of Greengard and Strain). The work is linear in the samples. Cells reach as far and
series are as long as ``TOLERANCE`` asks, whatever the number of samples; ``method="direct"`` sums all pairs of a
place in one task instead, for checks.
"""

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placemap.constants import CANVAS_HEIGHT, CANVAS_WIDTH, DENSITY_GRID
from placemap.operators.joins import beside_runs

#: Largest error of a density, as a share of what it would be if all samples of its place lay on one point.
TOLERANCE = 1e-10
#: Densities up to this share of that value count as zero. It lies far above the tolerance.
FLOOR = 1e-6
WIDTH = 0.5  # cell size in kernel widths


def _terms() -> int:
    """Terms after which the series' remainder, for offsets up to one cell, is a tenth of the tolerance."""
    return next(m for m in range(1, 64) if 1.1 * WIDTH**m / math.sqrt(math.factorial(m)) < TOLERANCE / 10)


TERMS = _terms()
REACH = math.ceil(math.sqrt(-2 * math.log(TOLERANCE / 10)) / WIDTH) + 1  # cells
BLOCK = 1024  # targets per numpy block
_MADE: dict[str, np.ndarray] = {}  # per worker

# Executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# --- eligibility and moments ------------------------------------------------------------------------


def _spread() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"),
        F.var_samp("x").alias("_sxx"), F.covar_samp("x", "y").alias("_sxy"), F.var_samp("y").alias("_syy"),
        F.min("x").alias("_x1"), F.max("x").alias("_x2"), F.min("y").alias("_y1"), F.max("y").alias("_y2"),
    ]


def kde_eligible(samples: DataFrame) -> DataFrame:
    """Places with at least two samples that do not all coincide, with their sample count."""
    moved = (F.col("_x2") > F.col("_x1")) | (F.col("_y2") > F.col("_y1"))
    return samples.groupBy("name").agg(*_spread()).filter((F.col("n") >= 2) & moved).select("name", "n")


def kernels(samples: DataFrame) -> DataFrame:
    """Kernel of every place whose samples span the plane.

    ``a, b, d`` turn an offset (dx, dy) into the round coordinates u = a dx, v = b dx + d dy, ``peak`` is the
    density one sample adds at its own place. Samples on a line have no kernel and are left out.
    """
    # Collinear samples leave a determinant of rounding size only.
    det = F.col("_sxx") * F.col("_syy") - F.col("_sxy") * F.col("_sxy")
    plane = det > F.lit(1e-14) * F.col("_sxx") * F.col("_syy")
    h2 = F.pow(F.col("n"), F.lit(-1 / 3))
    rest = F.col("_syy") - F.col("_sxy") * F.col("_sxy") / F.col("_sxx")
    a = 1 / F.sqrt(F.col("_sxx") * h2)
    d = 1 / F.sqrt(rest * h2)
    return samples.groupBy("name").agg(*_spread()).filter((F.col("n") >= 2) & plane).select(
        "name", "n", "mx", "my",
        a.alias("a"), (-F.col("_sxy") / F.col("_sxx") * d).alias("b"), d.alias("d"),
        (a * d / (2 * math.pi) / F.col("n")).alias("peak"),
    )


# --- direct sums ------------------------------------------------------------------------


def _direct(group: pd.DataFrame, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    first = group.iloc[0]
    px, py = group["x"].to_numpy(), group["y"].to_numpy()
    out = np.empty(len(xs))
    for at in range(0, len(xs), BLOCK):
        dx = xs[at:at + BLOCK, None] - px[None, :]
        dy = ys[at:at + BLOCK, None] - py[None, :]
        u, v = first["a"] * dx, first["b"] * dx + first["d"] * dy
        out[at:at + BLOCK] = np.exp(-0.5 * (u * u + v * v)).sum(axis=1)
    return out * first["peak"]


def _grid_columns(nx: int, ny: int, width: float, height: float) -> tuple[Column, Column]:
    gx = F.floor(F.col("cell") / ny) * F.lit(width / (nx - 1))
    gy = F.pmod(F.col("cell"), F.lit(ny)) * F.lit(height / (ny - 1))
    return gx.cast("double"), gy.cast("double")


# --- cells ---------------------------------------------------------------------------------


def _round_coordinates(points: DataFrame, kernel: DataFrame) -> DataFrame:
    """Cell and offset of each point in its place's round coordinates."""
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    table = beside_runs(points, kernel, "inner", on="name").withColumns(
        {"_u": F.col("a") * dx, "_v": F.col("b") * dx + F.col("d") * dy}
    )
    table = table.withColumns({"cu": F.floor(F.col("_u") / WIDTH), "cv": F.floor(F.col("_v") / WIDTH)})
    return table.withColumns({
        "du": F.col("_u") - (F.col("cu") + 0.5) * WIDTH, "dv": F.col("_v") - (F.col("cv") + 0.5) * WIDTH,
    })


def _step_matrices() -> np.ndarray:
    """[step, power of target, power of source] of exp(-(step * WIDTH + t - s)**2 / 2)."""
    if "steps" in _MADE:
        return _MADE["steps"]
    out = np.zeros((2 * REACH + 1, TERMS, TERMS))
    fact = [math.factorial(m) for m in range(2 * TERMS)]
    for step in range(-REACH, REACH + 1):
        delta = step * WIDTH
        hermite = [1.0, delta]
        for m in range(1, TERMS):
            hermite.append(delta * hermite[m] - m * hermite[m - 1])
        # exp(-(d + e)**2 / 2) = exp(-d*d / 2) * sum He_m(d) (-e)**m / m!, with e = t - s
        for m in range(TERMS):
            for i in range(m + 1):
                j = m - i
                sign = (-1) ** m * (-1) ** j
                weight = sign * hermite[m] * math.exp(-delta * delta / 2) / fact[m]
                out[step + REACH, i, j] = weight * (fact[m] / (fact[i] * fact[j]))
    _MADE["steps"] = out
    return out


def _carry(cells: np.ndarray, blocks: np.ndarray, wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Carry the blocks [source power, other axis] of one line of cells to the cells within reach."""
    steps = _step_matrices()
    around = np.unique((cells[:, None] + np.arange(-REACH, REACH + 1)[None, :]).ravel())
    targets = around if wanted is None else np.intersect1d(around, wanted)
    out = np.zeros((len(targets), TERMS, blocks.shape[2]))
    for step in range(-REACH, REACH + 1):
        source = np.minimum(np.searchsorted(cells, targets - step), len(cells) - 1)
        hit = cells[source] == targets - step
        if hit.any():
            out[hit] += steps[step + REACH] @ blocks[source[hit]]
    return targets, out


CELL = ["name", "cu", "cv"]
#: A cell's powers of both offsets, [u, v], as the bytes of TERMS x TERMS numbers.
_BLOCKS = T.StructType([T.StructField("name", T.StringType()), *[T.StructField(c, T.LongType()) for c in CELL[1:]], T.StructField("block", T.BinaryType())])
SLICE = 2048  # samples whose powers are formed together


def _stacked(blocks: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(blocks), float).reshape(-1, TERMS, TERMS)


def _summed(rows: pd.DataFrame, blocks: np.ndarray) -> pd.DataFrame:
    """One row per cell of ``rows`` with the sum of its blocks."""
    code = rows.groupby(CELL, sort=False).ngroup().to_numpy()
    order = np.argsort(code, kind="stable")
    starts = np.flatnonzero(np.diff(code[order], prepend=-1))
    sums = np.add.reduceat(blocks[order], starts, axis=0)
    return rows[CELL].iloc[order[starts]].assign(block=[b.tobytes() for b in sums])


def _power_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of du**a * dv**b over the samples of each cell, a slice of samples at a time."""
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            part = batch.iloc[at : at + SLICE]
            u, v = (np.vander(part[c].to_numpy(), TERMS, increasing=True) for c in ("du", "dv"))
            yield _summed(part, u[:, :, None] * v[:, None, :])


def _add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sum neighbouring rows of one cell; the last cell of a batch waits for the next one."""
    open_cell = None
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            part = batch.iloc[at : at + SLICE]
            if open_cell is not None:
                part = pd.concat([open_cell, part])
            sums = _summed(part, _stacked(part["block"]))
            open_cell = sums.iloc[-1:]
            yield sums.iloc[:-1]
    if open_cell is not None:
        yield open_cell


def _along_u(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("cu")
    targets, moved = _carry(rows["cu"].to_numpy(), _stacked(rows["block"]), None)
    return pd.DataFrame({"name": rows["name"].iat[0], "cu": targets, "cv": rows["cv"].iat[0], "block": [m.tobytes() for m in moved]})


def _along_v(rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
    nothing = pd.DataFrame({c: pd.Series([], dtype=object) for c in _BLOCKS.names})
    if rows.empty or wanted.empty:
        return nothing
    rows = rows.sort_values("cv")
    # Blocks are [u power, v power]; carry the v axis.
    targets, moved = _carry(rows["cv"].to_numpy(), _stacked(rows["block"]).transpose(0, 2, 1), wanted["cv"].to_numpy())
    if not len(targets):
        return nothing
    blocks = [np.ascontiguousarray(m.T).tobytes() for m in moved]
    return pd.DataFrame({"name": rows["name"].iat[0], "cu": rows["cu"].iat[0], "cv": targets, "block": blocks})


def _packed(points: DataFrame, kept: list[T.StructField]) -> DataFrame:
    """Points of one cell side by side in one row, as far as they come in one batch: a cell of any size is many short rows."""
    inner = [f.name for f in kept] + ["du", "dv"]
    fields = [*kept, *[T.StructField(c, T.DoubleType()) for c in ("du", "dv")]]
    schema = T.StructType([
        *_BLOCKS.fields[:3], T.StructField("peak", T.DoubleType()), T.StructField("n", T.LongType()), T.StructField("points", T.ArrayType(T.StructType(fields))),
    ])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code = batch.select(CELL).to_pandas().groupby(CELL, sort=False).ngroup().to_numpy()
            order = np.argsort(code, kind="stable")
            starts = np.flatnonzero(np.diff(code[order], prepend=-1))
            heads = batch.take(pa.array(order[starts]))
            inside = batch.select(inner).take(pa.array(order)).to_struct_array()
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)), pa.int32()), inside)
            yield pa.RecordBatch.from_arrays([*[heads.column(c) for c in (*CELL, "peak", "n")], lists], schema.names)

    return points.select(*CELL, "peak", "n", *[c for c in inner if c not in CELL]).mapInArrow(pack, schema)


def _read_cells(slices: DataFrame, kept: list[T.StructField]) -> DataFrame:
    """Value of the cell's polynomial at each point; 0 where no sample is within reach."""
    schema = T.StructType([*kept, *[T.StructField(c, T.DoubleType()) for c in ("density", "relative")]])
    names = [f.name for f in kept]

    def joined(done: list[tuple]) -> pa.RecordBatch:
        inside, value, relative = (list(c) for c in zip(*done))
        columns = [pa.concat_arrays([points.field(c) for points in inside]) for c in names]
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(value)), pa.array(np.concatenate(relative))], schema.names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, size = [], 0
            for points, block, peak, n in zip(batch.column("points"), batch.column("block"), batch.column("peak").to_pylist(), batch.column("n").to_pylist()):
                inside = points.values
                value = np.zeros(len(inside))
                if block.is_valid:
                    u, v = (np.vander(np.asarray(inside.field(c)), TERMS, increasing=True) for c in ("du", "dv"))
                    value = np.maximum(((u @ np.frombuffer(block.as_py(), float).reshape(TERMS, TERMS)) * v).sum(1), 0.0)
                done.append((inside, value * peak, value / n))
                size += len(inside)
                if size > 16 * SLICE:
                    yield joined(done)
                    done, size = [], 0
            if done:
                yield joined(done)

    return slices.mapInArrow(read, schema)


def _cell_density(samples: DataFrame, targets: DataFrame, kernel: DataFrame) -> DataFrame:
    """Density of ``samples`` at ``targets``, both joined to their kernel by name.

    A batch of samples sends one block per cell, a cell has one polynomial, and the points that read it come as short lists.
    """
    placed = _round_coordinates(samples.select("name", "x", "y"), kernel)
    sums = placed.select(*CELL, "du", "dv").mapInPandas(_power_sums, _BLOCKS)
    cells = sums.repartition(*CELL).sortWithinPartitions(*CELL).mapInPandas(_add_up, _BLOCKS)
    kept = targets.schema.fields
    slices = _packed(_round_coordinates(targets, kernel), kept)
    wanted = slices.select(*CELL).distinct()
    # A line holds the occupied cells of one row of cells, not samples.
    rows = cells.groupBy("name", "cv").applyInPandas(_along_u, _BLOCKS)
    rows = rows.join(wanted.select("name", "cu").distinct(), ["name", "cu"], "left_semi")
    polynomials = rows.groupBy("name", "cu").cogroup(wanted.groupBy("name", "cu")).applyInPandas(_along_v, _BLOCKS)
    return _read_cells(slices.join(polynomials, CELL, "left").select("points", "block", "peak", "n"), kept)


# --- operators -----------------------------------------------------------------------------------------


def kde_points(samples: DataFrame, method: str = "cells") -> DataFrame:
    """Density of each place's samples at the samples themselves.

    ``relative`` is its share of the density all samples would have on one point.
    """
    kernel = kernels(samples)
    rows = samples.select("run_id", "name", "x", "y")
    if method == "cells":
        return _cell_density(rows, rows, kernel)
    schema = T.StructType(rows.schema.fields + [T.StructField(c, T.DoubleType()) for c in ("density", "relative")])

    def direct(group: pd.DataFrame) -> pd.DataFrame:
        density = _direct(group, group["x"].to_numpy(), group["y"].to_numpy())
        return group[["run_id", "name", "x", "y"]].assign(density=density, relative=density / (group["peak"] * group["n"]))

    return rows.join(kernel, "name").groupBy("name").applyInPandas(direct, schema)


def grid(places: DataFrame, nx=DENSITY_GRID[0], ny=DENSITY_GRID[1], width=CANVAS_WIDTH, height=CANVAS_HEIGHT):
    """The evaluation grid of every place, borders included; ``cell`` counts y first."""
    cells = places.select("name", F.explode(F.sequence(F.lit(0), F.lit(nx * ny - 1))).alias("cell"))
    gx, gy = _grid_columns(nx, ny, float(width), float(height))
    return cells.select("name", "cell", gx.alias("x"), gy.alias("y"))


def kde_grid(
    samples: DataFrame, nx: int = DENSITY_GRID[0], ny: int = DENSITY_GRID[1],
    width: float = CANVAS_WIDTH, height: float = CANVAS_HEIGHT, method: str = "cells",
) -> DataFrame:
    """Density of each place's samples on a regular grid over the canvas."""
    kernel = kernels(samples)
    rows = samples.select("name", "x", "y")
    if method == "cells":
        return _cell_density(rows, grid(kernel, nx, ny, width, height), kernel)

    def direct(group: pd.DataFrame) -> pd.DataFrame:
        cell = np.arange(nx * ny, dtype=np.int32)
        xs, ys = cell // ny * (width / (nx - 1)), cell % ny * (height / (ny - 1))
        density = _direct(group, xs, ys)
        relative = density / (group["peak"].iat[0] * group["n"].iat[0])
        return pd.DataFrame({
            "name": group["name"].iat[0], "cell": cell, "x": xs, "y": ys, "density": density, "relative": relative,
        })

    schema = "name string, cell int, x double, y double, density double, relative double"
    return rows.join(kernel, "name").groupBy("name").applyInPandas(direct, schema)


def positive_density(densities: DataFrame, floor: float = FLOOR) -> DataFrame:
    """Rows whose density is above ``floor`` times what its place's samples would have on one point.

    A kernel is nowhere zero; the floor says where it counts as zero, for any number of samples and either method.
    """
    return densities.filter(F.col("relative") > floor)


def density_range(densities: DataFrame) -> DataFrame:
    """Smallest and largest density over all places; (0, 1) when there is none."""
    return densities.agg(
        F.coalesce(F.min("density"), F.lit(0.0)).alias("min_density"),
        F.coalesce(F.max("density"), F.lit(1.0)).alias("max_density"),
    )
