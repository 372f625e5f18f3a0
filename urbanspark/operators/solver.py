"""Mass-consistent wind in three dimensions: an iterative stencil, so a NumPy block per wind direction."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "dir double, col int, row int, k int, u double, v double, w double, solid boolean"
#: Voxels of a direction that one task solves.
MOST_VOXELS = 6_000_000


def initial_field(cells: DataFrame, dz: float = 5.0, top: float = 100.0) -> DataFrame:
    """Voxels of cells (dir, row, col, speed_u, speed_v, dem, dsm): solid where the level's centre is under the surface."""
    levels = max(int(np.ceil(top / dz)), 2)
    rows = cells.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    z = F.col("dem") + (F.col("k") + 0.5) * dz
    solid = z < F.col("dsm") + 0.01
    still = lambda c: F.when(solid, 0.0).otherwise(F.col(c))
    return rows.select("dir", "col", "row", "k", still("speed_u").alias("u"), still("speed_v").alias("v"), F.lit(0.0).alias("w"), solid.alias("solid"))


def solve_block(
    u: np.ndarray, v: np.ndarray, w: np.ndarray, solid: np.ndarray, dx: float, dy: float, dz: float, eps: float = 1e-4, rounds: int = 5000, form: str = "reference", alpha1: float = 1.0, alpha2: float = 1.0
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Red-black relaxation for the multiplier (0 on the border), then the velocity's correction.

    form "reference" divides rhs plus the neighbours' sum by the negative diagonal, as the published results do, and
    puts a cell's own value in a solid neighbour's place; "poisson" takes the neighbours' sum off and leaves solid
    neighbours out, which solves the stated equation. A sweep that diverges is given up, and the one before it counts.
    """
    a1, a2 = max(alpha1, 1e-10), max(alpha2, 1e-10)
    lam = np.zeros_like(u)
    if min(u.shape) > 2:
        c = (slice(1, -1),) * 3
        shift = lambda a, ax, s: a[tuple(slice(1 + s, a.shape[i] - 1 + s) if i == ax else slice(1, -1) for i in range(3))]
        rhs = -2.0 * a1 * a1 * ((shift(u, 0, 1) - shift(u, 0, -1)) / (2 * dx) + (shift(v, 1, 1) - shift(v, 1, -1)) / (2 * dy) + (shift(w, 2, 1) - shift(w, 2, -1)) / (2 * dz))
        weights = [(ax, s, 1 / h**2) for ax, h in ((0, dx), (1, dy), (2, dz)) for s in (1, -1)]
        open_to = [(ax, s, q * ~shift(solid, ax, s)) for ax, s, q in weights]
        walls = sum(q * shift(solid, ax, s) for ax, s, q in weights)
        as_stated = form == "poisson"
        diag = -sum(q for _, _, q in (open_to if as_stated else weights)) * np.ones_like(rhs)
        active = ~solid[c] & (diag < 0)
        colour = np.indices(u.shape).sum(axis=0)[c] % 2
        for _ in range(rounds):
            most, swept = 0.0, lam.copy()
            for part in (0, 1):
                total = sum(q * shift(swept, ax, s) for ax, s, q in open_to)
                total = rhs - total if as_stated else rhs + total + walls * swept[c]
                new = np.where(active & (colour == part), total / np.where(diag < 0, diag, 1.0), swept[c])
                most = max(most, float(np.abs(new - swept[c]).max()))
                swept[c] = new
            if not np.isfinite(most) or most > 1e30:
                break
            lam = swept
            if most < eps:
                break
    gradient = np.gradient(lam, dx, dy, dz) if min(lam.shape) > 1 else [np.zeros_like(lam)] * 3
    halves = (1 / (2 * a1 * a1), 1 / (2 * a1 * a1), 1 / (2 * a2 * a2))
    return tuple(np.where(solid, 0.0, f + half * g) for f, g, half in zip((u, v, w), gradient, halves, strict=True))


def mass_consistent(voxels: DataFrame, dx: float, dy: float, dz: float, eps: float = 1e-4, rounds: int = 5000, form: str = "reference", alpha1: float = 1.0, alpha2: float = 1.0) -> DataFrame:
    """Voxels (dir, col, row, k, u, v, w, solid) with balanced velocities; one group per direction, a whole block in memory, of MOST_VOXELS at most."""

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["col", "row", "k"])
        if len(pdf) > MOST_VOXELS:
            raise ValueError(f"a direction has {len(pdf)} voxels, over {MOST_VOXELS}: solve a smaller domain or coarser cells")
        shape = tuple(int(pdf[c].max()) + 1 for c in ("col", "row", "k"))
        cube = lambda c, t: pdf[c].to_numpy(t).reshape(shape)
        u, v, w = solve_block(*(cube(c, float) for c in "uvw"), cube("solid", bool), dx, dy, dz, eps, rounds, form, alpha1, alpha2)
        return pdf.assign(u=u.ravel(), v=v.ravel(), w=w.ravel())

    return voxels.select("dir", F.col("col").cast("int"), F.col("row").cast("int"), F.col("k").cast("int"), "u", "v", "w", "solid").groupBy("dir").applyInPandas(block, SCHEMA)


def slice_at(voxels: DataFrame, ground: DataFrame, height: float, dz: float, wind_dir: float, nodata: float = -9999.0) -> DataFrame:
    """row, col, speed, direction at a height over ground: linear between levels; nodata where a building stands higher."""
    at = height / dz - 0.5
    top = voxels.agg(F.max("k").alias("top"))
    k0 = F.greatest(F.least(F.lit(int(np.floor(at))), F.col("top") - 1), F.lit(0))
    rows = voxels.crossJoin(F.broadcast(top)).withColumn("k0", k0)
    share = F.greatest(F.least(F.lit(at) - F.col("k0"), F.lit(1.0)), F.lit(0.0))
    part = F.when(F.col("k") == F.col("k0"), 1 - share).when(F.col("k") == F.col("k0") + 1, share)
    both = rows.where(part.isNotNull()).groupBy("dir", "row", "col").agg(F.sum(F.col("u") * part).alias("u"), F.sum(F.col("v") * part).alias("v"))
    both = both.join(ground.select("row", "col", "building_height"), ["row", "col"])
    speed = F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v"))
    angle = F.when(speed < 1e-9, wind_dir).otherwise(F.pmod(F.degrees(F.atan2("u", "v")) + 180.0, F.lit(360.0)))
    covered = F.col("building_height") > height
    return both.select("dir", "row", "col", F.when(covered, nodata).otherwise(speed).alias("speed"), F.when(covered, nodata).otherwise(angle).alias("direction"))
