"""Map algebra on long rasters (row, col, band columns), vector to raster and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import Grid
from ..functions import geometry as G

NDVI_NODATA, NDVI_LEAST = -999.0, 0.2


def ndvi(nir: Column, red: Column) -> Column:
    """-999 where the sum is 0 or the index is under 0.2."""
    value = (nir - red) / (nir + red)
    return F.when(nir + red == 0, NDVI_NODATA).when(value < NDVI_LEAST, NDVI_NODATA).otherwise(value)


def vegetation_class(value: Column) -> Column:
    """The integer that a vectorised index has: 0 for vegetation below 1."""
    return value.cast("int")


def rgb_pack(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r.cast("int"), 16) + F.shiftleft(g.cast("int"), 8) + b.cast("int")


def rgb_unpack(packed: Column) -> tuple[Column, Column, Column]:
    low = F.lit(255)
    return F.shiftright(packed, 16).bitwiseAND(low), F.shiftright(packed, 8).bitwiseAND(low), packed.bitwiseAND(low)


def hex_rgb(colour: Column) -> tuple[Column, Column, Column]:
    digits = F.ltrim(colour, F.lit("#"))
    return tuple(F.conv(F.substring(digits, i, 2), 16, 10).cast("int") for i in (1, 3, 5))


def _bad(x: Column, nodata: float) -> Column:
    return x.isNull() | F.isnan(x) | (x == nodata)


def fill_from_dem(surface: DataFrame, nodata: float = -9999.0) -> DataFrame:
    """Columns dsm and dem: dsm without value, or 0, takes a valid dem."""
    bad = _bad(F.col("dsm"), nodata) | (F.col("dsm") == 0)
    return surface.withColumn("filled", F.when(bad & ~_bad(F.col("dem"), nodata), F.col("dem")).otherwise(F.col("dsm")))


def nan_to_nodata(raster: DataFrame, nodata: float = -9999.0) -> DataFrame:
    kinds = dict(raster.dtypes)
    return raster.select(*[F.when(F.col(c).isNull() | F.isnan(c), nodata).otherwise(F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in raster.columns])


def burn_buildings(dsm: DataFrame, mask: DataFrame) -> DataFrame:
    """dsm + height where a mask cell (row, col, height) is; of several the highest."""
    top = mask.groupBy("row", "col").agg(F.max("height").alias("height"))
    return dsm.join(top, ["row", "col"], "left").withColumn("dsm", F.col("dsm") + F.coalesce("height", F.lit(0.0))).drop("height")


KERNELS = {"gaussian": lambda r: F.exp(-2 * r * r), "cone": lambda r: 1 - r, "paraboloid": lambda r: 1 - r * r}


def burn_trees(cdsm: DataFrame, trees: DataFrame, grid: Grid, kernel: str = "gaussian", nodata: float = 0.0) -> DataFrame:
    """Crowns (x, y, height, diameter) into a raster (row, col, cdsm) by the greatest; a kernel of 0.1 or less leaves no crown."""
    t = trees.withColumns({"r": F.col("diameter") / 2, "cx": F.floor((F.col("x") - grid.x_min) / grid.res), "cy": F.floor((grid.y_max - F.col("y")) / grid.res)})
    span = F.ceil(F.col("r") / grid.res)
    t = t.withColumn("di", F.explode(F.sequence(-span, span))).withColumn("dj", F.explode(F.sequence(-span, span)))
    q = F.sqrt(F.col("di") * F.col("di") + F.col("dj") * F.col("dj")) * grid.res / F.col("r")
    t = t.withColumn("k", F.when(q <= 1, KERNELS[kernel](q)).otherwise(0.0)).where("k > 0.1")
    crowns = t.select((F.col("cy") + F.col("di")).cast("int").alias("row"), (F.col("cx") + F.col("dj")).cast("int").alias("col"), (F.col("height") * F.col("k")).alias("crown"))
    crowns = crowns.groupBy("row", "col").agg(F.max("crown").alias("crown"))
    return cdsm.join(crowns, ["row", "col"], "left").withColumn("cdsm", F.greatest(F.coalesce("cdsm", F.lit(nodata)), F.coalesce("crown", F.lit(nodata)))).drop("crown")


def override(base: DataFrame, *layers: DataFrame) -> DataFrame:
    """Land cover (row, col, value): later layers win."""
    out = base.withColumnRenamed("value", "v0")
    for i, layer in enumerate(layers, 1):
        out = out.join(layer.groupBy("row", "col").agg(F.max("value").alias(f"v{i}")), ["row", "col"], "left")
    return out.select("row", "col", F.coalesce(*[F.col(f"v{i}") for i in range(len(layers), -1, -1)]).alias("value"))


def rasterize(shapes: DataFrame, grid: Grid, fill: int = 0) -> DataFrame:
    """row, col, value: cells whose centre lies in a shape (ring, value, ord); the last shape wins.

    A shape is handed only to the cells of its envelope; an aggregate picks the winner.
    """
    e = G.envelope(F.col("ring"))
    lim = lambda c, top: F.greatest(F.least(c, F.lit(top - 1)), F.lit(0)).cast("int")
    spans = shapes.withColumn("e", e).withColumn("row", F.explode(F.sequence(lim(grid.row_of(F.col("e.max_y")), grid.height), lim(grid.row_of(F.col("e.min_y")), grid.height))))
    spans = spans.withColumn("col", F.explode(F.sequence(lim(grid.col_of(F.col("e.min_x")), grid.width), lim(grid.col_of(F.col("e.max_x")), grid.width))))
    inside = spans.where(G.contains(F.col("ring"), grid.x_of(F.col("col"), 0.5), grid.y_of(F.col("row"), 0.5)))
    won = inside.groupBy("row", "col").agg(F.max_by("value", "ord").alias("value"))
    return grid.cells(shapes.sparkSession).join(won, ["row", "col"], "left").withColumn("value", F.coalesce("value", F.lit(fill)).cast("int"))


def components(cells: DataFrame, grid: Grid, checkpoint: bool = True) -> DataFrame:
    """row, col, value, label: 4-connected cells of one value share their least flat index.

    Runs of equal values along rows are found by windows first, so that a round works on runs, not cells; then
    every run takes the least label of the runs it touches, and labels are followed to their labels, until none
    changes. Rounds are cut by checkpoints in the shared folder.
    """
    from pyspark.sql import Window

    along = Window.partitionBy("row").orderBy("col")
    fresh = ~F.lag("value").over(along).eqNullSafe(F.col("value")) | (F.lag("col").over(along) != F.col("col") - 1)
    marked = cells.select("row", "col", "value").withColumn("fresh", F.coalesce(fresh, F.lit(True)).cast("int"))
    runs = marked.withColumn("run", F.sum("fresh").over(along)).groupBy("row", "run", "value").agg(F.min("col").alias("a"), F.max("col").alias("b"))
    runs = runs.withColumn("id", F.col("row").cast("long") * grid.width + F.col("a"))
    below = runs.select((F.col("row") - 1).alias("row"), "value", F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("id").alias("id2"))
    cells_of = runs.select("row", "value", "a", "b", "id").join(below, ["row", "value"]).where("a <= b2 and a2 <= b")
    links = cells_of.select(F.col("id").alias("p"), F.col("id2").alias("q"))
    links = links.union(links.select("q", "p"))
    labels = runs.select("id", F.col("id").alias("label"))
    if checkpoint:
        links, labels = links.checkpoint(), labels.checkpoint()
    while True:
        offered = links.join(labels.select(F.col("id").alias("q"), "label"), "q").groupBy("p").agg(F.min("label").alias("offer"))
        near = labels.join(offered, labels["id"] == offered["p"], "left").select("id", F.least("label", F.coalesce("offer", "label")).alias("near"), F.col("label").alias("was"))
        up = near.select(F.col("id").alias("near"), F.col("near").alias("up"))
        new = near.join(up, "near").select("id", F.least("near", "up").alias("label"), "was")
        new = new.checkpoint() if checkpoint else new
        labels = new.select("id", "label")
        if new.where("label <> was").isEmpty():
            break
    out = runs.join(labels, "id").withColumn("col", F.explode(F.sequence("a", "b")))
    return out.select("row", F.col("col").cast("int").alias("col"), "value", "label")


def distinct_classes(raster: DataFrame, band: str = "value") -> DataFrame:
    """The band's values, each once; cells without one don't count."""
    return raster.where(F.col(band).isNotNull()).select(band).distinct()


def component_areas(labelled: DataFrame, cell_area: float = 1.0) -> DataFrame:
    return labelled.groupBy("label", "value").agg((F.count("*") * cell_area).alias("area"))


def bilinear(source: DataFrame, at: DataFrame, grid: Grid, band: str = "value") -> DataFrame:
    """Points (id, x, y) with the band between the four cell centres around; null where one of them is missing."""
    fx, fy = (F.col("x") - grid.x_min) / grid.res - 0.5, (F.lit(grid.y_max) - F.col("y")) / grid.res - 0.5
    p = at.withColumns({"c0": F.floor(fx), "r0": F.floor(fy), "tx": fx - F.floor(fx), "ty": fy - F.floor(fy)})
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    p = p.withColumn("o", corner).withColumns({"row": (F.col("r0") + F.col("o.i")).cast("int"), "col": (F.col("c0") + F.col("o.j")).cast("int")})
    weight = F.when(F.col("o.j") == 1, F.col("tx")).otherwise(1 - F.col("tx")) * F.when(F.col("o.i") == 1, F.col("ty")).otherwise(1 - F.col("ty"))
    rows = p.join(source.select("row", "col", F.col(band).alias("v")), ["row", "col"], "left").withColumn("part", F.when(weight == 0, 0.0).otherwise(weight * F.col("v")))
    return rows.groupBy("id").agg(F.when(F.count("part") == 4, F.sum("part")).alias(band))


def percentile_stretch(raster: DataFrame, band: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Band to 0..1 between two percentiles, clamped; one row of limits is joined. Where both are one value, what reaches it is 1 and all else 0, as in a limit from above."""
    lim = raster.agg(F.percentile(band, F.array(F.lit(low), F.lit(high))).alias("lim"))
    lo, hi = F.col("lim")[0], F.col("lim")[1]
    value = F.when(hi > lo, (F.col(band) - lo) / (hi - lo)).when(F.col(band) >= lo, 1.0).otherwise(0.0)
    return raster.crossJoin(F.broadcast(lim)).withColumn("stretched", F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))).drop("lim")


def raster_size(width: float, height: float, res: float) -> tuple[int, int]:
    w, h = int(width / res), int(height / res)
    if w <= 0 or h <= 0:
        raise ValueError("the raster would be empty")
    return w, h


def dem_mask(box: DataFrame, factor: float = 0.85) -> DataFrame:
    """Boxes (min_x ... max_y) shrunk about their centre."""
    cx, cy = (F.col("min_x") + F.col("max_x")) / 2, (F.col("min_y") + F.col("max_y")) / 2
    hx, hy = (F.col("max_x") - F.col("min_x")) / 2 * factor, (F.col("max_y") - F.col("min_y")) / 2 * factor
    return box.withColumns({"min_x": cx - hx, "min_y": cy - hy, "max_x": cx + hx, "max_y": cy + hy})


def wms_size(box: DataFrame, cap: int = 5010, res: float = 1.0) -> DataFrame:
    """width_px, height_px of a request for a box in degrees: metres by latitude, both sides capped alike."""
    lat = F.radians((F.col("min_y") + F.col("max_y")) / 2)
    w = F.floor((F.col("max_x") - F.col("min_x")) * (40075000.0 * F.cos(lat) / 360.0) / res).cast("double")
    h = F.floor((F.col("max_y") - F.col("min_y")) * 111320.0 / res).cast("double")
    scale = F.greatest(w / cap, h / cap)
    fit = lambda v: F.when(scale > 1, F.greatest(F.floor(v / scale), F.lit(1))).otherwise(v).cast("int")
    return box.withColumns({"width_px": fit(w), "height_px": fit(h)})


def class_histogram(cells: DataFrame, value: str = "value") -> DataFrame:
    """value, n: how many cells each class has; cells without one count as a class of their own."""
    return cells.groupBy(value).agg(F.count("*").alias("n"))


def filled_share(before: Column, after: Column, nodata: float = -9999.0) -> tuple[Column, Column]:
    """Aggregates: how many cells without a value got one, and their share of all."""
    gained = F.count_if(_bad(before, nodata) & ~_bad(after, nodata))
    return gained, gained / F.count("*")


def canopy_band(raster: DataFrame, bands: list[str], nodata: float = -9999.0) -> Column:
    """The third of at least three bands, else the first; nodata is null."""
    band = F.col(bands[2] if len(bands) > 2 else bands[0])
    return F.when(~_bad(band, nodata), band)


def class_colour(cells: DataFrame, colours: DataFrame, key: str, default: str) -> DataFrame:
    """Cells with the colour of their class from a small table (key, colour); unknown classes have the default."""
    return cells.join(F.broadcast(colours.select(key, "colour")), key, "left").withColumn("colour", F.coalesce("colour", F.lit(default)))


def domain_square(box: DataFrame, half: float | None = None) -> DataFrame:
    """Boxes (min_x ... max_y) as they are, or the square of a half side about their centres."""
    if half is None:
        return box
    cx, cy = (F.col("min_x") + F.col("max_x")) / 2, (F.col("min_y") + F.col("max_y")) / 2
    return box.withColumns({"min_x": cx - half, "min_y": cy - half, "max_x": cx + half, "max_y": cy + half})
