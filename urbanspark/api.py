"""Layers with one protocol: construct, set_bbox, set_crs, run, then read the result as a DataFrame.

``request_url`` says what a layer's data would be asked for with. ``run`` reads files that hold the answers, or an address
with open places ({min_x} ... {max_y} of a service, {tx}, {ty} of a folder) in tiles. Setters return the layer, and keep
what the others set.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dims
from .core import CC46, LAMBERT93, WGS84, BBox, Context, Grid
from .functions import crs
from .functions import geometry as G
from .functions import wind as W
from .operators import biotope, buildings, features, mapalgebra, points, polygons, solver, trees, wind
from .sources import files, geotiff, las, requests, tiles, vector


class Layer:
    """A layer of features or of a raster."""

    service = "WFS"
    key = ""

    def __init__(self, spark: SparkSession, *paths: str, context: Context | None = None) -> None:
        self.spark, self.paths, self.context = spark, paths, context or Context()
        self.result: DataFrame | None = None

    def set_bbox(self, *sides: float):
        self.context = self.context.with_bbox(*sides)
        return self

    def set_crs(self, epsg: int):
        self.context = self.context.with_crs(epsg)
        return self

    def request_url(self, base: str = "https://data.geopf.fr/wfs/ows") -> str:
        box = self._box()
        return requests.wfs_url(base, self.key, box) if self.service == "WFS" else requests.wms_url(self.key, box, self.key)

    def _box(self) -> BBox:
        if self.context.bbox is None:
            raise ValueError("set_bbox first")
        return self.context.bbox

    def load(self) -> DataFrame:
        raise NotImplementedError

    def run(self):
        self.result = self.load()
        return self

    def df(self) -> DataFrame:
        if self.result is None:
            raise ValueError("run first")
        return self.result


class VectorLayer(Layer):
    """Features as they are: id, properties (JSON text), kind, coordinates (JSON text), srid 4326; the box filters by envelope.

    An address with {min_x} ... {max_y} (a service, see ``tiles.service_url``) or {tx}, {ty} (a folder) is read in tiles of ``tile`` degrees that meet the context's box.
    """

    tile = 0.05

    def load(self) -> DataFrame:
        if "{" in self.paths[0]:
            if self.context.bbox is None:
                raise ValueError("a tiled layer wants the context's box")
            layer = tiles.within(tiles.read_tiles(self.spark, self.paths[0], self.context.bbox, self.tile), self.context.bbox)
            return layer.select("id", "properties", "kind", "coordinates", F.lit(WGS84).alias("srid"))
        rows = files.read_geojson(self.spark, *self.paths).withColumn("srid", F.lit(WGS84))
        if self.context.bbox is None:
            return rows
        b = self.context.bbox
        numbers = F.transform(F.regexp_extract_all("coordinates", F.lit(r"(\[\s*-?[\d.eE+-]+\s*,\s*-?[\d.eE+-]+)"), F.lit(1)), lambda p: F.split(F.regexp_replace(p, r"[\[\s]", ""), ","))
        ring = F.transform(numbers, lambda p: G.point(p[0].cast("double"), p[1].cast("double")))
        box = F.struct(*[F.lit(float(v)).alias(n) for n, v in (("min_x", b.min_x), ("min_y", b.min_y), ("max_x", b.max_x), ("max_y", b.max_y))])
        return rows.withColumn("__e", G.envelope(ring)).where(G.boxes_overlap(F.col("__e"), box)).drop("__e")


class Cadastre(VectorLayer):
    key = "cadastre"

    def stats(self) -> DataFrame:
        surface = F.get_json_object("properties", "$.contenance").try_cast("double")
        return self.df().agg(F.count("*").alias("count"), F.coalesce(F.sum(surface), F.lit(0.0)).alias("contenance"))


class Iris(VectorLayer):
    key = "iris"


class Road(VectorLayer):
    key = "road"


class Water(VectorLayer):
    key = "water"


class Rnb(Layer):
    key = "rnb"

    def load(self) -> DataFrame:
        return features.rnb_points(self.spark.read.text(list(self.paths), wholetext=True))


class Lcz(Layer):
    """Climate zones from a zipped or plain shapefile, with label and colour."""

    key = "lcz"

    def load(self) -> DataFrame:
        read = vector.read_zipped_shapefile if self.paths[0].endswith(".zip") else vector.read_shapefile
        rows = vector.lcz_rows(read(self.spark, self.paths[0]), "lcz_int").withColumn("ring", F.try_element_at("parts", F.lit(1)))
        zones = dims.lookup(self.spark, dims.LCZ, "lcz_int", "label", "color").drop("ord")
        return rows.join(F.broadcast(zones), "lcz_int", "left").withColumn("color", F.coalesce("color", F.lit(dims.LCZ_DEFAULT_COLOUR)))


class Building(Layer):
    """Footprints with heights filled; rings are in the context's system."""

    key = "buildings"

    def __init__(self, spark: SparkSession, *paths: str, context: Context | None = None, storey: float = buildings.STOREY, srid: int = WGS84) -> None:
        super().__init__(spark, *paths, context=context)
        self.storey, self.srid = max(storey, 0.1), srid

    def load(self) -> DataFrame:
        if "{" in self.paths[0]:
            layer = tiles.read_tiles(self.spark, self.paths[0], self._box(), VectorLayer.tile)
            rows = features.buildings_of(tiles.within(layer, self._box()).withColumn("id", F.monotonically_increasing_id()))
        else:
            rows = features.buildings_from_geojson(self.spark.read.text(list(self.paths), wholetext=True))
        rows = rows.withColumn("ring", crs.transform_ring(F.col("ring"), self.srid, self.context.epsg)).withColumn("srid", F.lit(self.context.epsg))
        return buildings.process_heights(buildings.with_shape(rows), self.storey)

    def stats(self) -> DataFrame:
        return buildings.stats(self.df())

    def to_geojson(self) -> DataFrame:
        return files.collection(self.df())

    def geometry(self) -> DataFrame:
        return self.df().select("id", *buildings.export_frame(self.df()).columns, files.ewkb(F.col("ring"), self.context.epsg).alias("geometry"))


class RasterLayer(Layer):
    """Cells of files, or of tiles (of ``tile`` units, ``res`` a pixel) where the address has {min_x} ... or {tx}, {ty}."""

    service = "WMS"
    tile, res = 1000.0, 1.0

    def load(self) -> DataFrame:
        if "{" in self.paths[0]:
            box = self._box()
            return tiles.within(tiles.read_tiles(self.spark, self.paths[0], box, self.tile, "raster", res=self.res), box, "raster").drop("tx", "ty")
        return geotiff.read_geotiff(self.spark, *self.paths)


class Dem(RasterLayer):
    key = "dem"

    def mask(self) -> BBox:
        """The projected box's inner rectangle."""
        return self._box().scaled(0.85)

    def write_mask(self, folder: str, name: str = "mask") -> int:
        """The mask as a shapefile in a folder that executors share."""
        m = self.mask()
        row = self.spark.range(1).select(F.lit(name).alias("name"), G.rectangle(*[F.lit(v) for v in (m.min_x, m.min_y, m.max_x, m.max_y)]).alias("ring"))
        return files.write_files(vector.shapefiles(row, "name"), folder)

    def stats(self) -> DataFrame:
        v = F.col("bands")[0]
        return self.df().agg(F.count(v).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"))


class Cosia(RasterLayer):
    key = "cosia"


class Mnt(RasterLayer):
    key = "mnt"


class Mns(RasterLayer):
    key = "mns"


class Mnh(RasterLayer):
    key = "mnh"


class Vegetation(RasterLayer):
    """Vegetation areas from infrared and red bands: components of the index's integer 0 over a least area."""

    key = "irc"

    def __init__(self, spark: SparkSession, *paths: str, grid: Grid, min_area: float = 0.0, context: Context | None = None) -> None:
        super().__init__(spark, *paths, context=context)
        self.grid, self.min_area = grid, min_area

    def load(self) -> DataFrame:
        cells = super().load().select("row", "col", mapalgebra.vegetation_class(mapalgebra.ndvi(F.col("bands")[0], F.col("bands")[1])).alias("value"))
        areas = mapalgebra.component_areas(mapalgebra.components(cells, self.grid), self.grid.res**2)
        return areas.where((F.col("value") == 0) & (F.col("area") > self.min_area))


class Lidar(Layer):
    """Rasters of a point cloud: row, col, dsm, dtm, chm; the box is in the cloud's system."""

    key = "lidar"

    def __init__(self, spark: SparkSession, *paths: str, classes: list[int] | None = None, resolution: float = 1.0, fill: str = "neighbor3x3", context: Context | None = None) -> None:
        super().__init__(spark, *paths, context=context)
        self.classes, self.resolution, self.fill = classes, resolution, fill

    def points(self) -> DataFrame:
        """Points of the cloud; of the box where there is one, which leaves files and points beside it unread."""
        if any("viewfs:" in p or "*" in p for p in self.paths):
            return las.read_las(self.spark, *self.paths)
        cloud, b = las.scan_las(self.spark, *self.paths), self.context.bbox
        return cloud if b is None else cloud.where(f"x >= {b.min_x!r}D and x <= {b.max_x!r}D and y >= {b.min_y!r}D and y <= {b.max_y!r}D")

    def load(self) -> DataFrame:
        return points.rasters(self.points(), self._box(), self.classes, self.resolution, self.fill)

    def trees(self, min_height: float = 2.0) -> DataFrame:
        """Crowns of the canopy; of a cloud for which no classes are named, ground and vegetation count."""
        cells = self.df() if self.classes is not None else points.rasters(self.points(), self._box(), list(trees.CANOPY_CLASSES), self.resolution, self.fill)
        return trees.crowns(cells, Grid.over(self._box(), self.resolution), min_height)

    def to_geotiff(self) -> bytes:
        return geotiff.write_geotiff(self.df(), Grid.over(self._box(), self.resolution), "dsm", "dtm", "chm")


@dataclass(frozen=True)
class WindConfig:
    """Direction, speed and height of the reference; profile; output height; overrides of the site's roughness; solver budget."""

    direction: float = 270.0
    u_ref: float = 1.0
    z_ref: float = 10.0
    profile: str = "power"
    storey: float = buildings.STOREY
    z0: float | None = None
    d: float | None = None
    hr: float | None = None
    lambda_f: float | None = None
    dz: float = 5.0
    top: float = 100.0
    epsilon: float = 1e-4
    rounds: int = 5000
    form: str = "reference"
    vegetation: Column | None = field(default=None, compare=False)


class WindField:
    """Wind rasters of buildings on a surface: ``dsm`` (row, col, dsm) and ``dem`` (row, col, dem) on a grid."""

    def __init__(self, config: WindConfig, grid: Grid) -> None:
        self.config, self.grid = config, grid

    def site(self, extents: DataFrame) -> W.Profile:
        """Roughness by the buildings, one row, with the config's overrides."""
        c, area = self.config, self.grid.width * self.grid.height * self.grid.res**2
        own = buildings.roughness(extents, area).first().asDict()
        pick = lambda n: own[n] if getattr(c, n) is None else getattr(c, n)
        return W.Profile(c.profile, c.z_ref, pick("z0"), pick("d"), pick("hr"), pick("lambda_f"))

    def run(self, footprints: DataFrame, dsm: DataFrame, dem: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(row, col, speed, direction) and (row, col, zone)."""
        c = self.config
        extents = buildings.wind_extents(footprints, c.direction, c.storey)
        pixels, profile = wind.pixel_heights(dsm, dem, self.grid), self.site(extents)
        return wind.wind_field_2d(pixels, extents, c.direction, profile, c.u_ref, c.vegetation), wind.zone_raster(pixels, extents, c.direction, profile)

    def run_3d(self, cells: DataFrame) -> DataFrame:
        """Balanced voxels of cells (dir, row, col, speed_u, speed_v, dem, dsm)."""
        c = self.config
        return solver.mass_consistent(solver.initial_field(cells, c.dz, c.top), self.grid.res, self.grid.res, c.dz, c.epsilon, c.rounds, c.form)


def tessellation(footprints: DataFrame, grid: Grid) -> DataFrame:
    """(row, col, id): every cell goes to the nearest building; ids have to be whole numbers that a double holds."""
    shapes = footprints.select("ring", F.col("id").alias("value"), F.col("id").alias("ord"))
    owned = mapalgebra.rasterize(shapes, grid, -1).where("value >= 0").select("row", "col", F.lit(None).cast("double").alias("dsm"), F.col("value").cast("double").alias("dtm"))
    return points.fill_nearest(owned, grid).select("row", "col", F.col("dtm").cast("long").alias("id"))


def aligned(source: DataFrame, source_grid: Grid, target: Grid, band: str, source_srid: int = LAMBERT93, target_srid: int = LAMBERT93) -> DataFrame:
    """(row, col, band): a raster on another grid, and in another system, bilinear between cell centres."""
    cells = target.cells(source.sparkSession)
    x, y = crs.transform(target.x_of(F.col("col"), 0.5), target.y_of(F.col("row"), 0.5), target_srid, source_srid)
    at = cells.select((F.col("row").cast("long") * target.width + F.col("col")).alias("id"), x.alias("x"), y.alias("y"))
    out = mapalgebra.bilinear(source, at, source_grid, band)
    return out.select(F.floor(F.col("id") / target.width).cast("int").alias("row"), (F.col("id") % target.width).cast("int").alias("col"), band)


class Biotope:
    """Biotope scores of parcels before and after a project.

    ``parcels`` has rings (ring) in the score's system, and with ``key`` a name that features carry as well; all rings of a name are one
    parcel. Features are clipped to their parcel, so each counts with the area that lies in it. A feature that lies beside it has none.
    """

    def __init__(self, parcels: DataFrame, key: str | None = None, epsg: int = LAMBERT93) -> None:
        self.key, self.epsg = key or "parcel", epsg
        named = parcels if key else parcels.withColumn("parcel", F.lit(0))
        self.rings = named.select(self.key, "ring")
        self.alone = key is None
        self.existing: DataFrame | None = None
        self.project: DataFrame | None = None

    def parcels(self) -> DataFrame:
        """Name and parcel_area of each parcel."""
        return polygons.areas(polygons.dissolved(self.rings, self.key), self.key).withColumnRenamed("area", "parcel_area")

    def _clipped(self, rows: DataFrame, srid: int) -> DataFrame:
        """Rows (ring, maybe the parcel's name) with their number and the surface that lies in their parcel; those without any go."""
        rows = rows.withColumn(self.key, F.lit(0)) if self.alone else rows
        rows = rows.withColumn("ring", crs.transform_ring(F.col("ring"), srid, self.epsg)).withColumn("id", F.monotonically_increasing_id()).checkpoint()
        parts = polygons.areas(polygons.clipped(rows.select("id", "ring", self.key), self.rings, self.key), "id")
        return rows.drop("surface").join(parts.withColumnRenamed("area", "surface"), "id")

    def load_existing(self, rows: DataFrame, srid: int = LAMBERT93) -> Biotope:
        """Land cover (ring, classe): the state before."""
        if "classe" not in rows.columns:
            raise ValueError("land cover wants a column classe")
        told = biotope.annotate(self._clipped(rows, srid))
        colours = F.create_map(*[F.lit(v) for pair in dims.COSIA_COLOUR.items() for v in pair])
        self.existing = told.withColumn("color", F.coalesce(F.try_element_at(colours, F.col("classe")), F.lit(dims.COSIA_DEFAULT_COLOUR)))
        return self

    def load_project(self, rows: DataFrame, srid: int = LAMBERT93) -> Biotope:
        """Features with what they state of their class: bff_class, epaisseur_m and toiture, type_plui, layer, classe; trees as n_arbres and forfait_arbre_m2."""
        self.project = biotope.annotate(self._clipped(rows, srid))
        return self

    def load_drawing(self, spark: SparkSession, path: str, srid: int = CC46) -> Biotope:
        """A project's drawing: closed shapes of the layers that have a class; points and circles of tree layers are circles."""
        shapes = vector.read_dxf(spark, path).where(F.col("layer").isin(*dims.LAYERS))
        return self.load_project(shapes.select("layer", vector.layer_polygon(F.col("layer"), F.col("ring")).alias("ring")).where(F.size("ring") > 3), srid)

    def compute(self) -> DataFrame:
        """cbs_existant, cbs_projet, delta and alert of each parcel (with its name, where parcels have names); null for a state that wasn't loaded."""
        parcels = self.parcels()
        unknown = parcels.select(self.key, F.lit(None).cast("double").alias("cbs"))
        scores = [unknown if t is None else biotope.score(biotope.by_class(t, self.key), parcels, self.key) for t in (self.existing, self.project)]
        out = biotope.compare(*scores, self.key)
        return out.drop(self.key) if self.alone else out
