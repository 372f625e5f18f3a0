"""The tiled source against a server of the test's own: tiles pruned, answers split, transfers mended."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import numpy as np
import pytest
from pyspark.sql import functions as F

from urbanspark.core import BBox, Grid
from urbanspark.sources import fetch, geotiff, tiles


class Service(BaseHTTPRequestHandler):
    """Features of a box, at most ``limit``; told to fail, it breaks off or refuses first."""

    features: list[dict] = []
    asked: list[tuple[float, ...]] = []
    ranges: list[str] = []
    limit, broken, refused = 1000, 0, 0
    lock = threading.Lock()

    def log_message(self, *_):
        pass

    def do_GET(self):
        cls = type(self)
        y0, x0, y1, x1 = map(float, parse_qs(urlsplit(self.path).query)["BBOX"][0].split(",")[:4])
        with cls.lock:
            cls.asked.append((x0, y0, x1, y1))
            refuse, broken = cls.refused > 0, cls.broken > 0
            cls.refused -= refuse
            cls.broken -= broken and not refuse
        if refuse:
            self.send_error(503)
            return
        xs = lambda f: [p[0] for p in f["geometry"]["coordinates"]]
        ys = lambda f: [p[1] for p in f["geometry"]["coordinates"]]
        hit = [f for f in cls.features if min(xs(f)) <= x1 and max(xs(f)) >= x0 and min(ys(f)) <= y1 and max(ys(f)) >= y0]
        body = json.dumps({"type": "FeatureCollection", "features": hit[: cls.limit]}).encode()
        begin = 0
        if wanted := self.headers.get("Range"):
            cls.ranges.append(wanted)
            begin = int(wanted.removeprefix("bytes=").rstrip("-"))
        self.send_response(206 if begin else 200)
        self.send_header("Content-Length", str(len(body) - begin))
        self.end_headers()
        self.wfile.write(body[begin : begin + 40] if broken else body[begin:])


@pytest.fixture
def service():
    rng = np.random.default_rng(3)
    Service.features = [
        {"type": "Feature", "id": i, "properties": {"n": i}, "geometry": {"type": "LineString", "coordinates": [[float(x), float(y)], [float(x + dx), float(y + dy)]]}}
        for i, (x, y, dx, dy) in enumerate(np.round(np.hstack([rng.uniform(0, 8, (60, 2)), rng.uniform(0, 3, (60, 2))]), 3).tolist())
    ]
    Service.features += [{"type": "Feature", "id": 900, "properties": None, "geometry": {"type": "LineString", "coordinates": [[10.0, 10.0], [10.0, 10.0]]}}]
    Service.asked, Service.ranges, Service.limit, Service.broken, Service.refused = [], [], 1000, 0, 0
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield tiles.service_url(f"http://127.0.0.1:{server.server_port}/wfs", "roads")
    server.shutdown()
    server.server_close()


BOX = BBox(0.0, 0.0, 10.0, 10.0)


def meets(box):
    out = []
    for f in Service.features:
        (ax, ay), (bx, by) = f["geometry"]["coordinates"]
        if ax <= box.max_x and bx >= box.min_x and ay <= box.max_y and by >= box.min_y:
            out.append(str(f["id"]))
    return sorted(out)


def test_every_feature_once(spark, service):
    rows = tiles.read_tiles(spark, service, BOX, 2.5, tilesPerPartition=3).collect()
    assert sorted(r["id"] for r in rows) == meets(BOX) and len(set(Service.asked)) == 16


@pytest.mark.parametrize("box", [BBox(2.6, 2.6, 4.9, 7.4), BBox(9.0, 0.0, 10.0, 1.0), BBox(5.0, 5.0, 5.0, 5.0), BBox(-5.0, -5.0, 30.0, 0.2), BBox(10.0, 10.0, 12.0, 12.0)])
def test_a_rectangle_opens_only_its_tiles(spark, service, box):
    layer = tiles.within(tiles.read_tiles(spark, service, BOX, 2.5), box)
    assert sorted(r["id"] for r in layer.collect()) == meets(box)
    assert all(x0 <= box.max_x and x1 >= box.min_x and y0 <= box.max_y and y1 >= box.min_y for x0, y0, x1, y1 in Service.asked)
    assert 0 < len(set(Service.asked)) <= 6


def test_conditions_that_exclude_each_other_open_nothing(spark, service):
    assert tiles.read_tiles(spark, service, BOX, 2.5).where("max_x >= 7 and min_x <= 3 and max_x < 2 and id = 'x'").count() == 0
    assert tiles.read_tiles(spark, service, BOX, 2.5).where("max_x >= 11").count() == 0 and not Service.asked[1:]


def test_a_full_answer_is_asked_again_in_parts(spark, service):
    Service.limit = 16
    rows = tiles.read_tiles(spark, service, BOX, 10.0, limit=16).collect()
    assert sorted(r["id"] for r in rows) == meets(BOX) and len(Service.asked) > 5


def test_broken_and_refused_transfers(spark, service):
    Service.broken, Service.refused = 2, 1
    rows = tiles.read_tiles(spark, service, BOX, 5.0, wait=0.01, tries=4).collect()
    assert sorted(r["id"] for r in rows) == meets(BOX) and "bytes=40-" in Service.ranges
    Service.refused = 100
    with pytest.raises(Exception, match="503"):
        tiles.read_tiles(spark, service, BOX, 10.0, wait=0.01).collect()
    assert Service.refused == 97  # three tries


def test_fetch_of_stored_files(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "part-0.txt").write_bytes(b"x")
    (tmp_path / "a" / "part-1.txt").write_bytes(b"y")
    (tmp_path / "a" / "_SUCCESS").write_bytes(b"")
    assert fetch.fetch(str(tmp_path / "a")) == b"x\ny" and fetch.fetch(f"file://{tmp_path}/a/part-1.txt") == b"y"
    assert fetch.fetch(str(tmp_path / "none")) is None


def test_raster_tiles_round_trip(spark, tmp_path):
    grid = Grid(100.0, 60.0, 2.0, 13, 9)
    cells = grid.cells(spark).where("row <> 4 or col <> 4").where("not (row > 3 and col < 5)").withColumn("v", (F.col("row") * 100 + F.col("col")).cast("double"))
    folder = f"file://{tmp_path}/t"
    written = geotiff.write_tiles(cells, grid, folder, 5, "v").collect()
    assert len(written) == 5 and {(r["tx"], r["ty"]) for r in written} == {(0, 1), (1, 0), (1, 1), (2, 0), (2, 1)}
    layer = tiles.read_tiles(spark, folder + "/{tx}_{ty}.tif", BBox(100.0, 42.0, 126.0, 60.0), 10.0, "raster")
    got = {(r["row"], r["col"]): r["bands"][0] for r in layer.where(F.col("bands")[0].isNotNull()).collect()}
    assert got == {(r["row"], r["col"]): r["v"] for r in cells.collect()}
    part = tiles.within(layer, BBox(111.0, 42.0, 115.0, 47.0), "raster").collect()
    assert {(r["row"], r["col"]) for r in part} == {(r, c) for r in (7, 8) for c in (5, 6, 7)} | {(6, c) for c in (5, 6, 7)} and {(r["tx"], r["ty"]) for r in part} == {(1, 0)}


def test_layers_of_a_service(spark, service):
    from urbanspark import api
    from urbanspark.core import Context

    road = api.Road(spark, service, context=Context(bbox=BBox(0.0, 0.0, 4.0, 4.0)))
    road.tile = 1.7
    rows = road.run().df()
    assert rows.columns == ["id", "properties", "kind", "coordinates", "srid"] and sorted(r["id"] for r in rows.collect()) == meets(BBox(0.0, 0.0, 4.0, 4.0))
    with pytest.raises(ValueError, match="box"):
        api.Road(spark, service).run()
