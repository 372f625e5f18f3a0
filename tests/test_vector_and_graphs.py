from __future__ import annotations

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from urbanspark.operators import graphs
from urbanspark.sources import vector


def shapefile(polygons):
    body = b""
    for i, parts in enumerate(polygons, 1):
        points = [p for part in parts for p in part]
        starts = np.cumsum([0, *map(len, parts)])[:-1].tolist()
        rec = struct.pack("<i4d2i", 5, 0, 0, 1, 1, len(parts), len(points)) + struct.pack(f"<{len(parts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        body += struct.pack(">2i", i, len(rec) // 2) + rec
    return struct.pack(">i", 9994).ljust(100, b"\0") + body


def dbase(rows, width=8):
    names = list(rows[0])
    head = struct.pack("<B3xIHH", 3, len(rows), 33 + 32 * len(names), 1 + width * len(names)).ljust(32, b"\0")
    for n in names:
        head += n.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([width]) + b"\0" * 15
    return head + b"\r" + b"".join(b" " + b"".join(str(v).encode().ljust(width) for v in r.values()) for r in rows)


def test_shapefile(spark, tmp_path):
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    (tmp_path / "a.shp").write_bytes(shapefile([[ring], [ring, ring]]))
    (tmp_path / "a.dbf").write_bytes(dbase([{"NAME": "x", "LCZ": 3}, {"NAME": "y", "LCZ": 12}]))
    rows = vector.lcz_rows(vector.read_shapefile(spark, str(tmp_path / "a.*"))).orderBy("id").collect()
    assert [(r["kind"], len(r["parts"]), r["properties"]["NAME"], r["lcz_int"]) for r in rows] == [("Polygon", 1, "x", 3), ("Polygon", 2, "y", 12)]
    assert [tuple(p) for p in rows[0]["parts"][0]] == ring


def test_drawing(spark, tmp_path):
    lines = "0 SECTION 2 ENTITIES 0 LWPOLYLINE 8 ENON-arbres_existants 90 3 70 1 10 0 20 0 10 2 20 0 10 2 20 2 0 CIRCLE 8 MUR 10 5 20 6 40 1.5 0 ENDSEC 0 EOF".split()
    (tmp_path / "a.dxf").write_text("\n".join(lines) + "\n")
    rows = vector.read_dxf(spark, str(tmp_path / "a.dxf")).collect()
    assert [(r["layer"], r["kind"], len(r["ring"]), r["radius"]) for r in rows] == [("ENON-arbres_existants", "LWPOLYLINE", 4, None), ("MUR", "CIRCLE", 1, 1.5)]
    shape = spark.createDataFrame(rows).limit(1).select(vector.layer_polygon(F.col("layer"), F.col("ring")).alias("ring")).first()["ring"]
    assert len(shape) == 37


def test_triangles_have_empty_circles():
    xy = np.random.default_rng(2).random((40, 2)) * 100
    found = graphs.triangles(xy)
    for t in found:
        a, b, c = xy[list(t)]
        m = np.array([b - a, c - a]) * 2
        centre = np.linalg.solve(m, [b @ b - a @ a, c @ c - a @ a])
        r = np.hypot(*(a - centre))
        assert (np.hypot(*(xy - centre).T) >= r - 1e-6).all()
    assert len(found) >= 40


def test_delaunay_tiles_agree(spark):
    xy = np.random.default_rng(3).random((60, 2)) * 100
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id long, x double, y double")
    whole = {tuple(sorted((t[i], t[j]))) for t in graphs.triangles(xy) for i, j in ((0, 1), (1, 2), (0, 2))}
    got = {(r["a"], r["b"]) for r in graphs.delaunay(points, 1000.0, 10.0).collect()}
    assert got == whole


def test_reach_closeness_meshedness(spark):
    rng = np.random.default_rng(5)
    edges = {(min(a, b), max(a, b)): float(w) for a, b, w in zip(rng.integers(0, 25, 60), rng.integers(0, 25, 60), rng.integers(1, 20, 60), strict=True) if a != b}
    table = spark.createDataFrame([(int(a), int(b), w) for (a, b), w in edges.items()], "a long, b long, length double")
    d = np.full((25, 25), np.inf)
    for (a, b), w in edges.items():
        d[a, b] = d[b, a] = min(d[a, b], w)
    for k in range(25):
        d = np.minimum(d, d[:, k, None] + d[None, k, :])
    reach = graphs.within_reach(table, 30.0)
    got = {(r["source"], r["node"]): r["dist"] for r in reach.collect()}
    assert got == {(i, j): d[i, j] for i in range(25) for j in range(25) if i != j and d[i, j] <= 30}
    assert graphs.closeness(reach, 25).count() == len({i for i, _ in got})
    mesh = {r["node"]: r["meshedness"] for r in graphs.meshedness(reach, table).collect()}
    own = {0} | {j for i, j in got if i == 0}
    assert mesh[0] == pytest.approx((sum(a in own and b in own for a, b in edges) - len(own) + 1) / (2 * len(own) - 5))


def test_street_profile(spark):
    street = spark.createDataFrame([(1, 0.0, 0.0, 30.0, 0.0)], "street_id long, x0 double, y0 double, x1 double, y1 double")
    walls = spark.createDataFrame([(-10.0, 6.0, 40.0, 6.0)], "x0 double, y0 double, x1 double, y1 double")
    r = graphs.street_profile(street, walls).first()
    assert r["width"] == pytest.approx(31.0) and r["deviation"] == pytest.approx(0.0) and r["openness"] == pytest.approx(0.5)


def test_las_scan_reads_ranges_and_leaves_files_out(spark, tmp_path, monkeypatch):
    import numpy as np
    import pytest

    from urbanspark.sources import las

    rng = np.random.default_rng(5)
    every = []
    for k in range(4):
        x, y, z = rng.uniform(100 * k, 100 * k + 90, 5000).round(2), rng.uniform(0, 50, 5000).round(2), rng.uniform(0, 9, 5000).round(2)
        c = rng.integers(1, 7, 5000)
        (tmp_path / f"t{k}.las").write_bytes(las.las_bytes(x, y, z, c))
        every.append(np.stack([x, y, z, c], 1))
    every = np.concatenate(every)
    cloud = las.scan_las(spark, str(tmp_path), slice=1500)
    got = np.array([tuple(r)[:4] for r in cloud.collect()])
    order = lambda a: a[np.lexsort(a.round(2).T)].round(2)
    assert (order(got) == order(every)).all() and cloud.rdd.getNumPartitions() == 16
    near = cloud.where("x >= 120.004 and x < 150 and z <= 4")
    want = every[(every[:, 0] >= 120.004) & (every[:, 0] < 150) & (every[:, 2] <= 4)]
    assert near.count() == len(want) and near.rdd.getNumPartitions() == 4
    assert cloud.where("x > 1000").count() == 0 and cloud.where("y < 10 and y > 20").count() == 0
    (tmp_path / "t0.las").write_bytes((tmp_path / "t0.las").read_bytes()[:5000])
    with pytest.raises(Exception, match="ends before"):
        cloud.count()
