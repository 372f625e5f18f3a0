"""Cells of a leaf are cut and closed together: steps follow neighbours and footprints, not points."""

from __future__ import annotations

import numpy as np
import pytest

from urbanspark.operators import tessellation as T

ROW = "id long, ring array<struct<x:double,y:double>>"


def box(x, y, w=10.0, h=8.0):
    return [{"x": float(x + a), "y": float(y + b)} for a, b in ((0, 0), (w, 0), (w, h), (0, h), (0, 0))]


def test_tables_between_steps_hold_footprints_and_there_are_two_rounds(spark, monkeypatch):
    rows = [(r * 12 + c, box(c * 30.0, r * 24.0)) for r in range(12) for c in range(12)]
    df = spark.createDataFrame(rows, ROW)
    points, kept = T.outline_points(df, 1.0).count(), []
    kind = next(k for k in type(df).__mro__ if "checkpoint" in vars(k))
    real = kind.checkpoint

    def noted(self, *a, **k):
        out = real(self, *a, **k)
        kept.append(out.count())
        return out

    monkeypatch.setattr(kind, "checkpoint", noted)
    got = T.tessellation(df, 100.0, 1.0, 20.0).collect()
    # The rim's cells reach the limit, whose halo is 200: before, that took as many rounds as 20 doubles to 200, each with a row for each point.
    assert len(got) == 144 and len(kept) <= 3 and max(kept) < points / 2
    inside = [r["area"] for r in got if 1 <= r["id"] % 12 <= 10 and 12 <= r["id"] < 132]
    assert len(inside) == 100 and inside == pytest.approx([720.0] * 100, abs=1e-6)


def test_cuts_follow_neighbours(monkeypatch):
    calls, real = [], T._Cells.cut
    monkeypatch.setattr(T._Cells, "cut", lambda self, rows, *a: (calls.append(len(rows)), real(self, rows, *a)))
    seen = []
    for side in (10, 30):
        at = np.array([(c * 30.0 + a, r * 24.0 + b) for r in range(side) for c in range(side) for a, b in ((0, 0), (5, 0), (10, 0), (10, 4), (10, 8), (5, 8), (0, 8), (0, 4))])
        calls.clear()
        sure, far, *_ = T.cells(at[:, 0], at[:, 1], np.arange(len(at)), np.full(len(at), 60.0), 100.0)
        assert (far[sure] <= 30.0).all() and sure.sum() > len(at) / 2
        seen.append(len(calls))
    assert seen[1] < 3 * seen[0]


def shapes(rnd, n):
    """Sides of cells: squares of small squares, some of whom are missing, with noise far below the snap."""
    out = []
    for code in range(n):
        have = rnd.random((4, 4)) < 0.7
        for r, c in zip(*np.nonzero(have), strict=True):
            p = [(c, r), (c + 1, r), (c + 1, r + 1), (c, r + 1)]
            out += [(code, np.array([*p[k], *p[(k + 1) % 4]]) * 10.0 + code * 0.1 + rnd.normal(0, 1e-13, 4)) for k in range(4)]
    rnd.shuffle(out)
    return np.array([c for c, _ in out]), np.array([e for _, e in out])


def test_rings_together_are_the_rings_one_by_one():
    code, at = shapes(np.random.default_rng(3), 60)
    owner, size, x, y = T.closed_rings(code, at, 60)
    first = np.cumsum(size) - size
    got = [[] for _ in range(60)]
    for o, f, n in zip(owner.tolist(), first.tolist(), size.tolist(), strict=True):
        got[o].append([(round(a, 6), round(b, 6)) for a, b in zip(x[f : f + n].tolist(), y[f : f + n].tolist(), strict=True)])
    holes = 0
    for c in range(60):
        want = [[(round(a, 6), round(b, 6)) for a, b in r[:-1]] for r in T.rings_of(list(map(tuple, at[code == c].tolist())))]
        assert sorted(map(sorted, got[c])) == sorted(map(sorted, want))
        holes += len(want) > 1
    assert holes > 5 and not sum(map(len, T.closed_rings(np.zeros(0, int), np.zeros((0, 4)), 3)))


def test_an_id_with_two_outlines_has_one_cell(spark):
    rows = [(r * 5 + c // 2, box(c * 30.0, r * 24.0)) for r in range(5) for c in range(10)]
    got = {r["id"]: r for r in T.tessellation(spark.createDataFrame(rows, ROW), 100.0, 2.0, 10.0, 50).collect()}
    for r in range(1, 4):
        for c in range(1, 4):
            assert got[r * 5 + c]["area"] == pytest.approx(1440.0, abs=1e-4) and len(got[r * 5 + c]["ring"]) == 5


def test_ids_of_other_kinds(spark):
    df = spark.createDataFrame([(k, box(k * 30.0, 0)) for k in range(3)], ROW)
    for kind in ("cast(id as string)", "named_struct('a', id % 2, 'b', nullif(id, 1))", "cast(id as decimal(9, 2))", "array(id)"):
        got = T.tessellation(df.selectExpr(f"{kind} id", "ring"), 20.0, 5.0, 15.0, 10).collect()
        want = T.tessellation(df, 20.0, 5.0, 15.0, 10).collect()
        assert len({str(r["id"]) for r in got}) == 3 and sorted(r["area"] for r in got) == pytest.approx(sorted(r["area"] for r in want))
