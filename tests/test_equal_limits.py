"""A band whose two percentiles are one value, as on tables so large that every cell reaches the greatest height."""

from __future__ import annotations

import duckdb

from urbanspark.operators import mapalgebra


def test_stretch_between_equal_limits_equals_sql(spark):
    values = [*[5.0] * 97, 4.0, 6.0, None]
    rows = spark.createDataFrame(list(enumerate(values)), "row long, dsm double")
    got = {r["row"]: r["stretched"] for r in mapalgebra.percentile_stretch(rows, "dsm").collect()}
    base = ", ".join(f"({i}, {'NULL' if v is None else v}::DOUBLE)" for i, v in enumerate(values))
    want = duckdb.sql(f"""WITH base(i, dsm) AS (VALUES {base}), q AS (SELECT quantile_cont(dsm, 0.02) AS lo, quantile_cont(dsm, 0.98) AS hi FROM base)
      SELECT i, round(least(greatest((dsm - lo) / (hi - lo), 0e0), 1e0), 6) FROM base, q""").fetchall()
    assert got == dict(want) and got[0] == 1.0 and got[97] == 0.0
