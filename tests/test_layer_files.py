"""Layers that the queries write are files of the tasks' own: nothing is moved through the driver, however many there are."""

from __future__ import annotations

from pathlib import Path

import pyarrow as pa

from urbanspark.core import shared_folder
from urbanspark.plans import layers
from urbanspark.sources import files


def test_a_tile_of_features_is_one_file_of_its_task(spark, small):
    there = set(Path(shared_folder(spark).removeprefix("file:")).glob("layer-*"))
    rows = layers.tiled_features(spark, small).collect()
    folder, = set(Path(shared_folder(spark).removeprefix("file:")).glob("layer-*")) - there
    written = list(folder.iterdir())
    assert rows and len(rows) == len({r["id"] for r in rows})
    assert len(written) > 4 and all(p.is_file() and p.suffix == ".json" for p in written)


def test_files_are_written_while_others_are_made(spark, tmp_path):
    folder = str(tmp_path / "out")

    def made(batches):
        import os

        for _ in batches:
            for i in range(64):
                there = len(os.listdir(folder)) if os.path.isdir(folder) else 0
                yield pa.RecordBatch.from_arrays([pa.array([f"{i}.bin"]), pa.array([there.to_bytes(4, "little") + bytes(1 << 20)], pa.binary())], ["name", "content"])

    assert files.write_files(spark.range(1).coalesce(1).mapInArrow(made, "name string, content binary"), folder) == 64
    written = sorted((tmp_path / "out").iterdir())
    assert len(written) == 64 and {p.stat().st_size for p in written} == {4 + (1 << 20)}
    # A sink that takes all files at once has written none when the last is made.
    assert int.from_bytes((tmp_path / "out" / "63.bin").read_bytes()[:4], "little") > 32
    assert files.write_files(spark.range(0).selectExpr("'a' name", "cast('b' as binary) content"), folder) == 0
