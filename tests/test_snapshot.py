"""Rolling snapshot of a stream: several batches, replays, a restart."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.streaming import snapshot
from tessera.streaming.sources import file_stream

SCHEMA = "ts long, id long, v string"


def _order():
    return [F.desc("ts"), F.desc("id")]


def _batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _latest(rows, n):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)[:n]


def _read(spark, path, batch=None):
    return sorted([tuple(r) for r in snapshot.read_snapshot(spark, path, batch).collect()],
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)


def test_batches_and_replays(spark, tmp_path):
    path, seen = str(tmp_path / "out"), []
    parts = [[(10 * b + i * 7 % 23, 100 * b + i, f"{b}") for i in range(12)] for b in (3, 0, 5, 1, 4, 2)]
    parts[1] += [(None, 7, None), (70, 8, None), (70, 8, None)]
    for b, part in enumerate(parts):
        for _ in range(2):                                    # every batch runs twice
            snapshot.update_snapshot(_batch(spark, part), b, path, _order(), 10)
        seen += part
        assert _read(spark, path) == _latest(seen, 10)
    assert snapshot.versions(spark, path) == [3, 4, 5]
    snapshot.update_snapshot(_batch(spark, []), 6, path, _order(), 10)
    assert _read(spark, path) == _latest(seen, 10)


def test_uncommitted_version_is_no_state(spark, tmp_path):
    path = str(tmp_path / "out")
    snapshot.update_snapshot(_batch(spark, [(1, 1, "a")]), 0, path, _order(), 2)
    snapshot.update_snapshot(_batch(spark, [(2, 2, "b")]), 1, path, _order(), 2)
    (tmp_path / "out" / "batch=1" / "_SUCCESS").unlink()
    assert _read(spark, path) == [(1, 1, "a")]
    snapshot.update_snapshot(_batch(spark, [(2, 2, "b")]), 1, path, _order(), 2)
    assert _read(spark, path) == [(2, 2, "b"), (1, 1, "a")]
    with pytest.raises(ValueError):
        snapshot.update_snapshot(_batch(spark, []), 2, path, _order(), 0)


def test_stream_with_restart(spark, tmp_path):
    src, path, ckpt = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    (tmp_path / "in").mkdir()
    assert snapshot.rolling_snapshot(file_stream(spark, src, SCHEMA), path, ckpt, _order(), 5) is None
    seen = []
    for run in range(3):
        for part in range(2):
            rows = [(run * 5 + (i * 11 + part) % 17, 1000 * run + 100 * part + i, "x") for i in range(9)]
            _batch(spark, rows).coalesce(1).write.mode("append").parquet(src)
            seen += rows
        stream = file_stream(spark, src, SCHEMA, max_files_per_trigger=1)
        snapshot.rolling_snapshot(stream, path, ckpt, _order(), 5)
        assert _read(spark, path) == _latest(seen, 5)
    assert snapshot.versions(spark, path)[-1] >= 5            # one batch a file
