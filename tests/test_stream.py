"""The stream without state: restarts, repeated tiles, and batches that are run again."""

from verdance.streaming import tiles

SCHEMA = "tile_ord long, label long, area long"


def sent(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def taken(spark, tmp_path):
    stream = tiles.arrivals(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema)
    query = tiles.append_new(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), ["tile_ord", "label"])
    assert query.awaitTermination(60) and query.exception() is None
    assert not any(p.stateOperators for p in query.recentProgress)
    return sorted((r["tile_ord"], r["label"] or -1, r["area"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_repeated_tiles_add_nothing(spark, tmp_path):
    folder, first = str(tmp_path / "in"), [(1, 1, 10), (1, 2, 20), (1, 2, 20), (2, None, 5)]
    sent(spark, folder, first)
    assert taken(spark, tmp_path) == [(1, 1, 10), (1, 2, 20), (2, -1, 5)]
    sent(spark, folder, first + [(3, 1, 30)])
    assert taken(spark, tmp_path) == [(1, 1, 10), (1, 2, 20), (2, -1, 5), (3, 1, 30)]
    assert len(taken(spark, tmp_path)) == 4


def test_a_batch_run_again_replaces_its_folder(spark, tmp_path):
    sent(spark, str(tmp_path / "in"), [(1, 1, 10)])
    once = taken(spark, tmp_path)
    for done in (tmp_path / "checkpoint" / "commits").iterdir():
        done.unlink()
    assert taken(spark, tmp_path) == once == [(1, 1, 10)]
