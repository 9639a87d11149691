"""Staged tables go with their block, and only with it."""

from pathlib import Path
from threading import Thread

import pytest

from cliptide.plans import QUERIES
from cliptide.sources import shared_dir, stage, staging

SF = "/root/testdata/sf0.001"


def _files(folder):
    return [p for p in Path(folder).rglob("*.parquet") if p.is_file()]


def test_tables_go_when_the_block_ends(spark):
    before = stage(spark.range(7), "kept")
    with staging(spark) as folder:
        inside = stage(spark.range(5), "gone")
        assert inside.count() == 5 and _files(folder)
    assert not Path(folder).exists()
    assert before.count() == 7
    after = stage(spark.range(3), "kept")
    assert after.count() == 3 and not any("block-" in f for f in after.inputFiles())


def test_an_inner_block_leaves_the_outer_one_alone(spark):
    with staging(spark) as outer:
        kept = stage(spark.range(4), "outer")
        with staging(spark) as inner:
            stage(spark.range(2), "inner")
        assert not Path(inner).exists() and Path(outer).exists() and kept.count() == 4
    assert not Path(outer).exists()


def test_tables_go_after_an_error_and_without_any_table_nothing_happens(spark):
    with pytest.raises(KeyError), staging(spark) as folder:
        stage(spark.range(2), "gone")
        raise KeyError("planted")
    assert not Path(folder).exists()
    with staging(spark) as folder:
        pass
    assert not Path(folder).exists()


def test_blocks_of_threads_do_not_meet(spark):
    paths = {}

    def work():
        with staging(spark):
            paths["thread"] = stage(spark.range(2), "own").inputFiles()

    with staging(spark) as folder:
        t = Thread(target=work)
        t.start()
        t.join()
        assert stage(spark.range(2), "own").count() == 2
    assert paths["thread"] and not any(folder in f for f in paths["thread"])


@pytest.mark.parametrize("name", ["j3_range_overlap", "r1_block_parallel_replay", "st1_streaming_replay"])
def test_a_query_leaves_nothing_behind(spark, name):
    shared = Path(shared_dir(spark))
    before = sorted(p.name for p in shared.iterdir())
    with staging(spark) as folder:
        rows = QUERIES[name](spark, SF).count()
        assert rows > 0 and _files(folder)
    assert sorted(p.name for p in shared.iterdir()) == before
