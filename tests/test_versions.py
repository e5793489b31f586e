"""The versioned table: repeats, restarts, compaction, unfinished bases."""

import os

from mxposture.streaming.versions import VersionedTable

SCHEMA = "k string, n bigint"


def held(table):
    return sorted(map(tuple, table.read().collect()))


def test_batches_count_once_in_their_order(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ["k"], SCHEMA, every=3)
    assert held(table) == []

    def merge(batch, *rows):
        table.merge(spark.createDataFrame(rows, SCHEMA), batch)

    merge(0, ("a", 1), ("b", 1))
    merge(1, ("a", 2))
    assert held(table) == [("a", 2), ("b", 1)]
    merge(1, ("a", 3), ("c", None))  # the batch runs again and now holds something else
    assert held(table) == [("a", 3), ("b", 1), ("c", None)]
    merge(2, ("b", 0))  # smaller than before, but newer; compacted
    assert os.path.exists(tmp_path / "t" / "base" / "upto=2" / "_SUCCESS")
    assert held(table) == [("a", 3), ("b", 0), ("c", None)]
    merge(2, ("b", 5))  # repeated after its compaction: compacted again
    merge(3, ("d", 1), ("d", 2))
    assert held(table) == [("a", 3), ("b", 5), ("c", None), ("d", 2)]


def test_an_unfinished_base_is_not_read(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ["k"], SCHEMA, every=2)
    for batch in range(4):
        table.merge(spark.createDataFrame([("a", batch), (f"b{batch}", batch)], SCHEMA), batch)
    want = held(table)
    assert want == [("a", 3), ("b0", 0), ("b1", 1), ("b2", 2), ("b3", 3)]
    os.remove(tmp_path / "t" / "base" / "upto=3" / "_SUCCESS")
    assert held(table) == want
    again = VersionedTable(spark, str(tmp_path / "t"), ["k"], SCHEMA, every=2)
    again.compact(3)
    assert held(again) == want
