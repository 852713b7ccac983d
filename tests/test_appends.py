"""Appends that count once."""

import threading

import pytest

from gridledger.session import fresh_folder
from gridledger.sources import sinks

SCHEMA = "id bigint, cost double, label string"


def test_replays_torn_and_racing_writers(spark):
    folder = fresh_folder(spark, "once")
    table = spark.createDataFrame([], SCHEMA)
    rows = lambda *ids: spark.createDataFrame([(i, "x") for i in ids], "id bigint, label string")
    assert sinks.read_committed(spark, folder, SCHEMA).count() == 0
    assert sinks.append_once(rows(1, 2), table, folder, "label", "a")
    assert not sinks.append_once(rows(1, 2), table, folder, "label", "a")
    rows(9).write.partitionBy("label").json(f"{folder}/rows/batch=b/try=dead")
    assert sorted(r.id for r in sinks.read_committed(spark, folder, SCHEMA).collect()) == [1, 2]
    assert sinks.append_once(rows(9), table, folder, "label", "b")
    won = []
    writers = [threading.Thread(target=lambda: won.append(sinks.append_once(rows(5), table, folder, "label", "c"))) for _ in range(3)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert won.count(True) == 1
    got = sinks.read_committed(spark, folder, SCHEMA)
    assert got.columns == ["id", "cost", "label"]
    assert sorted((r.id, r.cost, r.label) for r in got.collect()) == [(1, None, "x"), (2, None, "x"), (5, None, "x"), (9, None, "x")]
    with pytest.raises(ValueError):
        sinks.append_once(rows(1), table, folder, "label", "../a")
    with pytest.raises(ValueError):
        sinks.append_once(rows(1).withColumnRenamed("id", "key"), table, folder, "label", "d")
