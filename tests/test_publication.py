"""Publication by views over snapshot folders: no gap for readers, and old snapshots go."""

import os
import threading


def test_readers_never_miss_a_table_across_schema_changes(lake, spark):
    lake.publish(spark.range(5), "gold", "moving", "r0")
    seen, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            try:
                frame = spark.table(lake.name("gold", "moving"))
                seen.append((tuple(frame.columns), frame.count()))
            except Exception as problem:  # what the test looks for
                seen.append(problem)

    reader = threading.Thread(target=read)
    reader.start()
    for i in range(1, 6):
        lake.publish(spark.range(5 + i).selectExpr("id", *[f"id AS c{j}" for j in range(i % 3)]), "gold", "moving", f"r{i}")
    stop.set()
    reader.join()
    wrong = [s for s in seen if not isinstance(s, tuple)]
    assert not wrong and all(n >= 5 for _, n in seen) and len(seen) > 1
    assert lake.read_layer("gold", "moving").columns == ["id", "c0", "c1"]


def test_old_snapshots_expire_and_the_current_one_stays(lake, spark):
    for i in range(4):
        lake.publish(spark.range(i + 1), "gold", "kept", f"r{i}")
    lake.stage(spark.range(9), "gold", "kept", "failed")
    folder = f"{lake.root}/gold/kept"
    assert len(os.listdir(folder)) == 5
    gone = lake.expire_snapshots("gold", "kept", keep=1)
    assert len(gone) == 3 and lake.read_layer("gold", "kept").count() == 4
    assert sorted(x.split("-")[0] for x in os.listdir(folder)) == ["failed", "r3"]
    assert lake.expire_snapshots("gold", "absent") == []


def test_a_table_may_be_replaced_from_itself(lake, spark):
    lake.publish(spark.range(3), "silver", "own", "a")
    lake.publish(lake.read_layer("silver", "own").selectExpr("id + 1 AS id"), "silver", "own", "b")
    assert sorted(r.id for r in lake.read_layer("silver", "own").collect()) == [1, 2, 3]
