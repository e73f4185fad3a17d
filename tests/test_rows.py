"""Row-level changes: merged reads, several writers, commits over two tables."""

import threading

import pytest
from pyspark.sql import functions as F

from siftline.sources import rows
from siftline.sources.rows import Edit, RowTables, RunStore


def table(spark, *items):
    return spark.createDataFrame(list(items), "k string, v int")


def content(tables, name="t"):
    return sorted((r.k, r.v) for r in tables.read(name).collect())


def test_puts_deletes_and_compaction(spark, tmp_path):
    t = RowTables(spark, f"file://{tmp_path}/t", {"t": ["k"]})
    assert t.read("t") is None
    t.put("t", table(spark, ("a", 1), ("b", 2), (None, 9)))
    t.put("t", table(spark, ("a", 3)))
    t.delete("t", table(spark, ("b", 0)).select("k"))
    assert sorted((r.k or "", r.v) for r in t.read("t").collect()) == [("", 9), ("a", 3)]
    t.compact("t")
    assert t.log.state()[1]["t"]["changes"] == []
    t.put("t", table(spark, ("b", 5), ("c", 6)))
    t.delete("t", spark.createDataFrame([(None,)], "k string"))
    assert content(t) == [("a", 3), ("b", 5), ("c", 6)]
    t.commit(lambda _: Edit(puts={"t": table(spark, ("c", 7))}, deletes={"t": table(spark, ("a", 0))}))
    assert content(t) == [("b", 5), ("c", 7)]
    assert t.tidy(keep=1) > 0 and content(t) == [("b", 5), ("c", 7)]


def test_change_writes_its_own_rows_only(spark, tmp_path):
    t = RowTables(spark, f"file://{tmp_path}/t", {"t": ["k"]})
    t.put("t", spark.range(50_000).select(F.col("id").cast("string").alias("k"), F.col("id").cast("int").alias("v")))
    t.compact("t")
    t.put("t", table(spark, ("7", -1)))
    change = t.log.read(t.log.state()[1]["t"]["changes"][0])
    assert change.count() == 1 and t.read("t").where("k = '7'").first().v == -1 and t.read("t").count() == 50_000
    plan = t.read("t")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_many_changes_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rows, "MOST_CHANGES", 3)
    t = RowTables(spark, f"file://{tmp_path}/t", {"t": ["k"]})
    for n in range(6):
        t.put("t", table(spark, (f"k{n % 2}", n)))
    assert content(t) == [("k0", 4), ("k1", 5)] and len(t.log.state()[1]["t"]["changes"]) <= 3


def test_two_writers_lose_nothing(spark, tmp_path):
    t = RowTables(spark, f"file://{tmp_path}/t", {"t": ["k"]})
    failures = []

    def write(who):
        try:
            for n in range(4):
                t.put("t", table(spark, (f"{who}{n}", n)))
        except Exception as e:
            failures.append(e)

    threads = [threading.Thread(target=write, args=(w,)) for w in "ab"]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert not failures and content(t) == sorted((f"{w}{n}", n) for w in "ab" for n in range(4))


def test_edit_on_what_it_read_is_made_again(spark, tmp_path):
    t = RowTables(spark, f"file://{tmp_path}/t", {"t": ["k"]})
    t.put("t", table(spark, ("n", 1)))
    tries = []

    def add(state):
        now = t.read("t", state).first().v
        if not tries:  # another writer comes in between
            t.put("t", table(spark, ("n", 10)))
        tries.append(now)
        return Edit(puts={"t": table(spark, ("n", now + 1))}, read=("t",))

    assert t.commit(add) and tries == [1, 10] and content(t) == [("n", 11)]


RUN = "run_id string, status string, variant_usage map<string,int>, variant_usage_applied boolean"


def test_runs_change_row_by_row(spark, tmp_path):
    store = RunStore(spark, f"file://{tmp_path}/r")
    assert not store.update("a", {"status": "oferta"}) and not store.delete("a") and store.text("a") is None
    store.add(spark.createDataFrame([("a", "pendiente", {}, False), ("b", "pendiente", {}, False)], RUN), spark.createDataFrame([("a", "one"), ("b", "two")], "run_id string, text string"))
    assert store.update("a", {"status": "oferta"}) and store.text("a") == "one"
    assert {r.run_id: r.status for r in store.tables.read("runs").collect()} == {"a": "oferta", "b": "pendiente"}
    with pytest.raises(ValueError):
        store.update("a", {"status": "nonsense"})
    assert store.delete("a") and not store.delete("a") and store.text("a") is None and store.text("b") == "two"


def test_usage_counts_once_whatever_breaks(spark, tmp_path):
    store = RunStore(spark, f"file://{tmp_path}/r")
    store.tables.put("variants", spark.createDataFrame([("v", 1), ("w", None)], "variant_id string, used_count int"))
    store.add(spark.createDataFrame([("a", "x", {"v": 2, "gone": 1}, False), ("b", "x", {"w": -3}, None)], RUN))
    used = lambda: {r.variant_id: r.used_count for r in store.tables.read("variants").collect()}
    whole, store.tables.log.commit = store.tables.log.commit, lambda *_: (_ for _ in ()).throw(OSError("crash before the commit"))
    with pytest.raises(OSError):
        store.apply_usage()
    store.tables.log.commit = whole
    assert used() == {"v": 1, "w": None}
    assert store.apply_usage() and used() == {"v": 3, "w": 0}
    assert not store.apply_usage() and used() == {"v": 3, "w": 0}  # as after a crash behind the commit
    store.add(spark.createDataFrame([("c", "x", {"v": 1}, False)], RUN))
    assert store.apply_usage() and used() == {"v": 4, "w": 0}


def test_sessions_are_saved_whole(spark, tmp_path):
    store = RunStore(spark, f"file://{tmp_path}/r")
    assert store.session("s") is None
    bullets = spark.createDataFrame([("s", 1, "x"), ("o", 1, "y")], "session_id string, id int, text string")
    clusters = spark.createDataFrame([("s", "c", [1])], "session_id string, cluster_id string, bullet_ids array<int>")
    states = spark.createDataFrame([("s", "c", "pending")], "session_id string, cluster_id string, status string")
    store.save_session(bullets, clusters, states)
    store.tables.put("import_resolutions", states.withColumn("status", F.lit("done")))
    assert [df.count() for df in store.session("s")] == [1, 1, 1] and store.session("s")[2].first().status == "done" and store.session("z") is None
