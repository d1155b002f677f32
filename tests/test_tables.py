"""Tables that plans write for themselves last as long as their workspace, and no other goes with them."""

from pathlib import Path

import pytest

from coderake.operators import rules
from coderake.operators.taint import _value_extents, live_names
from coderake.plans.tables import PREFIX, shared_dir, workspace, written
from coderake.sources import fixture
from coderake.streaming.incremental import file_stream, scan_stream
from tests.conftest import DATA
from tests.test_scan import texts


def left(spark):
    folder = Path(shared_dir(spark)) / "coderake"
    return {p.name for p in folder.iterdir()} if folder.exists() else set(), {t.name for t in spark.catalog.listTables(pattern=f"{PREFIX}*")}


def test_a_workspace_clears_what_is_its_own(spark):
    rows = spark.range(10).selectExpr("id", "id % 3 AS path")
    outside = written(rows, "outside", by="path")
    before = left(spark)
    with workspace(spark):
        first, second = written(rows, "one", by="path"), written(rows, "two")
        with workspace(spark):
            assert written(rows, "three", by="path").count() == 10
        assert first.count() + second.count() == 20
        assert [len(a - b) for a, b in zip(left(spark), before)] == [2, 1]
    assert left(spark) == before and outside.count() == 10


def test_a_workspace_clears_after_failures(spark):
    before = left(spark)
    with pytest.raises(Exception, match="no such thing"):
        with workspace(spark):
            written(spark.range(3), "one", by="id")
            written(spark.range(3).selectExpr("raise_error('no such thing') AS x"), "two").count()
    assert left(spark) == before
    with workspace(spark):
        pass
    assert left(spark) == before


def test_a_stream_leaves_no_tables_and_takes_none_of_others(spark, tmp_path):
    outside = written(spark.range(10).selectExpr("id", "id % 3 AS path"), "outside", by="path")
    before = left(spark)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.py").write_text('q = request.args.get("id")\ncur.execute("SELECT " + q)\n')
    query = scan_stream(file_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "findings")).where("rule_id = 'SQLI'").count() == 1
    assert left(spark) == before and outside.count() == 10


def test_files_are_dealt_out_by_their_size_and_stay_so(spark, monkeypatch):
    """Parts grow in number with the texts, and what is found by path and token shuffles no tokens."""
    monkeypatch.setattr(rules, "PART_BYTES", 100)
    own = rules.Facts(texts(spark, *[(f"{n}.py", "python", f"x{n} = request.args\nf(x{n})\n") for n in range(40)]), persisted=True)
    assert own.parts > int(spark.conf.get("spark.sql.shuffle.partitions"))
    live = live_names(own.code, own.calls, _value_extents(own.assignments))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in live._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in own.calls.join(own.code.select("path", "tok_no", "mask"), ["path", "tok_no"])._jdf.queryExecution().executedPlan().toString()
        assert live.count() == 40 and own.calls.count() == 40
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert spark.conf.get("spark.sql.sources.bucketing.autoBucketedScan.enabled") == "true"


def test_more_files_come_from_more_tasks(spark, monkeypatch):
    """What a task holds of the texts that it deals out does not grow with the table of parts."""
    monkeypatch.setattr(fixture, "ROWS", 10, raising=False)
    files = fixture.code_files(spark, DATA)
    assert files.rdd.getNumPartitions() == -(-spark.read.parquet(f"{DATA}/part.parquet").count() // 10) > spark.sparkContext.defaultParallelism


def test_a_bucket_is_written_without_a_sort(spark):
    """Tasks of one bucket each hold no rows back: a sort of them would spill where they are many."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def stages():
        found = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), getattr(store, "stageList$default$5")()).iterator()
        while found.hasNext():
            yield found.next()

    before = {s.stageId() for s in stages()}
    rows = spark.range(10_000).selectExpr("id", "concat('f', id % 97) AS path").repartition(7, "path")
    conf, most = spark._jvm.org.apache.spark.SparkEnv.get().conf(), "spark.shuffle.spill.numElementsForceSpillThreshold"
    conf.set(most, "100")  # any sort of more rows spills
    try:
        with workspace(spark):
            assert written(rows, "buckets", by="path", parts=7).count() == 10_000
    finally:
        conf.remove(most)
    new = [s for s in stages() if s.stageId() not in before]
    assert sum(s.outputRecords() for s in new) == 10_000 and sum(s.memoryBytesSpilled() for s in new) == 0
