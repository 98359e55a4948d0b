import pytest

from marginalia import session


def test_cut_keeps_rows_types_and_real_size(spark):
    df = spark.range(1000).selectExpr("id", "array(id, id + 1) pair", "cast(null as string) none", "named_struct('a', id) s")
    got = session.cut(df)
    assert got.dtypes == df.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    size = int(str(got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    fs, path = session._files(got)
    assert size == pytest.approx(fs.getContentSummary(path).getLength(), rel=0.2)
    assert session.cut(df.limit(0)).count() == 0


def test_bounded_looks_at_rows_and_bytes(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    big, small = spark.range(100_000), spark.range(100)
    plan = lambda side: big.join(side, "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(session.bounded(small))
    assert "BroadcastHashJoin" not in plan(session.bounded(small, max_rows=99))
    assert "BroadcastHashJoin" not in plan(session.bounded(small, max_bytes=10))


def test_local_folders_only_where_all_tasks_share_the_driver():
    assert session._is_local("local") and session._is_local("local[4]")
    assert not session._is_local("local-cluster[3,2,1024]") and not session._is_local("spark://host:7077")
