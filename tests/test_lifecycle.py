from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions.durations import micros
from tidemark.plans.catalog import Catalog
from tidemark.plans.measurement import Measurement
from tidemark.sources import files
from tidemark.sources.store import read_table, write_table
from tidemark.streaming.continuous import ContinuousQuery
from tidemark.streaming.lifecycle import Downsample, RetentionPolicy, compact, default_shard_duration, enforce, shards

T0 = datetime(2024, 1, 1)


def points(spark, n=120, step=60):
    rows = [(i, T0 + timedelta(seconds=i * step), "ab"[i % 2], float(i)) for i in range(n)]
    return spark.createDataFrame(rows, "seq long, time timestamp_ntz, host string, v double")


def measure(df):
    return Measurement(df, "time", ("host",), ("v",), ("seq",), "m")


def cq(**kw):
    return ContinuousQuery(**({"name": "q", "database": "db", "source": "m", "destination": "m_1h", "field": "v", "function": "mean", "every": "1h"} | kw))


def test_turns_meet_without_overlap(spark, tmp_path):
    m, path = measure(points(spark, 240)), str(tmp_path / "out")
    at = cq().run(m, path, T0 + timedelta(hours=2, minutes=30), T0)
    assert at == T0 + timedelta(hours=1)
    assert cq().run(m, path, T0 + timedelta(hours=2, minutes=40), at) == at
    at = cq().run(m, path, T0 + timedelta(hours=4, minutes=10), at)
    got = spark.read.parquet(path).groupBy("time", "host").count()
    assert at == T0 + timedelta(hours=3) and got.count() == 6 and got.where("count > 1").count() == 0


@pytest.mark.parametrize("function", ["mean", "first"])
def test_stream_gives_what_the_batch_gives(spark, tmp_path, function):
    points(spark, 240).write.parquet(str(tmp_path / "in"))
    stream = measure(spark.readStream.schema(points(spark, 1).schema).parquet(str(tmp_path / "in")))
    q = cq(function=function)
    s = q.start(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert s.awaitTermination(600)
    got = {(r["time"], r["host"]): r["v"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["time"], r["host"]): r["v"] for r in q.batch(measure(points(spark, 240))).collect()}
    assert all(want[k] == v for k, v in got.items())
    assert set(got) == {(T0 + timedelta(hours=i), h) for i in (0, 1) for h in "ab"}  # the watermark holds back the other two hours


def test_cq_validation():
    for bad in ({"name": ""}, {"field": ""}, {"destination": ""}, {"function": "median"}, {"every": "0s"}):
        with pytest.raises(ValueError):
            cq(**bad)


def test_retention(spark, tmp_path):
    path = str(tmp_path / "m")
    write_table(points(spark, 96, 3600), path, tags=("host",))
    m = read_table(spark, path, "m", ("host",), ("v",), sequence=("seq",))
    how = Downsample("6h", ("mean", "count"), "_6h")
    assert enforce(m, path, [RetentionPolicy("forever")], T0 + timedelta(days=90), "1d") == []
    gone = enforce(m, path, [RetentionPolicy("p", "48h", downsample=how), RetentionPolicy("q", "30d")], T0 + timedelta(days=4, hours=1), "1d")
    assert len(gone) == 2 and len(shards(spark, path)) == 2
    assert spark.read.parquet(path).agg(F.min("time")).first()[0] == T0 + timedelta(days=2)
    kept = spark.read.parquet(path + "_6h")
    assert kept.count() == 16 and kept.agg(F.sum("v_count")).first()[0] == 48


def test_policy_rules():
    assert [micros(default_shard_duration(x)) // 3_600_000_000 for x in ("0s", "10h", "70d", "30d")] == [168, 1, 168, 72]
    p = RetentionPolicy("p", "1h")
    assert p.expired(T0, T0 + timedelta(hours=2)) and not p.expired(T0, T0 + timedelta(minutes=30)) and not RetentionPolicy("z").expired(T0, T0 + timedelta(days=9999))
    for bad in ({"name": ""}, {"name": "x", "replication": 0}, {"name": "x", "duration": "-1h"}):
        with pytest.raises(ValueError):
            RetentionPolicy(**bad)
    with pytest.raises(ValueError):
        Downsample("1h", ("median",), "_x")


def test_compaction(spark, tmp_path):
    path = str(tmp_path / "m")
    for i in range(3):
        write_table(points(spark, 48, 3600).where(f"seq % 3 = {i}"), path, tags=("host",))
    m = read_table(spark, path, "m", ("host",), ("v",))
    before = sorted(map(str, spark.read.parquet(path).select("seq", "v").collect()))
    assert compact(m, path, T0 + timedelta(days=2, hours=1), "1d") == [19723]  # the newer day isn't cold
    assert {s: n for s, (n, _) in shards(spark, path).items()} == {19723: 1, 19724: 3}
    assert sorted(map(str, spark.read.parquet(path).select("seq", "v").collect())) == before


class Fails(Exception):
    pass


def fail_at(monkeypatch, target, name, nth=0):
    """Lets the nth call of a function fail, once."""
    calls, real = iter(range(1000)), getattr(target, name)

    def f(*a, **k):
        if next(calls) == nth:
            raise Fails
        return real(*a, **k)

    monkeypatch.setattr(target, name, f)


@pytest.mark.parametrize("nth", range(4))
def test_compaction_after_a_failure(spark, tmp_path, monkeypatch, nth):
    """Whatever move fails, no row is there twice, and the next call has them all."""
    path = str(tmp_path / "m")
    for i in range(3):
        write_table(points(spark, 24, 3600).where(f"seq % 3 = {i}"), path, tags=("host",))
    m = read_table(spark, path, "m", ("host",), ("v",))
    with monkeypatch.context() as mp:
        fail_at(mp, files, ("put_once", "move", "move", "remove")[nth], (0, 0, 1, 0)[nth])
        with pytest.raises(Fails):
            compact(m, path, T0 + timedelta(days=9), "1d")
    if files.exists(spark, f"{path}/shard_id=19723"):
        assert spark.read.parquet(path).groupBy("seq").count().where("count > 1").count() == 0
    else:  # between the two renames another writer appends
        write_table(points(spark, 25, 3600).where("seq = 24").withColumn("time", F.lit(T0).cast("timestamp_ntz")), path, tags=("host",))
    extra = int(spark.read.parquet(path).where("seq = 24").count())
    compact(m, path, T0 + timedelta(days=9), "1d")
    assert sorted(r["seq"] for r in spark.read.parquet(path).collect()) == list(range(24 + extra)) and not files.names(spark, f"{path}/_compact")


def test_retention_after_a_failure(spark, tmp_path, monkeypatch):
    """Aggregates are written, then dropping fails: the next call drops, and doesn't aggregate again."""
    path = str(tmp_path / "m")
    write_table(points(spark, 96, 3600), path, tags=("host",))
    m = lambda: read_table(spark, path, "m", ("host",), ("v",), sequence=("seq",))
    policy = RetentionPolicy("p", "48h", downsample=Downsample("6h", ("count",), "_6h"))
    for nth in (0, 1):
        with monkeypatch.context() as mp:
            fail_at(mp, files, "remove", nth)
            with pytest.raises(Fails):
                enforce(m(), path, [policy], T0 + timedelta(days=4, hours=1), "1d")
    assert enforce(m(), path, [policy], T0 + timedelta(days=5, hours=1), "1d") != []
    assert spark.read.parquet(path + "_6h").agg(F.sum("v_count")).first()[0] == 72 and spark.read.parquet(path).count() == 24


def test_turns_after_a_failure(spark, tmp_path, monkeypatch):
    """A turn whose record fails is ended by the next one; two writers' changes of a catalog both stay."""
    c, other = Catalog(spark, str(tmp_path / "w")), Catalog(spark, str(tmp_path / "w"))
    c.write_lines("db", spark.createDataFrame([(f"m,host=a v={i} {1704067200 + i * 600}",) for i in range(60)], "value string"), "s")
    c.create_query(cq())
    with monkeypatch.context() as mp:
        mp.setattr(c, "_change", lambda *a: (_ for _ in ()).throw(Fails()))
        with pytest.raises(Fails):
            c.run_queries("db", T0 + timedelta(hours=5))
    for hour in (7, 7, 9):
        c.run_queries("db", T0 + timedelta(hours=hour))
    got = c.measurement("db", "m_1h").df.groupBy("time").count()
    assert got.count() == 8 and got.where("count > 1").count() == 0 and c.query_status("db", "q")["processed"] == (T0 + timedelta(hours=8)).isoformat()
    put, first = c._put, iter([True])

    def late(db, version, state):
        if next(first, False):
            other.create_policy("db", RetentionPolicy("theirs"))
        return put(db, version, state)

    monkeypatch.setattr(c, "_put", late)
    c.create_policy("db", RetentionPolicy("ours"))
    assert [p.name for p in c.policies("db")] == ["ours", "theirs"]
    turns = iter([False, True])
    assert c.keep_running("db", 0, lambda: next(turns), lambda: T0 + timedelta(hours=9)) == 1


def test_catalog_of_policies_and_queries(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "w"))
    c.create_database("db")
    c.create_policy("db", RetentionPolicy("a", "30d", default=True))
    c.create_policy("db", RetentionPolicy("b", "1d", default=True, downsample=Downsample("1h", ("mean",), "_1h")))
    assert [(p.name, p.default) for p in c.policies("db")] == [("a", False), ("b", True)]
    assert c.policies("db")[1].downsample.aggregates == ("mean",)
    assert micros(c.alter_policy("db", "a", duration="7d").duration) == micros("7d")
    with pytest.raises(ValueError):
        c.drop_policy("db", "b")
    c.drop_policy("db", "a")
    c.drop_policy("db", "b")
    df = spark.createDataFrame([(f"m,host=a v={i} {1704067200 + i * 600}",) for i in range(30)], "value string")
    c.write_lines("db", df, "s")
    c.create_query(cq())
    with pytest.raises(ValueError):
        c.create_query(cq())
    c.enable_query("db", "q", False)
    assert c.run_queries("db", T0 + timedelta(hours=5)) == []
    c.enable_query("db", "q")
    assert c.run_queries("db", T0 + timedelta(hours=5)) == ["q"] and c.query_status("db", "q")["processed"] == (T0 + timedelta(hours=4)).isoformat()
    assert c.measurement("db", "m_1h").df.count() == 4
    c.drop_query("db", "q")
    assert c.queries("db") == []
