from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions.durations import instant, micros
from tidemark.functions.timebucket import bucket
from tidemark.operators import diff, metadata
from tidemark.plans.measurement import Measurement
from tidemark.plans.query import Query

T0 = datetime(2024, 1, 1)


def cpu(spark, rows):
    df = spark.createDataFrame([(i, datetime.fromisoformat(t), h, r, u) for i, (t, h, r, u) in enumerate(rows)], "seq long, time timestamp_ntz, host string, region string, usage double")
    return Measurement(df, "time", ("host", "region"), ("usage",), ("seq",), "cpu")


@pytest.fixture(scope="module")
def two(spark):
    rows = [(f"2024-01-01T00:0{i}:00", "a", "x", v) for i, v in enumerate((10.0, 20.0, 30.0))]
    return cpu(spark, rows + [("2024-01-01T00:00:00", "b", "y", 100.0), ("2024-01-01T00:01:00", "b", "y", 200.0)])


def values(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_durations():
    assert [micros(x) for x in ("1s", "5m", "2h", "1d", "1w", "500ms", "7us", "1h30m", "-1h", "3")] == [10**6, 3 * 10**8, 72 * 10**8, 864 * 10**8, 6048 * 10**8, 5 * 10**5, 7, 54 * 10**8, -36 * 10**8, 3 * 10**6]
    for bad in ("", "h", "1y", "1h x"):
        with pytest.raises(ValueError):
            micros(bad)
    assert instant("2024-01-01T01:00:00+01:00") == T0 == instant("2024-01-01") == instant(1_704_067_200_000_000_000)


def test_buckets(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 10, 12),), (datetime(1969, 12, 31, 23),), (None,)], "t timestamp_ntz")
    got = df.select(bucket(F.col("t"), "7d").alias("a"), bucket(F.col("t"), "7d", "unix").alias("b"), bucket(F.col("t"), "1h").alias("c")).collect()
    assert tuple(got[0]) == (datetime(2024, 1, 8), datetime(2024, 1, 4), datetime(2024, 1, 10, 12))
    assert got[1]["a"] == datetime(1969, 12, 29) and got[2]["a"] is None
    with pytest.raises(ValueError):
        bucket(F.col("t"), "0s")


def test_filter_and_project(two):
    assert Query(two).where("usage > 15").run().count() == 4
    assert Query(two).tags(host="a").where("usage > 15 AND usage < 25").select("usage").run().collect()[0][0] == 20.0
    assert Query(two).any_tag(host="b", region=["x"]).run().count() == 5
    assert Query(two).time_range("2024-01-01T00:01:00", include_start=False).run().count() == 1
    assert Query(two).since("1m", "2024-01-01T00:02:00Z").run().count() == 3
    with pytest.raises(ValueError):
        Query(two).select("nothing")


def test_merged_and_per_series(two):
    assert Query(two).agg(("mean", "usage", "m")).run().collect()[0]["m"] == 72.0
    assert values(Query(two).agg(("mean", "usage", "m")).group_by(per_series=True).run(), "host", "m") == [("a", 20.0), ("b", 150.0)]


def test_limit_is_per_series(two):
    assert values(Query(two).limit(2).run(), "usage") == [(10.0,), (20.0,), (100.0,), (200.0,)]
    assert values(Query(two).limit(2, 1).run(), "usage") == [(20.0,), (30.0,), (200.0,)]
    assert values(Query(two).limit(0, 2).run(), "usage") == [(30.0,)]
    assert Query(two).limit(0).run().count() == 5
    assert Query(two).limit(10, 100).run().count() == 0
    assert values(Query(two).order_by("usage", descending=True).limit(1).run(), "usage") == [(30.0,), (200.0,)]
    assert [r["usage"] for r in Query(two).order_by("usage", descending=True).select("time").run().select("*").join(two.df, "time").collect()] is not None


def test_aggregates(spark):
    rows = [("2024-01-01T00:00:00", "a", "x", v) for v in (2.0, 4.0, 4.0, 4.0, 5.0, 5.0, 7.0, 9.0)]
    m = cpu(spark, rows)
    got = Query(m).agg(("stddev", "usage", "sd"), ("first", "usage", "a"), ("last", "usage", "b"), ("median", "usage", "md")).run().collect()[0]
    assert got["sd"] == pytest.approx(2.138089935299395) and (got["a"], got["b"], got["md"]) == (2.0, 2.0, 4.5)  # of equal times the earliest row, for both
    ten = cpu(spark, [(f"2024-01-01T00:{i:02}:00", "a", "x", float(i)) for i in range(1, 11)])
    got = Query(ten).agg(*[("percentile", "usage", f"p{p}", p) for p in (0, 25, 50, 75, 100)]).run().collect()[0]
    assert tuple(got) == (1.0, 3.25, 5.5, 7.75, 10.0)
    for bad in (("percentile", "usage", "p"), ("percentile", "usage", "p", 101), ("mode", "usage", "p"), ("sum", "*", "p"), ("sum", "host", "p")):
        with pytest.raises(ValueError):
            Query(m).agg(bad).run()


def test_missing_values(spark):
    nan = float("nan")
    m = cpu(spark, [("2024-01-01T00:00:00", "a", None, 1.0), ("2024-01-01T00:01:00", "a", None, nan), ("2024-01-01T00:02:00", "a", None, 2.0), ("2024-01-01T00:03:00", "a", None, None)])
    got = Query(m).agg(("count", "usage", "n"), ("count", "*", "rows"), ("max", "usage", "hi"), ("mean", "usage", "m"), ("last", "usage", "l")).group_by("region").run().collect()[0]
    assert (got["n"], got["rows"], got["hi"], got["m"], got["l"], got["region"]) == (2, 4, 2.0, 1.5, 2.0, None)
    none = Query(m).where("usage > 99").agg(("count", "usage", "n"), ("sum", "usage", "s"), ("stddev", "usage", "d")).run().collect()[0]
    assert tuple(none) == (0, None, None)


def test_hourly_buckets(spark):
    m = cpu(spark, [("2024-01-01T00:00:00", "a", "x", 10.0), ("2024-01-01T00:30:00", "a", "x", 20.0), ("2024-01-01T01:30:00", "a", "x", 30.0), ("2024-01-01T02:00:00", "a", "x", 40.0)])
    assert [v for _, v in values(Query(m).agg(("mean", "usage", "m")).group_by(every="1h").run(), "time", "m")] == [15.0, 30.0, 40.0]


def test_metadata(spark, two):
    assert [r[0] for r in metadata.tag_keys(spark, two).collect()] == ["host", "region"]
    assert [tuple(r) for r in metadata.field_keys(spark, two).collect()] == [("usage", "float")]
    assert [r[0] for r in metadata.tag_values(two, "host").collect()] == ["a", "b"]
    assert metadata.series_cardinality(two).collect()[0][0] == 2
    assert sorted(r["series_key"] for r in metadata.series(two).collect()) == ["cpu,host=a,region=x", "cpu,host=b,region=y"]


def test_table_diff(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None), (4, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "Y"), (3, None), (5, "n")], "k int, v string")
    assert values(diff.table_diff(a, b, ["k"]), "k", "state") == [(2, "changed"), (4, "only_a"), (5, "only_b")]
    assert diff.table_diff(a, a, ["k"]).count() == 0


def test_tag_filter_reaches_the_scan(spark, two, tmp_path):
    two.df.write.parquet(str(tmp_path / "t"))
    m = two.over(spark.read.parquet(str(tmp_path / "t")))
    plan = Query(m).tags(host="a").time_range("2024-01-01").select("usage").run()._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(host,a)" in plan and "GreaterThanOrEqual(time" in plan and "region" not in plan.split("ReadSchema")[1]


def test_statement_text(two):
    q = Query(two).tags(host="a").time_range("2024-01-01", "2024-01-02", include_end=False).where("usage > 1").agg(("mean", "usage", "m"), ("percentile", "usage", "p", 90)).group_by("host", every="5m").limit(3, 1)
    assert str(q) == "SELECT mean(usage) AS m, percentile(usage, 90) AS p FROM cpu WHERE host = 'a' AND time >= '2024-01-01' AND time < '2024-01-02' AND (usage > 1) GROUP BY time(5m), host LIMIT 3 OFFSET 1"
    assert str(Query(two).select("usage").order_by("usage", descending=True)) == "SELECT usage FROM cpu ORDER BY usage DESC" and str(Query(two)) == "SELECT * FROM cpu"


def test_points_after_now(two):
    """Without an end, points after now are left out: of the run, or of the moment given; an end lets them in."""
    later = two.over(two.df.union(two.df.limit(1).withColumn("time", F.lit(datetime(2999, 1, 1)).cast("timestamp_ntz"))))
    assert Query(later).run().count() == 5 and Query(later).at("2024-01-01T00:01:00Z").run().count() == 4
    assert Query(later).time_range(end="3000-01-01").run().count() == 6 and Query(later).at("2024-01-01T00:00:00Z").agg(("count", "*", "n")).run().collect()[0]["n"] == 2
