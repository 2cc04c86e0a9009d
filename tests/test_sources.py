import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.plans.catalog import Catalog
from tidemark.plans.measurement import Measurement
from tidemark.plans.query import Query
from tidemark.sources import csv_points, json_points, line_protocol, store, transfer
from tidemark.sources.points import precision, wide, written_time
from tidemark.sources.results import csv_rows, header, series_json

NOW = datetime(2024, 1, 1)


def lines(spark, *text):
    return spark.createDataFrame([(t,) for t in text], "value string")


def parse(spark, *text, **kw):
    return line_protocol.parse_lines(lines(spark, *text), now=NOW, **kw).collect()


def test_line_types(spark):
    r = parse(spark, 'tank level=-0.25,pumps=7i,state="half full",open=true 1700000000000000000')[0]
    f = r["fields"]
    assert (f["level"]["f"], f["pumps"]["i"], f["state"]["s"], f["open"]["b"]) == (-0.25, 7, "half full", True)
    assert r["time_ns"] == 1700000000000000000 and r["time"] == datetime(2023, 11, 14, 22, 13, 20)
    for yes, no in zip(line_protocol.TRUE, line_protocol.FALSE, strict=True):
        got = parse(spark, f"tank a={yes},b={no} 1")[0]["fields"]
        assert got["a"]["b"] is True and got["b"]["b"] is False
    assert parse(spark, "tank a=F")[0]["fields"]["a"]["b"] is False


def test_line_escapes(spark):
    r = parse(spark, r"tank,old\ site=pier\ 4,a\=b=c\,d level=2 1700000000000000000", r'tank note="say \"no\", x=y z" 5', "tank  level=3   9")
    assert r[0]["tags"] == {"old site": "pier 4", "a=b": "c,d"}
    assert r[1]["fields"]["note"]["s"] == 'say "no", x=y z' and r[1]["time_ns"] == 5
    assert r[2]["fields"]["level"]["f"] == 3.0 and r[2]["time_ns"] == 9


def test_long_lines(spark):
    """Tens of thousands of fields, escapes and quoted signs in a line."""
    many = ",".join(f"f{i}={i}i" for i in range(3000))
    r = parse(spark, f"tank {many} 1", "tank s=" + '"' + 'x, \\"' * 20000 + '" 2', "t" + "\\ " * 20000 + " v=1 3")
    assert [len(x["fields"]) for x in r] == [3000, 1, 1] and len(r[1]["fields"]["s"]["s"]) == 80000 and len(r[2]["measurement"]) == 20001


def test_line_defaults(spark):
    got = parse(spark, "", "# note", "cpu v=1", "cpu v=2 0", "cpu,t=1,t=2 v=1,v=3 7", unit="s")
    assert len(got) == 3 and [r["time"] for r in got[:2]] == [NOW, NOW]
    assert got[2]["tags"] == {"t": "2"} and got[2]["fields"]["v"]["f"] == 3.0 and got[2]["time_ns"] == 7 * 10**9


@pytest.mark.parametrize("bad", ["tank v=1.2.3", "tank,site=north", "tank ,v=1", ",site=north v=1", "tank =2 5", "tank,site= v=1", "tank,=x v=1", "tank v=abc", "tank v=1 2 3", "tank v=1,v", "tank v=99999999999999999999i", "tank v=1 99999999999999999999", 'tank v="open 1'])
def test_bad_lines(spark, bad):
    with pytest.raises(Exception, match="not line protocol"):
        parse(spark, bad)
    assert len(parse(spark, bad, "tank v=1", strict=False)) == 1


def test_json(spark):
    one = '{"measurement":"tank","tags":{"site":"pier 4"},"fields":{"level":-1.5,"pumps":12,"state":"low","open":true},"timestamp":1700000000123456789}'
    got = json_points.parse_json(lines(spark, f"[{one},{one}]", one, '{"points":[' + one + "," + one + "]}")).collect()
    assert len(got) == 5
    f = got[0]["fields"]
    assert (f["level"]["f"], f["pumps"]["f"], f["state"]["s"], f["open"]["b"]) == (-1.5, 12.0, "low", True) and got[0]["time_ns"] == 1700000000123456789
    r = json_points.parse_json(lines(spark, '{"time":"2023-11-14T22:13:20Z","measurement":"tank","fields":{"level":1}}')).collect()[0]
    assert r["time_ns"] == 1700000000000000000 and r["tags"] == {}
    bad = ["[1", '{"measurement":"tank","fields":{"level":null}}', '{"measurement":"tank"}', '{"measurement":"","fields":{"level":1}}']
    for b in bad:
        with pytest.raises(Exception, match="not a point"):
            json_points.parse_json(lines(spark, b)).collect()
    assert json_points.parse_json(lines(spark, *bad), strict=False).count() == 0


def csv(spark, tmp_path, text, **kw):
    p = tmp_path / "x.csv"
    p.write_text(text)
    return csv_points.read_csv(spark, str(p), **kw).collect()


def test_csv(spark, tmp_path):
    got = csv(spark, tmp_path, "site,level,time\npier 4,0.5,1700000000000000000\nnorth,8,1700000001\n", measurement="tank", tags=("site",))
    assert [r["time_ns"] for r in got] == [1700000000000000000, 1700000001000000000]
    assert got[0]["tags"] == {"site": "pier 4"} and got[0]["fields"]["level"]["f"] == 0.5 and got[1]["fields"]["level"]["i"] == 8
    got = csv(spark, tmp_path, "time,measurement,v\n5,tank,2\n6,pump,\n7,pump,off\n")
    assert [(r["measurement"], r["fields"]["v"]["type"]) for r in got] == [("tank", "integer"), ("pump", "string")]
    got = csv(spark, tmp_path, "false|7|word|2.5\n", measurement="m", header=False, delimiter="|")
    assert [got[0]["fields"][f"col{i}"]["type"] for i in range(4)] == ["boolean", "integer", "string", "float"]
    assert csv(spark, tmp_path, "time,v\n", measurement="m") == []


def test_times(spark):
    text = ["1700000000000000000", "1700000000000000", "1700000000000", "1700000000", "2023-11-14T22:13:20Z", "2023-11-14 22:13:20"]
    got = lines(spark, *text).select(written_time(F.col("value")).alias("t")).collect()
    assert [r["t"] for r in got] == [1700000000000000000] * 6
    assert [precision(p) for p in ("ns", "u", "ms", "s")] == [1, 1000, 10**6, 10**9]
    with pytest.raises(ValueError):
        precision("invalid")


def test_round_trips(spark):
    text = [r'a\ b,x\,y=1\=2 s="q\"\\",i=-5i,f=1.5,b=true 17', "m v=2 18"]
    points = line_protocol.parse_lines(lines(spark, *text))
    again = line_protocol.parse_lines(line_protocol.to_lines(points))
    assert sorted(map(str, points.collect())) == sorted(map(str, again.collect()))
    back = json_points.parse_json(json_points.to_json(points)).orderBy("time_ns").collect()
    assert back[0]["fields"]["s"]["s"] == 'q"\\' and back[0]["fields"]["i"]["f"] == -5.0 and back[0]["tags"] == {"x,y": "1=2"}


def test_wide_types(spark):
    df, tags, fields = wide(line_protocol.parse_lines(lines(spark, "m,t=a v=1i 1", "m v=2.5,w=1i 2")), "m")
    assert (tags, fields, dict(df.dtypes)["v"], dict(df.dtypes)["w"]) == (("t",), ("v", "w"), "double", "bigint")
    with pytest.raises(ValueError, match="types"):
        wide(line_protocol.parse_lines(lines(spark, "m v=1i 1", 'm v="x" 2')), "m")


def test_shards_are_pruned(spark, tmp_path):
    rows = [(datetime(2024, 1, 1 + i % 5, i % 24), "h", float(i)) for i in range(50)]
    store.write_table(spark.createDataFrame(rows, "time timestamp_ntz, host string, v double"), str(tmp_path / "t"), tags=("host",))
    m = store.read_table(spark, str(tmp_path / "t"), "t", ("host",), ("v",))
    df = Query(m).time_range("2024-01-03", "2024-01-03T23:59:59", shard_width="1d").run()
    assert df.count() == 10 and len(df.inputFiles()) >= 1
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard_id" in plan


def test_catalog(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "w"))
    c.create_database("db")
    with pytest.raises(ValueError):
        c.create_database("db")
    c.create_database("db", if_not_exists=True)
    c.write_lines("db", lines(spark, "cpu,host=a v=1 1704067200000000000", "cpu,host=b v=2 1704067260000000000", "mem used=5i 1704067200000000000"))
    c.write_lines("db", lines(spark, "cpu,host=a,dc=x v=3 1704153600000000000"))
    assert c.measurements("db") == ["cpu", "mem"] and c.tag_keys("db") == ["dc", "host"] and c.field_keys("db", "mem") == ["used"]
    assert Query(c.measurement("db", "cpu")).agg(("sum", "v", "s")).run().collect()[0]["s"] == 6.0
    assert c.all_points("db").count() == 4
    c.drop_measurement("db", "mem")
    assert c.measurements("db") == ["cpu"]
    with pytest.raises(KeyError):
        c.measurement("db", "mem")
    c.drop_database("db")
    assert c.databases() == []


def test_series_json(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1), "a", 1.0), (datetime(2024, 1, 2), "a", None)], "time timestamp_ntz, host string, v double")
    got = series_json(df, "cpu", ("host",)).collect()[0]["series"]
    assert '"name":"cpu"' in got and '"tags":{"host":"a"}' in got and got.index("2024-01-01") < got.index("2024-01-02")


def test_series_json_in_chunks(spark):
    rows = [(NOW + timedelta(seconds=i * 7 % 1000), "a" if i % 10 else None, float(i)) for i in range(1000)]
    df = spark.createDataFrame(rows, "time timestamp_ntz, host string, v double").repartition(5)
    got = [json.loads(r["series"]) for r in series_json(df, "cpu", ("host",), points=64).collect()]
    assert max(len(c["values"]) for c in got) <= 64 and len(got) >= 16 and len({c["chunk"] for c in got if c["tags"].get("host")}) >= 15
    for host in ("a", None):
        mine = sorted((c for c in got if c["tags"].get("host") == host), key=lambda c: c["chunk"])
        found = [(v["time"], v["v"]) for c in mine for v in c["values"]]
        assert found == sorted((t.isoformat(timespec="microseconds") + "Z", v) for t, h, v in rows if h == host)


def test_files_by_kind(spark, tmp_path):
    """A measurement's range goes out and comes back in each format, by the file's name."""
    rows = [(NOW + timedelta(hours=i), "a b" if i % 2 else None, i / 2, f'say "{i}", x') for i in range(10)]
    m = Measurement(spark.createDataFrame(rows, "time timestamp_ntz, `old.site` string, v double, `state now` string"), "time", ("old.site",), ("v", "state now"), (), "tank")
    want = sorted((t, s, v, n) for t, s, v, n in rows if NOW + timedelta(hours=2) <= t <= NOW + timedelta(hours=7))
    for name in ("x.lp", "x.JSON", "x.csv"):
        transfer.export(m, str(tmp_path / name), start=NOW + timedelta(hours=2), end=NOW + timedelta(hours=7))
        kw = {"tags": ("old.site",)} if name == "x.csv" else {"kind": "jsonl"} if name == "x.JSON" else {}
        got = transfer.read_points(spark, str(tmp_path / name), **kw)
        number = lambda f: f["f"] if f["f"] is not None else float(f["i"])
        assert sorted((r["time"], r["tags"].get("old.site"), number(r["fields"]["v"]), r["fields"]["state now"]["s"]) for r in got.collect()) == want
    one = tmp_path / "one.json"
    one.write_text('[\n {"measurement": "tank",\n "fields": {"v": 1}, "timestamp": 5}\n]')
    assert transfer.read_points(spark, str(one)).count() == 1 and transfer.kind_of("a/b.csv.gz") == "csv"
    with pytest.raises(ValueError):
        transfer.export(m, str(tmp_path / "y"), kind="xml")


def test_csv_of_results(spark):
    df = spark.createDataFrame([(NOW, 'a "b"', None, True, 2.5)], "time timestamp_ntz, s string, n long, b boolean, f double")
    assert header(df) == "time,s,n,b,f" and csv_rows(df).collect()[0][0] == '1704067200000000000,"a \\"b\\"",,true,2.5'
