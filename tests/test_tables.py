import datetime as dt

import pytest

from wattframe.config import load_config, project_config, resolve_script
from wattframe.errors import DataProblem, NameProblem, WattError
from wattframe.network import sample
from wattframe.plans.compiler import execute
from wattframe.sources.tables import connection, has_password, read_folder, read_mapped, redact
from wattframe.streaming.switching import follow, operations

MAPPING = """
[substations]
file = "station.csv"
mrid = "SUB-{no}"
name = "title"
voltage = { column = "volts", unit = "V" }
[[devices]]
file = "switch.csv"
mrid = "ID"
type = { column = "kind", values = { BKR = "breaker", LBS = "switch" } }
feeder = "FDR-{circuit}"
substation = { value = "SUB-1" }
state = { column = "pos", values = { o = "OPEN", c = "CLOSED" }, default = "CLOSED" }
from_node = "a"
to_node = "b"
[[devices]]
file = "load.parquet"
mrid = "id"
type = { value = "load" }
feeder = "FDR-{circuit}"
kw = { column = "demand", unit = "W" }
from_node = "a"
[connections]
file = "wire.csv"
from_device = "x"
to_device = "y"
"""


def values(net, text):
    return execute(net, text).rows()


def test_mapped_tables(spark, tmp_path):
    (tmp_path / "station.csv").write_text("no,title,volts\n1,Hill,13800\n")
    (tmp_path / "switch.csv").write_text("ID,kind,circuit,pos,a,b,crew\nB1,BKR,7,C,n0,n1,x\nS1,LBS,7,O,n1,n2,\nB1,LBS,7,O,n9,n9,\n,LBS,7,O,n9,n9,\nQ,odd,,,n1,n5,z\n")
    (tmp_path / "wire.csv").write_text("x,y\nS1,B1\nS1,nothing\n")
    spark.createDataFrame([("L1", 7, "5000", "n2", 2020), ("L2", 7, "2kW", "n1", None), ("L3", 7, "3kV", "n1", 1)], "id string, circuit int, demand string, a string, year int").write.parquet(f"{tmp_path}/load.parquet")
    net = read_folder(spark, str(tmp_path), MAPPING)
    assert values(net, "FIND devices SELECT mrid, type, feeder, state, kw, crew, year, depth, energized") == [
        {"mrid": "B1", "type": "breaker", "feeder": "FDR-7", "state": "CLOSED", "kw": None, "crew": "x", "year": None, "depth": 0, "energized": True},
        {"mrid": "L1", "type": "load", "feeder": "FDR-7", "state": None, "kw": 5.0, "crew": None, "year": 2020, "depth": 2, "energized": False},
        {"mrid": "L2", "type": "load", "feeder": "FDR-7", "state": None, "kw": 2.0, "crew": None, "year": None, "depth": 1, "energized": True},
        {"mrid": "L3", "type": "load", "feeder": "FDR-7", "state": None, "kw": None, "crew": None, "year": 1, "depth": 1, "energized": True},
        {"mrid": "Q", "type": "device", "feeder": None, "state": None, "kw": None, "crew": "z", "year": None, "depth": None, "energized": True},
        {"mrid": "S1", "type": "switch", "feeder": "FDR-7", "state": "OPEN", "kw": None, "crew": None, "year": None, "depth": 1, "energized": True},
    ]
    assert values(net, "FIND feeders SELECT mrid, substation, voltage") == [{"mrid": "FDR-7", "substation": "SUB-1", "voltage": 13.8}]
    assert sorted(net.notes) == ["1 connections with an unknown end", "1 rows that repeat an mrid", "1 rows without mrid", "1 values of kw are no quantity"]


def test_mapping_problems(spark):
    df = spark.range(1)
    with pytest.raises(NameProblem):
        read_mapped(spark, '[devices]\nmrid = "idd"\n', lambda rule: df)
    with pytest.raises(NameProblem):
        read_mapped(spark, '[devices]\nmrid = "id"\ncolour = "id"\n', lambda rule: df)
    with pytest.raises(DataProblem):
        read_mapped(spark, '[things]\nmrid = "id"\n', lambda rule: df)


def test_connections():
    assert connection("postgresql://u:p%40@h:5/d?sslmode=require") == ("jdbc:postgresql://h:5/d", {"user": "u", "password": "p@", "sslmode": "require"})
    assert connection("host=h dbname=d user=u password='a b'") == ("jdbc:postgresql://h:5432/d", {"user": "u", "password": "a b"})
    assert redact("postgresql://u:p@h/d") == "postgresql://u:***@h/d" and redact("host=h password=x") == "host=h password=***"
    assert has_password("password=x") and not has_password("postgresql://u@h/d")


def test_switching(spark, tmp_path):
    net, kind = sample(spark), "mrid string, state string, at timestamp"
    put = lambda rows: spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    run = lambda: follow(net, spark.readStream.schema(kind).parquet(f"{tmp_path}/events"), f"{tmp_path}/out").awaitTermination(120)
    live = lambda n: {r.mrid for r in spark.read.parquet(f"{tmp_path}/out/energized/batch={n}").where("energized").collect()}
    t = dt.datetime(2024, 1, 1)
    put([("SW-002", "closed", t + dt.timedelta(hours=2)), ("SW-002", "OPEN", t), (None, "OPEN", t), ("SW-001", "odd", t)])
    run()
    assert {"LOAD-002", "LOAD-001"} <= live(0)
    put([("REC-001", "OPEN", t), ("SW-002", "OPEN", t + dt.timedelta(hours=1))])  # the second is late and changes nothing
    run()
    assert live(1) == {"BRK-001", "LN-001", "REC-001", "FDR-104"}
    assert {(r.mrid, r.state) for r in spark.read.parquet(f"{tmp_path}/out/states/batch=1").collect()} == {("SW-002", "CLOSED"), ("REC-001", "OPEN")}
    rows = operations(spark.read.parquet(f"{tmp_path}/events")).where("mrid is not null").groupBy("mrid").agg({"n": "sum", "opened": "sum"}).orderBy("mrid").collect()
    assert [(r.mrid, r["sum(n)"], r["sum(opened)"]) for r in rows] == [("REC-001", 1, 1), ("SW-001", 1, 0), ("SW-002", 3, 2)]


def test_config(tmp_path, monkeypatch):
    (tmp_path / "project.wattframe").write_text('name = "x"\ncsv = "data"\nqueries = "q"\n[params]\nfeeder = "F"\n')
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "loads.wq").write_text("FIND loads")
    monkeypatch.chdir(tmp_path / "q")
    c = project_config()
    assert c.csv == f"{tmp_path}/data" and c.params == {"feeder": "F"}
    monkeypatch.chdir("/")
    assert resolve_script(c, "loads") == f"{tmp_path}/q/loads.wq"
    with pytest.raises(WattError):
        resolve_script(c, "none")
    for text in ('colour = "x"', 'db = "a"\ncsv = "b"', "name = 3", "params = 3", "="):
        (tmp_path / "bad").write_text(text)
        with pytest.raises(WattError):
            load_config(f"{tmp_path}/bad")


def test_typed_values_as_text(spark):
    from pyspark.sql import functions as F

    from wattframe.sources.tables import plain_text

    numbers = [12345678.0, 0.0005, -1.5e-7, 1e16, 123456789.25, -3.0, 1e22, 1.25e20, 99999999999.5, 0.001, 1e7]
    want = ["12345678.0", "0.0005", "-0.00000015", "10000000000000000", "123456789.25", "-3.0", "10000000000000000000000", "125000000000000000000", "99999999999.5", "0.001", "10000000.0"]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    assert [r[0] for r in df.select(plain_text(F.col("x"), "double")).collect()] == want
    one = spark.sql("select timestamp'2024-01-02 03:04:05' as t, date'2024-01-02' as d, binary('ab') as b, array(1, 2) as a, true as f, cast(1.50 as decimal(9, 2)) as n, double('nan') as x")
    assert list(one.select(*(plain_text(F.col(c), t) for c, t in one.dtypes)).first()) == ["2024-01-02T03:04:05", "2024-01-02", "6162", "[1,2]", "true", "1.50", "NaN"]


def test_quantities_of_doubles_are_not_lost(spark, tmp_path):
    spark.createDataFrame([(12345678.0, 12345678.0), (7.0, 0.0005)], "id double, kw double").write.parquet(str(tmp_path / "load.parquet"))
    net = read_folder(spark, str(tmp_path), """
[[devices]]
file = "load.parquet"
mrid = "L-{id}"
type = { value = "load" }
kw = { column = "kw", unit = "kW" }
""")
    assert sorted((r.mrid, r.kw) for r in net.objects.where("is_device").collect()) == [("L-12345678.0", 12345678.0), ("L-7.0", 0.0005)]
