import io

import pandas as pd
import pytest
from pyspark.sql import functions as F

from weirflow import dialect, statement, validate
from weirflow.catalog import Catalog, Source
from weirflow.engine import Engine
from weirflow.functions.builtin import FunctionError, Registry, build_record, flatten, nested_field
from weirflow.operators.stream import Stream
from weirflow.operators.tables import Cache, LocalTable, Retry, lookup_join
from weirflow.shell import Shell
from weirflow.sources import connectors
from weirflow.streaming.triggers import Trigger, tumbling_with_trigger
from weirflow.testing import Runner, contains_in_any_order, contains_in_order


def test_statement_is_split():
    s = statement.parse("INSERT INTO a.b (x) SELECT x FROM sys.t.`$table` AS t JOIN (SELECT substring(y FROM 2) z FROM sys.u) ON 1 = 1;;")
    assert s.sink == "a.b" and s.sources == ("sys.t.$table", "sys.u")
    for bad in ("SELECT 1", "INSERT INTO a DELETE FROM b"):
        with pytest.raises(statement.StatementError):
            statement.parse(bad)


def test_sql_file_and_json():
    assert statement.from_file("-- c\ninsert into a\nselect 1;\ninsert into b select 2") == ["insert into a select 1", "insert into b select 2"]
    assert statement.from_json('["x", "y"]') == ["x", "y"]
    with pytest.raises(statement.StatementError):
        statement.from_file("select 1")


def test_dialect_leaves_strings_alone():
    assert dialect.rewrite("select 'ARRAY[1] SIMILAR TO' -- ROW(1)") == "select 'ARRAY[1] SIMILAR TO' -- ROW(1)"
    assert dialect.divided("a * b / c + '/'", [(0, 8)]) == "a * b  div  c + '/'"
    assert dialect.similar_to_regex("a%_[b%]") == "(?s)^(?:a.*.[b%])$"
    assert dialect.similar_to_regex("a.c!%", "!") == r"(?s)^(?:a\.c%)$"


def test_joins_are_found():
    found = statement.joins("SELECT * FROM sys.a.`$table` x LEFT JOIN sys.b AS y ON x.k = y.k AND 1 = 1 JOIN sys.c ON y.k = sys.c.k WHERE 1 = 1")
    assert found == [("sys.a.$table", "sys.b", "left", "x . k = y . k AND 1 = 1"), ("sys.a.$table", "sys.c", "inner", "y . k = sys . c . k")]
    assert [x[:3] for x in statement.joins("SELECT * FROM a, b")] == [("a", "b", "cross")]


def test_engine_rules(spark):
    """Integer division by types, newlines in SIMILAR TO, one Flatten a SELECT, no third column of a name, carets, strict joins."""
    from pyspark.errors import AnalysisException

    c = Catalog()
    c.add("s", Source(read=lambda s: s.createDataFrame([(7, 2, "a\nc", ["x"], ["y"])], "a int, b int, t string, l array<string>, m array<string>")))
    engine = Engine(spark, c)
    one = lambda sql: tuple(engine.query(sql).first())
    assert one("SELECT a / b AS q, a / 2.0 AS r, -a / b * 2 AS u, (SELECT max(a / b) FROM s) AS v FROM s") == (3, 3.5, -6, 3)
    assert one("SELECT t SIMILAR TO 'a_c' AS x, t SIMILAR TO 'a.c' AS y, TRUNCATE(0.29D, 2) AS z, TRUNCATE(-1.55D, 1) AS w, INITCAP('heLLo wORLD-foo') AS i FROM s") == (True, False, 0.29, -1.5, "Hello World-Foo")
    with pytest.raises(dialect.DialectError):
        engine.query("SELECT Flatten(l) AS x, Flatten(m) AS y FROM (SELECT * FROM s)")
    assert engine.query("SELECT Flatten(x) AS y FROM (SELECT Flatten(ARRAY[l]) AS x FROM s)").first()[0] == "x"
    with pytest.raises(dialect.DialectError):
        engine.query("SELECT a, b AS a, 3 AS a FROM s")
    with pytest.raises(AnalysisException) as e:
        engine.query("SELECT nothing FROM s")
    assert "^^^^^^^" in "".join(e.value.__notes__)
    c.add("out", Source(write=lambda df: df))
    assert Engine(spark, c).run("INSERT INTO out SELECT x.a FROM s x JOIN s y ON x.a = y.a").count() == 1
    with pytest.raises(validate.ValidationError):
        Engine(spark, c, strict=True).run("INSERT INTO out SELECT x.a FROM s x JOIN s y ON x.a = y.a")


def test_updates_of_a_key(spark, tmp_path):
    """Several updates of a key leave one row of it, by the greatest."""
    table = LocalTable(spark, f"{tmp_path}/t", "k int, v int", ("k",))
    table.put_all(spark.createDataFrame([(1, 1), (2, 2)], "k int, v int"))
    table.update_all(spark.createDataFrame([(1, 5), (1, 9), (3, 7)], "k int, v int"))
    assert sorted(map(tuple, table.read().collect())) == [(1, 9), (2, 2)]


def test_flatten_rows(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "id int, v array<string>")
    contains_in_any_order(flatten(df, "v"), [(1, "a"), (1, "b"), (3, None)])


def test_nested_field(spark):
    df = spark.createDataFrame([(1,)], "x int").select(build_record("a", F.array(F.lit(1), F.lit(2)), "m", F.create_map(F.lit("k"), F.lit(5))).alias("r"))
    contains_in_order(df.select(nested_field(df, "r", "a[1]"), nested_field(df, "r", "m.k"), nested_field(df, "r", "m.q")), [(2, 5, None)])
    with pytest.raises(FunctionError):
        nested_field(df, "r", "none")
    with pytest.raises(FunctionError):
        build_record("a")


def test_validator(spark):
    r = Runner(spark).source("s.t", [(1, "a")], "id int, name string").sink("o.x", schema=spark.createDataFrame([], "id bigint, name string").schema)
    r.run("INSERT INTO o.x SELECT id, name FROM s.t")
    contains_in_any_order(r.written["o.x"][0], [(1, "a")])
    for bad in ("SELECT id FROM s.t", "SELECT id, name, 1 AS z FROM s.t", "SELECT name AS id, name FROM s.t"):
        with pytest.raises(validate.ValidationError):
            r.run(f"INSERT INTO o.x {bad}")
    assert validate.underline("select x", 1, 8).split("\n")[1] == "-------^"


@pytest.mark.parametrize(("left", "right", "how", "on"), [("s.a", "s.b", "inner", "x = y"), ("s.a", "s.b.$table", "full", "x = y"), ("s.a", "s.b.$table", "inner", ""), ("s.a.$table", "s.b", "left", "x = y"), ("s.a", "s.b.$table", "inner", "x < y")])
def test_strict_joins(left, right, how, on):
    c = Catalog({"s.a": Source(), "s.b": Source()})
    with pytest.raises(validate.ValidationError):
        validate.strict_join(c, left, right, how, on)
    validate.strict_join(c, "s.a", "s.b.$table", "left", "a = b")


def test_null_keys_and_star(spark):
    r = Runner(spark).source("s.v", [(i, None if i % 2 == 0 else i) for i in range(10)], "id int, fk int").source("s.c", [(i, f"n{i}") for i in range(10)], "cid int, name string", key=("cid",)).sink("o.x")
    r.run("INSERT INTO o.x SELECT id, name FROM s.v JOIN s.c.`$table` ON fk = cid", "INSERT INTO o.x SELECT id, name FROM s.v LEFT JOIN s.c.`$table` ON fk = cid")
    assert r.written["o.x"][0].count() == 5 + 10
    assert Engine(spark, r.catalog).query("SELECT * FROM s.c").columns[0] == "__key__"


def test_udf_overloads(spark):
    reg = Registry()
    reg.udf("f", ("string",), "string")(lambda x: x + "!")
    df = spark.createDataFrame([("a", 1.0)], "s string, d double")
    contains_in_order(df.select(reg.call(df, "F", "s")), [("a!",)])
    with pytest.raises(FunctionError):
        reg.call(df, "f", "d")


def test_local_table(spark, tmp_path):
    t = LocalTable(spark, f"file://{tmp_path}/t", "id int, v string", ("id",))
    assert t.get(id=1) is None
    t.put_all(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"))
    t.put_all(spark.createDataFrame([(2, "c", 1), (2, "d", 2)], "id int, v string, n int"), order="n")
    assert t.get(id=2)["v"] == "d"
    t.update_all(spark.createDataFrame([(1, "z"), (9, "y")], "id int, v string"))
    contains_in_any_order(t.read(), [(1, "z"), (2, "d")])
    t.delete_all(spark.createDataFrame([(1,)], "id int"))
    contains_in_any_order(t.read(), [(2, "d")])


class _Remote:
    def __init__(self):
        self.calls = 0

    def get_many(self, keys):
        self.calls += 1
        if self.calls == 1:
            raise OSError("once")
        return {k: {"name": f"n{k}"} for k in keys if k != 3}


def test_lookup_join(spark):
    df = spark.createDataFrame([(1, 1), (2, None), (3, 3), (4, 1)], "id int, k int")
    contains_in_any_order(lookup_join(df, "k", _Remote, "name string", retry=Retry(3, 0.001), limit=1e6, cache=Cache()).select("id", "name"), [(1, "n1"), (4, "n1")])
    assert lookup_join(df, "k", _Remote, "name string", how="left", retry=Retry(3, 0.001)).count() == 4


def test_async_flat_map(spark):
    s = Stream(spark.createDataFrame([(1,), (2,)], "x long")).flat_map_async(lambda r: [{"y": r["x"]}] * int(r["x"]), "y long")
    contains_in_any_order(s.df, [(1,), (2,), (2,)])


def _stream(spark, tmp_path, rows):
    folder = tmp_path / "in"
    folder.mkdir()
    for k, batch in enumerate(rows):
        pd.DataFrame(batch, columns=["u", "ts", "v"]).astype({"ts": "datetime64[us]"}).to_parquet(folder / f"{k}.parquet")
    return spark.readStream.schema("u string, ts timestamp_ntz, v double").option("maxFilesPerTrigger", 1).parquet(str(folder)).withColumn("ts", F.col("ts").cast("timestamp"))


@pytest.mark.parametrize("discarding", [False, True])
def test_early_trigger(spark, tmp_path, discarding):
    t = pd.Timestamp("2024-01-01")
    rows = [[("a", t + pd.Timedelta(seconds=i), 1.0) for i in range(5)], [("a", t + pd.Timedelta(minutes=5), 1.0)], [("a", t + pd.Timedelta(minutes=9), 1.0)]]
    out = tumbling_with_trigger(_stream(spark, tmp_path, rows), "u", "ts", "v", 60_000, Trigger(count=2, repeat=True), discarding=discarding)
    name = f"panes_{discarding}".lower()
    q = out.writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = [(r["count"], r["firing"]) for r in spark.table(name).where("window_start = timestamp'2024-01-01 00:00:00'").collect()]
    assert sorted(got) == sorted([(2, "EARLY"), (2, "EARLY"), (1, "DEFAULT")] if discarding else [(2, "EARLY"), (4, "EARLY"), (5, "DEFAULT")])


def test_stream_equals_batch(spark, tmp_path):
    t = pd.Timestamp("2024-01-01")
    rows = [[("a", t + pd.Timedelta(hours=i), 1.0) for i in range(48)], [("a", t + pd.Timedelta(days=9), 1.0)]]
    s = Stream(_stream(spark, tmp_path, rows)).tumbling("ts", "1 day", "u", n=F.count("*"))
    q = s.df.writeStream.format("memory").queryName("days").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["n"] for r in spark.table("days").collect()) == [24, 24]


def test_connectors(spark, tmp_path):
    if not connectors.available(spark, "kafka"):
        with pytest.raises(connectors.ConnectorUnavailable):
            connectors.kafka_read(spark, "x:1", "t")
    df = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "id int, d string")
    connectors.directory_write(df, str(tmp_path / "o"), date_column="d", rows_per_file=1)
    assert connectors.directory_read(spark, str(tmp_path / "o")).count() == 2
    shown = []
    connectors.console_write(df, shown.append)
    assert len(shown) == 2


def test_shell(spark, tmp_path):
    r = Runner(spark).source("s.t", [(1, "a")], "id int, name string").sink("o.x")
    out = io.StringIO()
    sh = Shell(Engine(spark, r.catalog), stdout=out)
    (tmp_path / "f.sql").write_text("-- c\ninsert into o.x\nselect id from s.t;\n")
    for line in ("SHOW TABLES;", "SHOW FUNCTIONS", "DESCRIBE s.t", "SELECT id, name FROM s.t", "INSERT INTO o.x SELECT id FROM s.t", f"EXECUTE {tmp_path}/f.sql", "LS", "RM 1", "SET a=b", "SET", "VERSION", "SELECT nope FROM s.t"):
        sh.onecmd(line)
    text = out.getvalue()
    assert "s.t" in text and "regexmatch" in text and "name string" in text and "'name': 'a'" in text and "a=b" in text and "AnalysisException" in text
    assert sh.onecmd("EXIT")
