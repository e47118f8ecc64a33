"""Queries of the engine's own operators with the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weirflow.catalog import Catalog, Source
from weirflow.engine import Engine
from weirflow.functions.builtin import Registry, build_record, flatten, nested_field, regex_match
from weirflow.operators.stream import Stream

#: Tables with their key (fixed values).
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id", "embeddings": "vec_id"}


def catalog(sf_dir: str, sink: Callable[[DataFrame], object] = lambda df: df) -> Catalog:
    """The driver's tables as ``sys.<table>``, and sinks ``out.<name>`` that give the rows written."""
    out = Catalog()
    for t, key in KEYS.items():
        out.add(f"sys.{t}", Source(read=lambda spark, t=t: spark.read.parquet(f"{sf_dir}/{t}.parquet"), key=(key,)))
    out.add("out.rows", Source(write=sink))
    return out


def _insert(select: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Engine(spark, catalog(sf_dir)).run(f"INSERT INTO out.rows {select}")


def _table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: name: (statement's SELECT, DuckDB SQL or None if it is the same but for the names of sources)
SELECTS: dict[str, tuple[str, str | None]] = {
    "join_insert_enriched": ("SELECT o.o_orderkey, c.c_name FROM sys.orders AS o JOIN sys.customer.`$table` AS c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 100000", "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where o_totalprice > 100000"),
    "project_expressions": ("SELECT o_orderkey, o_orderkey + 1 AS up, -o_orderkey AS neg, o_custkey * 2 AS dbl FROM sys.orders", None),
    "filter_compare": ("SELECT l_orderkey, l_linenumber FROM sys.lineitem WHERE l_quantity >= 10 AND l_quantity < 20 AND l_linenumber <> 3 OR l_quantity = 50", None),
    "filter_is_true": ("SELECT o_orderkey FROM sys.orders WHERE (o_totalprice > 1000) IS TRUE AND (o_orderstatus = 'F') IS NOT FALSE", None),
    "filter_is_not_true": ("SELECT o_orderkey FROM sys.orders WHERE (nullif(o_orderstatus, 'F') = 'O') IS NOT TRUE", None),
    "filter_null": ("SELECT o_orderkey FROM sys.orders WHERE nullif(o_orderstatus, 'F') IS NULL OR nullif(o_orderstatus, 'P') IS NOT NULL", None),
    "filter_in": ("SELECT o_orderkey FROM sys.orders WHERE o_orderstatus IN ('F', 'P') AND o_custkey NOT IN (1, 2, 3)", None),
    "filter_like": ("SELECT p_partkey, p_name FROM sys.part WHERE p_name LIKE '%a%' AND p_name NOT LIKE 'z%'", None),
    "filter_similar_to": ("SELECT p_partkey FROM sys.part WHERE p_type SIMILAR TO '(%)(A|E)(%)'", "select p_partkey from part where p_type similar to '(.*)(A|E)(.*)'"),
    "filter_not_similar_to": ("SELECT p_partkey FROM sys.part WHERE p_type NOT SIMILAR TO '%(A|E)%'", "select p_partkey from part where p_type not similar to '.*(A|E).*'"),
    "filter_regex_match": ("SELECT p_partkey FROM sys.part WHERE RegexMatch('.*e.*?', p_name)", "select p_partkey from part where regexp_full_match(p_name, '.*e.*?')"),
    "case_in": ("SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN 'known' ELSE NULL END AS st FROM sys.orders", None),
    "coalesce": ("SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'N/A') AS st FROM sys.orders", None),
    "math_mod": ("SELECT o_orderkey, mod(-o_orderkey, 7) AS m, -o_orderkey % 5 AS n FROM sys.orders", None),
    "math_int_div": ("SELECT o_orderkey, o_orderkey div 7 AS q FROM sys.orders", "select o_orderkey, o_orderkey // 7 as q from orders"),
    "math_power_sqrt": ("SELECT o_orderkey, round(power(o_orderkey % 100, 2), 2) AS p, round(sqrt(o_orderkey), 4) AS s FROM sys.orders", None),
    "math_round": ("SELECT l_orderkey, l_linenumber, round(l_extendedprice, 1) AS t FROM sys.lineitem", None),
    "math_floor_ceil": ("SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice) AS BIGINT) AS f, CAST(ceil(l_extendedprice) AS BIGINT) AS c FROM sys.lineitem", None),
    "math_truncate": ("SELECT l_orderkey, l_linenumber, TRUNCATE(l_extendedprice, 1) AS t FROM sys.lineitem", "select l_orderkey, l_linenumber, trunc(cast(l_extendedprice as decimal(18, 6)) * 10) / 10 as t from lineitem"),
    "string_concat": ("SELECT c_custkey, c_name || '-' || c_mktsegment AS s FROM sys.customer", None),
    "string_overlay": ("SELECT p_partkey, overlay(p_name placing 'ZZ' from 2 for 2) AS o FROM sys.part", "select p_partkey, substr(p_name, 1, 1) || 'ZZ' || substr(p_name, 4) as o from part"),
    "string_position": ("SELECT p_partkey, CAST(position('a' IN p_name) AS BIGINT) AS i FROM sys.part", None),
    "string_length": ("SELECT p_partkey, CAST(character_length(p_name) AS BIGINT) AS n, CAST(char_length(p_type) AS BIGINT) AS m FROM sys.part", "select p_partkey, length(p_name) as n, length(p_type) as m from part"),
    "string_initcap": ("SELECT p_partkey, initcap(p_name) AS i FROM sys.part", "select p_partkey, list_aggregate(list_transform(regexp_extract_all(p_name, '[a-zA-Z0-9]+|[^a-zA-Z0-9]+'), lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', '') as i from part"),
    "string_substring": ("SELECT p_partkey, substring(p_name FROM 2 FOR 3) AS s, substring(p_name, 4) AS t FROM sys.part", None),
    "string_replace": ("SELECT p_partkey, replace(p_name, 'a', '_') AS s FROM sys.part", None),
    "string_trim": ("SELECT p_partkey, trim(BOTH 'a' FROM p_name) AS s, trim(LEADING 'b' FROM p_name) AS l, trim(TRAILING 'e' FROM p_name) AS t FROM sys.part", "select p_partkey, trim(p_name, 'a') as s, ltrim(p_name, 'b') as l, rtrim(p_name, 'e') as t from part"),
    "string_upper_lower": ("SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS l FROM sys.part", None),
    "cast_bool": ("SELECT o_orderkey, upper(CAST(o_totalprice > 1000 AS STRING)) AS b FROM sys.orders", "select o_orderkey, upper(cast(o_totalprice > 1000 as varchar)) as b from orders"),
    "cast_number": ("SELECT o_orderkey, CAST(CAST(o_totalprice AS INT) AS STRING) AS b, convertToString(o_custkey) AS c FROM sys.orders", "select o_orderkey, cast(cast(trunc(o_totalprice) as int) as varchar) as b, cast(o_custkey as varchar) as c from orders"),
    "date_parts": (
        "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(quarter(o_orderdate) AS BIGINT) AS q, CAST(weekofyear(o_orderdate) AS BIGINT) AS w, CAST(dayofyear(o_orderdate) AS BIGINT) AS dy, CAST(dayofmonth(o_orderdate) AS BIGINT) AS dm, CAST(dayofweek(o_orderdate) AS BIGINT) AS dw FROM sys.orders",
        "select o_orderkey, year(o_orderdate) as y, month(o_orderdate) as m, quarter(o_orderdate) as q, weekofyear(o_orderdate) as w, dayofyear(o_orderdate) as dy, dayofmonth(o_orderdate) as dm, dayofweek(o_orderdate) + 1 as dw from orders",
    ),
    "date_time_parts": ("SELECT event_id, CAST(hour(ts) AS BIGINT) AS h, CAST(minute(ts) AS BIGINT) AS m, CAST(second(ts) AS BIGINT) AS s, CAST(extract(DAY FROM ts) AS BIGINT) AS d FROM sys.events", "select event_id, hour(ts) as h, minute(ts) as m, second(ts) as s, extract(day from ts) as d from events"),
    "date_timestampadd": ("SELECT event_id, timestampadd(HOUR, 5, ts) AS t FROM sys.events", "select event_id, ts + interval 5 hour as t from events"),
    "date_timestampdiff": ("SELECT event_id, timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', ts) AS h FROM sys.events", "select event_id, datesub('hour', timestamp '2024-01-01 00:00:00', ts) as h from events"),
    "date_floor": ("SELECT event_id, CAST(FLOOR(ts TO HOUR) AS TIMESTAMP_NTZ) AS t FROM sys.events", "select event_id, date_trunc('hour', ts) as t from events"),
    "array_item": ("SELECT vec_id, get(embedding, 0) AS a, CAST(cardinality(embedding) AS BIGINT) AS n FROM sys.embeddings", "select vec_id, embedding[1] as a, len(embedding) as n from embeddings"),
    "array_constructors": ("SELECT o_orderkey, ARRAY[o_orderkey, o_custkey][1] AS a, MAP['k', o_custkey]['k'] AS m, ROW(o_custkey, 1).col1 AS r, ELEMENT(ARRAY[o_custkey]) AS e FROM sys.orders WHERE ARRAY[o_orderkey] IS NOT EMPTY", "select o_orderkey, o_custkey as a, o_custkey as m, o_custkey as r, o_custkey as e from orders"),
    "map_access": ("SELECT event_id, from_json(props, 'map<string,int>')['k'] AS k FROM sys.events", "select event_id, cast(json_extract(props, '$.k') as int) as k from events"),
    "nested_record": ("SELECT o_orderkey, GetSqlField(s, 'a.b') AS v FROM (SELECT o_orderkey, BuildOutputRecord('a', BuildOutputRecord('b', o_custkey)) AS s FROM sys.orders)", "select o_orderkey, cast(o_custkey as varchar) as v from orders"),
    "flatten_array": ("SELECT p_partkey, Flatten(split(p_name, ' ')) AS w FROM sys.part", "select p_partkey, unnest(string_split(p_name, ' ')) as w from part"),
    "flatten_null": (
        "SELECT o_orderkey, Flatten(a) AS v FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN CAST(array() AS array<string>) ELSE array('x', 'y') END AS a FROM sys.orders)",
        "select o_orderkey, unnest(case when o_orderkey % 3 = 0 then [null] when o_orderkey % 3 = 1 then []::varchar[] else ['x', 'y'] end) as v from orders",
    ),
    "subquery_from": ("SELECT k FROM (SELECT o_orderkey AS k, o_custkey FROM sys.orders WHERE o_totalprice > 1000) WHERE k % 2 = 1", None),
    "join_inner": ("SELECT o.o_orderkey, c.c_name FROM sys.orders o JOIN sys.customer.`$table` c ON o.o_custkey = c.c_custkey", "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey"),
    "join_left_null": ("SELECT o_orderkey, c_name FROM (SELECT *, nullif(o_custkey % 2, 0) * o_custkey AS fk FROM sys.orders) o LEFT JOIN sys.customer.`$table` c ON o.fk = c.c_custkey", "select o_orderkey, c_name from (select *, nullif(o_custkey % 2, 0) * o_custkey as fk from orders) o left join customer c on o.fk = c.c_custkey"),
    "join_right": ("SELECT o.o_orderkey, c.c_custkey FROM sys.customer.`$table` c RIGHT JOIN sys.orders o ON o.o_custkey = c.c_custkey", "select o_orderkey, c_custkey from customer right join orders on o_custkey = c_custkey"),
    "join_three": ("SELECT o_orderkey, c_name, n_name FROM sys.orders o JOIN sys.customer.`$table` c ON o.o_custkey = c.c_custkey JOIN sys.nation.`$table` n ON c.c_nationkey = n.n_nationkey", "select o_orderkey, c_name, n_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey"),
    "join_on_key": ("SELECT o.o_orderkey, c.c_name FROM sys.orders o JOIN sys.customer.`$table` c ON c.__key__ = o.o_custkey", "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey"),
    "join_expression_keys": ("SELECT o.o_orderkey, c.c_name FROM sys.orders o JOIN sys.customer.`$table` c ON o.o_custkey + 1 = c.c_custkey + 1", "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey"),
    "join_composite": ("SELECT l.l_orderkey, l.l_linenumber, o.o_custkey FROM sys.lineitem l JOIN sys.orders.`$table` o ON l.l_orderkey = o.o_orderkey AND l.l_linenumber = o.o_orderkey % 7", "select l_orderkey, l_linenumber, o_custkey from lineitem join orders on l_orderkey = o_orderkey and l_linenumber = o_orderkey % 7"),
    "join_full": ("SELECT o_orderkey, c_custkey FROM sys.orders FULL JOIN sys.customer ON o_custkey = c_custkey AND c_custkey % 2 = 0", None),
    "join_semi": ("SELECT c_custkey FROM sys.customer c WHERE EXISTS (SELECT 1 FROM sys.orders o WHERE o.o_custkey = c.c_custkey)", None),
    "join_anti": ("SELECT c_custkey FROM sys.customer c WHERE NOT EXISTS (SELECT 1 FROM sys.orders o WHERE o.o_custkey = c.c_custkey)", None),
    "join_interval": ("SELECT l.event_id AS a, r.event_id AS b FROM sys.events l JOIN sys.events r ON l.user_id = r.user_id AND r.ts BETWEEN l.ts - INTERVAL 1 HOUR AND l.ts + INTERVAL 1 HOUR", None),
    "group_count": ("SELECT o_orderpriority, count(*) AS c FROM sys.orders WHERE o_orderstatus = 'F' OR o_orderstatus = 'O' GROUP BY o_orderpriority HAVING count(*) > 1", None),
    "group_aggregates": ("SELECT l_returnflag, l_linestatus, count(*) AS c, round(sum(l_quantity), 2) AS q, round(avg(l_extendedprice), 2) AS p, min(l_linenumber) AS lo, max(l_linenumber) AS hi FROM sys.lineitem GROUP BY l_returnflag, l_linestatus", None),
    "group_count_distinct": ("SELECT o_orderstatus, count(DISTINCT o_custkey) AS c FROM sys.orders GROUP BY o_orderstatus", None),
    "group_sum0": ("SELECT c_custkey, round(coalesce(sum(o_totalprice), 0), 2) AS s FROM sys.customer LEFT JOIN sys.orders ON o_custkey = c_custkey GROUP BY c_custkey", None),
    "group_rollup": ("SELECT l_returnflag, l_linestatus, count(*) AS c FROM sys.lineitem GROUP BY ROLLUP(l_returnflag, l_linestatus)", None),
    "group_cube": ("SELECT l_returnflag, l_linestatus, count(*) AS c FROM sys.lineitem GROUP BY CUBE(l_returnflag, l_linestatus)", None),
    "window_tumbling": ("SELECT TUMBLE_START(ts, INTERVAL '1' DAY) AS ws, event_type, count(*) AS c FROM sys.events GROUP BY TUMBLE(ts, INTERVAL '1' DAY), event_type", "select time_bucket(interval '1 day', ts) as ws, event_type, count(*) as c from events group by 1, 2"),
    "window_rank": ("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM sys.orders", None),
    "sort_limit": ("SELECT o_orderkey, o_totalprice FROM sys.orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100", None),
    "set_union": ("SELECT k FROM (SELECT o_orderkey AS k FROM sys.orders UNION SELECT l_partkey AS k FROM sys.lineitem)", None),
    "set_intersect": ("SELECT k FROM (SELECT o_orderkey AS k FROM sys.orders INTERSECT SELECT l_partkey AS k FROM sys.lineitem)", None),
    "set_except": ("SELECT k FROM (SELECT o_orderkey AS k FROM sys.orders EXCEPT SELECT l_partkey AS k FROM sys.lineitem)", None),
    "cast_varchar": ("SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS a, CAST(o_orderpriority AS VARCHAR(3)) AS b FROM sys.orders", "select o_orderkey, cast(o_orderkey as varchar) as a, o_orderpriority[:3] as b from orders"),
    "math_divide": ("SELECT o_orderkey, o_orderkey / 7 AS q, -o_orderkey * 2 / 3 AS r, o_orderkey / 2.0D AS h FROM sys.orders", "select o_orderkey, o_orderkey // 7 as q, cast(trunc(-o_orderkey * 2 / 3) as bigint) as r, o_orderkey / 2.0 as h from orders"),
    "math_signs": ("SELECT o_orderkey, +o_custkey AS p, o_orderkey - o_custkey AS d FROM sys.orders WHERE o_custkey <= 500", "select o_orderkey, o_custkey as p, o_orderkey - o_custkey as d from orders where o_custkey <= 500"),
    "filter_is_false": ("SELECT o_orderkey FROM sys.orders WHERE (nullif(o_orderstatus, 'F') = 'O') IS FALSE", None),
    "filter_is_empty": ("SELECT o_orderkey, CAST(cardinality(MULTISET[o_custkey, 1]) AS BIGINT) AS n FROM sys.orders WHERE filter(ARRAY[o_custkey], x -> x > 500) IS EMPTY", "select o_orderkey, cast(2 as bigint) as n from orders where not o_custkey > 500"),
    "filter_similar_signs": ("SELECT p_partkey FROM sys.part WHERE p_type || '.x$' SIMILAR TO '%(A|E)%.x!$' ESCAPE '!' AND NOT p_type SIMILAR TO '%.%'", "select p_partkey from part where p_type similar to '.*(A|E).*' and not contains(p_type, '.')"),
    "date_ceil": ("SELECT event_id, CAST(CEIL(ts TO DAY) AS TIMESTAMP_NTZ) AS t FROM sys.events", "select event_id, case when date_trunc('day', ts) = ts then ts else date_trunc('day', ts) + interval 1 day end as t from events"),
    "window_tumbling_end": ("SELECT TUMBLE_END(ts, INTERVAL '1' DAY) AS we, count(*) AS c FROM sys.events GROUP BY TUMBLE(ts, INTERVAL '1' DAY)", "select time_bucket(interval '1 day', ts) + interval 1 day as we, count(*) as c from events group by 1"),
    "group_sum_zero": ("SELECT c_custkey, $SUM0(o_orderkey) AS s FROM sys.customer LEFT JOIN sys.orders ON o_custkey = c_custkey GROUP BY c_custkey", "select c_custkey, cast(coalesce(sum(o_orderkey), 0) as bigint) as s from customer left join orders on o_custkey = c_custkey group by c_custkey"),
    "group_sets": ("SELECT l_returnflag, l_linestatus, count(*) AS c FROM sys.lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())", None),
    "group_stddev": ("SELECT l_returnflag, round(stddev_samp(l_quantity), 4) AS d, round(var_pop(l_quantity), 4) AS v FROM sys.lineitem GROUP BY l_returnflag", None),
    "array_query": ("SELECT r_regionkey, CAST(cardinality(ARRAY(SELECT n_nationkey FROM sys.nation)) AS BIGINT) AS n, MAP(SELECT n_nationkey, n_name FROM sys.nation)[3] AS m, CAST(cardinality(MULTISET(SELECT n_name FROM sys.nation)) AS BIGINT) AS k FROM sys.region", "select r_regionkey, (select count(*) from nation) as n, (select n_name from nation where n_nationkey = 3) as m, (select count(*) from nation) as k from region"),
    "from_unnest": ("SELECT p_partkey, w FROM sys.part p, UNNEST(split(p.p_name, ' ')) AS u(w)", "select p_partkey, unnest(string_split(p_name, ' ')) as w from part"),
    "from_comma": ("SELECT n_name, r_name FROM sys.nation n, sys.region r WHERE n.n_regionkey = r.r_regionkey", "select n_name, r_name from nation, region where n_regionkey = r_regionkey"),
    "table_query": ("TABLE sys.region", "select r_regionkey as __key__, * from region"),
    "values_rows": ("VALUES (1, 'a'), (2, 'b')", "select * from (values (1, 'a'), (2, 'b')) t(col1, col2)"),
    "join_literal": ("SELECT o.o_orderkey, c.c_custkey FROM sys.orders o JOIN sys.customer.`$table` c ON o.o_custkey = c.c_custkey AND c.c_nationkey = 3", "select o_orderkey, c_custkey from orders join customer on o_custkey = c_custkey and c_nationkey = 3"),
    "join_tables": ("SELECT c.c_custkey, n.n_name FROM sys.customer.`$table` c JOIN sys.nation.`$table` n ON c.c_nationkey = n.n_nationkey", "select c_custkey, n_name from customer join nation on c_nationkey = n_nationkey"),
    "join_table_kept": ("SELECT c.c_custkey, o.o_orderkey FROM sys.customer.`$table` c LEFT JOIN sys.orders o ON o.o_custkey = c.c_custkey", "select c_custkey, o_orderkey from customer left join orders on o_custkey = c_custkey"),
    "sort_offset": ("SELECT o_orderkey, o_totalprice FROM sys.orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 30", None),
    "latest_per_key": ("SELECT user_id, max(event_id) AS event_id FROM sys.events GROUP BY user_id", None),
}


def _plain(sql: str) -> str:
    return sql.replace("sys.", "").replace(".`$table`", "")


def _events(spark: SparkSession, sf_dir: str) -> Stream:
    return Stream(_table("events")(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")))


def fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, catalog(sf_dir)).run_all(["INSERT INTO out.rows SELECT o_orderkey AS k FROM sys.orders", "INSERT INTO out.rows SELECT l_orderkey AS k FROM sys.lineitem;"])[0]


def delete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Engine(spark, catalog(sf_dir)).run("INSERT INTO out.rows SELECT o.__key__ AS __key__, 'DELETE' AS __op__ FROM sys.orders o WHERE o_orderstatus = 'F'")
    return out.select(F.col("__key__").alias("k"), F.col("__op__").alias("op"))


def nested_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table("events")(spark, sf_dir).select("event_id", build_record("m", F.from_json("props", "map<string,int>"), "a", F.array("user_id", "event_id")).alias("r"))
    return df.select("event_id", nested_field(df, "r", "m.k").alias("k"), nested_field(df, "r", "a[1]").alias("e"))


def udf_overloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user-defined function with overloads: twice a number, twice a string's length."""
    registry = Registry()
    registry.udf("poly", ("bigint",), "bigint")(_twice)
    registry.udf("poly", ("string",), "bigint")(_twice_length)
    df = _table("customer")(spark, sf_dir).withColumn("c_custkey", F.col("c_custkey").cast("bigint"))
    return df.select("c_custkey", registry.call(df, "POLY", "c_custkey").alias("a"), registry.call(df, "poly", "c_name").alias("b"))


def udf_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An overloaded function in SQL: in SELECT, WHERE and ON."""
    registry = Registry()
    registry.udf("poly", ("bigint",), "bigint")(_twice)
    registry.udf("poly", ("string",), "bigint")(_twice_length)
    return Engine(spark, catalog(sf_dir), registry).run("INSERT INTO out.rows SELECT n.n_nationkey, poly(n.n_name) AS a, POLY(r.r_regionkey) AS b FROM sys.nation n JOIN sys.region.`$table` r ON poly(n.n_regionkey) = poly(r.r_regionkey) WHERE poly(n.n_name) > 10")


def checked_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sink with a schema: what is selected is held against it."""
    c = catalog(sf_dir)
    c.add("out.checked", Source(write=lambda df: df, schema=StructType.fromDDL("id bigint, name string, note string"), optional=frozenset({"note"})))
    return Engine(spark, c, strict=True).run("INSERT INTO out.checked SELECT CAST(o.o_orderkey AS BIGINT) AS id, c.c_name AS name FROM sys.orders o JOIN sys.customer.`$table` c ON o.o_custkey = c.c_custkey")


def _twice(x):
    return x * 2


def _twice_length(x):
    return x.str.len() * 2


def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog()
    c.add("sys.users", Source(read=lambda s: _table("events")(s, sf_dir), key=("user_id",), version_by=("ts", "event_id")))
    return Engine(spark, c).query("SELECT user_id, event_id FROM sys.users.`$table`")


#: name: (query, DuckDB SQL or None)
FRAMES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "sink_fan_in": (fan_in, "select o_orderkey as k from orders union all select l_orderkey as k from lineitem"),
    "sink_delete": (delete_rows, "select o_orderkey as k, 'DELETE' as op from orders where o_orderstatus = 'F'"),
    "nested_path": (nested_path, "select event_id, cast(json_extract(props, '$.k') as int) as k, event_id as e from events"),
    "udf_overloads": (udf_overloads, "select cast(c_custkey as bigint) as c_custkey, cast(c_custkey * 2 as bigint) as a, length(c_name) * 2 as b from customer"),
    "udf_in_sql": (udf_in_sql, "select n_nationkey, length(n_name) * 2 as a, cast(r_regionkey * 2 as bigint) as b from nation join region on n_regionkey = r_regionkey where length(n_name) * 2 > 10"),
    "sink_checked": (checked_sink, "select cast(o_orderkey as bigint) as id, c_name as name from orders join customer on o_custkey = c_custkey"),
    "table_latest": (latest_version, "select user_id, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) r from events) where r = 1"),
    "regex_column": (lambda s, d: _table("part")(s, d).where(regex_match(".*e.*?", F.col("p_name"))).select("p_partkey"), "select p_partkey from part where regexp_full_match(p_name, '.*e.*?')"),
    "flatten_frame": (lambda s, d: flatten(_table("part")(s, d).select("p_partkey", F.split("p_name", " ").alias("w")), "w"), "select p_partkey, unnest(string_split(p_name, ' ')) as w from part"),
    "stream_map_filter": (lambda s, d: Stream(_table("orders")(s, d)).map(o_orderkey=F.col("o_orderkey"), v=F.col("o_custkey") * 2).filter(F.col("v") > 100).df, "select o_orderkey, o_custkey * 2 as v from orders where o_custkey * 2 > 100"),
    "stream_flat_map": (lambda s, d: Stream(_table("part")(s, d)).flat_map(F.split("p_name", " "), "w", keep=("p_partkey",)).df, "select p_partkey, unnest(string_split(p_name, ' ')) as w from part"),
    "stream_merge": (lambda s, d: Stream.merge_all([Stream(_table("orders")(s, d)).map(k=F.col("o_orderkey")), Stream(_table("lineitem")(s, d)).map(k=F.col("l_orderkey"))]).df, "select o_orderkey as k from orders union all select l_orderkey as k from lineitem"),
    "stream_partition_by": (lambda s, d: Stream(_table("orders")(s, d)).partition_by("o_custkey", "o_totalprice").df.select(F.col("key").alias("k"), F.col("value").alias("v")), "select o_custkey as k, o_totalprice as v from orders"),
    "stream_join_table": (lambda s, d: Stream(_table("orders")(s, d)).join_table(_table("customer")(s, d), "o_custkey", "c_custkey").df.select("o_orderkey", "c_name"), "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey"),
    "stream_join_stream": (
        lambda s, d: _events(s, d).filter(F.col("event_type") == "click").join(_events(s, d).filter(F.col("event_type") == "purchase"), "user_id", "user_id", "ts", "1 hour").df.select(F.col("left.event_id").alias("a"), F.col("right.event_id").alias("b")),
        "select l.event_id as a, r.event_id as b from events l join events r on l.user_id = r.user_id and r.ts between l.ts - interval 1 hour and l.ts + interval 1 hour where l.event_type = 'click' and r.event_type = 'purchase'",
    ),
    "stream_tumbling_fold": (lambda s, d: _events(s, d).tumbling("ts", "1 day", "user_id", n=F.count("*"), v=F.round(F.sum("value"), 2)).df.select(F.col("window_start").cast("timestamp_ntz").alias("ws"), "user_id", "n", "v"), "select time_bucket(interval '1 day', ts) as ws, user_id, count(*) as n, round(sum(value), 2) as v from events group by 1, 2"),
    "stream_tumbling_collect": (lambda s, d: _events(s, d).tumbling("ts", "1 day", "user_id", rows=F.collect_list("event_id")).df.select(F.col("window_start").cast("timestamp_ntz").alias("ws"), "user_id", F.size("rows").cast("long").alias("n")), "select time_bucket(interval '1 day', ts) as ws, user_id, len(list(event_id)) as n from events group by 1, 2"),
    "stream_sliding": (lambda s, d: _events(s, d).tumbling("ts", "2 days", "event_type", slide="1 day", n=F.count("*")).df.select(F.col("window_start").cast("timestamp_ntz").alias("ws"), "event_type", "n"), "select ws, event_type, count(*) as n from (select unnest([time_bucket(interval '1 day', ts), time_bucket(interval '1 day', ts) - interval 1 day]) as ws, event_type from events) group by 1, 2"),
    "stream_session": (
        lambda s, d: _events(s, d).session("ts", "12 hours", "user_id", c=F.count("*")).df.select("user_id", F.col("window_start").cast("timestamp_ntz").alias("ss"), F.col("window_end").cast("timestamp_ntz").alias("se"), "c"),
        "select user_id, min(ts) as ss, max(ts) + interval 12 hours as se, count(*) as c from (select *, sum(n) over (partition by user_id order by ts rows unbounded preceding) g from (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 12 hours then 0 else 1 end n from events)) group by user_id, g",
    ),
    "stream_json_rows": (lambda s, d: _table("region")(s, d).select("r_regionkey", F.to_json(F.struct("r_name")).alias("j")), "select r_regionkey, '{\"r_name\":\"' || r_name || '\"}' as j from region"),
    "window_running_sum": (lambda s, d: _table("orders")(s, d).select("o_orderkey", F.round(F.sum("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)), 2).alias("t")), "select o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows unbounded preceding), 2) as t from orders"),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: _insert(v[0]) for k, v in SELECTS.items()} | {k: v[0] for k, v in FRAMES.items()}
ORACLE_SQL: dict[str, str] = {k: v[1] or _plain(v[0]) for k, v in SELECTS.items()} | {k: v[1] for k, v in FRAMES.items() if v[1]}
