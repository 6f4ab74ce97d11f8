"""Every registered query of the engine, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coerce as co
from ..functions.expression import compile_value
from ..operators import aggregate as A
from ..operators import business as B
from ..operators import cluster, diff, finance, joins, ordering, profile, rows, setops, statistics, text, timeseries, windows
from ..sources import generate

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

EVENTS_DAY = "CAST(date_trunc('day', ts) AS TIMESTAMP)"


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def r2(x: str, d: int = 2) -> str:
    """SQL for rounding halves up."""
    return f"floor(({x}) * {10**d}.0 + 0.5) / {10**d}.0"


def up(x, d: int = 2):
    return co.half_up(x, d)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: up(F.col(c), d) for c, d in digits.items()})


# -- expressions, filter, derive, select, cast, clean -------------------------------------------------


@register(f"""
    WITH p AS (SELECT l_returnflag, l_extendedprice * (1 - l_discount) - l_tax AS profit FROM lineitem)
    SELECT l_returnflag, {r2("sum(profit)")} AS total, {r2("avg(profit)")} AS avg, count(*) AS n
    FROM p WHERE profit >= 1000 AND l_returnflag <> 'N' GROUP BY 1""")
def flagship(spark, sf):
    df = rows.derive(table(spark, sf, "lineitem"), {"profit": "l_extendedprice * (1 - l_discount) - l_tax"})
    df = rows.filter_rows(df, 'profit >= 1000 && l_returnflag != "N"')
    out = A.reduce_rows(df, "total = sum(profit), avg = avg(profit), n = count()", by="l_returnflag")
    return ordering.sort(rounded(out, total=2, avg=2), "total:desc")


@register("""
    SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
    WHERE l_quantity > 30 AND l_discount <= 0.05 AND l_returnflag = 'R' AND (l_tax > 0.02 OR l_linestatus <> 'F')""")
def filter_expr(spark, sf):
    df = rows.filter_rows(table(spark, sf, "lineitem"), "l_quantity > 30 and l_discount <= 0.05 and l_returnflag == 'R' and (l_tax > 0.02 or l_linestatus != 'F')")
    return rows.select_columns(df, ["l_orderkey", "l_linenumber", "l_quantity"])


@register("""
    WITH e AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events)
    SELECT event_id, coalesce(v < 50, FALSE) AS low, NOT coalesce(v < 50, FALSE) AS not_low, v IS NULL AS blank, coalesce(NOT (v = 10), TRUE) AS other, coalesce(v, 0) + 1 AS plus FROM e""")
def null_logic(spark, sf):
    df = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"))
    return rows.derive(df, {"low": "v < 50", "not_low": "!(v < 50)", "blank": "v == null", "other": "v != 10", "plus": "v + 1"}).drop("v")


@register(f"""
    SELECT l_orderkey, l_linenumber, {r2("l_extendedprice * (1 - l_discount) * (1 + l_tax)")} AS charge,
        l_extendedprice / CASE WHEN l_discount = 0 THEN 1 ELSE l_discount END AS ratio, CASE WHEN l_quantity > 25 THEN 'big' ELSE 'small' END AS size
    FROM lineitem""")
def map_derive(spark, sf):
    df = rows.derive(table(spark, sf, "lineitem"), {"charge": "(l_extendedprice * (1 - l_discount) * (1 + l_tax)) | round(2)", "ratio": "l_extendedprice / l_discount", "size": "if(l_quantity > 25, 'big', 'small')"})
    return rows.select_columns(df, ["l_orderkey", "l_linenumber", "charge", "ratio", "size"])


@register("SELECT o_orderkey AS key, o_totalprice AS price, '' AS missing FROM orders")
def select_rename(spark, sf):
    return rows.select_columns(rows.rename(table(spark, sf, "orders"), "o_orderkey=key,o_totalprice=price"), ["key", "price", "missing"])


@register("SELECT event_id, try_cast(x AS BIGINT) AS x, try_cast(y AS DOUBLE) AS y FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'abc' WHEN event_id % 5 = 1 THEN '' ELSE CAST(user_id AS VARCHAR) END AS x, CASE WHEN event_id % 3 = 0 THEN 'n/a' ELSE '1.5' END AS y FROM events)")
def cast_null(spark, sf):
    df = table(spark, sf, "events").selectExpr("event_id", "case when event_id % 5 = 0 then 'abc' when event_id % 5 = 1 then '' else cast(user_id as string) end as x", "case when event_id % 3 = 0 then 'n/a' else '1.5' end as y")
    return rows.cast(df, {"x": "integer", "y": "number"})


@register("SELECT event_id, try_cast(x AS BIGINT) AS x FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'abc' WHEN event_id % 5 = 1 THEN '' ELSE CAST(user_id AS VARCHAR) END AS x FROM events) WHERE x <> 'abc'")
def cast_skip_row(spark, sf):
    df = table(spark, sf, "events").selectExpr("event_id", "case when event_id % 5 = 0 then 'abc' when event_id % 5 = 1 then '' else cast(user_id as string) end as x")
    return rows.cast(df, {"x": "integer"}, on_error="skip-row")


@register("""
    SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'unknown' ELSE lower(c_mktsegment) END AS s, coalesce(CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END, 0) AS b FROM customer""")
def clean_nulls(spark, sf):
    df = table(spark, sf, "customer").selectExpr("c_custkey", "case when c_custkey % 4 = 0 then ' N/A ' else concat('  ', c_mktsegment, ' #') end as s", "case when c_custkey % 3 = 0 then null else c_acctbal end as b")
    return rows.clean(df, ["s", "b"], strip="#", case="lower", null_words=["n/a"], fill={"s": "unknown", "b": 0.0})


STRINGS = {
    "up": "upper(p_name)", "sub": "substr(p_name, 2, 4)", "last3": "substr(p_name, -3)", "rep": "replace(p_name, 'a', '_')", "word": "splitIndex(p_name, ' ', 1)", "at": "indexOf(p_name, 'e')",
    "pad": "padLeft(p_size, 4, '0')", "has": "contains(p_type, 'BRASS')", "starts": "startsWith(p_brand, 'Brand#1')", "ends": "endsWith(p_brand, '3')", "len": "length(p_name)", "cat": "concat(p_brand, '-', p_size)", "rx": "matches(p_name, '^[a-m]')",
}


@register("""
    SELECT p_partkey, upper(p_name) AS up, substr(p_name, 3, 4) AS sub, right(p_name, 3) AS last3, replace(p_name, 'a', '_') AS rep, split_part(p_name, ' ', 2) AS word, CAST(instr(p_name, 'e') - 1 AS DOUBLE) AS at,
        CASE WHEN length(CAST(p_size AS VARCHAR)) >= 4 THEN CAST(p_size AS VARCHAR) ELSE lpad(CAST(p_size AS VARCHAR), 4, '0') END AS pad, contains(lower(p_type), 'brass') AS has, starts_with(p_brand, 'Brand#1') AS starts,
        ends_with(p_brand, '3') AS ends, CAST(length(p_name) AS DOUBLE) AS len, p_brand || '-' || p_size AS cat, regexp_matches(p_name, '^[a-m]') AS rx FROM part""")
def string_functions(spark, sf):
    df = table(spark, sf, "part")
    return rows.derive(df, STRINGS).select("p_partkey", *STRINGS)


@register("""
    SELECT o_orderkey, CAST(year(o_orderdate) AS DOUBLE) AS y, CAST(month(o_orderdate) AS DOUBLE) AS m, CAST(day(o_orderdate) AS DOUBLE) AS d, CAST(hour(o_orderdate) AS DOUBLE) AS h, CAST(dayofweek(o_orderdate) AS DOUBLE) AS w,
        floor((epoch_ms(o_orderdate) - epoch_ms(TIMESTAMP '1995-01-01')) / 86400000.0 + 0.5) AS days, o_orderdate < now()::TIMESTAMP AS past FROM orders""")
def date_functions(spark, sf):
    made = {"y": "year(o_orderdate)", "m": "month(o_orderdate)", "d": "day(o_orderdate)", "h": "hour(o_orderdate)", "w": "dayOfWeek(o_orderdate)", "days": "dateDiff(o_orderdate, '1995-01-01')", "past": "isPast(o_orderdate)"}
    return rows.derive(table(spark, sf, "orders"), made).select("o_orderkey", *made)


@register(f"""
    SELECT l_orderkey, l_linenumber, abs(l_discount - 0.05) AS a, ceil(l_extendedprice) AS c, floor(l_extendedprice) AS f, {r2("l_extendedprice", 1)} AS r, least(greatest(l_quantity, 10), 40) AS k, least(l_quantity, l_linenumber) AS lo,
        greatest(l_quantity, l_linenumber) AS hi, pow(l_linenumber, 2) AS p, sqrt(l_quantity) AS q, coalesce(nullif(l_returnflag, 'N'), 'none') AS n, l_quantity BETWEEN 5 AND 10 AS b, l_returnflag IN ('A', 'R') AS i,
        -l_quantity AS neg, CAST(CAST(l_quantity AS INT) % 7 AS DOUBLE) AS md FROM lineitem""")
def math_null_functions(spark, sf):
    made = {"a": "abs(l_discount - 0.05)", "c": "ceil(l_extendedprice)", "f": "floor(l_extendedprice)", "r": "l_extendedprice | round(1)", "k": "clamp(l_quantity, 10, 40)", "lo": "min(l_quantity, l_linenumber)", "hi": "max(l_quantity, l_linenumber)", "p": "pow(l_linenumber, 2)", "q": "sqrt(l_quantity)", "n": "nvl(nullIf(l_returnflag, 'N'), 'none')", "b": "between(l_quantity, 5, 10)", "i": "in(l_returnflag, 'A', 'R')", "neg": "-l_quantity", "md": "l_quantity % 7"}
    return rows.derive(table(spark, sf, "lineitem"), made).select("l_orderkey", "l_linenumber", *made)


@register("SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(json_extract_string(props, '$.k') AS DOUBLE) > 50 AS big FROM events")
def json_get(spark, sf):
    return rows.derive(table(spark, sf, "events"), {"k": "jsonGet(props, 'k')", "big": "props.k > 50"}).select("event_id", "k", "big")


@register("SELECT p_partkey, word FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part) WHERE trim(word) <> ''")
def explode_tokens(spark, sf):
    return rows.explode(table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("word")), "word", " ")


@register("SELECT c_custkey, c_name AS \"who.name\", c_nationkey AS \"who.place.nation\", c_acctbal FROM customer")
def flatten_struct(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_nationkey").alias("nation")).alias("place")).alias("who"), "c_acctbal")
    return rows.flatten(df)


@register("""
    SELECT c_custkey, substr(sha256('salt:' || c_name), 1, 16) AS c_name, substr(e, 1, 1) || '***@' || regexp_extract(e, '@(.*)$', 1) AS e, '***-***-' || right(regexp_replace(p, '[^0-9]', '', 'g'), 4) AS p, '[REDACTED]' AS c_mktsegment
    FROM (SELECT *, lower(c_mktsegment) || c_custkey || '@example.com' AS e, '+1 555 ' || (100000 + c_custkey) AS p FROM customer)""")
def mask_pii(spark, sf):
    df = table(spark, sf, "customer").selectExpr("c_custkey", "c_name", "concat(lower(c_mktsegment), c_custkey, '@example.com') as e", "concat('+1 555 ', 100000 + c_custkey) as p", "c_mktsegment")
    return rows.mask(df, {"c_name": "hash", "e": "email", "p": "phone", "c_mktsegment": "redact"}, salt="salt")


# -- aggregation -----------------------------------------------------------------------------------------


@register(f"""
    SELECT l_returnflag, l_linestatus, count(*) AS n, {r2("sum(l_quantity)")} AS qty, {r2("avg(l_extendedprice)")} AS price, min(l_discount) AS low, max(l_tax) AS high, count(DISTINCT l_suppkey) AS suppliers,
        {r2("stddev_samp(l_quantity)", 4)} AS sd, {r2("var_samp(l_quantity)", 3)} AS var FROM lineitem GROUP BY 1, 2""")
def group_multi_agg(spark, sf):
    specs = "n = count(), qty = sum(l_quantity), price = avg(l_extendedprice), low = min(l_discount), high = max(l_tax), suppliers = countDistinct(l_suppkey), sd = stddev(l_quantity), var = variance(l_quantity)"
    return rounded(A.reduce_rows(table(spark, sf, "lineitem"), specs, by=["l_returnflag", "l_linestatus"]), qty=2, price=2, sd=4, var=3)


@register(f"SELECT count(*) AS n, {r2('sum(o_totalprice)')} AS total, {r2('avg(o_totalprice)')} AS mean, min(o_totalprice) AS low, max(o_totalprice) AS high, count(DISTINCT o_custkey) AS customers FROM orders")
def reduce_global(spark, sf):
    return rounded(A.reduce_rows(table(spark, sf, "orders"), "n = count(), total = sum(o_totalprice), mean = avg(o_totalprice), low = min(o_totalprice), high = max(o_totalprice), customers = countDistinct(o_custkey)"), total=2, mean=2)


@register("SELECT user_id, arg_min(event_type, event_id) AS first_type, arg_max(event_type, event_id) AS last_type, count(*) AS count FROM events GROUP BY 1")
def group_first_last(spark, sf):
    return A.reduce_rows(table(spark, sf, "events"), "first_type = first(event_type), last_type = last(event_type), count = count()", by="user_id", order_by="event_id")


@register("SELECT o_orderstatus, count(*) AS count FROM orders GROUP BY 1")
def count_by(spark, sf):
    return A.count(table(spark, sf, "orders"), by="o_orderstatus")


@register('SELECT count(*) AS total, count(DISTINCT o_custkey) AS "distinct" FROM orders')
def count_distinct(spark, sf):
    return A.count(table(spark, sf, "orders"), distinct="o_custkey")


@register()
def count_distinct_approx(spark, sf):
    return A.count(table(spark, sf, "orders"), distinct="o_custkey", approx=True)


@register(f"SELECT event_type AS value, count(*) AS count, {r2('count(*) * 100.0 / (SELECT count(*) FROM events)')} AS percent FROM events GROUP BY 1")
def freq_values(spark, sf):
    return A.frequencies(table(spark, sf, "events"), "event_type")


@register("SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def unique_first(spark, sf):
    return A.unique(table(spark, sf, "events"), ["user_id"], "first", "event_id")


@register("SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def unique_last(spark, sf):
    return A.unique(table(spark, sf, "events"), ["user_id", "event_type"], "last", "event_id")


PIVOT = ", ".join(f"""coalesce({r2(f"sum(CASE WHEN o_orderstatus = '{s}' THEN o_totalprice END)", 2)}, 0) AS {s}""" for s in "FOP")


@register(f"SELECT o_orderpriority, {PIVOT} FROM orders GROUP BY 1")
def pivot_sum(spark, sf):
    out = A.pivot(table(spark, sf, "orders"), ["o_orderpriority"], "o_orderstatus", "o_totalprice", "sum", headers=["F", "O", "P"])
    return rounded(out, F=2, O=2, P=2)


@register("SELECT p_partkey, 'p_size' AS variable, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def unpivot_cols(spark, sf):
    return A.unpivot(table(spark, sf, "part"), ["p_partkey"], ["p_size", "p_retailprice"])


# -- order --------------------------------------------------------------------------------------------------


@register("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 200")
def sort_limit(spark, sf):
    return ordering.limit(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), 200, "o_orderpriority,o_totalprice:desc,o_orderkey")


@register("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top_k(spark, sf):
    return ordering.top(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 100, tie="o_orderkey")


@register("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 120")
def offset_limit(spark, sf):
    return ordering.offset(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 120, "o_orderkey").limit(50)


@register("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 100")
def tail_n(spark, sf):
    return ordering.tail(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 100, "o_orderkey")


@register("SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) AS place FROM customer")
def sort_natural_whole(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_name", F.concat(F.lit("file"), F.col("c_custkey").cast("string")).alias("f"))
    return ordering.ranked(df, "f", natural_order=True).select("c_custkey", "c_name", "place")


@register("SELECT event_id, v, row_number() OVER (ORDER BY v DESC NULLS FIRST, event_id) AS place FROM (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS v FROM events)")
def sort_nulls_turned_whole(spark, sf):
    df = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 9 != 0, F.col("value")).alias("v"))
    return ordering.ranked(df, "v:desc,event_id")


@register()
def sample_rows(spark, sf):
    return ordering.sample(table(spark, sf, "orders"), 500, seed=7)


# -- joins and unions -----------------------------------------------------------------------------------------

_CUST = "SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey FROM customer"
_NAT = "SELECT CASE WHEN n_nationkey % 5 = 0 THEN NULL WHEN n_nationkey % 3 = 1 THEN n_nationkey + 100 ELSE n_nationkey END AS n_nationkey, n_name, n_regionkey AS c_name FROM nation"


def _sides(spark, sf):
    c = table(spark, sf, "customer").selectExpr("c_custkey", "c_name", "case when c_custkey % 10 = 0 then null else c_nationkey end as c_nationkey")
    n = table(spark, sf, "nation").selectExpr("case when n_nationkey % 5 = 0 then null when n_nationkey % 3 = 1 then n_nationkey + 100 else n_nationkey end as n_nationkey", "n_name", "n_regionkey as c_name")
    return c, n


def _join_query(how: str) -> None:
    kind = {"semi": "SEMI", "anti": "ANTI"}.get(how, how.upper())
    if how in ("semi", "anti"):
        cols = "c.c_custkey, c.c_name, c.c_nationkey"
    else:
        cols = "c.c_custkey, c.c_name, " + ("coalesce(c.c_nationkey, n.n_nationkey)" if how in ("right", "full") else "c.c_nationkey") + " AS c_nationkey, n.n_name, n.c_name AS c_name_right"

    def run(spark, sf):
        c, n = _sides(spark, sf)
        return joins.join(c, n, "c_nationkey=n_nationkey", how)

    run.__name__ = f"join_{how}"
    register(f"SELECT {cols} FROM ({_CUST}) c {kind} JOIN ({_NAT}) n ON c.c_nationkey IS NOT DISTINCT FROM n.n_nationkey")(run)


for _how in ("inner", "left", "right", "full", "semi", "anti"):
    _join_query(_how)


@register(f"""
    SELECT c_mktsegment, n_name, count(*) AS n, {r2("sum(o_totalprice)")} AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def join_three(spark, sf):
    df = joins.join(table(spark, sf, "orders").select("o_custkey", "o_totalprice"), table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), "o_custkey=c_custkey")
    df = joins.join(df, table(spark, sf, "nation").select("n_nationkey", "n_name"), "c_nationkey=n_nationkey")
    return rounded(A.reduce_rows(df, "n = count(), total = sum(o_totalprice)", by=["c_mktsegment", "n_name"]), total=2)


@register(f"""
    WITH s AS (SELECT s_name, c_name, 1 - levenshtein(lower(trim(s_name)), lower(trim(c_name))) / greatest(length(trim(s_name)), length(trim(c_name)))::DOUBLE AS s FROM supplier, customer),
    t AS (SELECT * FROM s WHERE s >= 0.6 QUALIFY row_number() OVER (PARTITION BY s_name ORDER BY s DESC, lower(trim(c_name))) = 1)
    SELECT supplier.s_name, t.c_name, {r2("t.s", 4)} AS _score FROM supplier LEFT JOIN t USING (s_name)""")
def fuzzy_levenshtein(spark, sf):
    return joins.fuzzy_join(table(spark, sf, "supplier").select("s_name"), table(spark, sf, "customer").select("c_name"), "s_name", "c_name", threshold=0.6)


_BIGRAM = "list_distinct([substr({0}, i, 2) FOR i IN range(1, length({0}))])"


@register(f"""
    WITH g AS (SELECT p_partkey, {_BIGRAM.format('p_name')} AS x, {_BIGRAM.format('p_type')} AS y FROM part)
    SELECT p_partkey, {r2("len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE", 4)} AS score FROM g""")
def jaccard_bigram(spark, sf):
    return table(spark, sf, "part").select("p_partkey", up(joins.jaccard(F.col("p_name"), F.col("p_type")), 4).alias("score"))


@register()
def fuzzy_jaro_winkler(spark, sf):
    n = table(spark, sf, "nation")
    return joins.fuzzy_join(n.select("n_name"), n.select(F.reverse("n_name").alias("other")), "n_name", "other", method="jaro-winkler", threshold=0.5)


@register()
def soundex_codes(spark, sf):
    return table(spark, sf, "nation").select("n_name", joins.soundex(F.col("n_name")).alias("code"))


@register("SELECT c_custkey AS key, c_name AS name, c_acctbal AS bal, 'source_1' AS origin FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, 'source_2' FROM supplier")
def concat_union(spark, sf):
    c = table(spark, sf, "customer").selectExpr("c_custkey as key", "c_name as name", "c_acctbal as bal")
    s = table(spark, sf, "supplier").selectExpr("s_suppkey as key", "s_name as name")
    return setops.concat([c, s], source_col="origin")


@register("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, sf):
    return setops.union_distinct([table(spark, sf, "customer").selectExpr("c_nationkey as k"), table(spark, sf, "supplier").selectExpr("s_nationkey as k")])


# -- windows -----------------------------------------------------------------------------------------------------

_W = "OVER (PARTITION BY user_id ORDER BY event_id"


def _events(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")


@register(f"SELECT event_id, row_number() {_W}) AS rn, lag(value, 1) {_W}) AS prev, lag(event_type, 2, 'none') {_W}) AS prev2, lead(value, 3, 0) {_W}) AS ahead FROM events")
def window_lag_lead(spark, sf):
    return windows.window(_events(spark, sf), {"rn": "row_number()", "prev": "lag(value)", "prev2": 'lag(event_type, 2, "none")', "ahead": "lead(value, 3, 0)"}, "user_id", "event_id").select("event_id", F.col("rn").cast("long").alias("rn"), "prev", "prev2", "ahead")


@register("SELECT event_id, rank() OVER (PARTITION BY user_id ORDER BY event_type) AS r, dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS d FROM events")
def window_rank(spark, sf):
    return windows.window(_events(spark, sf), {"r": "rank()", "d": "dense_rank()"}, "user_id", "event_type").select("event_id", F.col("r").cast("long").alias("r"), F.col("d").cast("long").alias("d"))


@register(f"SELECT event_id, {r2(f'sum(value) {_W})', 3)} AS s, {r2(f'avg(value) {_W})', 9)} AS a, min(value) {_W}) AS lo, max(value) {_W}) AS hi, count(*) {_W}) AS n FROM events")
def window_running(spark, sf):
    out = windows.window(_events(spark, sf), {"s": "running_sum(value)", "a": "running_avg(value)", "lo": "running_min(value)", "hi": "running_max(value)", "n": "running_count()"}, "user_id", "event_id")
    return rounded(out, s=3, a=9).select("event_id", "s", "a", "lo", "hi", "n")


_M = _W + " ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"


@register(f"SELECT event_id, {r2(f'sum(value) {_M}', 3)} AS s, {r2(f'avg(value) {_M}', 3)} AS a, min(value) {_M} AS lo, max(value) {_M} AS hi FROM events")
def window_moving(spark, sf):
    out = windows.window(_events(spark, sf), {"s": "moving_sum(value, 5)", "a": "moving_avg(value, 5)", "lo": "moving_min(value, 5)", "hi": "moving_max(value, 5)"}, "user_id", "event_id")
    return rounded(out, s=3, a=3).select("event_id", "s", "a", "lo", "hi")


# -- diff -----------------------------------------------------------------------------------------------------------

_NEW = "SELECT CASE WHEN o_orderkey % 17 = 0 THEN o_orderkey + 100000000 ELSE o_orderkey END AS o_orderkey, o_custkey, CASE WHEN o_orderkey % 11 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders"


def _changes(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    new = o.selectExpr("case when o_orderkey % 17 = 0 then o_orderkey + 100000000 else o_orderkey end as o_orderkey", "o_custkey", "case when o_orderkey % 11 = 0 then o_totalprice + 1 else o_totalprice end as o_totalprice", "case when o_orderkey % 13 = 0 then 'X' else o_orderstatus end as o_orderstatus")
    return diff.diff(o, new, "o_orderkey")


_DIFF = f"""
    WITH n AS ({_NEW}), j AS (SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, o.o_orderkey IS NULL AS added, n.o_orderkey IS NULL AS removed, o.o_totalprice IS DISTINCT FROM n.o_totalprice AS p, o.o_orderstatus IS DISTINCT FROM n.o_orderstatus AS s FROM orders o FULL JOIN n USING (o_orderkey)),
    d AS (SELECT *, CASE WHEN added THEN 'added' WHEN removed THEN 'removed' WHEN p OR s THEN 'changed' ELSE 'unchanged' END AS change_type FROM j)"""


@register(f"""{_DIFF} SELECT o_orderkey, change_type, CASE WHEN change_type = 'changed' THEN concat_ws(',', CASE WHEN p THEN 'o_totalprice' END, CASE WHEN s THEN 'o_orderstatus' END) ELSE '' END AS changed FROM d""")
def diff_events(spark, sf):
    return _changes(spark, sf).select("o_orderkey", "change_type", F.array_join("changed_columns", ",").alias("changed"))


@register(f"""{_DIFF} SELECT change_type, NULL::VARCHAR AS "column", count(*) AS count FROM d GROUP BY 1 UNION ALL SELECT 'changed', 'o_totalprice', count(*) FROM d WHERE change_type = 'changed' AND p UNION ALL SELECT 'changed', 'o_orderstatus', count(*) FROM d WHERE change_type = 'changed' AND s""")
def diff_summary(spark, sf):
    return diff.summary(_changes(spark, sf))


@register()
def diff_patch(spark, sf):
    return diff.patch(_changes(spark, sf), "o_orderkey")


# -- time series ---------------------------------------------------------------------------------------------------------


@register(f"SELECT {EVENTS_DAY} AS ts, {r2('avg(value)', 3)} AS avg_value, max(value) AS hi, count(*) AS n FROM events GROUP BY 1")
def resample_day(spark, sf):
    out = timeseries.resample(table(spark, sf, "events"), "ts", "1d", "value, max(value) as hi, count(*) as n")
    return rounded(out, avg_value=3).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


_HOURS = "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS t, sum(value) AS v, count(*) AS n FROM events GROUP BY 1"
_SPINE = "SELECT unnest(generate_series((SELECT min(t) FROM h), (SELECT max(t) FROM h), INTERVAL 5 MINUTE)) AS t"


@register(f"WITH h AS ({_HOURS}), s AS ({_SPINE}) SELECT s.t AS ts, {r2('last_value(v IGNORE NULLS) OVER (ORDER BY s.t)', 3)} AS v FROM s LEFT JOIN h ON s.t = h.t")
def gapfill_ffill(spark, sf):
    out = timeseries.resample(table(spark, sf, "events"), "ts", "5m", "sum(value) as v", fill="ffill")
    return rounded(out, v=3).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@register(f"""
    WITH h AS ({_HOURS}), s AS ({_SPINE}), j AS (SELECT s.t, h.v, CASE WHEN h.v IS NOT NULL THEN epoch_ms(s.t) END AS k FROM s LEFT JOIN h ON s.t = h.t),
    w AS (SELECT t, v, last_value(v IGNORE NULLS) OVER b AS v0, first_value(v IGNORE NULLS) OVER f AS v1, last_value(k IGNORE NULLS) OVER b AS k0, first_value(k IGNORE NULLS) OVER f AS k1 FROM j
        WINDOW b AS (ORDER BY t), f AS (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT t AS ts, {r2("CASE WHEN v IS NOT NULL THEN v ELSE v0 + (v1 - v0) * (epoch_ms(t) - k0) / (k1 - k0) END", 3)} AS v FROM w""")
def gapfill_linear(spark, sf):
    out = timeseries.resample(table(spark, sf, "events"), "ts", "5m", "sum(value) as v", fill="linear")
    return rounded(out, v=3).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@register("SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS o_orderdate, count(*) AS n FROM orders GROUP BY 1")
def resample_month(spark, sf):
    return timeseries.resample(table(spark, sf, "orders"), "o_orderdate", "1mo", "count(*) as n").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


# -- describing data --------------------------------------------------------------------------------------------------------


@register(f"SELECT count(*) AS count, 0::BIGINT AS nulls, min(l_quantity) AS min, max(l_quantity) AS max, {r2('sum(l_quantity)')} AS sum, {r2('avg(l_quantity)', 4)} AS mean, {r2('var_samp(l_quantity)', 4)} AS variance, {r2('stddev_samp(l_quantity)', 4)} AS stddev, count(DISTINCT l_quantity) AS \"distinct\" FROM lineitem")
def stats_numeric(spark, sf):
    return rounded(profile.numeric_stats(table(spark, sf, "lineitem"), "l_quantity"), sum=2, mean=4, variance=4, stddev=4)


@register(f"SELECT count(p_name) AS count, 0::BIGINT AS nulls, 0::BIGINT AS empty, min(length(p_name)) AS min_length, max(length(p_name)) AS max_length, {r2('avg(length(p_name))', 4)} AS avg_length, count(DISTINCT p_name) AS \"distinct\" FROM part")
def stats_string(spark, sf):
    return rounded(profile.string_stats(table(spark, sf, "part"), "p_name"), avg_length=4)


@register()
def infer_schema(spark, sf):
    df = table(spark, sf, "customer")
    return profile.infer_schema(df.select(*(F.col(c).cast("string").alias(c) for c in df.columns)))


@register()
def profile_columns(spark, sf):
    return profile.profile(table(spark, sf, "customer"))


@register(f"""
    SELECT 'l_quantity' AS "column", count(*) AS count, min(l_quantity) AS min, {r2("quantile_cont(l_quantity, 0.25)", 4)} AS q1, {r2("quantile_cont(l_quantity, 0.5)", 4)} AS median, {r2("quantile_cont(l_quantity, 0.75)", 4)} AS q3,
        {r2("quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25)", 4)} AS iqr, max(l_quantity) AS max, {r2("quantile_cont(l_quantity, 0.9)", 4)} AS p90, {r2("quantile_cont(l_quantity, 0.99)", 4)} AS p99 FROM lineitem""")
def quantiles(spark, sf):
    return profile.quantiles(table(spark, sf, "lineitem"), ["l_quantity"], (90, 99))


_OUT = "SELECT o_orderkey, o_totalprice AS v FROM orders"


@register(f"WITH s AS (SELECT avg(v) AS m, stddev_samp(v) AS s FROM ({_OUT})) SELECT o_orderkey, abs((v - m) / s) > 2 AS _is_outlier, round((v - m) / s, 2) AS score FROM ({_OUT}), s")
def outliers_z(spark, sf):
    out = statistics.outliers(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", threshold=2.0)
    m = out.agg(F.avg("o_totalprice").alias("m"), F.stddev_samp("o_totalprice").alias("s"))
    return out.crossJoin(F.broadcast(m)).select("o_orderkey", "_is_outlier", F.round((F.col("o_totalprice") - F.col("m")) / F.col("s"), 2).alias("score"))  # one row


@register(f"""
    WITH r AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM ({_OUT})),
    q AS (SELECT max(CASE WHEN i = floor(0.25 * (n - 1)) THEN v END) AS q1, max(CASE WHEN i = floor(0.75 * (n - 1)) THEN v END) AS q3 FROM r)
    SELECT o_orderkey FROM ({_OUT}), q WHERE v < q1 - 0.5 * (q3 - q1) OR v > q3 + 0.5 * (q3 - q1)""")
def outliers_iqr(spark, sf):
    return statistics.outliers(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "iqr", 0.5, only=True).select("o_orderkey")


@register(f"""
    WITH r AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM ({_OUT})), m AS (SELECT max(CASE WHEN i = n // 2 THEN v END) AS m FROM r),
    d AS (SELECT abs(v - m) AS d, row_number() OVER (ORDER BY abs(v - m)) - 1 AS i, count(*) OVER () AS n FROM ({_OUT}), m), a AS (SELECT max(CASE WHEN i = n // 2 THEN d END) AS a FROM d)
    SELECT o_orderkey FROM ({_OUT}), m, a WHERE 0.6745 * abs(v - m) / a > 1.2""")
def outliers_mad(spark, sf):
    return statistics.outliers(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "mad", 1.2, only=True).select("o_orderkey")


@register(f"""
    WITH c AS (SELECT {r2("corr(l_quantity, l_extendedprice)", 4)} AS qe, {r2("corr(l_quantity, l_discount)", 4)} AS qd, {r2("corr(l_extendedprice, l_discount)", 4)} AS ed FROM lineitem)
    SELECT a, b, r FROM (SELECT unnest(['l_quantity', 'l_quantity', 'l_quantity', 'l_extendedprice', 'l_extendedprice', 'l_extendedprice', 'l_discount', 'l_discount', 'l_discount']) AS a,
        unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_quantity', 'l_extendedprice', 'l_discount', 'l_quantity', 'l_extendedprice', 'l_discount']) AS b, unnest([1.0::DOUBLE, qe, qd, qe, 1.0, ed, qd, ed, 1.0]) AS r FROM c)""")
def correlation(spark, sf):
    return statistics.correlation(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@register(f"""
    SELECT regr_count(l_extendedprice, l_quantity)::BIGINT AS n, {r2("regr_slope(l_extendedprice, l_quantity)", 4)} AS slope, {r2("regr_intercept(l_extendedprice, l_quantity)", 3)} AS intercept, {r2("corr(l_extendedprice, l_quantity)", 4)} AS r,
        {r2("regr_r2(l_extendedprice, l_quantity)", 4)} AS r2 FROM lineitem""")
def regression(spark, sf):
    return rounded(statistics.regression(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"), slope=4, intercept=3).drop("std_error")


@register("SELECT l_returnflag AS row, l_linestatus AS col, count(*) AS count FROM lineitem GROUP BY 1, 2")
def crosstab_counts(spark, sf):
    return statistics.crosstab(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus").filter("count > 0")


@register(f"""
    WITH c AS (SELECT l_returnflag AS r, l_linestatus AS k, count(*) AS n FROM lineitem GROUP BY 1, 2), g AS (SELECT a.r, b.k, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT r FROM c) a CROSS JOIN (SELECT DISTINCT k FROM c) b LEFT JOIN c ON c.r = a.r AND c.k = b.k),
    e AS (SELECT r, k, n, sum(n) OVER (PARTITION BY r) * sum(n) OVER (PARTITION BY k) / sum(n) OVER ()::DOUBLE AS x FROM g)
    SELECT {r2("sum((n - x) ** 2 / x)", 4)} AS chi_square, ((count(DISTINCT r) - 1) * (count(DISTINCT k) - 1))::BIGINT AS dof, sum(n)::BIGINT AS n FROM e""")
def crosstab_chi2(spark, sf):
    return statistics.chi_square(statistics.crosstab(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus"))


_H = "(log2(sum(n)) - sum(n * log2(n)) / sum(n))"


@register(f"""
    WITH c AS (SELECT 'l_returnflag' AS f, l_returnflag AS x, l_shipmode AS y FROM (SELECT *, CASE WHEN l_quantity > 25 THEN 'big' ELSE 'small' END AS l_shipmode FROM lineitem) UNION ALL SELECT 'l_linestatus', l_linestatus, CASE WHEN l_quantity > 25 THEN 'big' ELSE 'small' END FROM lineitem),
    j AS (SELECT f, x, y, count(*) AS n FROM c GROUP BY ALL), hx AS (SELECT f, {_H} AS hx FROM (SELECT f, x, sum(n) AS n FROM j GROUP BY ALL) GROUP BY f), hy AS (SELECT f, {_H} AS hy FROM (SELECT f, y, sum(n) AS n FROM j GROUP BY ALL) GROUP BY f),
    hi AS (SELECT f, sum(s * h) / sum(s) AS rest FROM (SELECT f, x, sum(n) AS s, {_H} AS h FROM j GROUP BY f, x) GROUP BY f)
    SELECT f AS feature, {r2("abs(hx)", 4)} AS entropy, {r2("greatest(hy - rest, 0)", 4)} AS information_gain FROM hx JOIN hy USING (f) JOIN hi USING (f)""")
def entropy_gain(spark, sf):
    df = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", F.when(F.col("l_quantity") > 25, "big").otherwise("small").alias("size"))
    return statistics.entropy(df, ["l_returnflag", "l_linestatus"], "size").drop("gain_ratio")


@register("SELECT * FROM (VALUES ('not_null(o_custkey)', 0::BIGINT), ('unique(o_custkey)', (SELECT count(o_custkey) - count(DISTINCT o_custkey) FROM orders)), ('o_totalprice > 50000', (SELECT count(*) FROM orders WHERE NOT (o_totalprice > 50000)))) t(rule, violations)")
def data_tests(spark, sf):
    return profile.data_tests(table(spark, sf, "orders"), ["not_null(o_custkey)", "unique(o_custkey)", "o_totalprice > 50000"]).drop("passed")


@register("""
    WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_name END AS name, CASE WHEN c_custkey % 5 = 0 THEN 'x' ELSE CAST(c_custkey AS VARCHAR) END AS code FROM customer)
    SELECT 'name' AS "column", 'nullable' AS rule, sum((name IS NULL)::INT)::BIGINT AS violations FROM c UNION ALL SELECT 'code', 'type', sum((code = 'x')::INT)::BIGINT FROM c UNION ALL SELECT NULL, NULL, sum((name IS NULL OR code = 'x')::INT)::BIGINT FROM c""")
def validate_rules(spark, sf):
    df = table(spark, sf, "customer").selectExpr("case when c_custkey % 6 = 0 then null else c_name end as name", "case when c_custkey % 5 = 0 then 'x' else cast(c_custkey as string) end as code")
    return profile.validate(df, {"name": {"nullable": False, "type": "string"}, "code": {"type": "integer"}}).filter("rule is null or rule <> 'type' or column <> 'name'").drop("samples")


@register(f"""
    WITH e AS (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS b, (max(l_extendedprice) - min(l_extendedprice)) / 12 AS w FROM lineitem)
    SELECT CAST(least(floor((l_extendedprice - a) / w), 11) AS BIGINT) AS bin, count(*) AS count FROM lineitem, e GROUP BY 1""")
def histogram_bins(spark, sf):
    return profile.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 12).filter("count > 0").select("bin", "count")


@register("SELECT CASE WHEN regexp_matches(url, '^https?://[^\\s/$.?#].[^\\s]*$', 'i') THEN 'url' END AS type, count(*) AS n FROM pages GROUP BY 1")
def semantic_types(spark, sf):
    return table(spark, sf, "pages").groupBy(profile.semantic_type(F.col("url")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


@register(f"""
    WITH w AS (SELECT list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}\\s_]', ' ', 'g'), '\\s+'), lambda x: x <> '') AS w FROM documents),
    g AS (SELECT unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS ngram FROM w WHERE len(w) >= 2), c AS (SELECT ngram, count(*) AS count FROM g GROUP BY 1)
    SELECT ngram, count, {r2("count * 100.0 / (SELECT sum(count) FROM c)")} AS share FROM c ORDER BY count DESC, ngram LIMIT 50""")
def ngrams_top(spark, sf):
    return text.ngrams(table(spark, sf, "documents"), "text", 2, top=50)


# -- business and finance ------------------------------------------------------------------------------------------------------


_RFM = f"""
    WITH c AS (SELECT CAST(o_custkey AS VARCHAR) AS customer_id, max(epoch_ms(o_orderdate)) AS l, count(*) AS frequency, sum(o_totalprice) AS total FROM orders GROUP BY 1),
    d AS (SELECT *, CAST(greatest(floor((max(l) OVER () - l) / 86400000.0), 0) AS BIGINT) AS recency_days, count(*) OVER () AS n FROM c),
    s AS (SELECT customer_id, recency_days, frequency, {r2("total")} AS monetary, 6 - CAST(least(greatest(ceil(row_number() OVER (ORDER BY recency_days, customer_id) / n::DOUBLE * 5 - 1e-9), 1), 5) AS INT) AS r_score,
        CAST(least(greatest(ceil(row_number() OVER (ORDER BY frequency, customer_id) / n::DOUBLE * 5 - 1e-9), 1), 5) AS INT) AS f_score, CAST(least(greatest(ceil(row_number() OVER (ORDER BY total, customer_id) / n::DOUBLE * 5 - 1e-9), 1), 5) AS INT) AS m_score FROM d)"""


@register(f"{_RFM} SELECT customer_id, recency_days, frequency, monetary, r_score, f_score FROM s")
def rfm_scores(spark, sf):
    return B.rfm(table(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_totalprice").drop("segment", "m_score")


@register()
def rfm_segments(spark, sf):
    return B.rfm_summary(B.rfm(table(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_totalprice"))


@register(f"""
    WITH p AS (SELECT DISTINCT user_id AS u, CAST(floor((date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) + 3) / 7.0) AS INT) AS p FROM events), f AS (SELECT u, min(p) AS f FROM p GROUP BY 1),
    c AS (SELECT f, p - f AS o, count(*) AS active FROM p JOIN f USING (u) GROUP BY 1, 2), z AS (SELECT f, count(*) AS users FROM f GROUP BY 1)
    SELECT DATE '1970-01-01' + (f * 7 - 3)::INT AS cohort, users, o::BIGINT AS "offset", active, {r2("active * 100.0 / users", 1)} AS rate FROM c JOIN z USING (f) WHERE o <= 12""")
def cohort_matrix(spark, sf):
    return B.cohorts(table(spark, sf, "events"), "user_id", "ts", "week")


@register("""
    WITH a AS (SELECT user_id, min((ts, event_id)) AS t FROM events WHERE event_type = 'signup' GROUP BY 1), b AS (SELECT e.user_id, min((ts, event_id)) AS t FROM events e JOIN a USING (user_id) WHERE event_type = 'view' AND (ts, event_id) > a.t GROUP BY 1),
    c AS (SELECT e.user_id, min((ts, event_id)) AS t FROM events e JOIN b USING (user_id) WHERE event_type = 'purchase' AND (ts, event_id) > b.t GROUP BY 1)
    SELECT 1::BIGINT AS step_number, 'signup' AS step, (SELECT count(*) FROM a) AS users UNION ALL SELECT 2, 'view', (SELECT count(*) FROM b) UNION ALL SELECT 3, 'purchase', (SELECT count(*) FROM c)""")
def funnel_steps(spark, sf):
    return B.funnel(table(spark, sf, "events"), "user_id", "event_type", ["signup", "view", "purchase"], time="ts", order_by="event_id").select("step_number", "step", "users")


_AB = "SELECT CASE WHEN user_id % 2 = 0 THEN 'control' ELSE 'variant' END AS g, {0} AS v FROM events"


@register(f"""
    WITH e AS ({_AB.format("(event_type = 'purchase')::INT")}), s AS (SELECT sum((g = 'control')::INT) AS n1, sum((g = 'variant')::INT) AS n2, sum(CASE WHEN g = 'control' THEN v END) AS x1, sum(CASE WHEN g = 'variant' THEN v END) AS x2 FROM e)
    SELECT n1::BIGINT AS control_n, n2::BIGINT AS variant_n, {r2("x1 / n1", 6)} AS control_metric, {r2("x2 / n2", 6)} AS variant_metric, {r2("(x2 / n2 - x1 / n1) / sqrt((x1 + x2) / (n1 + n2) * (1 - (x1 + x2) / (n1 + n2)) * (1 / n1 + 1 / n2))", 4)} AS statistic
    FROM (SELECT n1::DOUBLE AS n1, n2::DOUBLE AS n2, x1::DOUBLE AS x1, x2::DOUBLE AS x2 FROM s)""")
def abtest_proportion(spark, sf):
    df = table(spark, sf, "events").selectExpr("case when user_id % 2 = 0 then 'control' else 'variant' end as g", "case when event_type = 'purchase' then 1 else 0 end as v")
    return rounded(B.ab_test(df, "g", "v", "control", "variant"), control_metric=6, variant_metric=6, statistic=4).select("control_n", "variant_n", "control_metric", "variant_metric", "statistic")


@register(f"""
    WITH e AS ({_AB.format("value")}), s AS (SELECT count(*) FILTER (g = 'control') AS n1, count(*) FILTER (g = 'variant') AS n2, avg(v) FILTER (g = 'control') AS m1, avg(v) FILTER (g = 'variant') AS m2, var_samp(v) FILTER (g = 'control') AS v1, var_samp(v) FILTER (g = 'variant') AS v2 FROM e)
    SELECT n1 AS control_n, n2 AS variant_n, {r2("m1", 4)} AS control_metric, {r2("m2", 4)} AS variant_metric, {r2("(m2 - m1) / sqrt(v1 / n1 + v2 / n2)", 4)} AS statistic, {r2("m2 - m1 - 1.96 * sqrt(v1 / n1 + v2 / n2)", 3)} AS ci_low FROM s""")
def abtest_welch(spark, sf):
    df = table(spark, sf, "events").selectExpr("case when user_id % 2 = 0 then 'control' else 'variant' end as g", "value as v")
    return rounded(B.ab_test(df, "g", "v", "control", "variant"), control_metric=4, variant_metric=4, statistic=4, ci_low=3).select("control_n", "variant_n", "control_metric", "variant_metric", "statistic", "ci_low")


@register(f"""
    WITH i AS (SELECT CAST(l_partkey AS VARCHAR) AS item, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1), r AS (SELECT item, v, row_number() OVER (ORDER BY v DESC, item) AS rank, sum(v) OVER (ORDER BY v DESC, item ROWS UNBOUNDED PRECEDING) AS run, sum(v) OVER () AS total FROM i)
    SELECT rank, item, {r2("v")} AS value, CASE WHEN run / total * 100 <= 80 OR rank = 1 THEN 'A' WHEN run / total * 100 <= 95 THEN 'B' ELSE 'C' END AS abc_class FROM r""")
def pareto_abc(spark, sf):
    return B.pareto(table(spark, sf, "lineitem"), "l_partkey", "l_extendedprice").select("rank", "item", "value", "abc_class")


_F = "OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN {0} PRECEDING AND CURRENT ROW)"


@register(f"""
    SELECT event_id, CASE WHEN count(*) {_F.format(4)} = 5 THEN {r2(f"avg(value) {_F.format(4)}", 4)} END AS sma_5, CASE WHEN count(*) {_F.format(9)} = 10 THEN {r2(f"avg(value) {_F.format(9)} + 2 * stddev_pop(value) {_F.format(9)}", 4)} END AS bb_upper,
        {r2(r2(f"sum(value * (event_id % 13 + 1)) {_F.format('UNBOUNDED')} / sum(event_id % 13 + 1) {_F.format('UNBOUNDED')}", 4))} AS vwap FROM events""")
def sma_bollinger_vwap(spark, sf):
    df = _events(spark, sf).withColumn("volume", F.col("event_id") % 13 + 1)
    out = finance.indicators(df, ["sma(5)", "bb(10)", "vwap"], "value", "event_id", "user_id", "volume")
    return rounded(out, vwap=2).select("event_id", "sma_5", "bb_upper", "vwap")


@register()
def ema_rsi_macd_atr(spark, sf):
    out = finance.indicators(_events(spark, sf), ["ema(5)", "rsi(14)", "macd", "atr(14)"], "value", "event_id", "user_id")
    return out.select("event_id", "ema_5", "rsi_14", "macd", "macd_signal", "macd_hist", "atr_14")


@register()
def k_means(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    return cluster.assign(df, ["p_size", "p_retailprice"], cluster.k_means(df, ["p_size", "p_retailprice"], 4))


@register()
def generate_rows(spark, sf):
    return generate.generate(spark, "id:seq,name:name,email:email,age:int(20,50),score:float(1.0,10.0,2),status:choice(active,inactive)", 1000)


@register("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'text/csv' WHEN 1 THEN 'image/png' ELSE 'application/octet-stream' END AS mime FROM part")
def mime_types(spark, sf):
    from ..sources.files import mime_column

    df = table(spark, sf, "part").selectExpr("p_partkey", "element_at(array('a.csv', 'b.PNG', 'c.unknownext'), cast(p_size % 3 + 1 as int)) as f")
    return df.select("p_partkey", mime_column(F.col("f")).alias("mime"))


@register("SELECT event_id, concat(event_type, '/', user_id) AS v FROM events")
def expression_column(spark, sf):
    df = table(spark, sf, "events")
    return df.select("event_id", compile_value("concat(event_type, '/', user_id)", df.schema).col.alias("v"))


def queries() -> dict[str, Query]:
    from . import catalog_more  # noqa: F401

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    from . import catalog_more  # noqa: F401

    return dict(_sql)
