"""Further registered queries: what the first catalogue leaves unproved. Imported by it."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import business as B
from ..operators import diff, finance, joins, ordering, profile, rows, setops, statistics, timeseries
from ..sources import readers, writers
from ..functions.expression import EMAIL, URL, UUID
from .catalog import _AB, _BIGRAM, _DIFF, _NEW, _RFM, _changes, _events, r2, register, rounded, table, up

# -- functions -----------------------------------------------------------------------------------------------

_TEXTS = "CASE event_id % 8 WHEN 0 THEN '  a b ' WHEN 1 THEN '12.9abc' WHEN 2 THEN '1.5' WHEN 3 THEN 'Yes' WHEN 4 THEN '' WHEN 5 THEN '2024-02-28' WHEN 6 THEN '-7e2 ' ELSE 'TRUE' END"
_MORE = f"SELECT *, {_TEXTS} AS t, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v, event_id % 2 = 0 AS flag, event_type || user_id || CASE WHEN event_id % 3 = 0 THEN '@mail.example' ELSE '@mail.org' END AS mail FROM events"


def _texts(spark, sf):
    df = table(spark, sf, "events")
    return df.selectExpr("*", f"{_TEXTS} AS t", "CASE WHEN event_id % 7 <> 0 THEN value END AS v", "event_id % 2 = 0 AS flag", "concat(event_type, user_id, CASE WHEN event_id % 3 = 0 THEN '@mail.example' ELSE '@mail.org' END) AS mail")


CHECKS = {
    "not_in": ("notIn(event_type, 'view', 'click')", "event_type NOT IN ('view', 'click')"),
    "minute": ("minute(ts)", "CAST(minute(ts) AS DOUBLE)"),
    "today": ("isToday(ts)", "CAST(ts AS DATE) = current_date"),
    "future": ("isFuture(ts)", "ts > now()::TIMESTAMP"),
    "trimmed": ("trim(t)", "trim(t)"),
    "lowered": ("lower(t)", "lower(t)"),
    "padded": ("padRight(event_type, 12, '.')", "rpad(event_type, 12, '.')"),
    "blank": ("isNull(v)", "v IS NULL"),
    "full": ("isNotNull(v)", "v IS NOT NULL"),
    "first": ("coalesce(v, 7)", "coalesce(v, 7)"),
    "number": ("isNumber(t)", r"regexp_full_match(t, '\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*')"),
    "email": ("isEmail(mail)", f"regexp_matches(mail, '{EMAIL}')"),
    "url": ("isUrl(concat('https://', mail))", f"regexp_matches('https://' || mail, '{URL}')"),
    "uuid": ("isUuid(t)", f"regexp_matches(t, '{UUID}')"),
    "dated": ("isDate(t)", "try_cast(nullif(t, '') AS TIMESTAMP) IS NOT NULL"),
    "whole": ("toInt(t)", r"try_cast(regexp_extract(t, '^\s*([+-]?\d+)', 1) AS DOUBLE)"),
    "real": ("toFloat(t)", r"try_cast(regexp_extract(t, '^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)', 1) AS DOUBLE)"),
    "text": ("toString(event_id)", "CAST(event_id AS VARCHAR)"),
    "yes": ("toBool(t)", "lower(t) IN ('true', '1', 'yes', 't', 'y')"),
    "size": ("formatBytes(event_id % 9 * 512)", "CASE WHEN event_id % 9 < 2 THEN CAST(event_id % 9 * 512 AS VARCHAR) || ' B' ELSE regexp_replace(format('{:.2f}', event_id % 9 / 2.0), '\\.?0+$', '') || ' KB' END"),
    "bytes": ("parseBytes(concat(event_id % 9, '.5', if(event_id % 2 == 0, 'KB', ' MiB')))", "(event_id % 9 + 0.5)::DOUBLE * CASE WHEN event_id % 2 = 0 THEN 1024 ELSE 1048576 END"),
    "thousands": ("formatNumber(event_id * 1000)", "format('{:,}', event_id * 1000)"),
    "is_true": ("flag == true", "flag"),
    "same": ("event_id == user_id", "event_id = user_id"),
    "truth": ("if(t, 'some', 'none')", "CASE WHEN t <> '' THEN 'some' ELSE 'none' END"),
    "untruth": ("!v", "coalesce(v = 0, TRUE)"),
}


@register(f"SELECT event_id, {r2('ln(value + 1)', 6)} AS log, {', '.join(f'{b} AS {k}' for k, (_, b) in CHECKS.items())} FROM ({_MORE})")
def more_functions(spark, sf):
    out = rows.derive(_texts(spark, sf), {"log": "log(value + 1)", **{k: a for k, (a, _) in CHECKS.items()}})
    return rounded(out, log=6).select("event_id", "log", *CHECKS)


# -- sources and sinks ---------------------------------------------------------------------------------------


def _folder(spark) -> str:
    """A fresh folder where the cluster shares files; the warehouse if no other is named."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/files-{uuid.uuid4().hex}"


_CUSTOMERS = "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_name || ', \"the\" ' || c_custkey || ' <&>' ELSE c_name END AS c_name, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS c_acctbal, c_mktsegment FROM customer"


def _customers(spark, sf):
    return table(spark, sf, "customer").selectExpr("c_custkey", "CASE WHEN c_custkey % 5 = 0 THEN concat(c_name, ', \"the\" ', c_custkey, ' <&>') ELSE c_name END AS c_name", "CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS c_acctbal", "c_mktsegment")


def _typed(df):
    return df.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", F.expr("try_cast(nullif(cast(c_acctbal as string), '') as double)").alias("c_acctbal"), "c_mktsegment")


def _round_trip(name: str, extension: str, local: bool = False, **options) -> None:
    def run(spark, sf):
        path = f"{_folder(spark)}/x.{extension}"
        if local:  # formats of one file, which the driver writes
            os.makedirs(os.path.dirname(path.removeprefix("file://").removeprefix("file:")), exist_ok=True)
            path = path.removeprefix("file://").removeprefix("file:")
        writers.write(_customers(spark, sf), path, **({} if local else {"single": False}), **options)
        return _typed(readers.read(spark, path, **({"record": "row"} if extension == "xml" else {"table": "t"} if extension == "sqlite" else {})))

    run.__name__ = f"round_trip_{name}"
    register(_CUSTOMERS)(run)


for _name, _ext, _local, _options in (
    ("csv", "csv", False, {}), ("tsv", "tsv", False, {}), ("psv", "psv", False, {}), ("jsonl", "jsonl", False, {}), ("xml", "xml", False, {}), ("parquet", "parquet", False, {}),
    ("csv_gz", "csv", False, {"compression": "gzip"}), ("json", "json", True, {}), ("arrow", "arrow", True, {}), ("avro", "avro", True, {}), ("xlsx", "xlsx", True, {}), ("sqlite", "sqlite", True, {"table": "t"}),
):
    _round_trip(_name, _ext, _local, **_options)


@register(_CUSTOMERS)
def round_trip_partitioned(spark, sf):
    root = _folder(spark)
    writers.write_partitioned(_customers(spark, sf), root, ["c_mktsegment"])
    return _typed(spark.read.parquet(root))


@register("SELECT c_custkey, (row_number() OVER (ORDER BY c_custkey) - 1) // 400 + 1 AS file FROM customer")
def split_files(spark, sf):
    root = _folder(spark)
    writers.write_split(table(spark, sf, "customer").select("c_custkey"), f"{root}/x.csv", rows=400, order_by="c_custkey", single=False)
    found = spark.read.option("header", True).csv(f"{root}/x.csv")
    return found.select(F.col("c_custkey").cast("long").alias("c_custkey"), F.col("_part").cast("long").alias("file"))


@register("SELECT c_name, count(*) AS n FROM (SELECT c_mktsegment AS c_name FROM customer UNION ALL SELECT c_mktsegment FROM customer) GROUP BY 1")
def multi_file_union(spark, sf):
    root = _folder(spark)
    for name in ("a", "b"):
        writers.write(table(spark, sf, "customer").select(F.col("c_mktsegment").alias("c_name")), f"{root}/{name}.jsonl", single=False)
    return readers.read(spark, [f"{root}/a.jsonl", f"{root}/b.jsonl"], format="jsonl").groupBy("c_name").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT count(*)::BIGINT AS n, count(DISTINCT s)::BIGINT AS kinds FROM (SELECT c_mktsegment AS s FROM customer)")
def inspect_csv(spark, sf):
    path = f"{_folder(spark)}/x.csv"
    writers.write(table(spark, sf, "customer").select("c_mktsegment"), path, single=False)
    df = readers.read(spark, path)
    return df.agg(F.lit(readers.inspect(df)["rows"]).cast("long").alias("n"), F.count_distinct("c_mktsegment").alias("kinds"))


@register("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name FROM customer WHERE c_custkey % 10 <> 0")
def csv_skip_corrupt(spark, sf):
    path = f"{_folder(spark)}/x.csv"
    lines = table(spark, sf, "customer").selectExpr("case when c_custkey % 10 = 0 then concat(c_custkey, ',', c_name, ',more,still') else concat(c_custkey, ',', c_name) end as value")
    spark.range(1).selectExpr("'c_custkey,c_name' as value").unionByName(lines).coalesce(1).write.text(path)
    return readers.read(spark, path, format="csv", on_error="skip", header=True)


# -- rows, unions, aggregates --------------------------------------------------------------------------------


@register("SELECT c_custkey, '10.' || c_nationkey || '.***.***' AS ip, substr(c_mktsegment, 1, 1) || '***' AS c_mktsegment, '**** **** **** ' || (1000 + c_custkey % 9000) AS card FROM customer")
def mask_more(spark, sf):
    df = table(spark, sf, "customer").selectExpr("c_custkey", "concat('10.', c_nationkey, '.3.4') as ip", "c_mktsegment", "concat('4111 2222 3333 ', 1000 + c_custkey % 9000) as card")
    return rows.mask(df, {"ip": "ip", "c_mktsegment": "name", "card": "card"})


@register("SELECT o_orderkey, substr(CAST(o_orderdate AS VARCHAR), 1, 10) AS day FROM orders")
def map_function(spark, sf):
    def first_ten(batches):
        for b in batches:
            yield b.assign(day=b["day"].str.slice(0, 10))

    return table(spark, sf, "orders").selectExpr("o_orderkey", "cast(o_orderdate as string) as day").mapInPandas(first_ten, "o_orderkey long, day string")


@register("SELECT c_custkey AS k FROM customer UNION ALL SELECT s_suppkey FROM supplier")
def concat_intersect(spark, sf):
    return setops.concat([table(spark, sf, "customer").selectExpr("c_custkey as k", "c_name as a"), table(spark, sf, "supplier").selectExpr("s_suppkey as k", "s_name as b")], align="intersect")


@register("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey")
def sort_ignore_case(spark, sf):
    df = table(spark, sf, "customer").selectExpr("c_custkey", "c_name", "case when c_custkey % 2 = 0 then upper(c_name) else lower(c_name) end as f")
    return ordering.ranked(df, "f,c_custkey", ignore_case=True).select("c_custkey", "c_name")


@register("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC LIMIT 100")
def tail_lines(spark, sf):
    return ordering.tail(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), 100, "l_orderkey,l_linenumber,l_extendedprice")


@register()
def count_lines_approx(spark, sf):
    return A.count(table(spark, sf, "lineitem"), distinct="l_returnflag", approx=True)


@register("SELECT l_returnflag, l_linestatus, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_orderkey, l_linenumber) = 1")
def unique_lines(spark, sf):
    df = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber")
    return A.unique(df, ["l_returnflag", "l_linestatus"], "first", "l_orderkey,l_linenumber")


@register("SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY user_id DESC, event_id) = 1")
def unique_two_keys(spark, sf):
    return A.unique(table(spark, sf, "events"), ["event_type"], "first", "user_id:desc,event_id")


@register("SELECT o_orderstatus, sum(o_orderkey)::BIGINT AS keys, count(*) AS n, max(o_orderkey) - min(o_orderkey) AS wide FROM orders GROUP BY 1")
def custom_aggregate(spark, sf):
    key = F.col("o_orderkey")
    return A.reduce_rows(table(spark, sf, "orders"), "keys = sum(o_orderkey), n = count()", by="o_orderstatus", custom={"wide": F.max(key) - F.min(key)}).withColumn("keys", F.col("keys").cast("long"))


@register("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 = 1 AND c_nationkey > 5")
def filter_function(spark, sf):
    return rows.filter_rows(table(spark, sf, "customer"), lambda r: r["c_custkey"] % 3 == 1 and r["c_nationkey"] > 5).select("c_custkey", "c_name")


# -- joins ------------------------------------------------------------------------------------------------------

_FUZZY = """
    WITH a AS (SELECT lower(trim(s_name)) AS a, s_name FROM supplier), b AS (SELECT lower(trim(c_name)) AS b, c_name FROM customer WHERE c_custkey % 3 = 0),
    s AS (SELECT s_name, c_name, b, {score} AS s FROM a, b WHERE a <> '' AND b <> ''), t AS (SELECT * FROM s WHERE s >= {least})"""


def _fuzzy_sides(spark, sf):
    return table(spark, sf, "supplier").select("s_name"), table(spark, sf, "customer").filter("c_custkey % 3 = 0").select("c_name")


_LEV = "1 - levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE"
_JAC = f"len(list_intersect({_BIGRAM.format('a')}, {_BIGRAM.format('b')})) / len(list_distinct(list_concat({_BIGRAM.format('a')}, {_BIGRAM.format('b')})))::DOUBLE"


@register(f"{_FUZZY.format(score=_LEV, least=0.7)} SELECT s_name, c_name, {r2('s', 4)} AS _score FROM t")
def fuzzy_all(spark, sf):
    return joins.fuzzy_join(*_fuzzy_sides(spark, sf), "s_name", "c_name", how="inner", threshold=0.7, best=False)


@register(f"{_FUZZY.format(score=_LEV, least=0.7)} SELECT s_name, c_name, {r2('s', 4)} AS _score FROM t QUALIFY row_number() OVER (PARTITION BY s_name ORDER BY s DESC, b) = 1")
def fuzzy_inner(spark, sf):
    return joins.fuzzy_join(*_fuzzy_sides(spark, sf), "s_name", "c_name", how="inner", threshold=0.7)


@register(f"{_FUZZY.format(score=_JAC, least=0.3)} SELECT s_name, c_name, {r2('s', 4)} AS _score FROM t")
def fuzzy_jaccard(spark, sf):
    return joins.fuzzy_join(*_fuzzy_sides(spark, sf), "s_name", "c_name", how="inner", method="jaccard", threshold=0.3, best=False)


@register("""
    WITH RECURSIVE n AS (SELECT DISTINCT upper(regexp_replace(n_name, '[^A-Za-z]', '', 'g')) AS w, n_name FROM nation),
    c AS (SELECT n_name, w, translate(w, 'AEIOUYHWBFPVCGJKQSXZDTLMNR', '00000000111122222222334556') AS code FROM n),
    o AS (SELECT n_name, w, code, 1 AS i, substr(code, 1, 1) AS once FROM c UNION ALL SELECT n_name, w, code, i + 1, CASE WHEN substr(code, i + 1, 1) = substr(code, i, 1) THEN once ELSE once || substr(code, i + 1, 1) END FROM o WHERE i < length(code)),
    f AS (SELECT n_name, substr(w, 1, 1) || replace(substr(once, 2), '0', '') AS k FROM o WHERE i = length(code))
    SELECT n_name, left(rpad(k, 4, '0'), 4) AS code FROM f""")
def soundex_all(spark, sf):
    return table(spark, sf, "nation").select("n_name", joins.soundex(F.col("n_name")).alias("code")).distinct()


# -- diff -------------------------------------------------------------------------------------------------------


@register(f"""{_DIFF} SELECT change_type, count(*) AS n FROM d WHERE change_type <> 'unchanged' GROUP BY 1""")
def diff_only(spark, sf):
    return _changes(spark, sf).filter("change_type <> 'unchanged'").groupBy("change_type").agg(F.count(F.lit(1)).alias("n"))


@register(f"SELECT CASE WHEN abs(o.o_totalprice - n.o_totalprice) > 2 THEN 'changed' ELSE 'unchanged' END AS change_type, count(*) AS n FROM orders o JOIN ({_NEW}) n USING (o_orderkey) GROUP BY 1 UNION ALL SELECT 'added', count(*) FROM ({_NEW}) n ANTI JOIN orders o USING (o_orderkey) UNION ALL SELECT 'removed', count(*) FROM orders o ANTI JOIN ({_NEW}) n USING (o_orderkey)")
def diff_epsilon(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    new = o.selectExpr("case when o_orderkey % 17 = 0 then o_orderkey + 100000000 else o_orderkey end as o_orderkey", "case when o_orderkey % 11 = 0 then o_totalprice + 1 else o_totalprice end as o_totalprice")
    return diff.diff(o, new, "o_orderkey", epsilon=2.0).groupBy("change_type").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT c_custkey, 'unchanged' AS change_type FROM customer")
def diff_trim_case(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    return diff.diff(c, c.selectExpr("c_custkey", "concat(' ', upper(c_name), ' ') as c_name"), "c_custkey", trim=True, ignore_case=True).select("c_custkey", "change_type")


# -- whole results of operators that the first catalogue shows in part --------------------------------------


@register(f"""
    WITH s AS (SELECT regr_count(l_extendedprice, l_quantity) AS n, regr_syy(l_extendedprice, l_quantity) AS syy, regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_sxy(l_extendedprice, l_quantity) AS sxy FROM lineitem)
    SELECT n::BIGINT AS n, {r2("sqrt((syy - sxy * sxy / sxx) / (n - 2))", 2)} AS std_error FROM s""")
def regression_error(spark, sf):
    return rounded(statistics.regression(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice").select("n", "std_error"), std_error=2)


@register("WITH c AS (SELECT l_returnflag AS r, l_linestatus AS k, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT a.r AS row, b.k AS col, coalesce(c.n, 0) AS count FROM (SELECT DISTINCT r FROM c) a CROSS JOIN (SELECT DISTINCT k FROM c) b LEFT JOIN c ON c.r = a.r AND c.k = b.k")
def crosstab_all(spark, sf):
    return statistics.crosstab(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


@register(f"""
    WITH e AS (SELECT min(l_extendedprice) AS a, (max(l_extendedprice) - min(l_extendedprice)) / 12 AS w, count(*) AS n FROM lineitem),
    c AS (SELECT CAST(least(floor((l_extendedprice - a) / w), 11) AS BIGINT) AS bin, count(*) AS c FROM lineitem, e GROUP BY 1)
    SELECT i AS bin, {r2("a + i * w", 4)} AS low, {r2("a + i * w + w", 4)} AS high, coalesce(c, 0) AS count, {r2("coalesce(c, 0) * 100.0 / n", 1)} AS percent FROM range(12) t(i) LEFT JOIN c ON bin = i, e""")
def histogram_all(spark, sf):
    return rounded(profile.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 12), low=4, high=4)


@register("SELECT * FROM (VALUES ('not_null(o_custkey)', 0::BIGINT, TRUE), ('o_totalprice > 50000', (SELECT count(*) FROM orders WHERE NOT (o_totalprice > 50000)), (SELECT count(*) FROM orders WHERE NOT (o_totalprice > 50000)) = 0)) t(rule, violations, passed)")
def data_tests_all(spark, sf):
    return profile.data_tests(table(spark, sf, "orders"), ["not_null(o_custkey)", "o_totalprice > 50000"])


_SEGMENT = " ".join(f"WHEN r_score BETWEEN {r[0]} AND {r[1]} AND f_score BETWEEN {f[0]} AND {f[1]} AND m_score BETWEEN {m[0]} AND {m[1]} THEN '{name.replace(chr(39), chr(39) * 2)}'" for name, r, f, m in B.SEGMENTS)


@register(f"{_RFM} SELECT *, CASE {_SEGMENT} ELSE 'Promising' END AS segment FROM s")
def rfm_all(spark, sf):
    return B.rfm(table(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_totalprice")


@register(f"""{_RFM}, g AS (SELECT *, CASE {_SEGMENT} ELSE 'Promising' END AS segment FROM s)
    SELECT segment, count(*) AS count, {r2("count(*) * 100.0 / (SELECT count(*) FROM g)", 1)} AS percent, {r2("avg(recency_days)", 1)} AS avg_recency, {r2("avg(frequency)", 1)} AS avg_frequency FROM g GROUP BY 1""")
def rfm_segments_all(spark, sf):
    return B.rfm_summary(B.rfm(table(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_totalprice")).select("segment", "count", "percent", "avg_recency", "avg_frequency")


@register(f"""
    WITH i AS (SELECT CAST(l_partkey AS VARCHAR) AS item, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1), r AS (SELECT item, v, row_number() OVER (ORDER BY v DESC, item) AS rank, sum(v) OVER (ORDER BY v DESC, item ROWS UNBOUNDED PRECEDING) AS run, sum(v) OVER () AS total FROM i)
    SELECT rank, item, {r2("v")} AS value, {r2("v / total * 100")} AS share_pct, {r2("run / 100000", 0)} AS cumulative_value, {r2("run / total * 100", 1)} AS cumulative_pct, CASE WHEN run / total * 100 <= 80 OR rank = 1 THEN 'A' WHEN run / total * 100 <= 95 THEN 'B' ELSE 'C' END AS abc_class FROM r""")
def pareto_all(spark, sf):
    return B.pareto(table(spark, sf, "lineitem"), "l_partkey", "l_extendedprice").withColumn("cumulative_value", up(F.col("cumulative_value") / 100000, 0))


@register(f"""
    WITH a AS (SELECT user_id, min((ts, event_id)) AS t FROM events WHERE event_type = 'signup' GROUP BY 1), b AS (SELECT e.user_id, min((ts, event_id)) AS t FROM events e JOIN a USING (user_id) WHERE event_type = 'view' AND (ts, event_id) > a.t GROUP BY 1),
    s AS (SELECT 1::BIGINT AS n, 'signup' AS step, (SELECT count(*) FROM a) AS users UNION ALL SELECT 2, 'view', (SELECT count(*) FROM b)), w AS (SELECT *, first_value(users) OVER (ORDER BY n) AS f, lag(users) OVER (ORDER BY n) AS p FROM s),
    z AS (SELECT n, step, users, {r2("users * 100.0 / f", 1)} AS conversion, CASE WHEN p IS NULL THEN 100.0 ELSE {r2("users * 100.0 / p", 1)} END AS step_conversion FROM w)
    SELECT n AS step_number, step, users, conversion, step_conversion, CASE WHEN n = 1 THEN 0.0 ELSE {r2("100 - step_conversion", 1)} END AS drop_off FROM z""")
def funnel_all(spark, sf):
    return B.funnel(table(spark, sf, "events"), "user_id", "event_type", ["signup", "view"], time="ts", order_by="event_id")


@register(f"""
    WITH e AS ({_AB.format("value")}), s AS (SELECT count(*) FILTER (g = 'control') AS n1, count(*) FILTER (g = 'variant') AS n2, avg(v) FILTER (g = 'control') AS m1, avg(v) FILTER (g = 'variant') AS m2, var_samp(v) FILTER (g = 'control') AS v1, var_samp(v) FILTER (g = 'variant') AS v2 FROM e),
    t AS (SELECT *, (m2 - m1) / sqrt(v1 / n1 + v2 / n2) AS z FROM s), u AS (SELECT *, 1 / (1 + abs(z) * 0.2316419) AS k FROM t),
    p AS (SELECT *, least(greatest(2 * exp(-z * z / 2) / sqrt(2 * pi()) * k * (0.31938153 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429)))), 0), 1) AS p FROM u)
    SELECT 'means' AS test_type, {r2("m2 - m1", 4)} AS difference, {r2("(m2 - m1) / m1 * 100", 4)} AS lift_pct, {r2("p", 4)} AS p_value, {r2("m2 - m1 + 1.96 * sqrt(v1 / n1 + v2 / n2)", 3)} AS ci_high, p < 0.05 AS significant FROM p""")
def abtest_all(spark, sf):
    df = table(spark, sf, "events").selectExpr("case when user_id % 2 = 0 then 'control' else 'variant' end as g", "value as v")
    return rounded(B.ab_test(df, "g", "v", "control", "variant"), difference=4, lift_pct=4, p_value=4, ci_high=3).select("test_type", "difference", "lift_pct", "p_value", "ci_high", "significant")


@register(f"WITH s AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders) SELECT o_orderkey, abs((o_totalprice - m) / s) > 2 AS _is_outlier, {r2('abs((o_totalprice - m) / s)', 3)} AS _outlier_score FROM orders, s")
def outliers_scored(spark, sf):
    out = statistics.outliers(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", threshold=2.0)
    return out.select("o_orderkey", "_is_outlier", up(F.abs("_outlier_score"), 3).alias("_outlier_score"))


@register(f"SELECT epoch_ms(date_trunc('day', ts))::BIGINT AS ts, count(*) AS n FROM events GROUP BY 1")
def resample_epoch(spark, sf):
    return timeseries.resample(table(spark, sf, "events"), "ts", "1d", "count(*) as n").select(F.unix_millis("ts").alias("ts"), "n")


_E = "OVER (PARTITION BY user_id ORDER BY event_id)"
_FIRST = "avg({0}) FILTER (i BETWEEN {1} AND {2}) OVER (PARTITION BY user_id)"


@register(f"""
    WITH RECURSIVE o AS (SELECT event_id, user_id, value AS v, row_number() {_E} AS i, lag(value) {_E} AS p FROM events),
    d AS (SELECT *, greatest(v - p, 0) AS u, greatest(p - v, 0) AS w, coalesce(abs(v - p), 0) AS r FROM o),
    s AS (SELECT *, {_FIRST.format("v", 1, 5)} AS e0, {_FIRST.format("u", 2, 15)} AS u0, {_FIRST.format("w", 2, 15)} AS w0, {_FIRST.format("r", 1, 14)} AS r0 FROM d),
    g AS (SELECT event_id, user_id, i, NULL::DOUBLE AS e, NULL::DOUBLE AS up, NULL::DOUBLE AS down, NULL::DOUBLE AS tr FROM s WHERE i = 1
        UNION ALL SELECT s.event_id, s.user_id, s.i, CASE WHEN s.i = 5 THEN e0 ELSE v / 3 + g.e * 2 / 3 END, CASE WHEN s.i = 15 THEN u0 ELSE (g.up * 13 + u) / 14 END, CASE WHEN s.i = 15 THEN w0 ELSE (g.down * 13 + w) / 14 END, CASE WHEN s.i = 14 THEN r0 ELSE (g.tr * 13 + r) / 14 END
        FROM g JOIN s ON s.user_id = g.user_id AND s.i = g.i + 1)
    SELECT event_id, {r2("e", 4)} AS ema_5, CASE WHEN down = 0 THEN 100 ELSE {r2("100 - 100 / (1 + up / down)", 2)} END AS rsi_14, {r2("tr", 4)} AS atr_14 FROM g""")
def ema_rsi_atr(spark, sf):
    out = finance.indicators(_events(spark, sf), ["ema(5)", "rsi(14)", "atr(14)"], "value", "event_id", "user_id")
    return out.select("event_id", "ema_5", "rsi_14", "atr_14")
