"""Operators on small literal inputs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.errors import ArgumentError, DuplicateKeyError, MismatchError, ValidationError
from gristmill.operators import aggregate as A
from gristmill.operators import business as B
from gristmill.operators import alike, cluster, diff, finance, joins, ordering, profile, rows, setops, statistics, text, timeseries, windows


def rowsof(df):
    return [tuple(r) for r in df.collect()]


def test_joins(spark):
    u = spark.createDataFrame([(1, "Alice", "D10"), (2, "Bob", "D20"), (3, "Charlie", "D30"), (4, "David", None)], "id long, name string, dept_id string")
    d = spark.createDataFrame([("D10", "Engineering", "x"), ("D20", "Marketing", "y"), ("D40", "Finance", "z"), (None, "None", "w")], "dept_id string, dept_name string, name string")
    inner = joins.join(u, d, "dept_id")
    assert inner.columns == ["id", "name", "dept_id", "dept_name", "name_right"]
    assert sorted(r.id for r in inner.collect()) == [1, 2, 4]  # a null key meets a null key
    assert joins.join(u, d, "dept_id", "left").count() == 4
    assert sorted(str(r.dept_id) for r in joins.join(u, d, "dept_id", "right").collect()) == ["D10", "D20", "D40", "None"]
    assert joins.join(u, d, "dept_id", "full").count() == 5
    assert sorted(r.id for r in joins.join(u, d, "dept_id", "semi").collect()) == [1, 2, 4]
    assert [r.id for r in joins.join(u, d, "dept_id", "anti").collect()] == [3]
    assert joins.join(u, d, "dept_id", prefix="r_").columns[-2:] == ["r_dept_name", "r_name"]
    assert joins.join(u, d, "id=dept_id").count() == 0  # numbers match no strings
    with pytest.raises(ArgumentError):
        joins.join(u, d, left_on=["id", "name"], right_on=["dept_id"])


def test_fuzzy(spark):
    a = spark.createDataFrame([(1, "Apple Inc."), (2, "Micro soft Corp"), (3, "Amazon"), (4, "Unknown Entity"), (5, None)], "id long, comp_name string")
    b = spark.createDataFrame([("AAPL", "Apple Inc"), ("MSFT", "Microsoft Corp"), ("AMZN", "Amazon.com")], "ticker string, legal_name string")
    got = {r.id: (r.ticker, r._score) for r in joins.fuzzy_join(a, b, "comp_name", "legal_name", threshold=0.6).collect()}
    assert got[1][0] == "AAPL" and got[1][1] > 0.8 and got[2][0] == "MSFT" and got[3] == ("AMZN", 0.6) and got[4] == (None, None) and got[5] == (None, None)
    assert joins.fuzzy_join(a, b, "comp_name", "legal_name", "inner", threshold=0.6).count() == 3
    assert joins.fuzzy_join(a, b, "comp_name", "legal_name", "full", threshold=0.9).count() == 6
    for m in ("jaccard", "jaro-winkler", "soundex"):
        assert joins.fuzzy_join(a, b, "comp_name", "legal_name", "inner", m, 0.3).count() >= 1
    assert joins._jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    w = spark.createDataFrame([("Robert",), ("Rupert",), ("123",)], "w string")
    assert [r[0] for r in w.select(joins.soundex(F.col("w"))).collect()] == ["R163", "R163", "0000"]


@pytest.mark.parametrize("method, least", [("levenshtein", 0.05), ("levenshtein", 0.5), ("levenshtein", 0.6), ("levenshtein", 0.75), ("levenshtein", 1), ("jaccard", 0.2), ("jaccard", 0.6), ("jaccard", 1.0), ("jaro-winkler", 0.3), ("jaro-winkler", 0.72), ("jaro-winkler", 0.9)])
def test_blocking_loses_no_pair(spark, method, least):
    r = random.Random(1)
    words = ["".join(r.choice("abcé😀") for _ in range(r.randint(1, 9))) for _ in range(30)] + [w * 3 for w in ("abcde", "éabd")]
    words += [w[:i] + "x" + w[i + r.randint(0, 2):] for w in words for i in (0, len(w) // 2)]
    a = spark.createDataFrame([(w,) for w in sorted(set(words[::2]))], "a string")
    b = spark.createDataFrame([(w,) for w in sorted(set(words[1::2] + words[::4]))], "b string")
    got = [(x.a, x.b) for x in joins.fuzzy_join(a, b, "a", "b", "inner", method, threshold=least, best=False).collect()]
    every = a.crossJoin(b).select("a", "b", joins.SCORES[method](F.col("a"), F.col("b")).alias("s")).filter(F.col("s") >= least)
    assert sorted(got) == sorted((x.a, x.b) for x in every.collect()) and got


@pytest.mark.parametrize("method, least", [("levenshtein", 0.05), ("levenshtein", 0.6), ("levenshtein", 1), ("jaccard", 0.2), ("jaccard", 1.0)])
def test_walking_all_pairs_loses_none(spark, monkeypatch, method, least):
    monkeypatch.setattr(joins, "FEW_PAIRS", 0)
    monkeypatch.setattr(joins, "CROWDED", -1.0)
    r = random.Random(1)
    words = ["".join(r.choice("abcé😀") for _ in range(r.randint(1, 9))) for _ in range(30)] + [w * 3 for w in ("abcde", "éabd")]
    words += [f"item#{i:05d}" for i in range(40)]
    a = spark.createDataFrame([(w,) for w in sorted(set(words[::2]))] + [("",), (None,)], "a string")
    b = spark.createDataFrame([(w,) for w in sorted(set(words[1::2] + words[::4]))], "b string")
    got = joins.fuzzy_join(a, b, "a", "b", "inner", method, threshold=least, best=False)
    every = a.filter("a <> ''").crossJoin(b).select("a", "b", joins.SCORES[method](F.col("a"), F.col("b")).alias("s")).filter(F.col("s") >= least).collect()
    assert sorted((x.a, x.b, x._score) for x in got.collect()) == sorted((x.a, x.b, math.floor(x.s * 10000 + 0.5) / 10000) for x in every)
    best = {}
    for x in every:
        best[x.a] = min(best.get(x.a, (1.0, "")), (-x.s, x.b))
    found = joins.fuzzy_join(a, b, "a", "b", "left", method, threshold=least).collect()
    assert len(found) == a.count() and {x.a: x.b for x in found if x.b is not None} == {k: v[1] for k, v in best.items()}


def test_names_with_a_common_head_are_walked(spark, monkeypatch):
    """1,100 by 1,100 names that nearly all share pieces and bigrams; by pieces every pair would meet."""
    walked = []
    monkeypatch.setattr(joins, "all_pairs", lambda *x: walked.append(x[2]) or alike.all_pairs(*x))
    a = spark.range(1100).selectExpr("format_string('Supplier#%09d', id) AS a")
    b = spark.range(1100).selectExpr("format_string('Customer#%09d', id) AS b")
    got = joins.fuzzy_join(a, b, "a", "b", "inner", threshold=0.7, best=False).collect()
    assert len(got) == 1100 and all(x.a[-9:] == x.b[-9:] and x._score == 0.7222 for x in got)
    joins.fuzzy_join(a, b, "a", "b", "inner", "jaccard", threshold=0.3)
    varied = a.selectExpr("sha2(a, 256) AS a"), b.selectExpr("sha2(b, 256) AS b")
    assert joins.fuzzy_join(*varied, "a", "b", "inner", threshold=0.9).count() == 0 and walked == ["levenshtein", "jaccard"]


def test_order(spark):
    df = spark.createDataFrame([("Alice", 85, 1200), ("Bob", 92, 800), ("Charlie", 78, 2500), ("David", 95, 1500), ("Eve", 88, 3100)], "name string, score long, revenue long")
    assert [r.name for r in ordering.top(df, "revenue", 3).collect()] == ["Eve", "Charlie", "David"]
    assert [r.name for r in ordering.top(df, "score", 2, smallest=True).collect()] == ["Charlie", "Alice"]
    s = spark.createDataFrame([("10",), ("2",), ("1",), ("x",), ("",), ("20",)], "val string")
    assert [r.val for r in ordering.sort(s, "val").collect()] == ["1", "2", "10", "20", "x", ""]
    f = spark.createDataFrame([("file10.txt",), ("file2.txt",), ("file1.txt",)], "file string")
    assert [r.file for r in ordering.sort(f, "file", natural_order=True).collect()] == ["file1.txt", "file2.txt", "file10.txt"]
    n = spark.createDataFrame([(1, 50), (2, None), (3, 90)], "id long, score long")
    assert [r.score for r in ordering.sort(n, "score").collect()] == [50, 90, None]
    assert [r.score for r in ordering.sort(n, "score", nulls="first").collect()] == [None, 50, 90]
    assert [r.score for r in ordering.sort(n, "score:desc").collect()] == [None, 90, 50]
    assert [r.score for r in ordering.sort(n, "score:desc", nulls_absolute=True).collect()] == [90, 50, None]
    assert [r.id for r in ordering.tail(n, 2, "id").collect()] == [2, 3]
    assert [r.id for r in ordering.offset(n, 1, "id").collect()] == [2, 3]
    assert rowsof(ordering.sample(df, 2, 3)) == rowsof(ordering.sample(df.repartition(3), 2, 3))
    p = spark.createDataFrame([("P1", "A", 10), ("P2", "B", 50), ("P3", "A", 30), ("P4", "A", 20)], "name string, category string, price long")
    assert [r.name for r in ordering.top(p, "category:asc,price:desc", 3).collect()] == ["P3", "P4", "P1"]
    assert rowsof(ordering.top(p, "price", 2)) == rowsof(ordering.sort(p, "price:desc").limit(2))


def test_aggregates(spark):
    df = spark.createDataFrame([("u1", "100"), ("u2", "200"), ("u1", ""), ("u3", "abc"), (None, "400"), ("", "1")], "user string, v string")
    (r,) = A.reduce_rows(df, "s = sum(v), a = avg(v), n = count(), f = count(v), d = countDistinct(user), lo = min(v), sd = stddev(v)").collect()
    assert (r.s, r.a, r.n, r.f, r.d, r.lo) == (701.0, 701 / 4, 6, 5, 3, 1.0)
    got = {r.user: (r["count"], r.v_sum) for r in A.group(df, "user", sum="v", count=True).collect()}
    assert got == {"u1": (2, 100.0), "u2": (1, 200.0), "u3": (1, 0.0), None: (2, 401.0)}
    assert A.reduce_rows(df.limit(0), "s = sum(v), n = count(), a = avg(v)").collect()[0].asDict() == {"s": 0.0, "n": 0, "a": None}
    assert A.reduce_rows(df, "sd = stddev(v), va = variance(v)", by="user").filter("user = 'u2'").first()[1:] == (0.0, 0.0)
    with pytest.raises(ArgumentError):
        A.reduce_rows(df, "x = median(v)")
    freq = rowsof(A.frequencies(df, "user"))
    assert freq[0] == ("u1", 2, 33.33) and ("<null>", 1, 16.67) in freq


def test_unique_pivot_unpivot(spark):
    u = spark.createDataFrame([("alice", 1, "a"), ("bob", 1, "b"), ("alice", 2, "c"), ("bob", 2, "d")], "email string, version long, role string")
    assert sorted(rowsof(A.unique(u, ["email"], "last", "version"))) == [("alice", 2, "c"), ("bob", 2, "d")]
    assert sorted(rowsof(A.unique(u, ["email"], "first", "version,role"))) == [("alice", 1, "a"), ("bob", 1, "b")]
    p = spark.createDataFrame([("North", 2024, 100), ("North", 2025, 150), ("South", 2024, 200), ("South", 2025, 250), ("East", 2024, 300)], "region string, year long, sales long")
    assert {r.region: r["2025"] for r in A.pivot(p, "region", "year", "sales").collect()} == {"North": 150.0, "South": 250.0, "East": 0.0}
    assert {r.region: r["2025"] for r in A.pivot(p, "region", "year", "sales", "avg", fill="N/A").collect()}["East"] == "N/A"
    wide = A.pivot(p, "region", "year", "sales", "max")
    back = A.unpivot(wide, "region", drop_null=True)
    assert sorted(rowsof(back)) == sorted((a, str(b), float(c)) for a, b, c in rowsof(p))


def test_windows(spark):
    df = spark.createDataFrame([(1, 10, "a"), (2, 20, "a"), (3, 30, "b"), (4, 40, "b")], "id long, val long, g string")
    got = windows.window(df, {"rn": "row_number()", "p": "lag(val, 1, 0)", "n": "lead(val, 2, -1)", "s": "running_sum(val)", "m": "moving_avg(val, 2)"}, (), "id").orderBy("id")
    assert [tuple(r)[3:] for r in got.collect()] == [(1, 0, 30, 10.0, 10.0), (2, 10, 40, 30.0, 15.0), (3, 20, -1, 60.0, 25.0), (4, 30, -1, 100.0, 35.0)]
    assert [r.n for r in windows.window(df, ["n = lead(val)"], "g", "id").orderBy("id").collect()] == [20, None, 40, None]
    assert windows.window(df, ["row_number()"]).columns[-1] == "row_number"


def test_rows(spark):
    df = spark.createDataFrame([(1, " N/A ", "42"), (2, "none", "x"), (3, "hello world", "4.8")], "id long, status string, rev string")
    got = rowsof(rows.clean(df, ["status", "rev"], case="title", fill={"status": "Unknown", "rev": 0.0}, coerce=False))
    assert got[2][1] == "Hello World"
    assert [r.status for r in rows.clean(df, ["status"], fill="Unknown").collect()] == ["Unknown", "Unknown", "hello world"]
    assert [r.rev for r in rows.clean(df, ["rev"], coerce=True, fill=0.0).collect()] == [42.0, 0.0, 4.8]
    assert [r.rev for r in rows.cast(df, {"rev": "integer"}).collect()] == [42, None, None]
    assert [r.rev for r in rows.cast(df, {"rev": "integer"}, "keep").collect()] == ["42", "x", "4.8"]
    assert rows.cast(df, {"rev": "number"}, "skip-row").count() == 2
    with pytest.raises(Exception, match="not integer"):
        rows.cast(df, {"rev": "integer"}, "fail").collect()
    e = spark.createDataFrame([(1, "United States, Germany, France"), (2, "Turkey"), (3, None), (4, '["a","b"]')], "id long, country string")
    assert [r.country for r in rows.explode(e, "country").collect()] == ["United States", "Germany", "France", "Turkey", "a", "b"]
    assert rows.explode(e, "country", preserve=True).count() == 7
    n = spark.createDataFrame([(1, ("Alice", (28, "Istanbul")), [1, 2])], "id long, user struct<name: string, profile: struct<age: long, city: string>>, a array<long>")
    assert rows.flatten(n).columns == ["id", "user.name", "user.profile.age", "user.profile.city", "a"]
    assert rows.flatten(n, arrays=True).columns[-2:] == ["a.0", "a.1"]
    assert rows.flatten(n, "_", depth=1).columns == ["id", "user_name", "user_profile", "a"]
    m = spark.createDataFrame([("alice@corp.com", "555-123-6543", "1234567898765432", "10.0.1.2", "Alice Smith", None)], "e string, p string, c string, i string, n string, z string")
    got = rows.mask(m, {"e": "email", "p": "phone", "c": "card", "i": "ip", "n": "name", "z": "redact"}).first()
    assert tuple(got) == ("a***@corp.com", "***-***-6543", "**** **** **** 5432", "10.0.***.***", "A*** S***", None)
    assert rows.select_columns(df, ["rev", "nope"]).first().nope == ""
    assert rows.derive(df, {"id": "id + 1", "twice": "id * 2"}).first()[0::3] == (2.0, 2.0)
    assert rowsof(rows.map_rows(df, lambda r: {"k": r["id"] * 10}, "k long")) == [(10,), (20,), (30,)]


def test_sets(spark):
    a, b = spark.createDataFrame([(1, 2)], "a long, b long"), spark.createDataFrame([(3, 4, 5)], "a long, b long, c long")
    assert rowsof(setops.concat([a, b], source_col="f", labels=["x", "y"])) == [(1, 2, "x", None), (3, 4, "y", 5)] or setops.concat([a, b]).count() == 2
    assert setops.concat([a, b], "intersect").columns == ["a", "b"]
    assert setops.union_distinct([a, a]).count() == 1


def test_diff(spark):
    schema = "id string, name string, status string, price string"
    a = spark.createDataFrame([("1", "Alice", "active", "120"), ("2", "Bob", "draft", "250"), ("3", "Carol", "active", "90")], schema)
    b = spark.createDataFrame([("1", "Alice", "active", "120"), ("2", "Bob", "active", "260"), ("4", "David", "active", "310")], schema)
    d = diff.diff(a, b, "id")
    assert {r.id: (r.change_type, r.changed_columns) for r in d.collect()} == {"1": ("unchanged", []), "2": ("changed", ["status", "price"]), "3": ("removed", []), "4": ("added", [])}
    assert {(r.change_type, r.column): r["count"] for r in diff.summary(d).collect()}[("changed", "price")] == 1
    assert {r.change_type for r in diff.diff(a, a, "id").collect()} == {"unchanged"}
    typed = spark.createDataFrame([(1, "Alice", "active", 120.0), (2, "Bob", "draft", 250.0), (3, "Carol", "active", 90.0)], "id long, name string, status string, price double")
    assert {r.change_type for r in diff.diff(a, typed, "id", coerce=True).collect()} == {"unchanged"}
    assert {r.change_type for r in diff.diff(a, typed, "id").collect()} == {"added", "removed"}
    keys = spark.createDataFrame([("a:b", "c", 1), ("a", "b:c", 2)], "k1 string, k2 string, v long")
    other = spark.createDataFrame([("a:b", "c", 9), ("a", "b:c", 2)], "k1 string, k2 string, v long")
    assert sorted(r.change_type for r in diff.diff(keys, other, "k1,k2").collect()) == ["changed", "unchanged"]
    near = spark.createDataFrame([(1, 10.0001)], "id long, v double"), spark.createDataFrame([(1, 10.0002)], "id long, v double")
    assert diff.diff(*near, "id").first().change_type == "changed" and diff.diff(*near, "id", epsilon=0.001).first().change_type == "unchanged"
    twice = a.union(a)
    with pytest.raises(DuplicateKeyError):
        diff.diff(twice, b, "id")
    assert diff.diff(twice, b, "id", duplicates="last").count() == 4
    with pytest.raises(ArgumentError):
        diff.diff(a, b, "id", ignore=["id"])
    with pytest.raises(MismatchError):
        diff.fail_on_difference(d)
    lines = sorted(r.value for r in diff.patch(d, "id").collect())
    assert lines[0] == '{"op":"delete","key":{"id":"3"}}' and '"changes":{"status":{"old":"draft","new":"active"}' in lines[2]
    assert diff.schema_diff(a, typed)["changed"] == [("id", "string", "bigint"), ("price", "string", "double")]


def test_time(spark):
    df = spark.createDataFrame([("2026-01-01 10:05:00", 50, 30), ("2026-01-01 10:25:00", 70, 50), ("2026-01-01 11:10:00", 100, 80), ("2026-01-01 11:40:00", 20, 90), ("bad", 1, 1)], "time string, cpu long, mem long")
    got = timeseries.resample(df, "time", "1h", "avg(cpu) as c, max(mem) as m, count(*) as n", output="iso").collect()
    assert [tuple(r) for r in got] == [("2026-01-01T10:00:00.000Z", 60.0, 50.0, 2), ("2026-01-01T11:00:00.000Z", 60.0, 90.0, 2)]
    gap = spark.createDataFrame([("2026-01-01 10:00:00", 10), ("2026-01-01 13:00:00", 40)], "time string, temp long")
    fill = lambda how: [r.t for r in timeseries.resample(gap, "time", "1h", "sum(temp) as t", how).collect()]
    assert fill("ffill") == [10, 10, 10, 40] and fill("bfill") == [10, 40, 40, 40] and fill("linear") == [10, 20, 30, 40] and fill("zero") == [10, 0, 0, 40] and fill("null") == [10, None, None, 40]
    assert timeseries.parse_interval("15m") == (900, "second") and timeseries.parse_interval("2mo") == (2, "month") and timeseries.parse_interval("s") == (1, "second")
    week = spark.createDataFrame([("2026-01-08",)], "time string")
    assert timeseries.resample(week, "time", "1w", output="date_only").first()[0] == "2026-01-08"  # weeks start on Thursday
    assert timeseries.resample(df, "time", "1h", "first(cpu) as a, last(cpu) as b", order_by="time").first()[1:] == (50, 70)


def test_profile(spark):
    df = spark.createDataFrame([("1", "a@x.co", "30", "2026-01-01"), ("2", "b@x.co", "x", "2026-01-02"), ("3", None, "5", "2026-01-03")], "id string, email string, age string, d string")
    got = {r.column: (r.type, r.nullable, r.semantic) for r in profile.infer_schema(df).collect()}
    assert got["id"] == ("integer", False, None) and got["email"] == ("string", True, "email") and got["age"][0] == "mixed" and got["d"][0] == "date"
    rules = {"id": {"type": "integer", "nullable": False}, "email": {"format": "email", "nullable": False}, "age": {"type": "integer"}}
    out = {(r.column, r.rule): (r.violations, r.samples) for r in profile.validate(df, rules).collect()}
    assert out[("age", "type")] == (1, ["x"]) and out[("email", "nullable")][0] == 1 and out[(None, None)][0] == 2
    with pytest.raises(ValidationError):
        profile.require_valid(df, rules)
    t = spark.createDataFrame([(1, -50), (2, 10), (3, 5), (3, 7)], "id long, amount long")
    assert [r.violations for r in profile.data_tests(t, ["amount >= 0", "not_null(id)", "unique(id)", "amount >>"], min_rows=5).collect()] == [1, 0, 1, 4, 1]
    v = spark.createDataFrame([(float(i),) for i in range(1, 101)], "val double")
    q = profile.quantiles(v, ["val"], (90, 99)).first()
    assert (q.median, q.q1, q.q3, q.p90, q.p99) == (50.5, 25.75, 75.25, 90.1, 99.01)
    s = profile.numeric_stats(spark.createDataFrame([("10",), (None,), ("",), ("30",)], "v string"), "v").first()
    assert (s["count"], s.nulls, s["mean"]) == (2, 2, 20.0)
    assert profile.numeric_stats(v.limit(1), "val").first().stddev == 0.0
    assert [r["count"] for r in profile.histogram(v, "val", 4).collect()] == [25, 25, 25, 25]
    assert {r.column for r in profile.profile(df).collect()} == set(df.columns)
    sem = spark.createDataFrame([("123e4567-e89b-12d3-a456-426614174000",), ("10.0.0.1",), ("TR",), ("EUR",), ("+90 555 123 45 67",), ("zzz",)], "s string")
    assert [r[0] for r in sem.select(profile.semantic_type(F.col("s"))).collect()] == ["uuid", "ipv4", "country-code", "currency", "phone", None]


def test_statistics(spark):
    df = spark.createDataFrame([(i, 2 * i, 12 - 2 * i, "x" if i > 2 else "y") for i in range(1, 6)], "a long, b long, c long, g string")
    assert {(r.a, r.b): r.r for r in statistics.correlation(df, ["a", "b", "c"]).collect()}[("a", "c")] == -1.0
    r = statistics.regression(spark.createDataFrame([(float(x), 2.0 * x + 3) for x in range(5)], "x double, y double"), "x", "y").first()
    assert (r.slope, r.intercept, r.r, r.r2) == (2.0, 3.0, 1.0, 1.0)
    o = spark.createDataFrame([(i, v) for i, v in enumerate([10, 11, 12, 10, 11, 12, 10, 11, 12, 1000], 1)], "id long, amount long")
    assert [r.id for r in statistics.outliers(o, "amount", "zscore", 2.5, only=True).collect()] == [10]
    assert [r.id for r in statistics.outliers(o, "amount", "iqr", only=True).collect()] == [10]
    assert [r.id for r in statistics.outliers(o, "amount", "mad", only=True).collect()] == [10]
    assert statistics.outliers(o, "amount", "iqr", invert=True).count() == 9
    c = statistics.crosstab(spark.createDataFrame([("Action", "R"), ("Action", "R"), ("Action", "PG"), ("Comedy", "PG"), ("Comedy", "R")], "g string, r string"), "g", "r")
    wide = {r.row: (r.PG, r.R, r.Total) for r in statistics.crosstab_wide(c).collect()}
    assert wide == {"Action": (1, 2, 3), "Comedy": (1, 1, 2), "Total": (2, 3, 5)}
    assert statistics.chi_square(c).first().dof == 1
    e = spark.createDataFrame([("a", "p", "1"), ("a", "q", "1"), ("b", "p", "0"), ("b", "q", "0")], "x1 string, x2 string, y string")
    assert [(r.feature, r.information_gain) for r in statistics.entropy(e, ["x1", "x2"], "y").collect()] == [("x1", 1.0), ("x2", 0.0)]


def test_business(spark):
    o = spark.createDataFrame([("c1", "2024-01-10", 100), ("c1", "2024-01-12", 200), ("c1", "2024-01-15", 300), ("c2", "2024-01-01", 50), ("c3", "2023-12-01", 20)], "customer_id string, date string, amount long")
    r = {x.customer_id: x for x in B.rfm(o, "customer_id", "date", "amount", "2024-01-16").collect()}
    assert (r["c1"].frequency, r["c1"].monetary, r["c1"].recency_days) == (3, 600.0, 1) and r["c1"].segment == "Champions"
    assert sum(x["count"] for x in B.rfm_summary(B.rfm(o, "customer_id", "date", "amount")).collect()) == 3
    c = spark.createDataFrame([("u1", "2024-01-05"), ("u1", "2024-02-05"), ("u2", "2024-01-09"), ("u3", "2024-02-01")], "user_id string, date string")
    assert [(r.users, r.offset, r.active, r.rate) for r in B.cohorts(c, "user_id", "date").collect()][:2] == [(2, 0, 2, 100.0), (2, 1, 1, 50.0)]
    assert "+M1" in B.cohort_matrix(B.cohorts(c, "user_id", "date")).columns
    f = spark.createDataFrame([("a", "view", 1), ("a", "cart", 2), ("a", "purchase", 3), ("b", "View", 1), ("b", "cart", 2), ("c", "cart", 1), ("c", "view", 2)], "user_id string, step string, t long")
    got = B.funnel(f, "user_id", "step", ["view", "cart", "purchase"], time="t").collect()
    assert [r.users for r in got] == [3, 2, 1] and got[2].conversion == 33.3
    assert [r.users for r in B.funnel(f, "user_id", "step", ["view", "cart", "purchase"]).collect()] == [3, 3, 1]
    ab = spark.createDataFrame([("control", 1 if i < 100 else 0) for i in range(1000)] + [("variant", 1 if i < 150 else 0) for i in range(1000)], "variant string, converted long")
    r = B.ab_test(ab, "variant", "converted", "control", "variant").first()
    assert r.statistic > 3 and r.p_value < 0.01 and r.lift_pct == pytest.approx(50) and r.significant and r.test_type == "proportion"
    w = spark.createDataFrame([("a", 50 + i % 10) for i in range(100)] + [("b", 80 + i % 10) for i in range(100)], "group string, revenue long")
    r = B.ab_test(w, "group", "revenue", "a", "b").first()
    assert (r.control_metric, r.variant_metric, r.test_type) == (54.5, 84.5, "means") and r.p_value < 1e-6
    p = spark.createDataFrame([("P1", 1000), ("P2", 500), ("P3", 300), ("P4", 100), ("P5", 50), ("P6", 50)], "product string, revenue long")
    items = B.pareto(p, "product", "revenue")
    assert [r.abc_class for r in items.collect()] == ["A", "A", "B", "B", "C", "C"]
    assert {r.abc_class: r["items"] for r in B.pareto_summary(items).collect()} == {"A": 2, "B": 2, "C": 2}
    assert B.detect_column(o, "amount|total", 0) == "amount"


def test_pareto_ties(spark):
    """Equal totals are ties by item, in whichever order their rows are added up."""
    rows = [("b", 0.1), ("b", 0.2), ("b", 0.3), ("a", 0.3), ("a", 0.2), ("a", 0.1)]
    got = B.pareto(spark.createDataFrame(rows, "item string, v double").coalesce(1), "item", "v").collect()
    assert [(r["rank"], r["item"], r["value"]) for r in got] == [(1, "a", 0.6), (2, "b", 0.6)]
    odd = B.pareto(spark.createDataFrame([("a", 1e300), ("b", 1.0)], "item string, v double"), "item", "v").collect()
    assert [(r["item"], r["abc_class"]) for r in odd] == [("a", "A"), ("b", "C")]


def test_finance(spark):
    prices = [10, 11, 12, 13, 14, 15, 14, 13, 12, 11]
    df = spark.createDataFrame([(i, float(p), 100) for i, p in enumerate(prices)], "time long, price double, volume long")
    got = finance.indicators(df, ["sma(3)", "vwap", "bb(3)", "ema(3)", "rsi(3)", "macd(2,3,2)", "atr(3)"], "price", "time", volume="volume").orderBy("time").collect()
    assert [r.sma_3 for r in got[:4]] == [None, None, 11.0, 12.0] and [r.vwap for r in got[:3]] == [10.0, 10.5, 11.0] and got[2].bb_middle == 11.0
    assert got[2].ema_3 == 11.0 and got[3].ema_3 == 12.0 and got[3].rsi_3 == 100.0 and got[-1].rsi_3 < 50 and got[2].macd is not None and got[1].atr_3 is None and got[2].atr_3 == pytest.approx(2 / 3, abs=1e-4)
    assert math.isnan(got[0].sma_3 or float("nan"))


def test_text_and_clusters(spark):
    t = spark.createDataFrame([("The quick brown fox! Quick.",), ("a quick brown dog",)], "text string")
    got = {r.ngram: r["count"] for r in text.ngrams(t, "text").collect()}
    assert got["quick brown"] == 2 and len(got) == 6
    assert "the quick" not in {r.ngram for r in text.ngrams(t, "text", stopwords=True).collect()}
    r = random.Random(1)
    pts = spark.createDataFrame([(10 + r.random(), 10 + r.random()) for _ in range(50)] + [(100 + r.random(), 100 + r.random()) for _ in range(50)] + [(None, 1.0)], "x double, y double")
    centres = cluster.k_means(pts, ["x", "y"], 2)
    out = cluster.assign(pts, ["x", "y"], centres).collect()
    assert len({x._cluster_id for x in out[:50]}) == 1 and out[0]._cluster_id != out[60]._cluster_id and out[100]._cluster_id is None


def test_recurrences_over_any_batches():
    """Smoothing goes on over batches that end anywhere; against one value at a time."""
    import random

    def plain(xs, n, alpha):
        out, y = [], None
        for i, x in enumerate(xs):
            y = sum(xs[:n]) / n if i == n - 1 else None if i < n else alpha * x + (1 - alpha) * y
            out.append(np.nan if y is None else y)
        return out

    r = random.Random(1)
    for _ in range(60):
        every = [[r.random() * 100 for _ in range(r.randint(1, 30))] for _ in range(r.randint(1, 6))]
        flat = [(k, x) for k, xs in enumerate(every) for x in xs]
        carry, last, got, at = finance.START, None, [], 0
        while at < len(flat):
            part = flat[at : at + r.randint(1, 25)]
            at += len(part)
            keys = np.array([k for k, _ in part])
            series = np.cumsum(np.r_[False, keys[1:] != keys[:-1]]) + (keys[0] != last)
            y, carry = finance.smoothed(np.array([x for _, x in part]), series, 7, 0.25, carry)
            got += y.tolist()
            last = keys[-1]
        assert np.allclose(got, [y for xs in every for y in plain(xs, 7, 0.25)], equal_nan=True)
