"""The expression language: grammar, two-valued logic, coercions, every function."""

import pytest
from pyspark.sql import functions as F

from gristmill.errors import ParseError
from gristmill.functions.expression import compile_column, compile_filter, register_function, _str


@pytest.fixture(scope="module")
def row(spark):
    return spark.createDataFrame(
        [(5, 2.5, "abc", "", None, True, "12", " pad ", "2026-09-16T10:20:30Z", '{"user":{"city":"Istanbul"},"items":[{"price":99}]}', [1, 2], {"k": "v"}, (7, "x"), "a@b.co")],
        "n long, d double, s string, e string, z string, b boolean, t string, p string, at string, payload string, arr array<long>, m map<string,string>, st struct<a: long, b: string>, mail string",
    ).cache()


CASES = [
    ("1 + 2 * 3", 7.0), ("(1 + 2) * 3", 9.0), ("n - 2", 3.0), ("n-2", 3.0), ("-n", -5.0), ("-n | abs", 5.0), ("n + d | round(0)", 8.0), ("10 % 4", 2.0), ("n / 0", 5.0), ("n % 0", 0.0), ("n / z", 5.0),
    ("s + n", "abc5"), ("t + t", "1212"), ("t * 2", 24.0), ("z + 1", "1"), ("s == 'abc'", True), ("s != 'abc'", False), ("z != 'x'", True), ("z == null", True), ("e == null", True), ("s == null", False), ("z < 5", False), ("!(z < 5)", True),
    ("t > 3", True), ("s > 3", False), ("n == 5", True), ("t == 12", True), ("b == true", True), ("n > 3 && d < 3", True), ("n > 9 or b", True), ("not b", False), ("!e", True), ("n >= 5 and n <= 5", True), ("missing", None), ("missing == null", True),
    ("in(s, 'x', 'abc')", True), ("in(n, 4, 5)", True), ("notIn(z, 'x')", True), ("between(n, 1, 5)", True), ("between(s, 1, 5)", False), ("between(z, 0, 1)", True),
    ("year(at)", 2026.0), ("month(at)", 9.0), ("day(at)", 16.0), ("hour(at)", 10.0), ("minute(at)", 20.0), ("dayOfWeek(at)", 3.0), ("dateDiff('2026-09-16', '2026-09-10')", 6.0), ("dateDiff('2026-09-16 12:00:00', '2026-09-16', 'hours')", 12.0), ("year('nope')", None), ("isPast('2000-01-01')", True), ("isFuture('2999-01-01')", True), ("isToday('2000-01-01')", False),
    ("concat(s, '-', z, n)", "abc-5"), ("substr('hello', 1, 3)", "ell"), ("substr('hello', -3)", "llo"), ("substring('hello', 2)", "llo"), ("replace('a.b.c', '.', '_')", "a_b_c"), ("splitIndex('a|b|c', '|', 1)", "b"), ("splitIndex('a,b', ',', 5)", ""), ("indexOf('hello', 'l')", 2.0), ("indexOf('hello', 'z')", -1.0),
    ("padLeft(n, 3, '0')", "005"), ("padRight('abcd', 2)", "abcd"), ("contains('HeLLo', 'ell')", True), ("startsWith(s, 'ab')", True), ("endsWith(s, 'B')", False), ("lower('AbC')", "abc"), ("upper(z)", ""), ("trim(p)", "pad"), ("length(s)", 3.0), ("length(z)", 0.0), ("matches(s, '^a.c$')", True), ("matches(s, '[')", False),
    ("abs(-3)", 3.0), ("ceil(d)", 3.0), ("floor(d)", 2.0), ("sqrt(16)", 4.0), ("round(-2.5)", -2.0), ("round(2.345, 2)", 2.35), ("clamp(n, 1, 3)", 3.0), ("clamp(n, null, 3)", 3.0), ("clamp(n, 7)", 7.0), ("min(n, d, 9)", 2.5), ("max(n, z)", 5.0), ("pow(2, 3)", 8.0), ("pow(2)", 2.0), ("log(1)", 0.0), ("log(z)", 0.0),
    ("if(n > 3, 'big', 'small')", "big"), ("iif(e, 1, 2)", 2.0), ("if(e, 1)", None), ("isNull(e)", True), ("isNotNull(s)", True), ("coalesce(z, e, s)", "abc"), ("nvl(e, 'd')", "d"), ("nullIf(s, 'abc')", None), ("nullIf(n, 4)", 5),
    ("isNumber(t)", True), ("isNumber(s)", False), ("isEmail(mail)", True), ("isUrl('https://a.b/c')", True), ("isUuid('123e4567-e89b-12d3-a456-426614174000')", True), ("isDate(at)", True), ("isDate(s)", False), ("toInt('12.9abc')", 12.0), ("toFloat('1.5kg')", 1.5), ("toString(n)", "5"), ("toString(z)", ""), ("toBool('Yes')", True), ("toBool(e)", False),
    ("formatBytes(1536)", "1.5 KB"), ("formatBytes(0)", "0 B"), ("parseBytes('10MB')", 10485760.0), ("formatNumber(1234567.5)", "1,234,567.5"), ("jsonGet(payload, 'user.city')", "Istanbul"), ("payload.items.0.price == 99", True), ("payload.user.city", "Istanbul"), ("st.a", 7), ("arr.1", 2), ("arr.9", None), ("m.k", "v"), ("st.zzz", None), ("row.n", 5),
    ("s | upper | length", 3.0), ("`n` + 1", 6.0), ("'it\\'s'", "it's"), ("", None), ("t | toInt", 12.0),
]


@pytest.mark.parametrize("text, want", CASES)
def test_value(row, text, want):
    got = row.select(compile_column(text, row).alias("v")).first()[0]
    if isinstance(want, float):
        assert got == pytest.approx(want)
    else:
        assert got == want


def test_filters(spark):
    df = spark.createDataFrame([(1, 35, "a@x.com"), (2, 20, "b@x.com"), (3, 45, "c@x.com"), (4, None, None)], "id long, age long, email string")
    ids = lambda e: [r.id for r in df.filter(compile_filter(e, df)).collect()]
    assert ids("between(age, 30, 50) && endsWith(email, '.com')") == [1, 3]
    assert ids("!(age > 30)") == [2, 4]
    assert ids("age != 35") == [2, 3, 4]
    assert ids("") == [1, 2, 3, 4]


def test_comparisons_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    plan = df.filter(compile_filter("l_quantity > 30 and l_returnflag == 'R'", df))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,30.0)" in plan and "EqualTo(l_returnflag,R)" in plan


@pytest.mark.parametrize("text", ["1 +", "nope(1)", "a | 3", "(1", "substr()", "#"])
def test_errors(row, text):
    with pytest.raises(ParseError):
        compile_column(text, row)


def test_own_function(row):
    register_function("shout", lambda a: _str(F.concat(F.upper(a[0].text), F.lit("!"))))
    assert row.select(compile_column("shout(s)", row)).first()[0] == "ABC!"
