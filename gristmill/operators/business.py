"""RFM, cohorts, funnels, A/B tests and Pareto classes. Places and running sums over all customers or items come from range sorts."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ArgumentError
from ..functions import coerce as co
from ..functions.expression import quoted
from .ordering import placed


def _kind(df: DataFrame, c: str) -> str:
    return co.kind_of(df.schema[c].dataType)


def detect_column(df: DataFrame, pattern: str, fallback: int) -> str:
    """The first column whose name matches, or the one at a place."""
    import re

    return next((c for c in df.columns if re.search(pattern, c, re.I)), df.columns[min(fallback, len(df.columns) - 1)])


#: Segments by the first rule that holds: name, least and most of recency, frequency and monetary score. Fixed values.
SEGMENTS = [
    ("Champions", (4, 5), (4, 5), (4, 5)),
    ("Can't Lose Them", (1, 2), (4, 5), (4, 5)),
    ("At Risk", (1, 2), (3, 5), (3, 5)),
    ("Loyal Customers", (3, 5), (3, 5), (3, 5)),
    ("Potential Loyalists", (4, 5), (2, 5), (2, 5)),
    ("New Customers", (4, 5), (1, 2), (1, 5)),
    ("Promising", (3, 5), (1, 2), (2, 5)),
    ("Customers Needing Attention", (2, 5), (2, 5), (2, 5)),
    ("Hibernating / Lost", (1, 2), (1, 2), (1, 2)),
    ("About to Sleep", (1, 2), (1, 5), (1, 5)),
]


def rfm(df: DataFrame, customer: str, date: str, amount: str, as_of: str | None = None) -> DataFrame:
    """customer_id, recency_days, frequency, monetary, r_score, f_score, m_score, segment. Scores are fifths of the rank; ties go by customer."""
    ts = co.event_time(quoted(date), _kind(df, date))
    rows = df.select(quoted(customer).cast("string").alias("customer_id"), F.unix_millis(ts).alias("ms"), F.coalesce(co.parse_float(quoted(amount), _kind(df, amount)), F.lit(0.0)).alias("amount"))
    every = rows.filter("customer_id <> ''").groupBy("customer_id").agg(F.max("ms").alias("last"), F.count(F.lit(1)).alias("frequency"), F.sum("amount").alias("total"))
    whole = every.agg(F.max("last").alias("last"), F.count(F.lit(1)).alias("n")).first()
    ref = F.unix_millis(F.lit(as_of).cast("timestamp")) if as_of else F.lit(whole["last"]).cast("long")
    days = F.when(F.col("last").isNull(), F.lit(999)).otherwise(F.greatest(F.floor((ref - F.col("last")) / 86400000.0), F.lit(0)))
    out = every.withColumn("recency_days", days.cast("long"))
    for score, c in (("r_score", "recency_days"), ("f_score", "frequency"), ("m_score", "total")):
        share = F.col(score) / F.lit(float(whole["n"] or 1))
        fifth = F.least(F.greatest(F.ceil(share * 5 - 1e-9), F.lit(1)), F.lit(5)).cast("int")
        out = placed(out, [F.col(c), F.col("customer_id")], score).withColumn(score, 6 - fifth if score == "r_score" else fifth)
    segment = F.lit("Promising")
    for name, *ranges in reversed(SEGMENTS):
        holds = F.lit(True)
        for c, (a, b) in zip(("r_score", "f_score", "m_score"), ranges, strict=True):
            holds = holds & F.col(c).between(a, b)
        segment = F.when(holds, name).otherwise(segment)
    return out.select("customer_id", "recency_days", "frequency", co.half_up(F.col("total"), 2).alias("monetary"), "r_score", "f_score", "m_score", segment.alias("segment"))


def rfm_summary(scores: DataFrame) -> DataFrame:
    total = F.sum("count").over(Window.partitionBy())
    out = scores.groupBy("segment").agg(F.count(F.lit(1)).alias("count"), F.avg("recency_days").alias("r"), F.avg("frequency").alias("f"), F.avg("monetary").alias("m"), F.sum("monetary").alias("revenue"))
    return out.select("segment", "count", co.half_up(F.col("count") * 100.0 / total, 1).alias("percent"), co.half_up(F.col("r"), 1).alias("avg_recency"), co.half_up(F.col("f"), 1).alias("avg_frequency"), co.half_up(F.col("m"), 2).alias("avg_monetary"), co.half_up(F.col("revenue"), 2).alias("revenue"))


def _period(ts: Column, period: str) -> Column:
    """The number of a day, ISO week, month or year."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date"))
    return {"day": days, "week": F.floor((days + 3) / 7).cast("int"), "month": (F.year(ts) - 1970) * 12 + F.month(ts) - 1, "year": F.year(ts) - 1970}[period]


def _period_start(n: Column, period: str) -> Column:
    epoch = F.lit("1970-01-01").cast("date")
    return {"day": F.date_add(epoch, n), "week": F.date_add(epoch, n * 7 - 3), "month": F.add_months(epoch, n), "year": F.add_months(epoch, n * 12)}[period]


def cohorts(df: DataFrame, user: str, date: str, period: str = "month", most: int = 12) -> DataFrame:
    """cohort (start of its period), users, offset, active, rate: users by first period, active again ``offset`` periods later."""
    ts = co.event_time(quoted(date), _kind(df, date))
    seen = df.select(quoted(user).alias("u"), _period(ts, period).alias("p")).filter("u is not null and p is not null").distinct()
    first = seen.groupBy("u").agg(F.min("p").alias("first"))
    active = seen.join(first, "u").select("u", "first", (F.col("p") - F.col("first")).alias("offset")).filter(F.col("offset") <= most)
    counts = active.groupBy("first", "offset").agg(F.count(F.lit(1)).alias("active"))
    size = first.groupBy("first").agg(F.count(F.lit(1)).alias("users"))
    return counts.join(size, "first").select(_period_start(F.col("first"), period).alias("cohort"), "users", F.col("offset").cast("long").alias("offset"), "active", co.half_up(F.col("active") * 100.0 / F.col("users"), 1).alias("rate")).orderBy("cohort", "offset")


LABELS = {"month": "+M", "week": "+Wk ", "day": "+Day ", "year": "+Yr "}


def cohort_matrix(long: DataFrame, period: str = "month", most: int = 12, value: str = "rate") -> DataFrame:
    labelled = long.withColumn("label", F.concat(F.lit(LABELS[period]), F.col("offset").cast("string")))
    return labelled.groupBy("cohort", "users").pivot("label", [f"{LABELS[period]}{i}" for i in range(most + 1)]).agg(F.first(value)).orderBy("cohort")


def funnel(df: DataFrame, user: str, step: str, steps: Iterable[str], time: str | None = None, window_ms: int | None = None, order_by: str | None = None) -> DataFrame:
    """step_number, step, users, conversion (of the first step), step_conversion, drop_off. Each user's events are matched greedily in order.

    The state carried over a user's events is one number; per step it is the
    first event after the previous step's, found by one aggregation a step.
    """
    steps = [s.strip() for s in steps]
    if not steps:
        raise ArgumentError("a funnel needs steps")
    lower = [s.lower() for s in steps]
    at = co.event_time(quoted(time), _kind(df, time)) if time else None
    order = F.struct(*([F.unix_millis(at)] if time else []), *([quoted(order_by)] if order_by else []), F.lit(0))
    events = df.select(quoted(user).cast("string").alias("u"), F.lower(F.trim(quoted(step).cast("string"))).alias("s"), order.alias("o"), (F.unix_millis(at) if time else F.lit(0)).alias("ms")).filter(F.col("s").isin(*lower) & (F.col("u") != ""))
    reached, counts = None, []
    for i, s in enumerate(lower):
        here = events.filter(F.col("s") == s)
        if not (time or order_by):  # without any order a user has a step if all steps before are there too
            got = here.select("u").distinct()
            reached = got if reached is None else reached.join(got, "u", "left_semi")
        elif reached is None:
            reached = here.groupBy("u").agg(F.min(F.struct("o", "ms")).alias("x")).select("u", F.col("x.o").alias("at"), F.col("x.ms").alias("start"))
        else:
            later = here.join(reached, "u").filter(F.col("o") > F.col("at"))
            if window_ms is not None:
                later = later.filter(F.col("ms") - F.col("start") <= window_ms)
            reached = later.groupBy("u", "start").agg(F.min("o").alias("at"))
        counts.append(reached.agg(F.count(F.lit(1)).alias("users")).select(F.lit(i + 1).cast("long").alias("step_number"), F.lit(steps[i]).alias("step"), "users"))
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    w = Window.orderBy("step_number")  # one row per step
    first, before = F.first("users").over(w), F.lag("users").over(w)
    share = lambda a, b: F.when(b > 0, co.half_up(a * 100.0 / b, 1)).otherwise(0.0)
    out = out.select("*", share(F.col("users"), first).alias("conversion"), F.when(before.isNull(), 100.0).otherwise(share(F.col("users"), before)).alias("step_conversion"))
    return out.withColumn("drop_off", F.when(F.col("step_number") == 1, 0.0).otherwise(co.half_up(100 - F.col("step_conversion"), 1))).orderBy("step_number")


def normal_cdf(z: Column) -> Column:
    """Abramowitz and Stegun 26.2.17; the coefficients are fixed values."""
    t = 1 / (1 + F.abs(z) * 0.2316419)
    poly = F.lit(0.0)
    for c in (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.31938153):
        poly = (poly + c) * t
    tail = F.exp(z * z * -0.5) / F.lit((2 * 3.141592653589793) ** 0.5) * poly
    return F.when(z >= 0, 1 - tail).otherwise(tail)


Z = {0.90: 1.645, 0.95: 1.96, 0.99: 2.576}


def ab_test(df: DataFrame, group: str, value: str, control: str, variant: str, kind: str = "auto", confidence: float = 0.95) -> DataFrame:
    """One row: sizes, rates or means, difference, lift, statistic, p-value, interval, significance. Two-proportion z for 0/1 values, else Welch's t."""
    raw = F.lower(F.trim(quoted(value).cast("string")))
    v = F.when(raw.isin("true", "yes"), 1.0).when(raw.isin("false", "no"), 0.0).otherwise(co.parse_float(quoted(value), _kind(df, value)))
    rows = df.select(quoted(group).cast("string").alias("g"), v.alias("v")).filter(F.col("g").isin(control, variant) & F.col("v").isNotNull())
    side = lambda g, f, x="v": f(F.when(F.col("g") == g, F.col(x)))
    out = rows.agg(*(f.alias(n + k) for k, g in (("1", control), ("2", variant)) for n, f in (("n", side(g, F.count)), ("x", side(g, F.sum)), ("m", side(g, F.avg)), ("v", F.coalesce(side(g, F.var_samp), F.lit(0.0))))), F.min(F.col("v").isin(0.0, 1.0)).alias("binary"))
    n1, n2, m1, m2, v1, v2 = (F.col(c) for c in ("n1", "n2", "m1", "m2", "v1", "v2"))
    binary = {"auto": F.col("binary"), "proportion": F.lit(True), "means": F.lit(False)}[kind]
    pooled = (F.col("x1") + F.col("x2")) / (n1 + n2)
    diff = m2 - m1
    se_test = F.when(binary, F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n2))).otherwise(F.sqrt(v1 / n1 + v2 / n2))
    se = F.when(binary, F.sqrt(m1 * (1 - m1) / n1 + m2 * (1 - m2) / n2)).otherwise(se_test)
    statistic = F.when(se_test > 0, diff / se_test).otherwise(0.0)
    low = F.pow(v1 / n1, F.lit(2.0)) / F.greatest(n1 - 1, F.lit(1)) + F.pow(v2 / n2, F.lit(2.0)) / F.greatest(n2 - 1, F.lit(1))
    dof = F.when(low > 0, F.pow(v1 / n1 + v2 / n2, F.lit(2.0)) / low).otherwise(1.0)
    size = F.abs(statistic) * F.when(binary | (dof >= 100), 1.0).otherwise(1 - 1 / (dof * 4))
    p = F.least(F.greatest((1 - normal_cdf(size)) * 2, F.lit(0.0)), F.lit(1.0))
    lift = F.when(m1 != 0, diff / m1 * 100).otherwise(0.0)
    z = Z.get(confidence, 1.96)
    return out.select(
        F.when(binary, "proportion").otherwise("means").alias("test_type"), n1.alias("control_n"), n2.alias("variant_n"), m1.alias("control_metric"), m2.alias("variant_metric"), diff.alias("difference"), lift.alias("lift_pct"),
        statistic.alias("statistic"), p.alias("p_value"), (diff - se * z).alias("ci_low"), (diff + se * z).alias("ci_high"), (p < 1 - confidence).alias("significant"),
    )


def _exact(df: DataFrame, c: str) -> str | None:
    """The decimal type in which sums of a column's doubles are exact to 38 digits, so that they depend on no order; none if a value is not finite or too large."""
    most = df.agg(F.sum(F.abs(c))).first()[0] or 0.0
    return f"decimal(38,{min(30, 36 - max(0, math.ceil(math.log10(most + 1))))})" if most < 1e30 else None


def pareto(df: DataFrame, item: str, value: str, a: float = 80.0, b: float = 95.0) -> DataFrame:
    """rank, item, value, share_pct, cumulative_value, cumulative_pct, abc_class; largest first, ties by item.

    Sums are decimal, so items of the same total are ties whatever the order of their rows.
    """
    v = F.coalesce(co.parse_float(quoted(value), _kind(df, value)), F.lit(0.0))
    rows = df.select(quoted(item).cast("string").alias("item"), v.alias("v")).filter("item <> ''")
    exact = _exact(rows, "v")
    sums = rows.groupBy("item").agg(F.sum(F.col("v").cast(exact) if exact else "v").alias("v"))
    total = sums.agg(F.sum("v")).first()[0] or 0.0
    out = placed(sums, [F.desc("v"), F.col("item")], "rank", {"run": "v"}).withColumns({"v": F.col("v").cast("double"), "run": F.col("run").cast("double"), "total": F.lit(float(total))})
    share = lambda c: F.when(F.col("total") > 0, F.col(c) / F.col("total") * 100).otherwise(0.0)
    cls = F.when((share("run") <= a) | (F.col("rank") == 1), "A").when(share("run") <= b, "B").otherwise("C")
    return out.select("rank", "item", co.half_up(F.col("v"), 2).alias("value"), co.half_up(share("v"), 2).alias("share_pct"), co.half_up(F.col("run"), 2).alias("cumulative_value"), co.half_up(share("run"), 1).alias("cumulative_pct"), cls.alias("abc_class")).orderBy("rank")


def pareto_summary(items: DataFrame) -> DataFrame:
    every = Window.partitionBy()
    out = items.groupBy("abc_class").agg(F.count(F.lit(1)).alias("items"), F.sum("value").alias("v"))
    return out.select("abc_class", "items", co.half_up(F.col("items") * 100.0 / F.sum("items").over(every), 1).alias("item_pct"), co.half_up(F.col("v"), 2).alias("value"), co.half_up(F.col("v") * 100.0 / F.sum("v").over(every), 1).alias("value_pct"))
