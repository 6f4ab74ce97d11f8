"""Equi-joins with null-safe, type-strict keys, and fuzzy string joins."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ArgumentError
from ..functions import coerce as co
from ..functions.expression import quoted
from .alike import all_pairs

KINDS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "outer": "full", "semi": "left_semi", "anti": "left_anti"}


def parse_keys(on: str | Iterable[str] = "id", left_on: Iterable[str] | None = None, right_on: Iterable[str] | None = None) -> list[tuple[str, str]]:
    """"a,b" or "user_id=id", or two lists."""
    if left_on or right_on:
        left, right = list(left_on or right_on), list(right_on or left_on)
        if len(left) != len(right):
            raise ArgumentError("the two sides have different numbers of keys")
        return list(zip(left, right, strict=True))
    items = on.split(",") if isinstance(on, str) else on
    return [(a.strip(), (b or a).strip()) for a, _, b in (x.partition("=") for x in items)]


def _names(left: list[str], right: list[str], keys: list[str], prefix: str, suffix: str | None) -> dict[str, str]:
    """Output names of the right side's columns that are no keys; a name taken by the left side gets a suffix, and a chosen prefix or suffix is on all."""
    out = {}
    for c in right:
        if c in keys:
            continue
        decorate = prefix or suffix is not None or c in left
        out[c] = f"{prefix}{c}{suffix if suffix is not None else '_right' if not prefix else ''}" if decorate else c
    return out


def join(left: DataFrame, right: DataFrame, on: str | Iterable[str] = "id", how: str = "inner", left_on: Iterable[str] | None = None, right_on: Iterable[str] | None = None, prefix: str = "", suffix: str | None = None) -> DataFrame:
    """Null keys match null keys; keys of different kinds match nothing. The right side's keys are not repeated. Which side is broadcast, if any, is for the optimizer to say from their sizes."""
    if how not in KINDS:
        raise ArgumentError(f"unknown join {how!r}")
    keys = parse_keys(on, left_on, right_on)
    other = {c: f"_r{i}" for i, c in enumerate(right.columns)}
    r = right.select([quoted(c).alias(n) for c, n in other.items()])
    condition = None
    for a, b in keys:
        same = co.kind_of(left.schema[a].dataType) == co.kind_of(right.schema[b].dataType)
        one = quoted(a).eqNullSafe(F.col(other[b])) if same else F.lit(False)
        condition = one if condition is None else condition & one
    if how in ("semi", "anti"):
        return left.join(r, condition, KINDS[how])
    names = _names(left.columns, right.columns, [b for _, b in keys], prefix, suffix)
    if how in ("right", "full", "outer"):
        l = left.select(F.lit(True).alias("_l"), *(quoted(c) for c in left.columns))
        match = dict(keys)
        cols = [F.when(F.col("_l"), quoted(c)).otherwise(F.col(other[match[c]])).alias(c) if c in match else quoted(c) for c in left.columns]
        return l.join(r, condition, KINDS[how]).select(*cols, *(F.col(other[c]).alias(n) for c, n in names.items()))
    return left.join(r, condition, KINDS[how]).select(*(quoted(c) for c in left.columns), *(F.col(other[c]).alias(n) for c, n in names.items()))


def levenshtein(a: Column, b: Column) -> Column:
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / most)


def bigrams(s: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(2))))


def jaccard(a: Column, b: Column) -> Column:
    """Set Jaccard of character bigrams; strings of less than two characters are alike if equal."""
    x, y = bigrams(a), bigrams(b)
    return F.when((F.length(a) < 2) | (F.length(b) < 2), (a == b).cast("double")).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def _jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used, hits = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                hits.append(x)
                break
    if not hits:
        return 0.0
    swapped = sum(x != y for x, y in zip(hits, (b[j] for j in range(len(b)) if used[j]), strict=True)) / 2
    m = len(hits)
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    if jaro < 0.7:
        return jaro
    head = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        head += 1
    return jaro + head * 0.1 * (1 - jaro)


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else _jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def soundex(s: Column) -> Column:
    """Letters to digit classes; a vowel, H or W ends a run of one class. No letters: 0000."""
    w = F.upper(F.regexp_replace(s, "[^A-Za-z]", ""))
    code = F.translate(w, "AEIOUYHWBFPVCGJKQSXZDTLMNR", "00000000111122222222334556")
    once = F.regexp_replace(code, r"(\d)\1+", "$1")
    rest = F.regexp_replace(F.substring(once, 2, 1 << 30), "0", "")
    return F.when(w == "", F.lit("0000")).otherwise(F.rpad(F.concat(F.substring(w, 1, 1), rest), 4, "0"))


def soundex_similarity(a: Column, b: Column) -> Column:
    return (soundex(a) == soundex(b)).cast("double")


PIECE_ROWS = 1000  # of one piece in a task, above which it is split
FEW_PAIRS, CROWDED = 1_000_000, 0.25  # all pairs up to which nothing is counted; the part of them that meet above which all are walked
SCORES = {"levenshtein": levenshtein, "jaccard": jaccard, "jaro-winkler": jaro_winkler, "soundex": soundex_similarity}


def _crowded(a: DataFrame, b: DataFrame, meets: list[tuple[DataFrame, DataFrame]], key: str) -> bool:
    """Whether so many pairs meet in a key that it is cheaper to walk all."""
    every = a.count() * b.count()
    if every <= FEW_PAIRS:
        return False
    counts = [[df.groupBy(key).agg(F.count(F.lit(1)).cast("double").alias(n)) for df, n in zip(sides, ("_x", "_y"), strict=True)] for sides in meets]
    return sum(x.join(y, key).agg(F.sum(F.col("_x") * F.col("_y"))).first()[0] or 0 for x, y in counts) > CROWDED * every


def _by_segments(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame | None:
    """Pairs of ``_a`` and ``_b`` whose Levenshtein score reaches the threshold; none if most pairs share a piece.

    With k edits at most, one of k + 1 pieces of the longer string is whole in
    the shorter one; of the left-most such piece the edits before it are at most
    its number, those after it at most the rest, which bounds how far it moved.
    A piece of many longer strings is dealt among several tasks.
    """
    edits = f"int(floor((1 - {threshold!r}D) * {{0}} + 1e-9D))".format

    def pieces(df: DataFrame, name: str) -> DataFrame:
        n = f"length({name})"
        return (
            df.selectExpr(name, f"{n} AS _m", f"{edits(n)} AS _k").selectExpr("*", "int(_m div (_k + 1)) AS _w", "_k + 1 - _m % (_k + 1) AS _plain")
            .selectExpr("*", "explode(sequence(0, _k)) AS _i").selectExpr("*", "_i * _w + greatest(0, _i - _plain) AS _at")
            .selectExpr(name, "_m", "_k", "_i", "_at", f"substring({name}, _at + 1, _w + int(_i >= _plain)) AS _piece")
        )

    def places(df: DataFrame, name: str) -> DataFrame:
        widths = f"array_distinct(flatten(transform(sequence(_n, int(floor(_n / {threshold!r}D + 1e-9D))), m -> array(int(m div ({edits('m')} + 1)), int(ceil(m / ({edits('m')} + 1)))))))"
        return (
            df.selectExpr(name, f"length({name}) AS _n").selectExpr("*", f"explode({widths}) AS _w").filter("_w <= _n")
            .selectExpr("*", "explode(sequence(0, _n - _w)) AS _to").selectExpr(name, "_n", "_to", f"substring({name}, _to + 1, _w) AS _piece")
        )

    def meet(long: DataFrame, short: DataFrame, length: str) -> DataFrame:
        hot = long.groupBy("_piece").agg(F.ceil(F.count(F.lit(1)) / PIECE_ROWS).cast("int").alias("_parts")).filter("_parts > 1")
        long = long.join(hot, "_piece", "left").withColumn("_part", F.pmod(F.xxhash64(long.columns[0]), F.coalesce("_parts", F.lit(1)))).drop("_parts")
        short = short.join(hot, "_piece", "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
        n = int(long.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number given, as rows are small and their pairs are many
        found = long.repartition(n, "_piece", "_part").join(short.repartition(n, "_piece", "_part"), ["_piece", "_part"]).filter(f"{length} AND _n >= _m * {threshold!r}D - 1e-9D AND abs(_to - _at) <= _i AND abs(_to - _at - _n + _m) <= _k - _i")
        return found.filter("levenshtein(_a, _b, _k) >= 0").select("_a", "_b")

    if _crowded(a, b, [(pieces(a, "_a"), places(b, "_b")), (pieces(b, "_b"), places(a, "_a"))], "_piece"):
        return None
    return meet(pieces(a, "_a"), places(b, "_b"), "_m >= _n").union(meet(pieces(b, "_b"), places(a, "_a"), "_m > _n")).distinct()


def _by_rare_tokens(a: DataFrame, b: DataFrame, method: str, threshold: float) -> DataFrame | None:
    """Pairs of ``_a`` and ``_b`` that may reach the threshold: if two sets share s members, the rarest size - s + 1 of each have one in common. None if most pairs have (Jaccard)."""
    if method == "jaccard":
        share = threshold
        tokens = lambda c: F.when(F.length(c) < 2, F.array(c)).otherwise(bigrams(c))
    else:
        # a common head adds at most 0.4 of the rest to a Jaro score of 0.7 or more, which is at most (m / |a| + m / |b| + 1) / 3
        share = 3 * (max(0.7, (threshold - 0.4) / 0.6) if threshold >= 0.7 else threshold) - 2
        tokens = lambda c: F.transform(F.split(c, ""), lambda x, i: F.concat(x, F.size(F.filter(F.slice(F.split(c, ""), 1, i), lambda y: y == x)).cast("string")))
    each = [df.select(name, F.explode(tokens(F.col(name))).alias("_t")) for df, name in ((a, "_a"), (b, "_b"))]
    often = each[0].select("_t").union(each[1].select("_t")).groupBy("_t").agg(F.count(F.lit(1)).alias("_often"))

    def rarest(df: DataFrame, name: str) -> DataFrame:
        own = df.join(often, "_t").groupBy(name).agg(F.sort_array(F.collect_list(F.struct("_often", "_t"))).alias("_own"))
        shared = F.greatest(F.ceil(F.size("_own") * share - 1e-9).cast("int"), F.lit(1))
        return own.select(name, F.explode(F.slice("_own", 1, F.size("_own") - shared + 1)).alias("_x")).select(name, F.col("_x._t").alias("_t"))

    one, two = rarest(each[0], "_a"), rarest(each[1], "_b")
    if method == "jaccard" and _crowded(a, b, [(one, two)], "_t"):
        return None
    return one.join(two, "_t").select("_a", "_b").distinct()


def fuzzy_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, how: str = "left", method: str = "levenshtein", threshold: float = 0.75, best: bool = True, score_col: str = "_score", normalise: bool = True, prefix: str = "", suffix: str | None = None) -> DataFrame:
    """Rows whose strings are alike enough; with ``best`` the most alike of the right side only.

    Distinct strings are compared, not rows, so repeats on either side cost
    nothing. Strings meet only if they can be alike: in a piece that so few edits
    must leave whole (Levenshtein), in one of their rarest bigrams or characters
    (Jaccard, Jaro-Winkler) or in their code. Where most pairs meet so, as names
    with a common head do, all are walked instead (``alike``). No pair above the
    threshold is lost.
    """
    norm = (lambda c: F.lower(F.trim(c))) if normalise else (lambda c: c)
    own = left.select(*(quoted(c) for c in left.columns), norm(quoted(left_on).cast("string")).alias("_a"))
    other = {c: f"_r{i}" for i, c in enumerate(right.columns)}
    r = right.select(*(quoted(c).alias(n) for c, n in other.items()), norm(quoted(right_on).cast("string")).alias("_b"))
    a = own.filter("_a <> ''").select("_a").distinct()
    b = r.filter("_b <> ''").select("_b").distinct()
    if method == "levenshtein" and threshold > 0:
        pairs = _by_segments(a, b, threshold)
    elif method == "soundex" and threshold > 0:
        pairs = a.withColumn("_k", soundex(F.col("_a"))).join(b.withColumn("_k", soundex(F.col("_b"))), "_k").select("_a", "_b")
    elif threshold > 0:
        pairs = _by_rare_tokens(a, b, method, threshold)
    else:
        pairs = a.join(b, F.lit(True))  # with no threshold every pair is asked for
    if pairs is None:
        scored = all_pairs(a, b, method, threshold, best)
    else:
        scored = pairs.withColumn("_s", SCORES[method](F.col("_a"), F.col("_b"))).filter(F.col("_s") >= threshold)
    if best:
        scored = scored.groupBy("_a").agg(F.min(F.struct((-F.col("_s")).alias("m"), "_b")).alias("x")).select("_a", F.col("x._b").alias("_b"), (-F.col("x.m")).alias("_s"))
        if how in ("left", "inner"):  # of right rows with the same string, one
            w = Window.partitionBy("_b").orderBy(*other.values())
            r = r.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")
    linked = own.join(scored, "_a", "left" if how in ("left", "full") else "inner")
    names = _names(left.columns, right.columns, [], prefix, suffix)
    if how in ("left", "inner"):
        out = linked.join(r, "_b", how)
    else:
        out = linked.join(r, linked["_b"].eqNullSafe(r["_b"]) & linked["_b"].isNotNull(), "full" if how == "full" else "right")
    return out.select(*(quoted(c) for c in left.columns), *(F.col(other[c]).alias(n) for c, n in names.items()), co.half_up(F.col("_s"), 4).alias(score_col))
