"""Synthetic rows from a specification: "id:seq,name:name,age:int(18,70),status:choice(a,b)"."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST = "Ada Ben Carla Dario Edda Finn Greta Hugo Ines Jonas Kira Leo Mona Nils Olga Pablo Ruth Sven Tara Uwe".split()
LAST = "Abel Brandt Castro Dubois Engel Ferrari Gruber Hansen Ivanov Jansen Keller Lopez Moser Novak Olsen Petrov Quint Rossi Sato Weber".split()
CITIES = ["Aarhus", "Bergen", "Cork", "Dresden", "Exeter", "Faro", "Ghent", "Haarlem", "Ivrea", "Jena"]
COMPANIES = ["Northwind Mills", "Blue Harbor", "Granite Works", "Lumen Labs", "Oak and Iron", "Quiet Systems"]
DOMAINS = ["example.com", "example.org", "example.net"]


def split_fields(spec: str) -> list[tuple[str, str]]:
    """Name and generator of each field; commas in brackets do not separate."""
    out, depth, at = [], 0, 0
    for i, ch in enumerate(spec + ","):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            name, _, how = spec[at:i].partition(":")
            out.append((name.strip(), how.strip() or "string"))
            at = i + 1
    return out


def field(how: str, seed: int) -> Column:
    name, _, raw = how.strip().partition("(")
    name, args = name.strip().lower(), [a.strip() for a in raw.rstrip(")").split(",")] if raw else []
    count = iter(range(100))

    def rand() -> Column:
        return F.rand(seed * 101 + next(count))

    def whole(low: int, high: int) -> Column:
        return F.floor(rand() * (high - low + 1) + low).cast("long")

    def pick(values: list[str]) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), F.floor(rand() * len(values) + 1).cast("int"))

    if name in ("seq", "sequence"):
        start, step = int(args[0]) if args else 1, int(args[1]) if len(args) > 1 else 1
        return F.col("id") * step + start
    if name in ("uuid", "guid"):
        h = F.sha2(F.concat(F.lit(f"{seed}-"), F.col("id").cast("string")), 256)
        return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(F.lit("a"), F.substring(h, 18, 3)), F.substring(h, 21, 12))
    if name in ("name", "fullname"):
        return F.concat_ws(" ", pick(FIRST), pick(LAST))
    if name in ("firstname", "first_name"):
        return pick(FIRST)
    if name in ("lastname", "last_name"):
        return pick(LAST)
    if name == "email":
        return F.concat(F.lower(pick(FIRST)), F.lit("."), F.lower(pick(LAST)), whole(1, 99).cast("string"), F.lit("@"), pick(DOMAINS))
    if name in ("city", "company"):
        return pick(CITIES if name == "city" else COMPANIES)
    if name in ("bool", "boolean"):
        return rand() > 0.5
    if name in ("ip", "ipv4"):
        return F.concat_ws(".", *(whole(*x).cast("string") for x in ((1, 255), (0, 255), (0, 255), (1, 254))))
    if name == "phone":
        return F.concat_ws("-", F.lit("+1"), *(whole(*x).cast("string") for x in ((200, 999), (100, 999), (1000, 9999))))
    if name == "date":
        low, high = (F.lit(args[0]), F.lit(args[1])) if len(args) > 1 else (F.lit("2020-01-01"), F.lit("2025-12-31"))
        return F.date_add(F.to_date(low), F.floor(rand() * (F.datediff(F.to_date(high), F.to_date(low)) + 1)).cast("int")).cast("string")
    if name in ("int", "integer"):
        return whole(*(int(a) for a in args[:2])) if len(args) > 1 else whole(0, 100)
    if name in ("float", "decimal", "number"):
        low, high = (float(args[0]), float(args[1])) if len(args) > 1 else (0.0, 100.0)
        return F.round(rand() * (high - low) + low, int(args[2]) if len(args) > 2 else 2)
    if name == "choice" and args:
        return pick([re.sub(r"^[\"']|[\"']$", "", a) for a in args])
    return F.lit(how)


def generate(spark: SparkSession, spec: str, n: int, seed: int = 1, partitions: int | None = None) -> DataFrame:
    rows = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    return rows.select(*(field(how, seed * 1000 + i).alias(name) for i, (name, how) in enumerate(split_fields(spec))))
