"""Writers by format, partitioned and split output, text tables and reports."""

from __future__ import annotations

import html
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ArgumentError
from ..functions import coerce as co
from ..functions.expression import quoted
from .readers import EXTENSIONS, format_of


def _flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    return df.withColumns({f.name: F.to_json(quoted(f.name)) for f in df.schema.fields if co.kind_of(f.dataType) == "any" and f.dataType.typeName() != "binary"})


def _local(path: str) -> str:
    return path.removeprefix("file://")


def _single(df: DataFrame, path: str, write: Callable) -> None:
    """One file at ``path``: one task writes it to a folder next to it, and the driver renames it. Only where the driver sees the folder."""
    folder = f"{_local(path)}.{uuid.uuid4().hex}"
    write(df.coalesce(1).write, folder)
    parts = [p for p in os.listdir(folder) if p.startswith("part-")]
    os.makedirs(os.path.dirname(os.path.abspath(_local(path))), exist_ok=True)
    if parts:
        os.replace(os.path.join(folder, parts[0]), _local(path))
    shutil.rmtree(folder)


def write_csv(df: DataFrame, path: str, single: bool = True, sep: str = ",", header: bool = True, compression: str | None = None) -> None:
    options = {"header": header, "sep": sep, "quote": '"', "escape": '"', "emptyValue": "", **({"compression": compression} if compression else {})}
    run = lambda w, p: w.options(**options).csv(p)
    _single(_flat(df), path, run) if single else run(_flat(df).write.mode("overwrite"), path)


def write_jsonl(df: DataFrame, path: str, single: bool = True, compression: str | None = None) -> None:
    options = {"ignoreNullFields": "false", **({"compression": compression} if compression else {})}
    run = lambda w, p: w.options(**options).json(p)
    _single(df, path, run) if single else run(df.write.mode("overwrite"), path)


def write_json(df: DataFrame, path: str, **_) -> None:
    """One array, streamed through the driver a partition at a time."""
    lines = df.select(F.to_json(F.struct(*(quoted(c) for c in df.columns)), {"ignoreNullFields": "false"}).alias("j"))
    with open(_local(path), "w", encoding="utf-8") as f:
        f.write("[")
        for i, r in enumerate(lines.toLocalIterator(prefetchPartitions=True)):
            f.write(("," if i else "") + "\n" + r["j"])
        f.write("\n]\n")


def write_parquet(df: DataFrame, path: str, single: bool = False, **options) -> None:
    run = lambda w, p: w.options(**options).parquet(p)
    _single(df, path, run) if single else run(df.write.mode("overwrite"), path)


def write_xml(df: DataFrame, path: str, single: bool = True, root: str = "rows", row: str = "row") -> None:
    safe = df.toDF(*(re.sub(r"^(?=\d)", "_", re.sub(r"[^\w.-]", "_", c)) for c in df.columns))
    run = lambda w, p: w.format("xml").options(rootTag=root, rowTag=row, nullValue="").save(p)
    _single(safe, path, run) if single else run(safe.write.mode("overwrite"), path)


def _rows(df: DataFrame, limit: int | None):
    """All rows, a partition at a time, or the first ``limit``."""
    return df.toLocalIterator(prefetchPartitions=True) if limit is None else df.limit(limit).collect()


def markdown(df: DataFrame, limit: int | None = None) -> str:
    """A table of all rows, or of ``limit``; numbers to the right."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", "<br>")
    right = [co.kind_of(f.dataType) == "num" for f in df.schema.fields]
    lines = ["| " + " | ".join(map(cell, df.columns)) + " |", "| " + " | ".join("---:" if r else "---" for r in right) + " |"]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in _rows(df, limit))])


BOXES = {"unicode": "┌┬┐├┼┤└┴┘─│", "ascii": "+++++++++-|", "compact": None}


def text_table(df: DataFrame, limit: int | None = 50, style: str = "unicode", width: int = 40) -> str:
    """A table for the terminal: the first ``limit`` rows, or all."""
    rows = [["" if v is None else str(v) for v in r] for r in _rows(df, limit)]
    rows = [[v if len(v) <= width else v[: width - 1] + "…" for v in r] for r in [list(df.columns), *rows]]
    size = [max(len(r[i]) for r in rows) for i in range(len(df.columns))]
    right = [co.kind_of(f.dataType) == "num" for f in df.schema.fields]
    pad = [[v.rjust(s) if n and k else v.ljust(s) for v, s, n in zip(r, size, right, strict=True)] for k, r in enumerate(rows)]
    box = BOXES[style]
    if box is None:
        return "\n".join("  ".join(r).rstrip() for r in pad)
    rule = lambda a, b, c: a + b.join(box[9] * (s + 2) for s in size) + c
    line = lambda r: box[10] + box[10].join(f" {v} " for v in r) + box[10]
    return "\n".join([rule(*box[0:3]), line(pad[0]), rule(*box[3:6]), *map(line, pad[1:]), rule(*box[6:9])])


def html_report(df: DataFrame, path: str, title: str = "Report") -> None:
    """Types and statistics of every column."""
    from ..operators.profile import profile

    rows = profile(df).collect()  # one row per column
    names = ["column", "type", "semantic", "confidence", "nulls", "distinct", "min", "max", "mean", "stddev"]
    cell = lambda v: html.escape("" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v))
    body = "\n".join("<tr>" + "".join(f"<td>{cell(r[n])}</td>" for n in names) + "</tr>" for r in rows)
    with open(_local(path), "w", encoding="utf-8") as f:
        f.write(f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><style>body{{font-family:sans-serif}}td,th{{padding:.3em .8em;text-align:left}}</style><h1>{html.escape(title)}</h1><p>{rows[0]['rows'] if rows else 0} rows, {len(rows)} columns</p><table><tr>{''.join(f'<th>{n}</th>' for n in names)}</tr>{body}</table>")


def write_partitioned(df: DataFrame, root: str, by: Iterable[str], format: str = "parquet", pattern: str | Callable[[dict], str] | None = None, drop: bool = False) -> list[str]:
    """Files by column values in folders col=value, written by all tasks. With a ``pattern`` such as {country}/{year}.csv the driver then renames one file per value to it. Null and empty values are _null_."""
    by = list(by)
    safe = {c: F.regexp_replace(F.when((quoted(c).cast("string") == "") | quoted(c).isNull(), "_null_").otherwise(quoted(c).cast("string")), r'[/\\:*?"<>|\x00-\x1f]', "_") for c in by}
    out = df.withColumns({f"_by_{i}": v for i, v in enumerate(safe.values())})
    marks = [f"_by_{i}" for i in range(len(by))]
    out = out.drop(*by) if drop else out
    options = {"header": True} if format in ("csv", "tsv") else {}
    kind = {"tsv": "csv", "jsonl": "json"}.get(format, format)
    if not pattern:
        out = out.drop(*by).withColumnsRenamed(dict(zip(marks, by, strict=True)))
        out.write.mode("overwrite").partitionBy(*by).format(kind).options(**options).save(root)
        return []
    folder = tempfile.mkdtemp(prefix="fan-out-")
    out.repartition(*marks).write.mode("overwrite").partitionBy(*marks).format(kind).options(**options).save("file://" + folder + "/x")
    made = []
    for where, _, names in os.walk(folder):
        parts = [n for n in names if n.startswith("part-")]
        if parts:
            from urllib.parse import unquote

            values = [unquote(p.split("=", 1)[1]) for p in os.path.relpath(where, folder + "/x").split(os.sep)]
            named = dict(zip(by, values, strict=True))
            target = os.path.join(_local(root), pattern(named) if callable(pattern) else pattern.format(**named))
            os.makedirs(os.path.dirname(os.path.abspath(target)), exist_ok=True)
            with open(target, "wb") as f:
                for k, p in enumerate(sorted(parts)):
                    with open(os.path.join(where, p), "rb") as g:
                        if k and kind == "csv":
                            g.readline()
                        shutil.copyfileobj(g, f)
            made.append(target)
    shutil.rmtree(folder)
    return sorted(made)


def write_split(df: DataFrame, path: str, rows: int = 100_000, order_by: str | None = None, format: str = "csv", single: bool = True) -> int:
    """Chunks of ``rows`` rows each, in one write; their number. Row numbers come from sizes of ordered partitions, so no task sees all rows.

    Files are named by {n} or _partN, which the driver gives them; without
    ``single`` they stay in folders _part=N of ``path``, as the tasks wrote them.
    """
    from ..operators.ordering import sort

    ordered = sort(df, order_by) if order_by else df
    numbered = ordered.rdd.zipWithIndex().map(lambda x: (*x[0], x[1])).toDF(df.schema.add("_n", "long")) if df.columns else df
    chunk = numbered.withColumn("_part", F.floor(F.col("_n") / rows).cast("long") + 1).drop("_n")
    if not single:
        kind = {"tsv": "csv", "jsonl": "json"}.get(format, format)
        chunk.write.mode("overwrite").partitionBy("_part").format(kind).options(**({"header": True} if kind == "csv" else {})).save(path)
        return df.sparkSession.read.format(kind).load(path).agg(F.max("_part")).first()[0] or 0
    base, ext = os.path.splitext(path)
    name = lambda v: _local(path).format(n=int(v["_part"])) if "{n" in path else f"{_local(base)}_part{v['_part']}{ext}"
    return len(write_partitioned(chunk, "", ["_part"], format, name, drop=True))


def dead_letters(bad: DataFrame, path: str) -> None:
    bad.write.mode("append").json(path)


def preview(df: DataFrame, n: int = 5) -> dict:
    """First rows and column types; nothing is written."""
    return {"rows": [r.asDict(recursive=True) for r in df.limit(n).collect()], "types": dict(df.dtypes)}


def collect(df: DataFrame, most: int = 10_000) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.limit(most).collect()]


def batches(df: DataFrame, size: int = 1000) -> Iterator[list[dict]]:
    """All rows in lists of ``size``, a partition at a time."""
    held: list[dict] = []
    for r in df.toLocalIterator(prefetchPartitions=True):
        held.append(r.asDict(recursive=True))
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def register_writer(name: str, writer: Callable, extensions: Iterable[str] = ()) -> None:
    """A format of the caller's own: ``writer(df, path, **options)``."""
    WRITERS[name] = writer
    EXTENSIONS.update({e.lstrip("."): name for e in extensions})


def _container(name: str) -> Callable:
    def run(df: DataFrame, path: str, **options) -> None:
        from . import containers

        getattr(containers, name)(df, path, **options)

    return run


def _to_text(make: Callable) -> Callable:
    def run(df: DataFrame, path: str, **options) -> None:
        with open(_local(path), "w", encoding="utf-8") as f:
            f.write(make(df, **options) + "\n")

    return run


WRITERS: dict[str, Callable] = {
    "csv": write_csv, "tsv": lambda d, p, **o: write_csv(d, p, sep="\t", **o), "psv": lambda d, p, **o: write_csv(d, p, sep="|", **o), "json": write_json, "jsonl": write_jsonl, "parquet": write_parquet, "xml": write_xml,
    "arrow": _container("write_arrow"), "avro": _container("write_avro"), "xlsx": _container("write_xlsx"), "sqlite": _container("write_sqlite"), "markdown": _to_text(markdown), "table": _to_text(lambda d, **o: text_table(d, **{"limit": None, **o})), "html": html_report,
    "orc": lambda d, p, **o: d.write.mode("overwrite").orc(p),
}


def write(df: DataFrame, path: str, format: str | None = None, **options) -> None:
    fmt = format or {"md": "markdown", "html": "html"}.get(path.rsplit(".", 1)[-1]) or format_of(path)
    if fmt not in WRITERS:
        raise ArgumentError(f"cannot write {fmt!r}")
    WRITERS[fmt](df, path, **options)


def capabilities() -> list[dict]:
    """What each format can do."""
    from .readers import READERS

    nested = {"json", "jsonl", "parquet", "arrow", "avro", "xml", "orc"}
    typed = {"parquet", "arrow", "avro", "sqlite", "orc"}
    return [{"format": f, "read": f in READERS, "write": f in WRITERS, "nested": f in nested, "schema": f in typed, "extensions": sorted(e for e, g in EXTENSIONS.items() if g == f)} for f in dict.fromkeys([*READERS, *WRITERS])]


def export_sheets(spark, path: str, folder: str, format: str = "csv") -> list[str]:
    """One file per worksheet."""
    from .containers import read_xlsx, sheets

    out = []
    for name in sheets(path):
        target = os.path.join(folder, f"{re.sub(r'[^A-Za-z0-9_-]+', '_', name)}.{format}")
        write(read_xlsx(spark, path, name), target, format)
        out.append(target)
    return out


def numbered(df: DataFrame, order_by: str, name: str = "row") -> DataFrame:
    """Row numbers over an order; for small results, as one task sees all rows."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(order_by)))
