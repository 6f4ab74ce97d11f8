"""Readers by format, with sniffing, compression suffixes and file sets."""

from __future__ import annotations

import difflib
import glob
import os
import re
import sys
import tempfile
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ArgumentError, ParseError
from ..functions.expression import quoted
from .files import glob_regex

EXTENSIONS = {"csv": "csv", "txt": "csv", "tsv": "tsv", "tab": "tsv", "psv": "psv", "json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "ldjson": "jsonl", "parquet": "parquet", "pq": "parquet", "arrow": "arrow", "feather": "arrow", "ipc": "arrow", "avro": "avro", "xml": "xml", "xlsx": "xlsx", "xlsm": "xlsx", "sqlite": "sqlite", "db": "sqlite", "orc": "orc"}
COMPRESSED = (".gz", ".gzip", ".br", ".brotli", ".zst", ".zstd", ".zz", ".deflate", ".bz2")
CORRUPT = "_corrupt_record"


def sniff(head: bytes) -> str | None:
    """The format that a file's first bytes show."""
    for magic, name in ((b"PAR1", "parquet"), (b"ARROW1", "arrow"), (b"Obj\x01", "avro"), (b"SQLite format 3", "sqlite"), (b"PK\x03\x04", "xlsx"), (b"ORC", "orc")):
        if head.startswith(magic):
            return name
    text = head.decode("utf-8", "replace").lstrip("﻿").lstrip()
    if not text:
        return None
    if text.startswith("<?xml") or (text[0] == "<" and not text.startswith("<!")):
        return "xml"
    if text[0] == "[":
        return "json"
    if text[0] == "{":
        return "jsonl" if "}" in text.split("\n")[0] else "json"
    first = text.split("\n")[0]
    return "tsv" if "\t" in first else "psv" if first.count("|") > first.count(",") else "csv"


def format_of(path: str) -> str:
    name = path.lower()
    for c in COMPRESSED:
        name = name.removesuffix(c)
    ext = os.path.splitext(name)[1].lstrip(".")
    if ext in EXTENSIONS:
        return EXTENSIONS[ext]
    local = path.removeprefix("file://")
    if os.path.isfile(local):
        with open(local, "rb") as f:
            if found := sniff(f.read(64)):
                return found
    near = difflib.get_close_matches(ext, EXTENSIONS, 1)
    raise ArgumentError(f"unknown format of {path!r}" + (f"; did you mean {near[0]!r}?" if near else ""))


def delimiter_of(line: str) -> str:
    """The commonest of , tab ; | outside quotes."""
    bare = re.sub(r'"[^"]*"', "", line)
    return max(",\t;|", key=lambda d: (bare.count(d), -",\t;|".index(d))) if any(d in bare for d in ",\t;|") else ","


def _first_line(spark: SparkSession, path) -> str:
    row = spark.read.text(path).first()
    return row[0].lstrip("﻿") if row else ""


def read_csv(spark: SparkSession, path, delimiter: str | None = None, header: bool = True, on_error: str = "keep", infer_types: bool = False, multi_line: bool | None = None, **options) -> DataFrame:
    """All columns are strings unless ``infer_types``. ``on_error``: keep (what can be read), fail, skip, or log (adds _corrupt_record).

    Files are split among tasks unless a value may hold a line end (``multi_line``);
    if that is not told, the lines are searched for one that ends inside quotes.
    """
    mode = {"keep": "PERMISSIVE", "log": "PERMISSIVE", "fail": "FAILFAST", "skip": "DROPMALFORMED"}.get(on_error)
    if mode is None:
        raise ArgumentError(f"unknown error policy {on_error!r}")
    line = _first_line(spark, path)
    sep = delimiter or delimiter_of(line)
    if multi_line is None:
        multi_line = not spark.read.text(path).filter((F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1).isEmpty()
    reader = spark.read.options(header=header, sep=sep, quote='"', escape='"', multiLine=multi_line, mode=mode, columnNameOfCorruptRecord=CORRUPT, **options)
    df = reader.csv(path)
    names = [re.sub(r"^﻿", "", c).strip() for c in df.columns]
    names = [f"col_{i + 1}" if not n or re.fullmatch(r"_c\d+", n) else n for i, n in enumerate(names)]
    if on_error == "log" or on_error == "skip":
        schema = ", ".join(f"`{n}` string" for n in [*names, CORRUPT])
        df = reader.schema(schema).csv(path)
        if on_error == "skip":
            df = df.drop(CORRUPT)
    else:
        df = df.toDF(*names)
    if infer_types:
        from ..operators.profile import infer_schema
        from ..operators.rows import cast

        found = {r["column"]: r["type"] for r in infer_schema(df).collect()}  # one row per column
        df = cast(df, {c: t for c, t in found.items() if t in ("integer", "number", "boolean", "date", "datetime")})
    return df


def split_errors(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and a dead-letter table: message and the raw record. The parsed rows are kept, as Spark cannot read the raw records alone."""
    df = df.persist()
    bad = df.filter(F.col(CORRUPT).isNotNull()).select(F.current_timestamp().alias("timestamp"), F.lit("ParseError").alias("errorType"), F.lit("the record does not fit the header").alias("message"), F.col(CORRUPT).alias("raw"))
    return df.filter(F.col(CORRUPT).isNull()).drop(CORRUPT), bad


def read_json(spark: SparkSession, path, data_path: str | None = None, **options) -> DataFrame:
    """An array of objects, at the top or under ``data_path``."""
    df = spark.read.options(multiLine=True, **options).json(path)
    if data_path:
        c = None
        for p in data_path.split("."):
            c = quoted(p) if c is None else c.getField(p)
        df = df.select(F.explode(c).alias("x")).select("x.*")
    return df


def read_jsonl(spark: SparkSession, path, on_error: str = "keep", **options) -> DataFrame:
    mode = {"keep": "PERMISSIVE", "log": "PERMISSIVE", "fail": "FAILFAST", "skip": "DROPMALFORMED"}[on_error]
    return spark.read.options(mode=mode, columnNameOfCorruptRecord=CORRUPT, **options).json(path)


def read_xml(spark: SparkSession, path, record: str | None = None, **options) -> DataFrame:
    """``record``: the repeating element, or a path that ends in it; by default the first child of the root."""
    if record:
        tag = re.split(r"[./]", record.strip("/."))[-1]
    else:
        head = "\n".join(r[0] for r in spark.read.text(path).limit(50).collect())
        tags = re.findall(r"<(?![?!/])([\w:.-]+)", head)
        if len(tags) < 2:
            raise ParseError("no repeating element")
        tag = tags[1]
    return spark.read.format("xml").options(rowTag=tag, attributePrefix="@", valueTag="#text", **options).load(path)


def _compressed(spark: SparkSession, path: str) -> str:
    """Paths with suffixes that the Hadoop codecs do not know are unpacked to a temporary file of the driver."""
    if isinstance(path, str) and path.endswith((".br", ".brotli")):
        raise ArgumentError("brotli is not supported")
    local = path.removeprefix("file://") if isinstance(path, str) else ""
    if local.endswith((".gzip", ".zst", ".zstd", ".zz")) and os.path.isfile(local):
        import gzip
        import zlib

        import zstandard

        with open(local, "rb") as f:
            raw = f.read()
        data = gzip.decompress(raw) if local.endswith(".gzip") else zlib.decompress(raw) if local.endswith(".zz") else zstandard.ZstdDecompressor().stream_reader(raw).read()
        out = os.path.join(tempfile.mkdtemp(), os.path.basename(local).rsplit(".", 1)[0])
        with open(out, "wb") as f:
            f.write(data)
        return "file://" + out
    return path


def _other(name: str) -> Callable:
    def run(spark: SparkSession, path, **options) -> DataFrame:
        from . import containers

        return getattr(containers, name)(spark, path, **options)

    return run


READERS: dict[str, Callable] = {
    "csv": read_csv, "tsv": lambda s, p, **o: read_csv(s, p, **{"delimiter": "\t", **o}), "psv": lambda s, p, **o: read_csv(s, p, **{"delimiter": "|", **o}), "json": read_json, "jsonl": read_jsonl, "xml": read_xml,
    "parquet": lambda s, p, **o: s.read.options(**o).parquet(*([p] if isinstance(p, str) else p)), "orc": lambda s, p, **o: s.read.options(**o).orc(p),
    "arrow": _other("read_arrow"), "avro": _other("read_avro"), "xlsx": _other("read_xlsx"), "sqlite": _other("read_sqlite"),
}


def register_format(name: str, reader: Callable, extensions: Iterable[str] = ()) -> None:
    READERS[name] = reader
    EXTENSIONS.update({e.lstrip("."): name for e in extensions})


def read(spark: SparkSession, path: str | list[str], format: str | None = None, file_col: str | None = None, max_rows: int | None = None, **options) -> DataFrame:
    """A file, folder, glob, list of these, or "-" for standard input. ``file_col``: adds the file's name as the first column; ``max_rows``: so many rows at most."""
    if path == "-":
        out = os.path.join(tempfile.mkdtemp(), "stdin")
        with open(out, "wb") as f:
            f.write(sys.stdin.buffer.read())
        path = out
    paths = [path] if isinstance(path, str) else list(path)
    every = [p for x in paths for p in (expand(x) if any(ch in x for ch in "*?{") and "://" not in x else [x])]
    if not every:
        raise ArgumentError(f"no file matches {path!r}")
    fmt = format or format_of(every[0])
    if fmt not in READERS:
        near = difflib.get_close_matches(fmt, READERS, 1)
        raise ArgumentError(f"unknown format {fmt!r}" + (f"; did you mean {near[0]!r}?" if near else ""))
    every = [_compressed(spark, p) for p in every]
    many = every if len(every) > 1 else every[0]
    df = READERS[fmt](spark, many, **options)
    if file_col:
        df = df.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias(file_col), *(quoted(c) for c in df.columns))
    return df if max_rows is None else df.limit(max_rows)


def expand(pattern: str) -> list[str]:
    root = re.split(r"[*?{]", pattern)[0]
    root = root if root.endswith("/") else os.path.dirname(root) or "."
    match = glob_regex(os.path.relpath(pattern, root) if "/" in pattern else pattern)
    found = glob.glob(os.path.join(root, "**"), recursive=True)
    return sorted(p for p in found if os.path.isfile(p) and match.fullmatch(os.path.relpath(p, root)))


def inspect(df: DataFrame) -> dict:
    """Rows, columns, types and nulls."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *(F.sum(quoted(c).isNull().cast("long")).alias(f"c{i}") for i, c in enumerate(df.columns))).first()
    return {"rows": row["n"], "columns": [{"name": c, "type": t, "nulls": row[f"c{i}"] or 0} for i, (c, t) in enumerate(df.dtypes)]}
