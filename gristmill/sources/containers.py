"""Arrow, Avro, XLSX, SQLite and HTTP sources.

Arrow, XLSX, SQLite and HTTP are Python data sources, read by the executors: an
Arrow file by record batch, a worksheet by row, a table by ranges of its row id,
an API by page. Avro and XLSX have decoders of their own, as neither has a library
or jar here.
"""

from __future__ import annotations

import base64
import io
import itertools
import json
import os
import re
import sqlite3
import struct
import urllib.parse
import urllib.request
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator
from datetime import date, datetime, timedelta, timezone

import pyarrow as pa
import pyarrow.ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema

from ..errors import ArgumentError, ParseError


def local(path: str) -> str:
    return path.removeprefix("file://")


class Part(InputPartition):
    def __init__(self, value):
        self.value = value


# -- Arrow ------------------------------------------------------------------------------------------------


def _open_arrow(path: str):
    with open(path, "rb") as f:
        magic = f.read(6)
    source = pa.memory_map(path)
    return pa.ipc.open_file(source) if magic == b"ARROW1" else pa.ipc.open_stream(source)


class ArrowReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = options["path"].split(";")

    def partitions(self) -> list[Part]:
        out = []
        for p in self.paths:
            f = _open_arrow(p)
            out += [Part((p, i)) for i in range(f.num_record_batches)] if hasattr(f, "num_record_batches") else [Part((p, None))]
        return out or [Part(None)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        path, i = partition.value
        f = _open_arrow(path)
        if i is not None:
            yield f.get_batch(i)
        else:
            yield from f


class ArrowSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrow_ipc"

    def schema(self) -> T.StructType:
        return from_arrow_schema(_open_arrow(self.options["path"].split(";")[0]).schema)

    def reader(self, schema) -> ArrowReader:
        return ArrowReader(self.options)


def read_arrow(spark: SparkSession, path, **_) -> DataFrame:
    spark.dataSource.register(ArrowSource)
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.format("arrow_ipc").option("path", ";".join(map(local, paths))).load()


def write_arrow(df: DataFrame, path: str, stream: bool = False) -> None:
    """One file, written by the driver batch by batch as partitions arrive."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(df.schema)
    make = pa.ipc.new_stream if stream else pa.ipc.new_file
    with pa.OSFile(local(path), "wb") as sink, make(sink, schema) as writer:
        rows = []
        for r in df.toLocalIterator(prefetchPartitions=True):
            rows.append(r.asDict(recursive=True))
            if len(rows) >= 10_000:
                writer.write_batch(pa.RecordBatch.from_pylist(rows, schema=schema))
                rows = []
        if rows:
            writer.write_batch(pa.RecordBatch.from_pylist(rows, schema=schema))


# -- Avro -------------------------------------------------------------------------------------------------

MAGIC = b"Obj\x01"


class _Avro:
    """Decodes the binary encoding of the object container file's blocks."""

    def __init__(self, data: bytes):
        self.f = io.BytesIO(data)

    def long(self) -> int:
        shift = n = 0
        while True:
            (b,) = self.f.read(1) or b"\0"
            n |= (b & 0x7F) << shift
            if not b & 0x80:
                return (n >> 1) ^ -(n & 1)
            shift += 7

    def bytes(self) -> bytes:
        return self.f.read(self.long())

    def blocks(self) -> Iterator[int]:
        while n := self.long():
            if n < 0:
                n = -n
                self.long()
            yield from range(n)

    def value(self, t, names: dict):
        if isinstance(t, list):
            return self.value(t[self.long()], names)
        if isinstance(t, str):
            if t in names:
                return self.value(names[t], names)
            simple = {"null": lambda: None, "boolean": lambda: self.f.read(1) == b"\1", "int": self.long, "long": self.long, "float": lambda: struct.unpack("<f", self.f.read(4))[0], "double": lambda: struct.unpack("<d", self.f.read(8))[0], "bytes": self.bytes, "string": lambda: self.bytes().decode()}
            return simple[t]()
        kind = t["type"]
        if kind == "record":
            names[t["name"]] = t
            return {f["name"]: self.value(f["type"], names) for f in t["fields"]}
        if kind == "enum":
            names[t["name"]] = t
            return t["symbols"][self.long()]
        if kind == "fixed":
            names[t["name"]] = t
            return self.f.read(t["size"])
        if kind == "array":
            return [self.value(t["items"], names) for _ in self.blocks()]
        if kind == "map":
            return {self.bytes().decode(): self.value(t["values"], names) for _ in self.blocks()}
        v, logical = self.value(kind, names), t.get("logicalType")
        if logical == "timestamp-millis":
            return datetime.fromtimestamp(v / 1000, timezone.utc)
        if logical == "timestamp-micros":
            return datetime.fromtimestamp(v / 1e6, timezone.utc)
        if logical == "date":
            return date(1970, 1, 1) + timedelta(days=v)
        return v


def _avro_type(t, names: dict) -> T.DataType:
    if isinstance(t, list):
        full = [x for x in t if x != "null"]
        return _avro_type(full[0], names) if len(full) == 1 else T.StringType()
    if isinstance(t, str):
        if t in names:
            return _avro_type(names[t], names)
        return {"null": T.StringType(), "boolean": T.BooleanType(), "int": T.LongType(), "long": T.LongType(), "float": T.DoubleType(), "double": T.DoubleType(), "bytes": T.BinaryType(), "string": T.StringType()}[t]
    kind = t["type"]
    if kind == "record":
        names[t["name"]] = t
        return T.StructType([T.StructField(f["name"], _avro_type(f["type"], names)) for f in t["fields"]])
    if kind == "enum":
        return T.StringType()
    if kind == "fixed":
        return T.BinaryType()
    if kind == "array":
        return T.ArrayType(_avro_type(t["items"], names))
    if kind == "map":
        return T.MapType(T.StringType(), _avro_type(t["values"], names))
    logical = t.get("logicalType")
    if logical in ("timestamp-millis", "timestamp-micros"):
        return T.TimestampType()
    return T.DateType() if logical == "date" else _avro_type(kind, names)


def read_avro_file(data: bytes) -> tuple[T.StructType, Iterator[dict]]:
    if data[:4] != MAGIC:
        raise ParseError("not an Avro container")
    d = _Avro(data)
    d.f.read(4)
    meta = {}
    for _ in d.blocks():
        key = d.bytes().decode()
        meta[key] = d.bytes()
    sync, schema, codec = d.f.read(16), json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null")

    def rows() -> Iterator[dict]:
        while d.f.tell() < len(data):
            n, raw = d.long(), d.bytes()
            if codec == b"deflate":
                raw = zlib.decompress(raw, -15)
            elif codec != b"null":
                raise ParseError(f"unknown codec {codec!r}")
            block, names = _Avro(raw), {}
            for _ in range(n):
                yield block.value(schema, names)
            if d.f.read(16) != sync:
                raise ParseError("a block does not end as the file says")

    return _avro_type(schema, {}), rows()


def read_avro(spark: SparkSession, path, **_) -> DataFrame:
    """Files are decoded by the executors, one a task."""
    first = spark.read.format("binaryFile").load(path).select("content").limit(1).first()
    if first is None:
        raise ArgumentError(f"no Avro file at {path!r}")
    schema, _rows = read_avro_file(bytes(first[0]))
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches):
        import pandas as pd

        for b in batches:
            for content in b["content"]:
                rows = list(read_avro_file(bytes(content))[1])
                yield pd.DataFrame(rows, columns=schema.names)

    return files.mapInPandas(run, schema)


def _zigzag(n: int) -> bytes:
    n = (n << 1) ^ (n >> 63)
    out = bytearray()
    while n & ~0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _avro_encoder(t: T.DataType):
    """The Avro type of a column (always nullable) and its encoder."""
    text = lambda v: _zigzag(len(b := str(v).encode())) + b
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        kind, enc = "long", _zigzag
    elif isinstance(t, (T.FloatType, T.DoubleType)):
        kind, enc = "double", lambda v: struct.pack("<d", v)
    elif isinstance(t, T.BooleanType):
        kind, enc = "boolean", lambda v: b"\1" if v else b"\0"
    elif isinstance(t, T.BinaryType):
        kind, enc = "bytes", lambda v: _zigzag(len(v)) + bytes(v)
    elif isinstance(t, T.TimestampType):
        kind, enc = {"type": "long", "logicalType": "timestamp-micros"}, lambda v: _zigzag(int(v.timestamp() * 1_000_000))
    elif isinstance(t, T.ArrayType):
        item, one = _avro_encoder(t.elementType)
        kind, enc = {"type": "array", "items": item}, lambda v: (_zigzag(len(v)) + b"".join(map(one, v)) if v else b"") + b"\0"
    elif isinstance(t, T.MapType):
        item, one = _avro_encoder(t.valueType)
        kind, enc = {"type": "map", "values": item}, lambda v: (_zigzag(len(v)) + b"".join(text(k) + one(x) for k, x in v.items()) if v else b"") + b"\0"
    else:
        kind, enc = "string", text
    return ["null", kind], lambda v: b"\0" if v is None else b"\2" + enc(v)


def write_avro(df: DataFrame, path: str) -> None:
    """One container file, a block per thousand rows."""
    fields = [(f.name, *_avro_encoder(f.dataType)) for f in df.schema.fields]
    schema = {"type": "record", "name": "row", "fields": [{"name": re.sub(r"\W", "_", n), "type": k} for n, k, _ in fields]}
    sync, text = os.urandom(16), lambda s: _zigzag(len(s)) + s
    with open(local(path), "wb") as f:
        f.write(MAGIC + _zigzag(2) + text(b"avro.schema") + text(json.dumps(schema).encode()) + text(b"avro.codec") + text(b"deflate") + b"\0" + sync)
        rows: list[bytes] = []

        def flush() -> None:
            c = zlib.compressobj(wbits=-15)
            body = c.compress(b"".join(rows)) + c.flush()
            f.write(_zigzag(len(rows)) + text(body) + sync)
            rows.clear()

        for r in df.toLocalIterator(prefetchPartitions=True):
            rows.append(b"".join(enc(v) for (_, _, enc), v in zip(fields, r, strict=True)))
            if len(rows) >= 1000:
                flush()
        if rows:
            flush()


# -- XLSX -------------------------------------------------------------------------------------------------

NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def sheets(path: str) -> dict[str, str]:
    """Worksheets' names and parts."""
    with zipfile.ZipFile(local(path)) as z:
        rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        book = ET.fromstring(z.read("xl/workbook.xml"))
        return {s.get("name"): "xl/" + rels[s.get(REL)].removeprefix("/xl/").removeprefix("xl/") for s in book.find("m:sheets", NS)}


def _xlsx_rows(path: str, part: str) -> Iterator[list[str]]:
    """Cells of each row of a worksheet, row by row; what is read is let go."""
    row_tag, cell_text = f"{{{NS['m']}}}row", f"{{{NS['m']}}}t"
    with zipfile.ZipFile(local(path)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as f:
                for si in _ended(f, f"{{{NS['m']}}}si"):
                    shared.append("".join(t.text or "" for t in si.iter(cell_text)))
        with z.open(part) as f:
            for row in _ended(f, row_tag):
                cells: dict[int, str] = {}
                for i, c in enumerate(row):
                    letters = re.match("[A-Z]*", c.get("r") or "")[0]
                    at = sum((ord(ch) - 64) * 26**k for k, ch in enumerate(reversed(letters))) - 1 if letters else i
                    v, inline = c.find("m:v", NS), c.find("m:is", NS)
                    raw = "".join(t.text or "" for t in inline.iter(cell_text)) if inline is not None else (v.text or "") if v is not None else ""
                    cells[at] = shared[int(raw)] if c.get("t") == "s" and raw else {"1": "true", "0": "false"}.get(raw, raw) if c.get("t") == "b" else raw
                yield [cells.get(i, "") for i in range(max(cells, default=-1) + 1)]


def _ended(f, tag: str) -> Iterator[ET.Element]:
    """Elements of a tag as they end; each is taken from its parent when the next is asked for."""
    above: list[ET.Element] = []
    for event, el in ET.iterparse(f, ("start", "end")):
        if event == "start":
            above.append(el)
            continue
        above.pop()
        if el.tag == tag:
            yield el
            if above:
                above[-1].clear()


class XlsxReader(DataSourceReader):
    def __init__(self, width: int, options: dict):
        self.width, self.o = width, dict(options)

    def partitions(self) -> list[Part]:
        return [Part(None)]  # a worksheet is one compressed stream

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        rows = (r for r in _xlsx_rows(self.o["path"], self.o["part"]) if any(r))
        next(rows, None)  # the header
        names = [f"c{i}" for i in range(self.width)]
        while batch := list(itertools.islice(rows, 4096)):
            yield pa.RecordBatch.from_arrays([pa.array([r[i] if i < len(r) else "" for r in batch], pa.string()) for i in range(self.width)], names=names)


class XlsxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx_sheet"

    def schema(self) -> str:
        return ", ".join(f"c{i} string" for i in range(int(self.options["width"])))

    def reader(self, schema) -> XlsxReader:
        return XlsxReader(int(self.options["width"]), self.options)


def read_xlsx(spark: SparkSession, path: str, sheet: str | int | None = None, **_) -> DataFrame:
    """A worksheet by name or number (from 1); the first row with a value is the header, all columns are strings. The driver reads the header, one task the rows as they are unpacked."""
    names = sheets(path)
    if isinstance(sheet, int) or (isinstance(sheet, str) and sheet.isdigit() and sheet not in names):
        part = list(names.values())[int(sheet) - 1]
    elif sheet:
        part = next((p for n, p in names.items() if n.lower() == sheet.lower()), None)
        if part is None:
            raise ArgumentError(f"no sheet {sheet!r} among {', '.join(names)}")
    else:
        part = next(iter(names.values()))
    first = next((r for r in _xlsx_rows(path, part) if any(r)), None)
    if first is None:
        return spark.createDataFrame([], "value string")
    spark.dataSource.register(XlsxSource)
    rows = spark.read.format("xlsx_sheet").option("path", path).option("part", part).option("width", len(first)).load()
    return rows.toDF(*(h.strip() or f"col_{i + 1}" for i, h in enumerate(first)))


def write_xlsx(df: DataFrame, path: str, sheet: str = "Sheet1") -> None:
    """One worksheet with a header, written by the driver; at most 1,048,576 rows, the format's limit."""
    from xml.sax.saxutils import escape

    def cell(v, col: int, row: int) -> str:
        name, n = "", col + 1
        while n:
            n, r = divmod(n - 1, 26)
            name = chr(65 + r) + name
        at = f'r="{name}{row}"'
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c {at} t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f"<c {at}><v>{v}</v></c>"
        return f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    with zipfile.ZipFile(local(path), "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{NS["m"]}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f'<?xml version="1.0"?><worksheet xmlns="{NS["m"]}"><sheetData>'.encode())
            f.write(("<row r=\"1\">" + "".join(cell(c, i, 1) for i, c in enumerate(df.columns)) + "</row>").encode())
            for k, r in enumerate(df.toLocalIterator(prefetchPartitions=True), 2):
                f.write((f'<row r="{k}">' + "".join(cell(v, i, k) for i, v in enumerate(r)) + "</row>").encode())
            f.write(b"</sheetData></worksheet>")


# -- SQLite -----------------------------------------------------------------------------------------------

SQL_TYPES = {"INT": "long", "CHAR": "string", "CLOB": "string", "TEXT": "string", "BLOB": "binary", "REAL": "double", "FLOA": "double", "DOUB": "double", "NUMERIC": "double", "BOOL": "boolean"}


def sql_type(declared: str) -> str:
    return next((t for k, t in SQL_TYPES.items() if k in (declared or "").upper()), "string")


def _connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{urllib.parse.quote(local(path).removeprefix('sqlite:').removeprefix('//'))}?mode=ro", uri=True)


def tables(path: str) -> list[str]:
    with _connect(path) as c:
        return [r[0] for r in c.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite_%' ORDER BY name")]


def table_schema(path: str, table: str) -> list[dict]:
    with _connect(path) as c:
        return [{"name": n, "type": t, "nullable": not no, "primary_key": bool(pk)} for _, n, t, no, _, pk in c.execute(f"PRAGMA table_info({_quote(table)})")]


def _quote(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class SqliteReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.types, self.o = schema, dict(options)

    def partitions(self) -> list[Part]:
        if "query" in self.o:
            return [Part(None)]
        with _connect(self.o["path"]) as c:
            try:
                low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {_quote(self.o['table'])}").fetchone()
            except sqlite3.OperationalError:  # a view, or a table without row ids
                return [Part(None)]
        if low is None:
            return [Part(None)]
        step = max(1, int(self.o.get("rows_per_task", 250_000)))
        return [Part((a, min(a + step - 1, high))) for a in range(low, high + 1, step)]

    def read(self, partition: Part) -> Iterator[tuple]:
        sql = self.o.get("query") or f"SELECT {', '.join(map(_quote, self.types.names))} FROM {_quote(self.o['table'])}"
        args: tuple = tuple(json.loads(self.o.get("params", "[]")))
        if partition.value:
            sql, args = sql + " WHERE rowid BETWEEN ? AND ?", partition.value
        kinds = [f.dataType for f in self.types.fields]
        with _connect(self.o["path"]) as c:
            for r in c.execute(sql, args):
                yield tuple(None if v is None else bool(v) if isinstance(t, T.BooleanType) else float(v) if isinstance(t, T.DoubleType) and not isinstance(v, str) else str(v) if isinstance(t, T.StringType) else v for v, t in zip(r, kinds, strict=True))


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        if "query" in self.options:
            with _connect(self.options["path"]) as c:
                cur = c.execute(self.options["query"], json.loads(self.options.get("params", "[]")))
                row = cur.fetchone()
            kinds = {int: "long", float: "double", bytes: "binary"}
            return ", ".join(f"`{d[0]}` {kinds.get(type(v), 'string')}" for d, v in zip(cur.description, row or [None] * len(cur.description), strict=True))
        return ", ".join(f"`{x['name']}` {sql_type(x['type'])}" for x in table_schema(self.options["path"], self.options["table"]))

    def reader(self, schema) -> SqliteReader:
        return SqliteReader(schema, self.options)


def read_sqlite(spark: SparkSession, path: str, table: str | None = None, query: str | None = None, params: tuple = (), **_) -> DataFrame:
    """A table, in ranges of its row id, or a query."""
    spark.dataSource.register(SqliteSource)
    r = spark.read.format("sqlite_table").option("path", path)
    if query:
        r = r.option("query", query).option("params", json.dumps(list(params)))
    else:
        r = r.option("table", table or tables(path)[0])
    return r.load()


def write_sqlite(df: DataFrame, path: str, table: str, mode: str = "append", keys: tuple[str, ...] = (), dry_run: bool = False, batch: int = 1000) -> str:
    """Insert, replace (truncate) or upsert rows in transactions of ``batch``; makes the table if there is none. A database file has one writer, so rows stream through the driver. Returns the DDL."""
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "float": "REAL", "boolean": "BOOLEAN", "binary": "BLOB"}
    cols = ", ".join(f"{_quote(c)} {kinds.get(t, 'TEXT')}" for c, t in df.dtypes)
    ddl = f"CREATE TABLE IF NOT EXISTS {_quote(table)} ({cols}{', PRIMARY KEY (' + ', '.join(map(_quote, keys)) + ')' if keys else ''})"
    if dry_run:
        return ddl
    if mode not in ("append", "truncate", "upsert", "ignore"):
        raise ArgumentError(f"unknown mode {mode!r}")
    sql = f"INSERT INTO {_quote(table)} ({', '.join(map(_quote, df.columns))}) VALUES ({', '.join('?' * len(df.columns))})"
    if mode in ("upsert", "ignore"):
        rest = [c for c in df.columns if c not in keys]
        todo = "DO UPDATE SET " + ", ".join(f"{_quote(c)} = excluded.{_quote(c)}" for c in rest) if mode == "upsert" and rest else "DO NOTHING"
        sql += f" ON CONFLICT ({', '.join(map(_quote, keys))}) {todo}"
    plain = lambda v: v if v is None or isinstance(v, (int, float, str, bytes)) else json.dumps(v, default=str) if isinstance(v, (list, dict, tuple)) else str(v)
    c = sqlite3.connect(local(path))
    try:
        c.execute(ddl)
        if mode == "truncate":
            c.execute(f"DELETE FROM {_quote(table)}")
        rows = []
        for r in df.toLocalIterator(prefetchPartitions=True):
            rows.append([plain(v) for v in r])
            if len(rows) >= batch:
                with c:
                    c.executemany(sql, rows)
                rows = []
        with c:
            c.executemany(sql, rows)
    finally:
        c.close()
    return ddl


def parse_url(url: str) -> dict:
    """postgres://, mysql:// or sqlite: addresses; ``safe`` has no password."""
    if url.startswith("sqlite:"):
        return {"kind": "sqlite", "path": url.removeprefix("sqlite:").removeprefix("//"), "safe": url}
    u = urllib.parse.urlsplit(url)
    kind = {"postgres": "postgresql", "postgresql": "postgresql", "mysql": "mysql", "mariadb": "mysql"}.get(u.scheme)
    if not kind:
        raise ArgumentError(f"unknown database {u.scheme!r}")
    safe = url.replace(f":{u.password}@", ":***@") if u.password else url
    port = u.port or {"postgresql": 5432, "mysql": 3306}[kind]
    return {"kind": kind, "host": u.hostname, "port": port, "user": urllib.parse.unquote(u.username or ""), "password": urllib.parse.unquote(u.password or ""), "database": u.path.lstrip("/"), "jdbc": f"jdbc:{kind}://{u.hostname}:{port}/{u.path.lstrip('/')}", "safe": safe}


def read_database(spark: SparkSession, url: str, table: str | None = None, query: str | None = None, **options) -> DataFrame:
    """SQLite by its own source; the others by JDBC, whose driver must be on the class path. Filters, columns, limits and top-k are pushed down by Spark."""
    u = parse_url(url)
    if u["kind"] == "sqlite":
        return read_sqlite(spark, u["path"], table, query)
    r = spark.read.format("jdbc").options(url=u["jdbc"], user=u["user"], password=u["password"], **options)
    return (r.option("query", query) if query else r.option("dbtable", table)).load()


# -- HTTP -------------------------------------------------------------------------------------------------


def fetch_page(url: str, headers: dict[str, str], data_path: str | None) -> tuple[list[dict], dict]:
    """Rows of one page (under ``data_path``, or the first list) and the whole answer."""
    with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=60) as f:
        body = json.loads(f.read())
    rows = body
    if data_path:
        for p in data_path.split("."):
            rows = rows[int(p)] if isinstance(rows, list) else rows.get(p, [])
    elif isinstance(body, dict):
        rows = next((v for v in body.values() if isinstance(v, list)), [body])
    return [r for r in rows if isinstance(r, dict)], body if isinstance(body, dict) else {}


def auth_headers(bearer: str | None = None, basic: str | None = None) -> dict[str, str]:
    if bearer:
        return {"Authorization": f"Bearer {bearer}"}
    return {"Authorization": "Basic " + base64.b64encode(basic.encode()).decode()} if basic else {}


def _with(url: str, **params) -> str:
    u = urllib.parse.urlsplit(url)
    return urllib.parse.urlunsplit(u._replace(query=urllib.parse.urlencode({**dict(urllib.parse.parse_qsl(u.query)), **params})))


def read_http(spark: SparkSession, url: str, data_path: str | None = None, paginate: str | None = None, page_param: str = "page", limit_param: str = "limit", limit: int = 100, cursor_param: str = "cursor", cursor_path: str = "next_cursor", max_pages: int = 100, bearer: str | None = None, basic: str | None = None) -> DataFrame:
    """JSON rows of an API, page after page: ``paginate`` is page, offset or cursor. ``max_pages`` bounds a walk whose end the server does not show; beyond it the walk fails rather than be cut."""
    headers, rows, at, seen = auth_headers(bearer, basic), [], None, 0
    while seen < max_pages:
        if paginate == "page":
            page = _with(url, **{page_param: seen + 1, limit_param: limit})
        elif paginate == "offset":
            page = _with(url, offset=seen * limit, **{limit_param: limit})
        else:
            page = _with(url, **{cursor_param: at}) if at is not None else url
        got, body = fetch_page(page, headers, data_path)
        rows += got
        seen += 1
        if paginate == "cursor":
            at = body
            for p in cursor_path.split("."):
                at = at.get(p) if isinstance(at, dict) else None
            if not at:
                break
        elif not paginate or len(got) < limit:
            break
    else:
        raise ArgumentError(f"more than {max_pages} pages")
    if not rows:
        return spark.createDataFrame([], "value string")
    return spark.read.json(spark.createDataFrame([(json.dumps(r),) for r in rows], "value string").rdd.map(lambda r: r[0]))
