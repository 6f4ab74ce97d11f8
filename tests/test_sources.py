"""Readers, writers, frames, streams."""

import gzip
import json
import os
import sqlite3
import threading
import tracemalloc
import zipfile
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from gristmill.errors import ArgumentError
from gristmill.plans.frame import Frame, pipeline
from gristmill.sources import containers, files, generate, readers, writers
from gristmill.streaming.windows import windowed


@pytest.fixture()
def table(spark):
    return spark.createDataFrame([(1, "Alice", 9.5, True, None), (2, 'Bo"b, x', None, False, "n"), (3, "Çelik\nline", 1.0, None, "")], "id long, name string, price double, ok boolean, note string")


def rowsof(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_csv(spark, tmp_path, table):
    p = str(tmp_path / "a.csv")
    writers.write(table.select("id", "name", "price"), p)
    assert rowsof(readers.read(spark, p))[1] == ("2", 'Bo"b, x', None)
    (tmp_path / "b.txt").write_text('﻿id; name ;\n1;"x;y";a\n2;z\n', "utf-8")
    df = readers.read(spark, str(tmp_path / "b.txt"))
    assert df.columns == ["id", "name", "col_3"] and df.first().name == "x;y"
    typed = readers.read(spark, p, infer_types=True)
    assert dict(typed.dtypes)["id"] == "bigint" and dict(typed.dtypes)["price"] == "double"
    with gzip.open(tmp_path / "c.tsv.gz", "wt") as f:
        f.write("a\tb\n1\t2\n")
    assert rowsof(readers.read(spark, str(tmp_path / "c.tsv.gz"))) == [("1", "2")]
    (tmp_path / "bad.csv").write_text("id,name\n1,a\n2,b,c,d\n3,c\n")
    good, bad = readers.split_errors(readers.read(spark, str(tmp_path / "bad.csv"), on_error="log"))
    assert good.count() == 2 and bad.first().raw == "2,b,c,d"
    with pytest.raises(ArgumentError):
        readers.read(spark, str(tmp_path / "x.brrr"))


def test_json_xml_parquet(spark, tmp_path, table):
    for name in ("a.json", "a.jsonl", "a.parquet", "a.arrow", "a.avro"):
        p = str(tmp_path / name)
        writers.write(table, p)
        assert rowsof(readers.read(spark, p).select(*table.columns)) == rowsof(table), name
    (tmp_path / "d.json").write_text(json.dumps({"data": {"results": [{"a": 1}, {"a": 2}]}}))
    assert rowsof(readers.read(spark, str(tmp_path / "d.json"), data_path="data.results")) == [(1,), (2,)]
    p = str(tmp_path / "x.xml")
    writers.write(table.select("id", "name"), p)
    assert [r.id for r in readers.read(spark, p).orderBy("id").collect()] == [1, 2, 3]
    (tmp_path / "y.xml").write_text("<catalog><items><item sku='a'><qty>1</qty></item><item sku='b'><qty>2</qty></item></items></catalog>")
    for path in ("items.item", "/catalog/items/item", "item"):
        assert sorted(r["@sku"] for r in readers.read(spark, str(tmp_path / "y.xml"), record=path).collect()) == ["a", "b"]


def test_avro_types(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2], {"a": "b"}, bytearray(b"xy")), (2, None, {}, None)], "id long, tags array<long>, meta map<string,string>, raw binary")
    containers.write_avro(df, str(tmp_path / "t.avro"))
    got = readers.read(spark, str(tmp_path / "t.avro")).orderBy("id").collect()
    assert got[0].tags == [1, 2] and got[0].meta == {"a": "b"} and bytes(got[0].raw) == b"xy" and got[1].tags is None


def test_xlsx(spark, tmp_path, table):
    p = str(tmp_path / "w.xlsx")
    writers.write(table.select("id", "name"), p, sheet="Users")
    assert containers.sheets(p) == {"Users": "xl/worksheets/sheet1.xml"}
    assert [r.name for r in readers.read(spark, p, sheet="users").collect()] == [r.name for r in table.collect()]
    assert readers.read(spark, p, sheet=1).count() == 3
    assert writers.export_sheets(spark, p, str(tmp_path)) == [str(tmp_path / "Users.csv")]


def test_xlsx_is_read_row_by_row(spark, tmp_path):
    """Neither the driver nor the task holds the sheet; widths vary, empty rows are skipped, names may repeat."""
    p = str(tmp_path / "w.xlsx")
    writers.write(spark.range(30_000).selectExpr("id", "concat('name ', id) AS name", "id % 2 = 0 AS even"), p)
    part = containers.sheets(p)["Sheet1"]
    tracemalloc.start()
    assert sum(int(r[0]) for r in containers._xlsx_rows(p, part) if r[0] != "id") == 30_000 * 29_999 // 2
    got = readers.read(spark, p)
    assert tracemalloc.get_traced_memory()[1] < 4 << 20
    tracemalloc.stop()
    assert got.count() == 30_000 and got.filter("id = 29999").collect() == [("29999", "name 29999", "false")]
    with zipfile.ZipFile(p) as z:
        rest = {n: z.read(n) for n in z.namelist() if n != part}
    cells = lambda *v: "<row>" + "".join(f'<c t="s"><v>{x}</v></c>' for x in v) + "</row>"
    with zipfile.ZipFile(p, "w") as z:
        for n, body in rest.items():
            z.writestr(n, body)
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{containers.NS["m"]}"><si><t>a</t></si><si><r><t>b</t></r><r><t>c</t></r></si></sst>')
        z.writestr(part, f'<worksheet xmlns="{containers.NS["m"]}"><sheetData><row/>{cells(0, 0)}{cells(1)}<row/>{cells(1, 0, 1)}</sheetData></worksheet>')
    again = readers.read(spark, p)
    assert again.columns == ["a", "a"] and [tuple(r) for r in again.collect()] == [("bc", ""), ("bc", "a")]


def test_sqlite(spark, tmp_path):
    p = str(tmp_path / "d.db")
    with sqlite3.connect(p) as c:
        c.execute("create table items (id integer primary key, name text, val real, big bigint)")
        c.executemany("insert into items values (?, ?, ?, ?)", [(i, f"n{i}", i / 2, 9223372036854775807) for i in range(1, 251)])
    spark.dataSource.register(containers.SqliteSource)
    df = spark.read.format("sqlite_table").option("path", p).option("table", "items").option("rows_per_task", 60).load()
    assert df.rdd.getNumPartitions() == 5 and df.count() == 250 and df.first().big == 9223372036854775807
    assert containers.read_sqlite(spark, p, query="select name from items where id < ?", params=(3,)).count() == 2
    new = spark.createDataFrame([(1, "changed", 0.0, 1), (999, "new", 1.0, 2)], "id long, name string, val double, big long")
    containers.write_sqlite(new, p, "items", "upsert", ("id",))
    assert containers.read_database(spark, f"sqlite:{p}", "items").filter("id in (1, 999)").count() == 2
    assert containers.read_sqlite(spark, p, query="select count(*) as n from items").first().n == 251
    containers.write_sqlite(new, p, "copy", "append")
    containers.write_sqlite(new, p, "copy", "truncate")
    assert containers.tables(p) == ["copy", "items"] and containers.read_sqlite(spark, p, "copy").count() == 2
    assert containers.table_schema(p, "items")[0] == {"name": "id", "type": "INTEGER", "nullable": True, "primary_key": True}
    assert "CREATE TABLE" in containers.write_sqlite(new, p, "dry", dry_run=True) and "dry" not in containers.tables(p)
    assert containers.parse_url("postgres://u:secret@h:1/db")["safe"] == "postgres://u:***@h:1/db"


def test_http(spark):
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            page = int(self.path.split("page=")[1].split("&")[0]) if "page=" in self.path else 1
            body = json.dumps({"items": [{"id": page * 10 + i} for i in range(2 if page < 3 else 1)], "auth": self.headers.get("Authorization")}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/x"
    assert rowsof(containers.read_http(spark, url, "items", "page", limit=2, bearer="t")) == [(10,), (11,), (20,), (21,), (30,)]
    assert containers.read_http(spark, url).count() == 2
    server.shutdown()


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.csv").write_text("1234")
    (tmp_path / "b.PNG").write_bytes(b"")
    (tmp_path / ".hidden").write_text("h")
    os.symlink(tmp_path, tmp_path / "a" / "loop")
    df = files.read_folder(spark, str(tmp_path), hash="sha256", deterministic=True)
    got = {r.relative_path: r for r in df.collect()}
    assert set(got) == {"a/x.csv", "b.PNG", "a/loop"} and got["a/x.csv"].mime == "text/csv" and got["b.PNG"].category == "image" and got["a/x.csv"].size_human == "4 B" and "accessed_at" not in df.columns
    assert got["a/x.csv"].hash == files.file_hash(str(tmp_path / "a" / "x.csv"))
    assert files.file_hash(str(tmp_path / "a" / "x.csv"), "fast").startswith("fast:")
    assert [r.name for r in files.read_folder(spark, str(tmp_path), include=["*.{csv,tsv}"]).collect()] == ["x.csv"]
    assert files.read_folder(spark, str(tmp_path), hidden=True, exclude=["**/loop"]).count() == 3
    assert files.glob_regex("**/*.csv").fullmatch("a/b/c.CSV") and not files.glob_regex("a/*.csv").fullmatch("a/b/c.csv")


def test_sniffing(tmp_path):
    for head, want in ((b"PAR1", "parquet"), (b"ARROW1", "arrow"), (b"Obj\x01", "avro"), (b"SQLite format 3\0", "sqlite"), (b"PK\x03\x04", "xlsx"), (b"<?xml", "xml"), (b" [1", "json"), (b'{"a":1}\n', "jsonl"), (b"a\tb", "tsv"), (b"a|b", "psv"), (b"a,b", "csv"), (b"", None)):
        assert readers.sniff(head) == want
    assert readers.format_of("x.csv.gz") == "csv" and readers.delimiter_of('"a,b";c;d') == ";"


def test_file_sets(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"p{i}.csv").write_text(f"a\n{i}\n")
    df = readers.read(spark, str(tmp_path / "p*.csv"), file_col="_file")
    assert rowsof(df) == [("p0.csv", "0"), ("p1.csv", "1"), ("p2.csv", "2")]
    assert readers.inspect(df)["rows"] == 3


def test_sinks(spark, tmp_path, table):
    df = spark.createDataFrame([(1, "TR", 2024, 1), (2, "US", 2024, 2), (3, "TR", 2025, 3), (4, "TR", 2024, 4), (5, None, 2025, 5)], "id long, country string, year long, val long")
    made = writers.write_partitioned(df, str(tmp_path / "out"), ["country", "year"], "csv", "{country}/{year}.csv")
    assert [os.path.relpath(m, tmp_path / "out") for m in made] == ["TR/2024.csv", "TR/2025.csv", "US/2024.csv", "_null_/2025.csv"]
    writers.write_partitioned(df, str(tmp_path / "hive"), ["year"])
    assert spark.read.parquet(str(tmp_path / "hive")).filter("year = 2024").count() == 3
    assert writers.write_split(df, str(tmp_path / "s_{n:03d}.csv"), 2, "id") == 3 and (tmp_path / "s_003.csv").read_text().splitlines()[1].startswith("5")
    assert writers.markdown(table.select("id", "name")).splitlines()[1] == "| ---: | --- |"
    assert "│ Alice" in writers.text_table(table.select("name")) and "+---" in writers.text_table(table.select("name"), style="ascii")
    writers.write(table, str(tmp_path / "r.html"))
    assert "<table>" in (tmp_path / "r.html").read_text()
    assert writers.preview(table, 1)["types"]["id"] == "bigint" and len(writers.collect(table)) == 3
    assert {c["format"] for c in writers.capabilities()} >= {"csv", "parquet", "avro", "xlsx"}


def test_generate(spark):
    df = generate.generate(spark, "id:seq,name:name,email:email,age:int(20,50),score:float(1.0,10.0,2),status:choice(active,inactive),k:fixed,d:date(2024-01-01,2024-01-31),u:uuid,ip:ipv4", 25)
    got = df.collect()
    assert [r.id for r in got] == list(range(1, 26)) and all(20 <= r.age <= 50 and 1 <= r.score <= 10 and r.status in ("active", "inactive") and r.k == "fixed" and "2024-01-01" <= r.d <= "2024-01-31" for r in got)
    assert len({r.u for r in got}) == 25 and rowsof(df) == rowsof(df)


def test_frame(spark, tmp_path):
    f = Frame.rows(spark, [(1, "TR", 100), (2, "US", 200), (3, "TR", 300), (4, "DE", 50)], "id long, country string, revenue long")
    got = f.filter("revenue >= 100").map({"tax": "revenue * 0.2"}).group("country", sum="revenue,tax").sort("revenue_sum:desc")
    assert got.to_list() == [{"country": "TR", "revenue_sum": 400.0, "tax_sum": 80.0}, {"country": "US", "revenue_sum": 200.0, "tax_sum": 40.0}]
    assert "1. filter" in got.explain() and "[spillable]" in got.explain(False)
    one = pipeline(f, limit=[1], sort="id:desc", filter="country == 'TR'", select=["id"])
    assert one.to_list() == [{"id": 3}]
    assert f.join(Frame.rows(spark, [("TR", "x")], "country string, c string"), "country").count() == 2
    assert f.concat(f).count() == 8 and f.pipe(lambda d: d.limit(1)).count() == 1
    assert f.diff(f, "id").df.filter("change_type = 'unchanged'").count() == 4
    with pytest.raises(AttributeError):
        f.nothing


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("2026-01-01 10:01:00", "a", 1.0), ("2026-01-01 10:04:00", "a", 3.0), ("2026-01-01 10:20:00", "b", 5.0)], "ts string, k string, v double").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(src)
    s = Frame(spark.readStream.schema("ts timestamp, k string, v double").parquet(src)).filter("v > 0").map({"w": "v * 2"})
    with pytest.raises(ValueError):
        s.sort("v")
    q = windowed(s.df, "ts", "5 minutes", "total = sum(w), n = count()", by=["k"]).writeStream.outputMode("complete").format("memory").queryName("totals").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.k, r.total, r.n) for r in spark.table("totals").collect()) == [("a", 8.0, 2), ("b", 10.0, 1)]
    batch = spark.read.parquet(src)
    assert windowed(batch, "ts", "10 minutes", "n = count()", session=True).count() == 2


def test_small_things(spark, tmp_path):
    from gristmill.operators.aggregate import distinct_sketches, merge_sketches
    from gristmill.sources import charts

    frame, seen = Frame.rows(spark, [(1, 5.0), (2, 7.0), (3, None)], "id long, v double").observed("n = count(), s = sum(v)")
    assert frame.count() == 3 and seen.get == {"n": 3, "s": 12.0}
    assert charts.sparkline([1, 2, 3]) == "▁▄█" and charts.bar_chart([("a", 2), ("bb", 1)], 4).splitlines()[0] == " a  ████  2"
    assert len(charts.histogram_chart(frame.df, "v", 4).splitlines()) == 4
    df = spark.range(5000).withColumn("g", F.col("id") % 3)
    assert merge_sketches(distinct_sketches(df, "id", ["g"])).first()["distinct"] == pytest.approx(5000, rel=0.08)
    for name, text in (("l", "same"), ("r", "same")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.txt").write_text(text)
    (tmp_path / "r" / "b.txt").write_text("new")
    assert {r.relative_path: r.change_type for r in files.diff_folders(spark, str(tmp_path / "l"), str(tmp_path / "r")).collect()} == {"a.txt": "unchanged", "b.txt": "added"}


def test_batches_writers_and_row_limits(spark, tmp_path):
    df = spark.range(25).withColumnRenamed("id", "x")
    assert [len(b) for b in writers.batches(df, 10)] == [10, 10, 5] and sum(r["x"] for b in writers.batches(df, 7) for r in b) == 300
    writers.register_writer("lines", lambda d, p, **_: open(p, "w").write("\n".join(str(r.x) for r in d.collect())), ["lines"])
    try:
        writers.write(df, str(tmp_path / "a.lines"))
        assert (tmp_path / "a.lines").read_text().split("\n") == [str(i) for i in range(25)]
    finally:
        writers.WRITERS.pop("lines")
        writers.EXTENSIONS.pop("lines")
    writers.write(df, str(tmp_path / "b.csv"))
    assert readers.read(spark, str(tmp_path / "b.csv"), max_rows=4).count() == 4
    assert writers.markdown(spark.range(1200)).count("\n") == 1201


def test_quoted_line_ends_are_found(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,t\n1,"two\nlines"\n2,x\n')
    (tmp_path / "b.csv").write_text("id,t\n1,one\n2,x\n")
    assert [tuple(r) for r in readers.read(spark, str(tmp_path / "a.csv")).collect()] == [("1", "two\nlines"), ("2", "x")]
    assert [tuple(r) for r in readers.read(spark, str(tmp_path / "b.csv")).collect()] == [("1", "one"), ("2", "x")]
