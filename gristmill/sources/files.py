"""The file system as a table: walk, globs, MIME types and hashes."""

from __future__ import annotations

import hashlib
import os
import re
import stat
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import FilesystemError

#: Extension, MIME type and category. Fixed values.
MIME = """
csv text/csv data; tsv text/tab-separated-values data; psv text/plain data; tab text/tab-separated-values data; json application/json data; jsonl application/x-ndjson data;
ndjson application/x-ndjson data; ldjson application/x-ndjson data; parquet application/vnd.apache.parquet data; pq application/vnd.apache.parquet data; sql application/sql data;
sqlite application/vnd.sqlite3 data; db application/octet-stream data; xml application/xml data; yaml application/yaml data; yml application/yaml data; toml application/toml data;
xlsx application/vnd.openxmlformats-officedocument.spreadsheetml.sheet document; xlsm application/vnd.ms-excel.sheet.macroEnabled.12 document; xls application/vnd.ms-excel document;
ods application/vnd.oasis.opendocument.spreadsheet document; pdf application/pdf document; docx application/vnd.openxmlformats-officedocument.wordprocessingml.document document;
doc application/msword document; pptx application/vnd.openxmlformats-officedocument.presentationml.presentation document; ppt application/vnd.ms-powerpoint document;
txt text/plain document; md text/markdown document; markdown text/markdown document; rtf application/rtf document; epub application/epub+zip document;
png image/png image; jpg image/jpeg image; jpeg image/jpeg image; webp image/webp image; gif image/gif image; svg image/svg+xml image; avif image/avif image; bmp image/bmp image;
ico image/x-icon image; tiff image/tiff image; tif image/tiff image; heic image/heic image; mp4 video/mp4 video; mkv video/x-matroska video; webm video/webm video;
avi video/x-msvideo video; mov video/quicktime video; wmv video/x-ms-wmv video; flv video/x-flv video; mp3 audio/mpeg audio; wav audio/wav audio; flac audio/flac audio;
aac audio/aac audio; ogg audio/ogg audio; m4a audio/mp4 audio; zip application/zip archive; tar application/x-tar archive; gz application/gzip archive; gzip application/gzip archive;
tgz application/gzip archive; bz2 application/x-bzip2 archive; xz application/x-xz archive; zst application/zstd archive; 7z application/x-7z-compressed archive; rar application/vnd.rar archive;
js text/javascript code; mjs text/javascript code; cjs text/javascript code; ts text/typescript code; mts text/typescript code; cts text/typescript code; jsx text/javascript code;
tsx text/typescript code; html text/html code; htm text/html code; css text/css code; scss text/x-scss code; sass text/x-sass code; less text/less code; py text/x-python code;
rs text/x-rust code; go text/x-go code; c text/x-c code; cpp text/x-c++ code; h text/x-c code; hpp text/x-c++ code; java text/x-java-source code; kt text/x-kotlin code;
swift text/x-swift code; rb text/x-ruby code; php application/x-httpd-php code; sh application/x-sh code; bash application/x-sh code; zsh application/x-sh code;
woff font/woff font; woff2 font/woff2 font; ttf font/ttf font; otf font/otf font
"""
TYPES = {e: (m, c) for e, m, c in (x.split() for x in MIME.replace("\n", " ").split(";"))}


def extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"([^.]*)$", 1))


def _lookup(c: Column, at: int, default: str) -> Column:
    table = F.create_map(*(F.lit(x) for e, t in TYPES.items() for x in (e, t[at])))
    return F.coalesce(F.try_element_at(table, extension(c)), F.lit(default))


def mime_column(c: Column) -> Column:
    return _lookup(c, 0, "application/octet-stream")


def category_column(c: Column) -> Column:
    return _lookup(c, 1, "other")


def glob_regex(pattern: str) -> re.Pattern:
    """Braces, ``**``, ``*`` and ``?``; case does not matter; without a slash it matches in any folder."""

    def braces(p: str) -> list[str]:
        m = re.search(r"\{([^{}]*)\}", p)
        return [x for part in m[1].split(",") for x in braces(p[: m.start()] + part + p[m.end() :])] if m else [p]

    def one(p: str) -> str:
        out = re.escape(p).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
        return out if "/" in p else "(?:.*/)?" + out

    return re.compile("|".join(f"(?:{one(p)})" for p in braces(pattern)), re.I)


def file_hash(path: str, algorithm: str = "sha256") -> str:
    """sha256, sha1, md5, or fast: size, time and the first and last 4 KB."""
    if algorithm == "fast":
        s = os.stat(path)
        ms = s.st_mtime_ns / 1e6
        ms = int(ms) if ms == int(ms) else ms
        if not s.st_size:
            return f"fast:0:{ms}:empty"
        h = hashlib.sha256(f"size:{s.st_size}|mtime:{ms}|".encode())
        with open(path, "rb") as f:
            h.update(f.read(4096))
            if s.st_size > 8192:
                f.seek(-4096, os.SEEK_END)
                h.update(f.read(4096))
        return "fast:" + h.hexdigest()[:16]
    h = hashlib.new(algorithm)
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


SCHEMA = "path string, relative_path string, name string, basename string, extension string, directory string, type string, size long, created_at timestamp, modified_at timestamp, accessed_at timestamp, mode int, is_file boolean, is_directory boolean, is_symlink boolean, mime string, category string, size_human string, hash string"
UNITS = ("B", "KB", "MB", "GB", "TB")


def human(n: float) -> str:
    i = 0
    while n >= 1024 and i < len(UNITS) - 1:
        n, i = n / 1024, i + 1
    return f"{n:.2f}".rstrip("0").rstrip(".") + f" {UNITS[i]}"


def record(root: str, path: str, algorithm: str | None) -> tuple:
    s = os.lstat(path)
    name = os.path.basename(path)
    base, ext = os.path.splitext(name)
    ext = ext.lstrip(".").lower()
    kind = "symlink" if stat.S_ISLNK(s.st_mode) else "directory" if stat.S_ISDIR(s.st_mode) else "file"
    when = [datetime.fromtimestamp(t, timezone.utc) for t in (s.st_ctime, s.st_mtime, s.st_atime)]
    mime, category = TYPES.get(ext, ("application/octet-stream", "other"))
    digest = file_hash(path, algorithm) if algorithm and kind == "file" else None
    return (path, os.path.relpath(path, root), name, base, ext, os.path.dirname(path), kind, s.st_size, *when, stat.S_IMODE(s.st_mode), kind == "file", kind == "directory", kind == "symlink", mime, category, human(s.st_size), digest)


def walk(root: str, options: dict) -> Iterator[str]:
    """Paths under a folder in order; links to folders already on the way are not followed."""
    include = [glob_regex(p) for p in (options.get("include") or "").split(";") if p]
    exclude = [glob_regex(p) for p in (options.get("exclude") or "").split(";") if p]
    hidden, folders, follow = (options.get(k, "false") == "true" for k in ("hidden", "folders", "follow"))
    depth = int(options.get("depth", 1 << 30))

    def visit(folder: str, level: int, seen: tuple) -> Iterator[str]:
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError as e:
            raise FilesystemError(str(e)) from e
        for e in entries:
            rel = os.path.relpath(e.path, root)
            if (not hidden and e.name.startswith(".")) or any(p.fullmatch(rel) for p in exclude):
                continue
            is_folder = e.is_dir(follow_symlinks=follow)
            if (not is_folder or folders) and (not include or any(p.fullmatch(rel) for p in include)):
                yield e.path
            if is_folder and level < depth:
                real = os.path.realpath(e.path)
                if real not in seen:
                    yield from visit(e.path, level + 1, (*seen, real))

    yield from visit(root, 1, (os.path.realpath(root),))


class FolderPartition(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class FolderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.options = options["path"], dict(options)

    def partitions(self) -> list[FolderPartition]:
        paths = list(walk(self.root, self.options))
        size = max(1, int(self.options.get("files_per_task", 2000)))
        return [FolderPartition(paths[i : i + size]) for i in range(0, len(paths), size)] or [FolderPartition([])]

    def read(self, partition: FolderPartition) -> Iterator[tuple]:
        for p in partition.paths:
            try:
                yield record(self.root, p, self.options.get("hash"))
            except FileNotFoundError:  # gone since the listing
                continue


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options)


def read_folder(spark: SparkSession, root: str, include: Iterable[str] = (), exclude: Iterable[str] = (), hash: str | None = None, deterministic: bool = False, **options) -> DataFrame:
    """One row per file; ``deterministic`` leaves out the access time."""
    spark.dataSource.register(FolderSource)
    given = {"path": os.path.abspath(root), "include": ";".join(include), "exclude": ";".join(exclude), **({"hash": hash} if hash else {}), **{k: str(v).lower() for k, v in options.items()}}
    df = spark.read.format("folder").options(**given).load()
    return df.drop("accessed_at") if deterministic else df


#: Columns that differ between copies of the same folder.
TIMES = ("path", "directory", "created_at", "modified_at", "accessed_at")


def diff_folders(spark: SparkSession, left: str, right: str, hash: str | None = "sha256", **options) -> DataFrame:
    """The keyed diff of two folders by relative path, without places and times."""
    from ..operators.diff import diff

    return diff(read_folder(spark, left, hash=hash, **options), read_folder(spark, right, hash=hash, **options), "relative_path", ignore=TIMES)
