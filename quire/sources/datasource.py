"""``spark.read.format("pages")`` for any store that Arrow opens by its URI, writers, and a table function for content.

``quire.sources.tables.read`` does the same for any store that Spark's own reader opens.
"""

from __future__ import annotations

import fnmatch
import os
import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quire.session import shipped, spread
from quire.sources import content, tables
from quire.sources.values import from_json, unparse
from quire.sources.writer import Options, write


class Files(InputPartition):
    """Some files for one task."""

    def __init__(self, paths: list[str]):
        self.paths = paths


class PagesSource(DataSource):
    """Options: ``path`` (a pattern), ``table``, ``filesPerTask``, ``recover``, ``password``, ``operators``."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        table = self.options.get("table", "docs")
        if table not in tables.SCHEMAS:
            raise ValueError(f"no table {table}; there are {', '.join(tables.SCHEMAS)}")
        return tables.SCHEMAS[table]

    def reader(self, schema) -> DataSourceReader:
        return PagesReader(dict(self.options))


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:"))


def _matching(path: str) -> list[str]:
    """Paths, within their store, of the files of a folder (*.pdf) or of a pattern in the last parts of a path."""
    signs = [path.find(c) for c in "*?[" if c in path]
    store, place = _store(path[: path.rfind("/", 0, min(signs)) + 1] if signs else path)
    if not signs:
        info = store.get_file_info(place)
        if info.type == fs.FileType.File:
            return [place]
        pattern = posixpath.join(place, "*.pdf")
    else:
        pattern = posixpath.join(place, path[path.rfind("/", 0, min(signs)) + 1 :])
    deep = pattern[len(place) :].strip("/").count("/") > 0
    found = store.get_file_info(fs.FileSelector(place, allow_not_found=True, recursive=deep))
    fits = lambda name: name.count("/") == pattern.count("/") and fnmatch.fnmatchcase(name, pattern)
    return sorted(f.path for f in found if f.type == fs.FileType.File and fits(f.path))


class PagesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Files]:
        names = _matching(self.options["path"])
        size = int(self.options.get("filespertask", self.options.get("filesPerTask", 64)))
        return [Files(names[i : i + size]) for i in range(0, len(names), size)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        table = self.options.get("table", "docs")
        more = {"operators": self.options.get("operators", "")} if table == "instructions" else {}
        store = _store(self.options["path"].split("*")[0])[0] if partition.paths else None
        for name in partition.paths:
            with store.open_input_stream(name) as f:
                yield from tables.rows_of(name, f.read(), table, self.options.get("recover", "true") != "false", self.options.get("password", ""), **more)


@F.udtf(returnType="seq: int, operator: string, operands: array<string>")
class Instructions:
    """``SELECT * FROM t, LATERAL content_instructions(content, 'q Q cm Do')``."""

    def eval(self, data: bytes, operators: str):
        for seq, (operands, operator) in enumerate(content.instructions(bytes(data or b""), operators or "")):
            yield seq, operator, [unparse(x).decode("latin-1") for x in (operands[:1] if operator == "INLINE IMAGE" else operands)]


def register(spark: SparkSession) -> None:
    """The source and the table function, by name."""
    spark.dataSource.register(PagesSource)
    spark.udtf.register("content_instructions", Instructions)


def save_files(files: DataFrame, folder: str) -> None:
    """Every ``content`` of ``path, content`` as the file of that name within ``folder``, a path or URI.

    A file is written under another name and moved when it is whole, so a reader sees it whole or
    not at all, and a task that is run again, or twice, leaves the same file. Names with a slash
    or that go up are an error before anything of their batch is written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = _store(folder)
        store.create_dir(place, recursive=True)
        for batch in batches:
            names = batch.column(0).to_pylist()
            if bad := [n for n in names if not n or "/" in n or n in (".", "..")]:
                raise ValueError(f"{bad[0]!r} is no file's name")
            for i, name in enumerate(names):
                whole, part = posixpath.join(place, name), posixpath.join(place, f"_{uuid.uuid4().hex}.part")
                with store.open_output_stream(part) as out:
                    out.write(batch.column(1)[i].as_py() or b"")
                store.move(part, whole)
            yield pa.RecordBatch.from_arrays([pa.array([len(names)], pa.int64())], ["written"])

    shipped(files).select("path", "content").mapInArrow(run, "written bigint").write.format("noop").mode("overwrite").save()


def to_files(objects: DataFrame, roots: DataFrame, options: Options = Options()) -> DataFrame:
    """``path, content``: each document's objects (``path, obj, gen, value, raw``) as a file.

    ``roots``: ``path, trailer``. A file is one value, so a document's objects meet in one
    task; documents are many. Options that don't go together fail here, before any job.
    """
    if problem := options.problem():
        raise ValueError(problem)

    def make(key: tuple, rows: pa.Table) -> pa.Table:
        got = rows.to_pylist()
        trailer = from_json(next(r["trailer"] for r in got if r["trailer"]))
        values = {(r["obj"], r["gen"]): from_json(r["value"], r["raw"]) for r in got if r["obj"] is not None}
        for k, v in values.items():
            head = getattr(v, "head", v)
            if isinstance(head, dict) and head.get("/Type") in ("/XRef", "/ObjStm"):
                values[k] = None
        return pa.table({"path": pa.array([key[0].as_py()], pa.string()), "content": pa.array([write({k: v for k, v in values.items() if v is not None}, trailer, "1.7", options)], pa.binary())})

    both = shipped(objects).select("path", "obj", "gen", "value", "raw", F.lit(None).cast("string").alias("trailer")).unionByName(roots.select("path", F.lit(None).cast("int").alias("obj"), F.lit(None).cast("int").alias("gen"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("binary").alias("raw"), "trailer"))
    return spread(both, "path").groupBy("path").applyInArrow(make, "path string, content binary")


def to_json_rows(objects: DataFrame, stream_data: str = "inline") -> DataFrame:
    """A row of JSON for each document: its objects by key, stream data inline as base64 or left out."""
    if stream_data not in ("inline", "none"):
        raise ValueError("stream data is inline or none")
    data = F.base64("raw") if stream_data == "inline" else F.lit(None).cast("string")
    entry = F.struct(F.concat(F.lit("obj:"), F.col("obj"), F.lit(" "), F.col("gen"), F.lit(" R")).alias("key"), F.struct(F.col("value"), data.alias("data")).alias("entry"))
    return objects.groupBy("path").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry), lambda a, b: F.when(a.key < b.key, -1).when(a.key > b.key, 1).otherwise(0)))).alias("json"))


def from_json_rows(rows: DataFrame) -> DataFrame:
    """Objects of documents written by ``to_json_rows``."""
    got = rows.select("path", F.explode(F.from_json("json", "map<string,struct<value:string,data:string>>")).alias("key", "e"))
    number = lambda i: F.regexp_extract("key", r"^obj:(\d+) (\d+) R$", i).cast("int")
    return got.select("path", number(1).alias("obj"), number(2).alias("gen"), F.col("e.value").alias("value"), F.unbase64("e.data").alias("raw"))


