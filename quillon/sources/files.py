"""Sources: one loader by suffix, and readers for folders, archives, workbooks and databases."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",", header: bool = True) -> DataFrame:
    reader = spark.read.option("header", header).option("sep", sep)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None, lines: bool = False) -> DataFrame:
    """A JSON array of records, or a record a line."""
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema else reader).json(path)


def read_excel(spark: SparkSession, path: str, columns: list[str], sheet: int = 1) -> DataFrame:
    """Rows of a sheet as text, the first row being the header; columns names those to return.

    Workbooks are zip files of XML, read by the standard library on the executors.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import re
        import zipfile
        from xml.etree import ElementTree

        def local(e) -> str:
            return e.tag.rpartition("}")[2]

        for part in parts:
            for content in part["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as book:
                    shared = []
                    if "xl/sharedStrings.xml" in book.namelist():
                        shared = ["".join(t.text or "" for t in si.iter() if local(t) == "t") for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")) if local(si) == "si"]
                    rows = []
                    for row in ElementTree.fromstring(book.read(f"xl/worksheets/sheet{sheet}.xml")).iter():
                        if local(row) != "row":
                            continue
                        cells = {}
                        for c in row:
                            letters = re.match(r"[A-Z]+", c.get("r", "A"))[0]
                            at = 0
                            for ch in letters:
                                at = at * 26 + ord(ch) - 64
                            value = "".join(t.text or "" for t in c.iter() if local(t) in ("v", "t"))
                            cells[at - 1] = shared[int(value)] if c.get("t") == "s" else value or None
                        rows.append(cells)
                names = rows[0] if rows else {}
                yield pd.DataFrame([{names.get(k): v for k, v in r.items()} for r in rows[1:]], columns=columns)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, ", ".join(f"`{c}` string" for c in columns))


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    """Read by suffix: parquet, orc, csv, tsv, json, jsonl, txt, xlsx."""
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
    by = {
        ".parquet": lambda: spark.read.parquet(path), ".orc": lambda: spark.read.orc(path),
        ".csv": lambda: read_csv(spark, path, **options), ".tsv": lambda: read_csv(spark, path, sep="\t", **options),
        ".json": lambda: read_json(spark, path, **options), ".jsonl": lambda: read_json(spark, path, lines=True, **options),
        ".txt": lambda: spark.read.text(path), ".xlsx": lambda: read_excel(spark, path, **options),
    }
    if suffix not in by:
        raise ValueError(f"Unsupported file format: {suffix or path}")
    return by[suffix]()


def read_folder(spark: SparkSession, path: str, kind: str = "csv", column: str = "source_file") -> DataFrame:
    """All files of a folder with the name of each row's file."""
    reader = spark.read.option("header", True).option("recursiveFileLookup", True)
    return getattr(reader, kind)(path).select("*", F.col("_metadata.file_name").alias(column))


def file_tree(spark: SparkSession, path: str) -> DataFrame:
    """(path, modified, size, md5) of all files below a folder; contents are not kept."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), F.md5("content").alias("md5"))


def duplicate_files(spark: SparkSession, path: str) -> DataFrame:
    """(md5, size, n, wasted) of contents that several files have; only files of equal size are hashed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    sizes = files.groupBy("length").agg(F.count("*").alias("n")).where("n > 1").select("length")
    hashed = files.join(sizes, "length", "left_semi").select(F.col("length").alias("size"), F.md5("content").alias("md5"))
    return hashed.groupBy("md5", "size").agg(F.count("*").alias("n")).where("n > 1").withColumn("wasted", F.col("size") * (F.col("n") - 1))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, size, md5) of all members of zip files, nested ones included."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib
        import io
        import zipfile

        def members(data: bytes, prefix: str = ""):
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for info in z.infolist():
                    if info.is_dir():
                        continue
                    content = z.read(info)
                    if info.filename.lower().endswith(".zip"):
                        yield from members(content, f"{prefix}{info.filename}!/")
                    else:
                        yield prefix + info.filename, len(content), hashlib.md5(content).hexdigest()

        for part in parts:
            for name, content in zip(part["path"], part["content"], strict=True):
                yield pd.DataFrame([(name, *m) for m in members(content)], columns=["archive", "member", "size", "md5"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content").mapInPandas(run, "archive string, member string, size long, md5 string")


def read_query(spark: SparkSession, url: str, query: str, **options) -> DataFrame:
    """Rows of a query over JDBC; the driver jar is the session's business."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def frame(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def time_spine(spark: SparkSession, start: str, end: str, step: str) -> DataFrame:
    """(ts): every step from start to end, both included."""
    return spark.sql("SELECT explode(sequence(timestamp(:a), timestamp(:b), cast(:step AS interval))) AS ts", args={"a": start, "b": end, "step": step})


def register(spark: SparkSession, sf_dir: str, names: list[str]) -> None:
    """Tables as temporary views for SQL."""
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
