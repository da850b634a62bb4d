"""Sources and sinks of sample streams, tables and parameters."""

from __future__ import annotations

import html
import io
import zipfile
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE_SCHEMA = "row LONG, ts TIMESTAMP, ch0 DOUBLE, ch1 DOUBLE, ch2 DOUBLE, state INT"
ENCODINGS = ("utf-8-sig", "utf-8", "cp949")


def require_columns(frame: DataFrame, columns: Sequence[str], what: str = "table") -> DataFrame:
    """The frame itself, or an error that names the columns it lacks."""
    missing = [c for c in columns if c not in frame.columns]
    if missing:
        raise ValueError(f"{what} lacks {', '.join(missing)}; it has {', '.join(frame.columns)}")
    return frame


def probe(spark: SparkSession, path: str, kind: str = "csv") -> dict[str, str]:
    """Columns of a table and their types, without reading its rows; all columns of a CSV table are text, as its first line alone is read."""
    reader = spark.read.option("header", True) if kind == "csv" else spark.read
    return dict(reader.format(kind).load(path).dtypes)


def is_there(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written to the end at a path, in any store that Spark reads."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def materialised(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The Parquet table of a path; made and written first where it isn't there, or a writer was lost before its end."""
    if not is_there(spark, path):
        make().write.parquet(path, mode="overwrite")
    return spark.read.parquet(path)


def job_folder(base: str, job: str, *parts: object) -> str:
    """The folder of a job's outputs: its name and parameters, as far as names of folders can hold them. Different ones don't share one."""
    def plain(x: object) -> str:
        return "".join(c if c.isascii() and (c.isalnum() or c in "-_") else f"%{ord(c):x}%" for c in str(x)) or "%"

    return "/".join([base.rstrip("/"), plain(job), *map(plain, parts)])


def sniff(head: bytes) -> str:
    """The first encoding that a file's head can be read in; a mark at its start decides."""
    if head.startswith(b"\xef\xbb\xbf"):
        return ENCODINGS[0]
    for name in ENCODINGS[1:]:
        for cut in range(min(4, len(head) + 1)):  # the head may end within a character
            try:
                head[: len(head) - cut].decode(name)
                return name
            except UnicodeDecodeError:
                continue
    raise ValueError("no known encoding")


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """file, length, encoding of every file under a path."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([sniff(x) for x in batch.column(2).to_pylist()], pa.string())], names=["file", "length", "encoding"])

    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.substring("content", 1, 4096).alias("head"))
    return files.mapInArrow(look, "file string, length long, encoding string")


def read_samples(spark: SparkSession, paths: dict[str, str], encoding: str = "UTF-8") -> DataFrame:
    """Samples of CSV files with a header, by source, with src added; an explicit schema, so nothing is read twice."""
    out = None
    for src, path in paths.items():
        own = spark.read.csv(path, schema=SAMPLE_SCHEMA, header=True, encoding=encoding, enforceSchema=True).withColumn("src", F.lit(src))
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no sources")
    return out


def read_with_file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV tables of a glob, with the name of the file that each row is from."""
    return spark.read.csv(path, schema=schema, header=True).select("*", F.col("_metadata.file_name").alias("file"))


def _archive(content: bytes) -> zipfile.ZipFile:
    """A zip file whose names without a mark of UTF-8 are Korean, or, where they can't be, as they are."""
    try:
        return zipfile.ZipFile(io.BytesIO(content), metadata_encoding="cp949")
    except UnicodeDecodeError:
        return zipfile.ZipFile(io.BytesIO(content))


def zip_lines(spark: SparkSession, path: str) -> DataFrame:
    """archive, member, line_no, line of text members of zip files, read where the files are; old names are repaired."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with _archive(content) as z:
                    for info in z.infolist():
                        if info.is_dir():
                            continue
                        with z.open(info) as f:
                            encoding = sniff(f.read(4096))
                        with z.open(info) as f:
                            lines: list[str] = []
                            start = 1
                            for line in io.TextIOWrapper(f, encoding):
                                lines.append(line.rstrip("\r\n"))
                                if len(lines) == 10_000:
                                    yield _lines(archive, info.filename, start, lines)
                                    start, lines = start + len(lines), []
                            yield _lines(archive, info.filename, start, lines)

    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")
    return files.mapInArrow(read, "archive string, member string, line_no long, line string")


def _lines(archive: str, member: str, start: int, lines: list[str]) -> pa.RecordBatch:
    n = len(lines)
    return pa.RecordBatch.from_arrays([pa.array([archive] * n, pa.string()), pa.array([member] * n, pa.string()), pa.array(range(start, start + n), pa.int64()), pa.array(lines, pa.string())], names=["archive", "member", "line_no", "line"])


def write_csv(frame: DataFrame, path: str, mode: str = "error") -> None:
    """A table for readers outside, with a header."""
    frame.write.csv(path, header=True, mode=mode)


def write_features(frame: DataFrame, path: str, mode: str = "error") -> None:
    """Feature tables are kept by window length, so that a read of one length prunes the others."""
    frame.write.partitionBy("win").parquet(path, mode=mode)


def append_log(spark: SparkSession, path: str, row: dict) -> None:
    """One more row of a run log."""
    spark.createDataFrame([row]).write.csv(path, header=True, mode="append")


def save_parameters(spark: SparkSession, path: str, rows: list[tuple[str, list[float]]]) -> None:
    """Fitted parameters as (name, values) rows."""
    spark.createDataFrame(rows, "name string, values array<double>").coalesce(1).write.parquet(path, mode="overwrite")


def load_parameters(spark: SparkSession, path: str) -> dict[str, list[float]]:
    return {r["name"]: list(r["values"]) for r in spark.read.parquet(path).collect()}


def html_report(tables: dict[str, DataFrame], most: int = 1000) -> str:
    """A page with a table for each small frame; one of more than ``most`` rows is an error, as it is no report."""
    parts = []
    for title, frame in tables.items():
        rows = frame.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{title} has over {most} rows")
        head = "".join(f"<th>{html.escape(c)}</th>" for c in frame.columns)
        body = "".join("<tr>" + "".join(f"<td>{'' if v is None else html.escape(str(v))}</td>" for v in r) + "</tr>" for r in rows)
        parts.append(f"<h2>{html.escape(title)}</h2><table><tr>{head}</tr>{body}</table>")
    return "<!doctype html><meta charset='utf-8'>" + "".join(parts)
