"""Sources and sinks.

Files are described by a manifest (path, format, separator, tag); each
group of files with the same read options is one Spark scan, and the scans
are unioned by name.  ZIP archives are not splittable, so each archive is
one task: ``binaryFile`` lists them, ``mapInPandas`` inflates the CSV
members of its archive and emits rows in Arrow batches.
"""

from __future__ import annotations

import io
import os
import uuid
import zipfile
from dataclasses import dataclass
from typing import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.relate import union_aligned  # noqa: F401 (re-exported)
from ..operators.running import running_sums
from ..session import checkpoint_dir, written_table

#: where a row stands: its file, the start of its split, and a number that grows by one per row of the split
PLACE = ("__file", "__block", "__at")


def work_dir(spark: SparkSession, name: str = "work") -> str:
    """A fresh folder under the shared checkpoint location (never a
    machine-local temp folder)."""
    base = checkpoint_dir(spark, allow_local=True)
    path = os.path.join(base, "promspark", name, uuid.uuid4().hex)
    return path


@dataclass
class FileSpec:
    path: str
    fmt: str = "csv"
    sep: str = ","
    tag: str | None = None
    null_value: str | None = None


def string_schema(columns: Sequence[str]) -> T.StructType:
    """Every column as STRING (tolerant scan; types come from try_cast)."""
    return T.StructType([T.StructField(c, T.StringType(), True) for c in columns])


def header(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """Column names from the header only (no data job beyond the first line)."""
    return spark.read.option("header", True).option("sep", sep).csv(path).columns


def read_csv(spark: SparkSession, path: str, sep: str = ",", schema: T.StructType | None = None,
             null_value: str | None = None, columns: Sequence[str] | None = None,
             recursive: bool = False, glob: str | None = None, place: bool = False) -> DataFrame:
    """CSV scan with header and separator,
    optional null marker, explicit (e.g. all-string) schema, projection.
    ``place`` adds the columns that ``number_rows`` needs."""
    r = spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE")
    if null_value is not None:
        r = r.option("nullValue", null_value)
    if recursive:
        r = r.option("recursiveFileLookup", True)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if schema is not None:
        r = r.schema(schema)
    df = r.csv(path)
    if place:
        return with_place(df, columns)
    return df.select(*columns) if columns else df


def with_place(scan: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A file scan with ``PLACE``, which ``number_rows`` turns into row numbers."""
    found = (F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return scan.select(*[F.col(f"`{c}`") for c in columns or scan.columns], *[c.alias(name) for c, name in zip(found, PLACE)])


def number_rows(placed: DataFrame, id_col: str = "record_id") -> DataFrame:
    """``placed`` (rows with ``PLACE``) as a written table with the row's number, from 0, in the order of the
    file paths and of the rows in a file.  The number does not depend on how the files were cut into splits.

    The files are parsed once, to that table.  A count per split and a running sum over the splits give each
    split's first number; that table has a row per split and is joined by its measured size."""
    rows = written_table(placed)
    splits = rows.groupBy("__file", "__block").agg(F.min("__at").alias("__base"), F.count(F.lit(1)).alias("__n"))
    starts = written_table(running_sums(splits, ["__file", "__block"], {"__n": "__start"}).select("__file", "__block", (F.col("__start") - F.col("__base")).alias("__start")))
    return rows.join(starts, ["__file", "__block"]).withColumn(id_col, F.col("__start") + F.col("__at")).drop(*PLACE, "__start")


def read_manifest(spark: SparkSession, specs: Sequence[FileSpec], schema: T.StructType | None = None,
                  tag_col: str = "source", id_col: str | None = None) -> DataFrame:
    """S01 + S07: files with per-file options -> one frame, union by name,
    with the tag (e.g. year) of each file.  A CSV file is read by its own
    header; ``schema`` names the columns to keep and their types, whatever
    their order in a file.  ``id_col`` adds row numbers (see ``number_rows``)."""
    frames, tags, place = [], [], PLACE if id_col else ()
    for s in specs:
        if s.fmt == "csv":
            own = header(spark, s.path, s.sep)
            df = read_csv(spark, s.path, s.sep, schema=string_schema(own), null_value=s.null_value, place=bool(id_col))
            if schema is not None:
                df = df.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) if not isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")
                                 for f in schema.fields if f.name in own], *place)
        elif s.fmt == "parquet":
            df = spark.read.parquet(s.path)
            df = with_place(df) if id_col else df
        else:
            raise ValueError(s.fmt)
        frames.append(df)
        tags.append(s.tag or os.path.basename(s.path))
    rows = union_aligned(frames, tags, tag_col)
    return number_rows(rows, id_col) if id_col else rows


def coerce_numeric(df: DataFrame, cols: Sequence[str], to: str = "double") -> DataFrame:
    """String -> number, malformed -> null (ANSI-safe try_cast);
    'nan' parses to NaN and is mapped to null too."""
    out = {}
    for c in cols:
        v = F.col(c).try_cast(to)
        if to in ("double", "float"):
            v = F.when(~F.isnan(v), v)
        out[c] = v
    return df.withColumns(out)


def _unzip_csv_batches(sep: str, columns: Sequence[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in z.namelist():
                        base = os.path.basename(member)
                        if member.startswith("__MACOSX") or base.startswith("._") or not base.lower().endswith(".csv"):
                            continue
                        with z.open(member) as fh:
                            for chunk in pd.read_csv(fh, sep=sep, dtype=str, keep_default_na=False,
                                                     chunksize=50_000):
                                chunk = chunk.reindex(columns=list(columns))
                                chunk["archive"] = os.path.basename(path)
                                chunk["member"] = base
                                yield chunk
    return run


def read_zip_csv(spark: SparkSession, path: str, columns: Sequence[str], sep: str = ",",
                 recursive: bool = True) -> DataFrame:
    """CSV members of every ZIP under ``path`` (macOS resource
    members skipped) as string columns plus archive and member names.
    Temporary files of unfinished writer attempts (``_tmp-*``) are hidden
    files to Spark's listing and are skipped."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.zip")
             .option("recursiveFileLookup", recursive).load(path).select("path", "content"))
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in columns] +
                          [T.StructField("archive", T.StringType()), T.StructField("member", T.StringType())])
    # archives are not splittable: spread the listing by path so archives
    # inflate in parallel, each inside one task
    return files.repartition("path").mapInPandas(_unzip_csv_batches(sep, columns), schema)


def _zip_partition_writer(out_dir: str, sep: str, columns: Sequence[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as pafs
        from pyspark import TaskContext
        ctx = TaskContext.get()
        part, attempt = (ctx.partitionId(), ctx.attemptNumber()) if ctx else (0, 0)
        # one archive per partition with a deterministic name; each attempt
        # writes a temporary file that is renamed at the end, so a task retried
        # after an executor loss replaces its archive instead of adding one
        name = f"part-{part:05d}"
        filesystem, root = pafs.FileSystem.from_uri(out_dir if "://" in out_dir or out_dir.startswith("file:")
                                                    else "file://" + os.path.abspath(out_dir))
        filesystem.create_dir(root, recursive=True)
        tmp = f"{root}/_tmp-{name}-{attempt}-{uuid.uuid4().hex}.zip"
        rows = 0
        # stream batch by batch into the archive member: memory is one Arrow
        # batch, not the partition (zipfile writes data descriptors on the
        # non-seekable output stream)
        with filesystem.open_output_stream(tmp) as fh, zipfile.ZipFile(fh, "w", zipfile.ZIP_DEFLATED) as z:
            with z.open(f"data/{name}.csv", "w", force_zip64=True) as member:
                member.write((sep.join(columns) + "\n").encode())
                for b in batches:
                    if len(b):
                        member.write(b[list(columns)].to_csv(sep=sep, index=False, header=False).encode())
                        rows += len(b)
            z.writestr(f"__MACOSX/data/._{name}.csv", "resource fork")
        filesystem.move(tmp, f"{root}/{name}.zip")
        yield pd.DataFrame({"file": [name + ".zip"], "rows": [rows]})
    return run


def write_zip_csv(df: DataFrame, out_dir: str, sep: str = ",", partitions: int | None = None) -> DataFrame:
    """Sink for ZIP archives: each task writes one archive of its rows
    (string columns).  Returns (file, rows) per archive; evaluate it to write."""
    src = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    if partitions:
        src = src.repartition(partitions)
    return src.mapInPandas(_zip_partition_writer(out_dir, sep, df.columns), "file string, rows long")


def write_parquet(df: DataFrame, path: str, compression: str = "gzip",
                  partition_by: Sequence[str] = ()) -> None:
    """Parquet sink (gzip by default, as the reference's hand-over files)."""
    w = df.write.mode("overwrite").option("compression", compression)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """CSV sink with header."""
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def write_paired(df: DataFrame, features: Sequence[str], target: str, path: str, key: str = "record_id") -> None:
    """Features and target as two files, both keyed by ``key``."""
    write_parquet(df.select(key, *features), os.path.join(path, "features"))
    write_parquet(df.select(key, target), os.path.join(path, "target"))


def read_paired(spark: SparkSession, path: str, key: str = "record_id") -> DataFrame:
    return spark.read.parquet(os.path.join(path, "features")).join(
        spark.read.parquet(os.path.join(path, "target")), key, "left")


def load_registry(spark: SparkSession, registry: dict[str, dict], label_col: str = "dataset") -> DataFrame:
    """{label: {"train": path, "test": path, "drop": [...]}} -> one frame
    with dataset label and split columns (union by name)."""
    frames = []
    for label, spec in registry.items():
        for split in ("train", "test"):
            if split in spec:
                df = spark.read.parquet(spec[split]).drop(*spec.get("drop", []))
                frames.append(df.withColumns({label_col: F.lit(label), "split": F.lit(split)}))
    return union_aligned(frames)
