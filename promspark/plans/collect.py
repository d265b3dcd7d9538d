"""Collect: yearly source files -> one typed, compact parquet table per topic.

per-file header read and schema diff (S04, C05) -> all-string scan with the
file's separator (S01, S03) -> union by name with the year tag (S07, C09) ->
clean and shorten column names (C01, C02) -> text Parquet, the one parse of
the files, with row ids by file and place (S07) -> ANSI-safe numeric coercion
of the non-text columns (C08), which must keep every value -> smallest
integer types from one min/max pass where no value has a fraction (C07),
doubles elsewhere -> gzip parquet partitioned by year (S10).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import schema as C
from ..session import written_table
from ..sources import files as S


@dataclass
class Collected:
    table: DataFrame          # the written table, read back
    schema_report: DataFrame  # column_name, file, present, type (all strings at this stage)


def collect_topic(spark: SparkSession, specs: list[S.FileSpec], out_path: str,
                  text_columns: tuple[str, ...] = ("provider_code", "procedure", "age_band", "gender"),
                  tag_col: str = "year", key: str = "record_id") -> Collected:
    """``text_columns`` stay text; any other column whose text is not all
    numbers raises an error that names it, so no value is lost.  Rows without
    a ``key`` column get one: the row's number in the order of file paths and
    of the rows in a file, the same however the files are cut into splits."""
    headers = {s.tag or s.path: S.header(spark, s.path, s.sep) for s in specs}
    report = C.schema_diff({name: spark.createDataFrame([], S.string_schema(cols))
                            for name, cols in headers.items()})
    all_cols = sorted({c for cols in headers.values() for c in cols})
    frames, tags = [], []
    for s in specs:
        frames.append(S.read_csv(spark, s.path, s.sep, schema=S.string_schema(headers[s.tag or s.path]), place=True))
        tags.append(s.tag)
    raw = S.union_aligned(frames, tags, f"__{tag_col}_tag")
    named = C.rename_columns(raw, lambda c: c if c in S.PLACE else C.short_name(c))
    if tag_col not in named.columns:
        named = named.withColumnRenamed(f"__{tag_col}_tag", tag_col)
    else:
        named = named.withColumn(tag_col, F.coalesce(F.col(tag_col), F.col(f"__{tag_col}_tag"))) \
            .drop(f"__{tag_col}_tag")
    named = S.number_rows(named, key) if key not in named.columns else written_table(named.drop(*S.PLACE))
    numeric = [c for c in named.columns if c not in text_columns and c not in (tag_col, key)]
    if dict(named.dtypes)[key] == "string":
        numeric.append(key)
    typed = S.coerce_numeric(named, numeric, "double")
    lost = named.select(*[(F.col(c).isNotNull() & (F.trim(c) != "") & F.col(c).try_cast("double").isNull()).alias(c) for c in numeric]) \
        .agg(*[F.count_if(F.col(c)).alias(c) for c in numeric]).first()
    bad = {c: lost[c] for c in numeric if lost[c]}
    if bad:
        raise ValueError(f"columns with text that is no number (values): {bad}; name them in text_columns")
    sizes = {r["column_name"]: "double" if r["type"] == "float" else r["type"] for r in C.smallest_types(typed, numeric).collect()}
    typed = C.apply_types(typed, sizes)
    S.write_parquet(typed, out_path, "gzip", partition_by=[tag_col])
    return Collected(spark.read.parquet(out_path), report)
