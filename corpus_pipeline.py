"""Documents to token ids: the operators of ``promspark.llm`` one after another.

``STAGES`` are (name, function) pairs.  A function takes (spark, docs, sf_dir)
and returns what it keeps; each result is written as Parquet and read again
as the next stage's documents.  All but the last return the columns of the
documents table.

1. language ID: learns from the labelled documents, names the language of
   those without one, and rejects texts without a letter or with a posterior
   under ``LEAST_SCORE``.
2. n-gram Jaccard join: documents whose sets of five-word runs have a Jaccard
   of 0.8 or more are linked; of each group the one with the smallest id stays
   (null ids last, then the first row).
3. benchmark decontamination: documents that hold a passage of a benchmark item
   of at least ``LEAST_ITEM`` words go (a few words in a row stand in clean text too).
4. PII: personal data is replaced by its kind.
5. SentencePiece: token ids, one row per document.

Rows are told apart by their place, not by id: rows with a null id or with the
same id but other texts are documents of their own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promspark.llm import decontaminate, language, ngram_join, pii, piece_lattice
from promspark.llm.bloom import without
from promspark.llm.common import written

PIECES = public_tokenizers.path("piece_bpe_32k.model")
LEAST_SCORE = 0.5
LEAST_ITEM = decontaminate.MIN_WORDS
SHINGLE, PERCENT = 5, 80  # near duplicates: words of a shingle, least Jaccard in percent
PACK_BYTES = 16 << 20  # text of a token pack: a worker has the earlier stages behind it


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.fit(docs, PIECES)
    told = language.identify(docs, model, lang_pred="__lang", score="__score")
    kept = told.where((F.col("__lang") != language.UND) & (F.col("__score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "__lang")).select(*docs.columns)


def numbered(docs: DataFrame) -> DataFrame:
    """Rows, not ids: a null or repeated id tells no rows apart.  The numbers are those of the places in the files."""
    return docs.withColumn("__row", F.monotonically_increasing_id())


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = numbered(docs)
    groups = written(ngram_join.join(rows.select("__row", "text"), key="__row", n=SHINGLE, percent=PERCENT).select("__row", "component_id"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")).alias("first")
    stay = rows.select("__row", "doc_id").join(groups, "__row").groupBy("component_id").agg(first).select("first.__row")
    return without(rows, "__row", written(groups.join(stay, "__row", "left_anti").select("__row"))).select(*docs.columns)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = numbered(docs)
    hits = decontaminate.find(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="__row", least_item=LEAST_ITEM)
    return rows.join(written(hits.select("__row").distinct()), "__row", "left_anti").select(*docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_lattice.encode(docs.select("doc_id", "text"), piece_lattice.load(PIECES), pack_bytes=PACK_BYTES)


STAGES = [
    ("language_id", language_id),
    ("ngram_join", one_of_each_group),
    ("decontamination", clean_of_benchmarks),
    ("pii", without_personal_data),
    ("sentencepiece", token_ids),
]

#: Trained scores and the piece lattice have no SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
