"""Queries of the numbered operators, and the SQL of those that SQL can express.

Each takes (spark, sf_dir), applies one operator with its production
parameters to its whole table and returns the full result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import curriculum, decontaminate, html_text, language, lexical_search, ngram_join, passages, piece_lattice, pii, spotsigs, token_files, warc_audit, whitening
from .common import shared_dir, table
from .oracles import ORACLE_SQL  # noqa: F401

VOCABULARY = public_tokenizers.path  # place of a public vocabulary file


def op1_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.find(table(spark, sf_dir, "documents"))


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_digest(table(spark, sf_dir, "documents"))


def op3_piece_lattice(spark: SparkSession, sf_dir: str, model_file: str = VOCABULARY("piece_bpe_32k.model")) -> DataFrame:
    return piece_lattice.encode(table(spark, sf_dir, "documents"), piece_lattice.load(model_file), ids=False)


def op4_language(spark: SparkSession, sf_dir: str, vocabulary_file: str = VOCABULARY("piece_bpe_32k.model")) -> DataFrame:
    """Learns from the labelled rows outside the held-out fifth; predicts every row."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    model = language.fit(docs.where(~F.col("held_out")), vocabulary_file)
    return language.identify(docs.select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), "text"), model).drop("text")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return rows.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str, tokenizer_file: str = VOCABULARY("word_bpe_49k.json")) -> DataFrame:
    path = shared_dir(spark)
    token_files.write(table(spark, sf_dir, "documents"), path, tokenizer_file, end_id=1)
    return token_files.digest(spark, path)


def op8_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the pages as two replicas, of which the second is damaged in the first byte of the payload of
    each page whose id has remainder 13 by 97 (pages that begin with an ASCII character), and audits all
    their records."""
    pages = table(spark, sf_dir, "pages")
    hit = (F.pmod("page_id", F.lit(97)) == 13) & F.col("html").rlike(r"^[\x00-\x7F]")
    good = warc_audit.records(pages.withColumn("hit", hit), keep=["hit"])
    bad = F.when(F.col("hit"), F.overlay("record", F.when(F.substring("payload", 1, 1) == "X", "Y").otherwise("X"), F.col("payload_at"), F.lit(1))).otherwise(F.col("record"))
    places = [shared_dir(spark), shared_dir(spark)]
    warc_audit.write(good.select("record"), places[0])
    warc_audit.write(good.select(bad.alias("record")), places[1])
    found = warc_audit.audit(*(warc_audit.leaves(spark, p) for p in places))
    page = F.regexp_extract("record_id_a", r"^<urn:page_id:(-?\d+)>$", 1).cast("long")
    return found.select(page.alias("page_id"), F.col("uri_a").alias("url"), "damaged", F.col("payload_a").alias("sha256_a"), F.col("payload_b").alias("sha256_b"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.digest(curriculum.plan(table(spark, sf_dir, "documents")))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.whiten(vectors, whitening.fit(vectors))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_passages": op1_passages,
    "op2_spotsigs": op2_spotsigs,
    "op3_piece_lattice": op3_piece_lattice,
    "op4_language": op4_language,
    "op5_html_text": op5_html_text,
    "op6_pii": op6_pii,
    "op7_token_files": op7_token_files,
    "op8_warc_audit": op8_warc_audit,
    "op9_ngram_join": op9_ngram_join,
    "op10_decontaminate": op10_decontaminate,
    "op11_curriculum": op11_curriculum,
    "op12_whitening": op12_whitening,
    "op13_lexical_search": op13_lexical_search,
}


