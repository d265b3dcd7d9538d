"""Operator 7: token ids as Parquet list columns, written in document order.

Documents are range-partitioned and sorted by key, encoded with a public
tokenizer, and written as one Parquet file per partition:

* ``ids`` is a list column with dictionary encoding (or delta encoding);
* the metadata columns (key, ``n_tokens``, ``local_start``, ``part``) are
  delta-encoded integers beside it, so a read of the metadata touches no ids;
* row groups and pages have bounded sizes and page indexes are written, so a
  read of a key range skips row groups and pages.

White space separates the words of this tokenizer, and a run of letters ends
where another character follows, so the ids of a text are those of its words
one after another; each task encodes a distinct word once and keeps a bounded
cache.

Rules: a null or empty text has only the end id.  Rows with the same key keep
one row each, ordered by the hash of their text.  A null key sorts first.  An
empty table writes files without rows.  Extra columns are not written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches
from .words import UNIT_WORDS, chunks

CACHE_WORDS = 1_000_000  # about 40 MB


class WordEncoder:
    """Ids of words by hash: each distinct word is encoded once while it stays in the cache.

    A word of ASCII letters is its own unit for the vocabulary's splitting rule,
    whatever its neighbours, so many of them go through the library as one text
    that is split at spaces only; other words are encoded one by one."""

    def __init__(self, tokenizer_file: str, end_id: int):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.encode = Tokenizer.from_file(tokenizer_file).encode_batch_fast
        plain = Tokenizer.from_file(tokenizer_file)
        plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.encode_plain = plain.encode_batch  # with the word of each id
        self.end_id = end_id
        self.clear()

    def clear(self) -> None:
        """Only the end id, as entry 0."""
        self.keys, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.bounds = np.array([self.end_id], np.int32), np.array([0, 1], np.int64)

    def encode_words(self, texts: list[str], together: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids per word)."""
        plain = np.fromiter((t.isascii() and t.isalpha() for t in texts), bool, len(texts))
        easy = [t.lower() for t, p in zip(texts, plain) if p]
        groups = self.encode_plain([" ".join(easy[k:k + together]) for k in range(0, len(easy), together)], add_special_tokens=False)
        hard = self.encode([t for t, p in zip(texts, plain) if not p], add_special_tokens=False)
        sizes = np.zeros(len(texts), np.int64)
        own = [np.bincount(np.array(g.word_ids, np.int64)) for g in groups]
        sizes[plain] = np.concatenate(own) if own else 0
        sizes[~plain] = np.fromiter((len(e.ids) for e in hard), np.int64, len(hard))
        out = np.zeros(int(sizes.sum()), np.int32)
        at = np.repeat(plain, sizes)
        out[at] = np.fromiter(chain.from_iterable(g.ids for g in groups), np.int32, int(at.sum()))
        out[~at] = np.fromiter(chain.from_iterable(e.ids for e in hard), np.int32, int((~at).sum()))
        return out, sizes

    def entries(self, words) -> np.ndarray:
        """The cache entry of every word of a chunk; encodes those not seen before."""
        unique, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(unique) > CACHE_WORDS:
            self.clear()
        at = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), bool)
        known[at < len(self.keys)] = self.keys[at[at < len(self.keys)]] == unique[at < len(self.keys)]
        entry = np.zeros(len(unique), np.int64)
        entry[known] = self.entry[at[known]]
        if not known.all():
            data = words.data.tobytes()
            a, b = words.starts[first[~known]].tolist(), words.ends[first[~known]].tolist()
            ids, sizes = self.encode_words([data[i:j].decode("utf-8") for i, j in zip(a, b)])
            entry[~known] = len(self.bounds) - 1 + np.arange(len(sizes))
            self.bounds = np.concatenate([self.bounds, len(self.ids) + np.cumsum(sizes)])
            self.ids = np.concatenate([self.ids, ids])
            self.keys, self.entry = np.insert(self.keys, at[~known], unique[~known]), np.insert(self.entry, at[~known], entry[~known])
        return entry[inverse.reshape(-1)]

    def encoded(self, words) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the rows, n + 1 offsets); each row ends with the end id."""
        entry = np.insert(self.entries(words), words.offsets[1:], 0)
        ids, bounds = self.ids, self.bounds
        size = bounds[entry + 1] - bounds[entry]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        out = ids[np.repeat(bounds[entry] - (ends - size), size) + np.arange(total)]
        last = words.offsets[1:] + np.arange(words.n)  # the end entries' places
        return out, np.concatenate([[0], ends[last]])


def _of_this_worker(tokenizer_file: str, end_id: int) -> WordEncoder:
    """One encoder per Python worker and file, so that the tasks a worker runs one after another share its cache."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_promspark_word_encoders", {})
    if (tokenizer_file, end_id) not in kept:
        kept[tokenizer_file, end_id] = WordEncoder(tokenizer_file, end_id)
    return kept[tokenizer_file, end_id]


def _encoder(tokenizer_file: str, end_id: int, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _of_this_worker(tokenizer_file, end_id)
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            keys = batch.column(0)
            for words in chunks(batch.column(1), UNIT_WORDS):
                ids, offsets = encoder.encoded(words)
                n = np.diff(offsets)
                yield pa.RecordBatch.from_arrays([
                    keys.slice(words.first, words.n), pa.array(np.full(words.n, part, np.int32)), pa.array(done + offsets[:-1]),
                    pa.array(n), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))],
                    names=[key, "part", "local_start", "n_tokens", "ids"])
                done += int(offsets[-1])
    return run


def write(df: DataFrame, path: str, tokenizer_file: str, end_id: int = 1, key: str = "doc_id", text: str = "text",
          encoding: str = "dictionary", row_group_bytes: int = 16 << 20, page_bytes: int = 256 << 10, page_rows: int = 1000) -> None:
    """Encodes ``text`` and writes it to ``path`` in ascending ``key`` order."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding must be dictionary or delta, not {encoding}")
    kind = df.schema[key].dataType.simpleString()
    rows = bounded_batches(df).select(F.col(f"`{key}`").alias(key), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    order = [F.col(key).asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.mapInArrow(_encoder(tokenizer_file, end_id, key), f"`{key}` {kind}, part int, local_start bigint, n_tokens bigint, ids array<int>")
    rows.write.options(**{
        "compression": "snappy", "parquet.writer.version": "PARQUET_2_0", "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes), "parquet.page.row.count.limit": str(page_rows),
        "parquet.enable.dictionary": "false", "parquet.enable.dictionary#ids.list.element": str(encoding == "dictionary").lower(),
    }).parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Keys and token counts; the ids are not read."""
    return spark.read.parquet(path).drop("ids")


def read_range(spark: SparkSession, path: str, low: int, high: int, key: str = "doc_id") -> DataFrame:
    """Rows with low <= key < high; other row groups and pages are skipped by their indexes."""
    return spark.read.parquet(path).where((F.col(key) >= low) & (F.col(key) < high))


def digest(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """Per row of the files: its key, the number of ids before it, its ids and their CRC-32.

    What is collected is one sum per file, not per row."""
    sums = read_metadata(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    base, total = {}, 0
    for part, n in sorted(sums):
        base[part] = total
        total += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(4)
            offsets, values = ids.offsets.to_numpy(), ids.values.to_numpy()
            crc = np.fromiter((zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])), np.int64, len(ids))
            start = batch.column(2).to_numpy() + np.fromiter((base[p] for p in batch.column(1).to_pylist()), np.int64, len(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(start), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc)],
                                             names=[key, "start", "n_tokens", "ids_crc32"])

    rows = spark.read.parquet(path).select(key, "part", "local_start", "n_tokens", "ids")
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")
