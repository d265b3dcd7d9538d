import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from promspark.llm import queries, token_files

FILE = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER, ENCODER = Tokenizer.from_file(FILE), token_files.WordEncoder(FILE, 1)


def brute(rows):
    """(key, start, n, crc) from whole texts encoded by the library."""
    tokenizer, out, start = Tokenizer.from_file(FILE), [], 0
    for key, text in sorted(rows):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_over_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op7_token_files(spark, sf).collect())) == brute(rows)


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_edges_and_encodings(spark, docs, tmp_path, encoding):
    texts = [None, "", "  \n", "Ünï cödé It's a b\x1cc don't", "<|endoftext|> a<|endoftext|>b", "é ́x", "日本語 テキスト", "w" * 300_000, "same", "same"]
    path = str(tmp_path / encoding)
    df = docs(texts, ids=list(range(len(texts)))[::-1]).withColumnRenamed("lang", "part").withColumnRenamed("source", "ids")
    token_files.write(df, path, FILE, encoding=encoding)
    got = sorted(map(tuple, token_files.digest(spark, path).collect()))
    assert got == brute([(len(texts) - 1 - i, t) for i, t in enumerate(texts)])
    file = pq.ParquetFile(next((tmp_path / encoding).glob("part-*.parquet")))
    column = [file.metadata.row_group(0).column(i) for i in range(file.metadata.num_columns)]
    ids = next(c for c in column if c.path_in_schema.startswith("ids"))
    assert ("RLE_DICTIONARY" in ids.encodings or "PLAIN_DICTIONARY" in ids.encodings) == (encoding == "dictionary")
    assert "DELTA_BINARY_PACKED" in column[0].encodings and column[0].has_offset_index
    assert token_files.read_range(spark, path, 3, 6).count() == 3
    assert "ids" not in token_files.read_metadata(spark, path).columns


def test_empty_table_and_repeated_keys(spark, docs, tmp_path):
    token_files.write(docs(["x"]).limit(0), str(tmp_path / "none"), FILE)
    assert token_files.digest(spark, str(tmp_path / "none")).count() == 0
    token_files.write(docs(["a b", "a b", "c"], ids=[1, 1, 1]), str(tmp_path / "ties"), FILE)
    rows = sorted(token_files.digest(spark, str(tmp_path / "ties")).collect())
    assert [r.start for r in rows] == [0, rows[0].n_tokens, rows[0].n_tokens + rows[1].n_tokens]


def test_cache_limit_does_not_change_ids(monkeypatch):
    import pyarrow as pa

    from promspark.llm.words import UNIT_WORDS, chunks

    monkeypatch.setattr(token_files, "CACHE_WORDS", 5)
    encoder, tokenizer = token_files.WordEncoder(FILE, 1), Tokenizer.from_file(FILE)
    for text in ["a b c d e f g h", "a z", "b y x w v u"] * 3:
        ids, _ = encoder.encoded(next(chunks(pa.array([text]), UNIT_WORDS)))
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aBst'd. |<>1é,\u0301ßΣ\x1c\n", max_size=30), min_size=1, max_size=4))
def test_words_encode_as_whole_texts(texts):
    import pyarrow as pa

    from promspark.llm.words import UNIT_WORDS, chunks

    ids, offsets = ENCODER.encoded(next(chunks(pa.array(texts), UNIT_WORDS))) if any(texts) else (np.ones(len(texts)), np.arange(len(texts) + 1))
    for k, text in enumerate(texts):
        assert ids[offsets[k]:offsets[k + 1]].tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids + [1]
