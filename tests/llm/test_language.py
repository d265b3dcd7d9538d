import zlib

import numpy as np
import public_tokenizers

from promspark.llm import language as L
from promspark.llm import queries

FILE = public_tokenizers.path("piece_bpe_32k.model")


def all_segmentations(word, p):
    """Sum over segmentations, straight from the definition."""
    if not word:
        return 1.0
    out = 0.0
    for n in range(1, len(word) + 1):
        q = p.get(word[:n], L.UNKNOWN if n == 1 else 0.0)
        out += q * all_segmentations(word[n:], p) if q else 0.0
    return out


def test_forward_sums_all_segmentations():
    pieces = ["▁a", "a", "b", "ab", "▁ab", "ba", "bab", "▁", "aba"]
    p = np.linspace(0.05, 0.2, len(pieces))[:, None]
    scorer = L.Scorer(L.Model(pieces, ["x"], p, np.zeros(1)))
    words = ["abab", "b", "aaa", "xab", "ba", "abababab"]
    want = [np.log(all_segmentations(L.START + w, dict(zip(pieces, p[:, 0])))) for w in words]
    assert np.allclose(scorer.log_p(words)[:, 0], want)


def test_backward_agrees_with_forward():
    pieces = L.vocabulary(FILE)
    lattice, p = L.Lattice(pieces), L.prior(pieces)
    points, lengths = L._code_points(["▁hello", "▁añob", "e", "▁zzßzz"])
    edges = lattice.edges(points, lengths)
    a = L.forward(edges, points, p[:, None])[np.arange(4), lengths, 0]
    assert np.allclose(a, L.backward(edges, points, lengths, p)[:, 0])


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.op4_language(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    assert all(rows[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 5 == 0) for d in docs)
    held = [d for d in docs if rows[d.doc_id].held_out and d.lang]
    assert np.mean([rows[d.doc_id].lang_pred == d.lang for d in held]) >= 0.98


def test_edges(spark, docs):
    texts = ["the cat and the dog", "le chat et le chien", None, "", "123 «»!", "日本", "t" * 100_000, "the cat and the dog"]
    df = docs(texts, langs=["en", "fr", "en", "en", None, None, None, "en"]).withColumnRenamed("source", "score")
    model = L.fit(df, FILE)
    assert model.languages == ["en", "fr"]
    got = L.identify(df, model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got[:5]] == ["en", "fr", "und", "und", "und"]
    assert got[0].score == got[7].score and all(0 <= r.score <= 1 for r in got) and got[5].lang_pred != "und"
    none = L.fit(df.where("lang is null"), FILE)
    assert {r.lang_pred for r in L.identify(df, none).collect()} == {"und"}
    assert L.identify(df.limit(0), model).count() == 0


def test_share_of_the_sample_never_rounds_to_nothing(spark):
    assert L.hash_bound(5 * 10 ** 10, 20_000) > 10 ** 11 and L.hash_bound(10, 20_000) == 1 << 62 and L.hash_bound(0, 5) == 0
    rows = [(f"the cat and the dog number {k}", "en") for k in range(300)] + [("le chat et le chien", "fr")] * 300
    model = L.fit(spark.createDataFrame(rows, "text string, lang string"), FILE, max_documents=100)
    assert "en" in model.languages
