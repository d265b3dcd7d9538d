import zlib

import numpy as np
import public_tokenizers
import pytest

from promspark.llm import piece_lattice as L
from promspark.llm import queries

FILE = public_tokenizers.path("piece_bpe_32k.model")
PIECES = L.load(FILE)


def best_ids(text, pieces):
    """Viterbi over the whole text, characters straight from the definition; ties go to the longer last piece."""
    if not text:
        return []
    table = {p: (i, s) for p, i, s in pieces.rows}
    t = L.MARK + text.replace(" ", L.MARK)
    best, back = [0] + [None] * len(t), [None] * (len(t) + 1)
    for e in range(1, len(t) + 1):
        for s in range(max(0, e - pieces.longest), e):
            i, score = table.get(t[s:e], (None, pieces.unknown) if e - s == 1 else (None, None))
            if score is not None and (best[e] is None or best[s] + score > best[e]):
                best[e], back[e] = best[s] + score, (s, i)
    out, e = [], len(t)
    while e:
        s, i = back[e]
        out = ([i] if i is not None else pieces.byte_ids[list(t[s:e].encode())].tolist()) + out
        e = s
    return out


TEXTS = [None, "", " ", "  a  b ", "The cat, sat on;\rthe mat.\n\nNext\tline", "ﬁ 日本語 🙂 ñandú", "▁a b▁c", "x" * 3000, "ab" * 700 + " \x00\x7f", "same words same words", "same words same words", "éèê " * 50]


def test_ids_against_whole_text_viterbi(spark, docs, monkeypatch):
    monkeypatch.setattr(L, "CHUNK_BYTES", 64)
    monkeypatch.setattr(L, "PACK_BYTES", 200)
    df = docs(TEXTS).withColumnRenamed("lang", "ids").withColumnRenamed("source", "pack")
    got = {r.doc_id: r for r in L.encode(df, PIECES).collect()}
    assert len(got) == len(TEXTS)
    for k, t in enumerate(TEXTS):
        want = best_ids(t or "", PIECES)
        assert got[k].ids == want and got[k].n_tokens == len(want)
        assert got[k].ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes()) and got[k].round_trip
    back = {r.doc_id: r.text for r in L.decode(L.encode(df, PIECES), PIECES).collect()}
    assert back == {k: (t or "").replace(L.MARK, " ") for k, t in enumerate(TEXTS)}
    assert L.encode(df.limit(0), PIECES).count() == 0
    # the longest words need more than one part of the two-level lists
    assert max(len(t or "") for t in TEXTS) > 2 * L.RUN


def test_small_table_with_ties(spark, docs):
    rows = [("▁", 0, -3), ("a", 1, -1), ("b", 2, -2), ("ab", 3, -3), ("▁a", 4, -4), ("ba", 5, -3), ("bab", 6, -5)]
    pieces = L.Pieces(rows, np.arange(10, 266))
    texts = ["abab", "babab ab", "aé", "bb aab", "ab" * 20]
    got = {r.doc_id: r.ids for r in L.encode(docs(texts), pieces).collect()}
    assert got == {k: best_ids(t, pieces) for k, t in enumerate(texts)}


def test_agrees_with_the_library_in_unigram_mode(spark, docs, sf):
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece

    proto = pb.ModelProto()
    proto.ParseFromString(open(FILE, "rb").read())
    proto.trainer_spec.model_type = 1  # unigram: the library's own Viterbi over the same pieces and scores
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    # scores that single precision cannot add exactly
    odd = {i for _, i, s in PIECES.rows if s < -1e8} | set(PIECES.byte_ids.tolist())
    words = sorted({w for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for w in (r.text or "").split()})[::7]
    got = {r.doc_id: r.ids for r in L.encode(docs(words), PIECES).collect()}
    compared = [k for k, w in enumerate(words) if not odd & set(library.encode(w)) and not odd & set(got[k])]
    score = {i: s for _, i, s in PIECES.rows}
    total = lambda ids: sum(score[i] for i in ids)
    assert len(compared) > 500 and all(total(got[k]) >= total(library.encode(words[k])) for k in compared)
    assert np.mean([got[k] == library.encode(words[k]) for k in compared]) > 0.98


def test_query_over_whole_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op3_piece_lattice(spark, sf).collect()
    assert len(got) == len(texts) and all(r.round_trip for r in got)
    for r in got:
        if r.doc_id % 5 == 0 and len(texts[r.doc_id] or "") < 4000:
            assert r.ids_crc32 == zlib.crc32(np.array(best_ids(texts[r.doc_id], PIECES), "<u4").tobytes())
