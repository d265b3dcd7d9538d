import hashlib
import random

import pyarrow as pa

from promspark.llm import queries, spotsigs
from promspark.llm.oracles import OP2

from .duck import same


def brute(text):
    """Spot signatures from their definition."""
    import regex

    words = [w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w]
    out = set()
    for i, w in enumerate(words):
        if w in spotsigs.ANCHORS:
            chain = [x for x in words[i:] if x not in spotsigs.ANCHORS][:2]
            if len(chain) == 2:
                out.add(" ".join([w, *chain]))
    return out or ({" ".join(words)} if words else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_whole_table_against_sql(spark, sf):
    assert same(queries.op2_spotsigs(spark, sf), OP2, sf)


def test_edges_against_brute_force(spark, docs):
    texts = [None, "", "the", "the cat", "The cat sat.", "the cat sat", "no anchors here", "!!!", "the of and a", "x" * 200_001, "Über the größe Straße", "the cat sat", "日本 the 語 テ"]
    df = docs(texts).withColumnRenamed("lang", "next").withColumnRenamed("source", "own")
    got = {r.doc_id: r for r in spotsigs.edited_digest(df).collect()}
    assert len(got) == len(texts)
    for k in range(len(texts)):
        own, ahead = texts[k] or "", texts[k - 1] or ""
        edited = own[:len(own) - len(own) // 2] + ahead[:len(own) // 2]
        r = got[k]
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == "|".join(sorted(brute(own))) and r.edited_fingerprint == "|".join(sorted(brute(edited)))
        assert abs(r.near_edited - jaccard(brute(own), brute(edited))) < 1e-12 and abs(r.near_next - jaccard(brute(own), brute(ahead))) < 1e-12
    assert spotsigs.edited_digest(df.limit(0)).count() == 0
    assert spotsigs.edited_digest(df.limit(1)).first().near_next == 1.0


def test_next_row_over_groups_ties_and_nulls(spark, docs):
    rng = random.Random(3)
    ids = [rng.randint(-50, 50) for _ in range(300)] + [None, None]
    df = docs([f"t{k}" for k in range(len(ids))], ids=ids).select("doc_id", "text")
    rows = [(r.doc_id, r.text, r.h) for r in df.withColumn("h", spotsigs.F.xxhash64("doc_id", "text")).collect()]
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), r[2]))
    want = {r[1]: rows[(k + 1) % len(rows)][1] for k, r in enumerate(rows)}
    for groups in (1, 7, 40):
        rows, window = spotsigs.in_order(df, "doc_id", groups)
        got = rows.withColumn("next", spotsigs.F.lead("text").over(window)).where("not added").collect()
        assert {r.text: r.next for r in got} == want and len(got) == len(ids)


def test_near_duplicates_against_brute_force(spark, docs):
    rng = random.Random(5)
    content = [f"w{k}" for k in range(60)]
    base = [" ".join(x for _ in range(rng.randint(3, 60)) for x in (rng.choice(spotsigs.ANCHORS[:6]), rng.choice(content))) for _ in range(12)]
    texts = [None, "", "!"]
    for b in base:
        for _ in range(6):
            words = b.split()
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(content)
            texts.append(" ".join(words))
    df = docs(texts)
    member = {r.doc_id: r.class_id for r in spotsigs.classes(df).collect()}
    sets = {k: brute(t) for k, t in enumerate(texts)}
    assert all((member[a] == member[b]) == (sets[a] == sets[b]) for a in sets for b in sets)
    heads = sorted(set(member.values()))
    want = {(a, b) for a in heads for b in heads if a < b and sets[a] and jaccard(sets[a], sets[b]) >= 0.8}
    assert {(r.a, r.b) for r in spotsigs.near_duplicates(df).collect()} == want and want


def test_sql_handles_the_edges(spark, docs):
    df = docs([None, "", "the cat sat on", "no", "the cat"])
    frame = pa.table({"doc_id": [0, 1, 2, 3, 4], "text": [None, "", "the cat sat on", "no", "the cat"]})
    assert same(spotsigs.edited_digest(df), OP2, "", documents=frame)
