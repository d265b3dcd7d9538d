from collections import Counter, defaultdict

import corpus_pipeline as C
from promspark.llm import decontaminate, language, pii

from .test_decontaminate import words
from .test_ngram_join import shingles
from .test_piece_lattice import PIECES, best_ids


def groups(texts, n=5, percent=80):
    """The first member of each text's group; links are counted over the texts that share a shingle."""
    sets = [shingles(t, n) for t in texts]
    label, holders = list(range(len(sets))), defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for k, s in enumerate(sets):
        shared = Counter(i for x in s for i in holders[x] if i < k)
        for i, common in shared.items():
            if 100 * common >= percent * (len(s) + len(sets[i]) - common):
                a, b = root(i), root(k)
                label[max(a, b)] = min(a, b)
    return [root(k) for k in range(len(sets))]


def holds(x, y):
    """Whether words x hold a passage of the item y: a match has at most two substitutions in 13 words or
    one in 8, so three words in a row are equal and name its diagonal."""
    size = min(decontaminate.WINDOW, len(y))
    if len(y) < decontaminate.MIN_WORDS:
        return False
    places = defaultdict(list)
    for q in range(len(y) - 2):
        places[tuple(y[q:q + 3])].append(q)
    for shift in {p - q for p in range(len(x) - 2) for q in places.get(tuple(x[p:p + 3]), ())}:
        low, high = max(shift, 0), min(len(x), len(y) + shift)
        same = [x[p] == y[p - shift] for p in range(low, high)]
        if any(sum(same[k:k + size]) >= decontaminate.need(size, decontaminate.SIMILARITY) for k in range(len(same) - size + 1)):
            return True
    return False


def test_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = [r for r in docs if language._has_letter(r.text)]
    label = groups([r.text for r in kept])
    kept = [(r.doc_id, r.text) for k, r in enumerate(kept) if label[k] == k]
    items = [words(t) for _, t in benchmark]
    bad = {d for d, t in kept for x in [words(t)] if any(holds(x, y) for y in items)}
    want = {d: pii.masked(t, 0.5) for d, t in kept if d not in bad}
    got = {r.doc_id: r for r in C.run(spark, sf).collect()}
    assert set(got) == set(want) and bad and len(want) < len(docs)
    for d in [d for d in sorted(want)[::6] if len(want[d]) < 4000]:
        assert got[d].ids == best_ids(want[d], PIECES)
    assert all(r.round_trip for r in got.values())


def test_stages_keep_the_columns_and_the_edges(spark, sf, docs):
    text = " ".join(f"word{k} and the other" for k in range(30))
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    df = docs([text, text, None, "", "123 !", text + " x", "mail me@example.org or call", item, text, "the cat and the dog"], ids=[3, 1, 4, 5, 6, 7, 8, 9, 1, None],
              langs=["en"] * 5 + [None] * 5)
    stage = dict(C.STAGES)
    a = stage["language_id"](spark, df, sf)
    assert a.columns == df.columns and sorted(r.doc_id or 0 for r in a.collect()) == [0, 1, 1, 3, 7, 8, 9]
    assert a.where("lang is null").count() == 0
    b = stage["ngram_join"](spark, a, sf)
    assert b.columns == df.columns and sorted(r.doc_id or 0 for r in b.collect()) == [0, 1, 8, 9]
    c = stage["decontamination"](spark, b, sf)
    assert c.columns == df.columns and sorted(r.doc_id or 0 for r in c.collect()) == [0, 1, 8]
    d = stage["pii"](spark, c, sf)
    rows = {r.doc_id: r for r in d.collect()}
    assert d.columns == df.columns and rows[8].text == "mail <email> or call" and rows[8].n_chars == 20
    assert stage["sentencepiece"](spark, d, sf).count() == 3
    none = df.limit(0)
    for name, f in C.STAGES:
        none = f(spark, none, sf) if name != "sentencepiece" else none
        assert none.count() == 0
    assert C.STAGES[-1][1](spark, none, sf).count() == 0


def test_decontamination_tells_rows_with_null_ids_and_clashing_columns_apart(spark, sf, docs):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    df = docs([item, "the cat and the dog", "a clean text without an id", item], ids=[None, None, 5, 5]).selectExpr("*", "'x' AS hit", "'y' AS seed")
    kept = dict(C.STAGES)["decontamination"](spark, df, sf)
    assert kept.columns == df.columns and sorted(r.text for r in kept.collect()) == ["a clean text without an id", "the cat and the dog"]


def test_groups_keep_one_row_whatever_the_ids(spark, sf, docs):
    a, b = (" ".join(f"{w}{k}" for k in range(60)) for w in "ab")
    near = a.split()
    near[30] = "other"  # shares 51 of 61 five-word runs
    far = a.split()
    far[20] = far[40] = "other"  # shares 46 of 66
    stage = dict(C.STAGES)["ngram_join"]
    kept = stage(spark, docs([a, a, b, b], ids=[5, 7, 5, 3]), sf).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(3, b), (5, a)]
    kept = stage(spark, docs([" ".join(near), a, " ".join(far), a, b], ids=[9, 4, 6, None, None]), sf).collect()
    assert {(r.doc_id, r.text) for r in kept} == {(4, a), (6, " ".join(far)), (None, b)} and len(kept) == 3
