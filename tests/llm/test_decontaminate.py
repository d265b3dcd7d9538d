import random

import pytest

from promspark.llm import decontaminate as D
from promspark.llm import queries

ITEM_SCHEMA = "item_id bigint, text string, doc_id string"


def words(text):
    out, run = [], ""
    for c in (text or "") + " ":
        if c.isascii() and not c.isalnum():
            out += [run] if run else []
            run = ""
        else:
            run += c.lower()
    return out


def brute(docs, items, window=D.WINDOW, low=D.MIN_WORDS, similarity=D.SIMILARITY):
    """{(doc_id, item class)}: some window of the item matches one of the document; items of fewer than ``low``
    words match as a whole and exactly."""
    out, classes = set(), {}
    for i, t in sorted(items):
        classes.setdefault(tuple(words(t)), i)
    for d, text in docs:
        x = words(text)
        for y, i in classes.items():
            size = min(window, len(y))
            least = D.need(size, similarity) if len(y) >= low else size
            if y and any(sum(a == b for a, b in zip(x[p:p + size], y[q:q + size])) >= least
                         for p in range(len(x) - size + 1) for q in range(len(y) - size + 1)):
                out.add((d, i))
    return out


def test_random_substitutions_against_brute_force(spark, docs):
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(5, 30)))) for k in range(12)]
    texts = []
    for k in range(60):
        x = rng.choices(vocabulary, k=rng.randint(0, 40))
        own = rng.choice(items)[1].split()
        for p in rng.sample(range(len(own)), min(len(own), rng.randint(0, 6))):
            own[p] = "zz"
        at = rng.randint(0, len(x))
        texts.append(", ".join(x[:at]) + " " + " ".join(own).title() + ". " + "\n".join(x[at:]))
    frame = spark.createDataFrame([(i, t, "x") for i, t in items], ITEM_SCHEMA)
    got = D.find(docs(texts), frame).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(list(enumerate(texts)), items)
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})
    for r in got:
        assert r.equal_words >= D.need(min(D.WINDOW, r.item_words), D.SIMILARITY) and r.end_word <= len(words(texts[r.doc_id]))


@pytest.mark.parametrize("size", range(D.MIN_WORDS, D.WINDOW + 1))
def test_every_tolerated_substitution_keeps_a_seed(size):
    from itertools import combinations

    blocks = size - D.need(size, D.SIMILARITY) + 2
    masks = [{k for k in range(size) if k % blocks in pair} for pair in combinations(range(blocks), 2)]
    for e in combinations(range(size), size - D.need(size, D.SIMILARITY)):
        assert any(not m & set(e) for m in masks)


def test_edges(spark, docs):
    passage = " ".join(f"token{k}" for k in range(15))
    short = " ".join(f"short{k}" for k in range(9))
    items = spark.createDataFrame([(5, passage, "x"), (3, passage.upper(), "y"), (1, None, None), (2, "", ""), (4, "too few words", ""), (6, short, "z")], ITEM_SCHEMA)
    texts = [None, "", passage, passage, "a " * 300_000 + passage, short.replace("short4", "other"), "too few words", passage.replace("token3", "x").replace("token9", "y")]
    got = sorted(map(tuple, D.find(docs(texts, ids=[0, 1, 2, 2, 4, 5, 6, 7]), items).collect()))
    assert [r[:2] for r in got] == [(2, 3), (2, 3), (4, 3), (5, 6), (6, 4), (7, 3)]
    assert got[2][2] == 300_000 and got[4][2:] == (0, 3, 3, 3) and got[5][4] == 13
    assert sorted(map(tuple, D.item_classes(items).where("item_id in (3, 5)").collect())) == [(3, 3), (5, 3)]
    assert D.find(docs(texts).limit(0), items).count() == 0
    assert D.find(docs(texts), items.limit(0)).count() == 0


def test_query_over_whole_table(spark, sf):
    d = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    b = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in queries.op10_decontaminate(spark, sf).collect()}
    places = {}
    for i, t in b:  # brute force, restricted to documents that share 3 equal words in a row with the item
        w = words(t)
        for k in range(len(w) - 2):
            places.setdefault(tuple(w[k:k + 3]), set()).add(i)
    texts = dict(b)
    want = set()
    for i, t in d:
        w = words(t)
        near = set().union(*(places.get(tuple(w[k:k + 3]), ()) for k in range(len(w) - 2))) if w else set()
        want |= brute([(i, t)], [(j, texts[j]) for j in near])
    assert got == want and got


@pytest.mark.parametrize("size", range(1, D.MIN_WORDS))
def test_short_items_are_found_word_for_word(spark, docs, size):
    item = [f"short{k}" for k in range(size)]
    items = spark.createDataFrame([(1, " ".join(item), "x")], ITEM_SCHEMA)
    changed = item[:-1] + ["other"]
    texts = [" ".join(["before", *item, "after"]), " ".join(item), " ".join(changed), " ".join(item[:-1]), " ".join(changed + item + item)]
    got = sorted(map(tuple, D.find(docs(texts), items).collect()))
    assert got == [(0, 1, 1, size + 1, size, size), (1, 1, 0, size, size, size), (4, 1, size, 2 * size, size, size)]
