import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from promspark.llm import lexical_search, queries
from promspark.llm.oracles import OP13

from .duck import same

TERMS = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERMS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=20):
    """(item, rank, key, score) by the definition of the score."""
    each = [(k, terms(t)) for k, t in docs if terms(t)]
    n_docs, length = len(each), sum(len(t) for _, t in each)
    df = Counter(x for _, t in each for x in set(t))
    out = []
    for item, text in items:
        scored = []
        for k, t in each:
            tf, m = Counter(t), 75 + (25 * len(t) * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((10 ** 9 * tf[x]) // (1000 * tf[x] + 12 * m)) for x in terms(text) if tf[x])
            if s > 0:
                scored.append((-s, k is None, k or 0))
        out += [(item, r, None if none else k, -s) for r, (s, none, k) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


def corpus(seed, n=300, words=60):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "The", "of"]) if rng.random() < 0.3 else f"w{min(int(rng.expovariate(0.08)), words)}"
    docs = [(k, " ".join(word() for _ in range(rng.choice([0, 1, 5, 40, 200])))) for k in range(n)]
    return docs + [(n + k, "copy of the W3, w3 w4!") for k in range(40)], [(k, " ".join(word() for _ in range(rng.choice([1, 4, 30])))) for k in range(25)]


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")


def rows(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block, short, group", [(4096, 256, 1 << 18), (128, 8, 1 << 18), (64, 0, 40), (100, 10_000, 1)])
def test_against_brute_force(spark, block, short, group):
    docs, items = corpus(5)
    d, q = frames(spark, docs, items)
    for part in (d.coalesce(1), d.repartition(6)):
        assert rows(lexical_search.search(part, q, block=block, short=short, group_terms=group)) == brute(docs, items)


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "Ärger ÄRGER ärger"), (None, "zoo zoo"), (None, "zoo zoo"), (7, "zoo zoo"), (7, "zoo zoo"), (8, "a" * 70_000 + " zoo"), (9, "日本 x-y_z 9"), (10, "!?;")]
    items = [(1, "zoo"), (1, "Zoo zoo"), (None, "ÄRGER"), (2, None), (3, " . "), (4, "y z 日本"), (5, "a" * 70_000), (6, "absent"), (7, "zoo " * 3000)]
    d, q = frames(spark, docs, items)
    d = d.withColumns({c: F.lit("x") for c in ("key", "n", "terms", "tf", "score", "item", "rank")})
    q = q.withColumns({c: F.lit("x") for c in ("item", "id", "doc_id", "score", "terms")})
    assert rows(lexical_search.search(d, q)) == brute(docs, items)
    assert lexical_search.search(d.limit(0), q).count() == 0 and lexical_search.search(d, q.limit(0)).count() == 0
    assert lexical_search.search(d.where("doc_id = 10"), q).count() == 0


def test_skipping_drops_ranges_but_no_document():
    rng = np.random.default_rng(2)
    n, vocabulary = 4096, 30
    cells = np.unique(rng.integers(0, n * vocabulary, 40_000))
    docs, ts = cells // vocabulary, cells % vocabulary
    drop = rng.random(len(ts)) < ts / vocabulary  # later terms have shorter lists
    docs, ts = docs[~drop], ts[~drop]
    lists = lexical_search.Lists(rng.integers(30, 60, n), docs, ts, rng.integers(1, 9, len(ts)), np.arange(1, vocabulary + 1) * 10, (n, n * 45))
    item = (np.array([0, 3, 11, 25, 29]), np.array([1, 1, 2, 1, 3]))
    at, scores = lexical_search.scan(lists, item, 1)
    full = np.zeros(n, np.int64)
    for t, k in zip(*item):
        d, v = lists.of(t)
        full[d] += k * v
    assert (np.flatnonzero(full) == at).all() and (full[at] == scores).all()
    for least in np.sort(full)[[-2000, -200, -20, -1]]:
        some, s = lexical_search.scan(lists, item, int(least))
        assert (some == np.flatnonzero(full >= least)).all() and (s == full[some]).all()
    assert len(lexical_search.scan(lists, item, int(full.max()) + 1)[0]) == 0


def test_whole_table_against_sql(spark, sf):
    assert same(queries.op13_lexical_search(spark, sf), OP13, sf)
