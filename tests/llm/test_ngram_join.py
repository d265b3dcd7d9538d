import random
import re

import numpy as np
import pyarrow as pa
import pytest

from promspark.llm import components, ngram_join, queries
from promspark.llm.oracles import OP9
from promspark.llm.words import SPACE_WORDS, chunks

from .duck import same


def shingles(text, n=3):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def brute(texts, percent=90):
    """(size, component) by all pairs."""
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            m = min(label[i], label[j])
            changed |= label[i] != m or label[j] != m
            label[i] = label[j] = m
    return [(len(s), c) for s, c in zip(sets, label)]


def family(rng, size, members, edits, vocabulary):
    base = rng.choices(vocabulary, k=size)
    out = []
    for _ in range(members):
        x = list(base)
        for _ in range(rng.randint(0, edits)):
            x[rng.randrange(len(x))] = rng.choice(vocabulary)
        out.append(" ".join(x))
    return out


@pytest.mark.parametrize("seed,small,block", [(1, 24, 64), (2, 2, 4), (3, 3, 1)])
def test_components_against_all_pairs(spark, docs, monkeypatch, seed, small, block):
    """Families of near copies around the threshold, long and short lists, frequent elements."""
    monkeypatch.setattr(ngram_join, "SMALL_LIST", small)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "LEAST_COUNT", 4)
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(500)]
    texts = [None, "", "one", "one two", "One  TWO", "a b c", "é à É"]
    for size, members, edits in ((40, 30, 2), (60, 60, 3), (100, 40, 4), (200, 20, 10), (8, 10, 1), (3, 4, 1)):
        texts += family(rng, size, members, edits, vocabulary)
    line = " ".join(rng.choices(vocabulary, k=12))
    texts += [line + " " + " ".join(rng.choices(vocabulary, k=rng.randint(1, 30))) for _ in range(60)]
    rng.shuffle(texts)
    got = sorted(map(tuple, ngram_join.join(docs(texts).withColumnRenamed("lang", "n").withColumnRenamed("source", "label")).collect()))
    assert [r[1:] for r in got] == brute(texts)


def test_group_in_parts_makes_few_pairs(spark, docs, monkeypatch):
    """Where the first answers leave a group of near copies in parts, not all pairs between them are made."""
    rng = random.Random(5)
    texts = family(rng, 400, 160, 3, [f"w{k}" for k in range(3000)])
    pairs, links, whole = [], ngram_join._links, ngram_join.components

    def counted(found, *rest):
        pairs.append(found.count())
        return links(found, *rest)

    def parts(edges):
        if len(pairs) == 1:
            edges = edges.where("pmod(xxhash64(a), 2) = pmod(xxhash64(b), 2)")
        return whole(edges)

    monkeypatch.setattr(ngram_join, "_links", counted)
    monkeypatch.setattr(ngram_join, "components", parts)
    got = sorted(map(tuple, ngram_join.join(docs(texts)).collect()))
    assert [r[1:] for r in got] == brute(texts)
    assert sum(pairs) < 6 * len(texts), pairs


def test_later_readings_take_open_lists_only(spark, docs, monkeypatch):
    """Lists without a possible pair, or of one component, are not made again for sets that stand in other lists."""
    rng = random.Random(6)
    texts = [t for k in range(40) for t in family(rng, 120, 5, 1, [f"w{k}_{i}" for i in range(400)])]
    read, plain = [], ngram_join._list_table

    def counted(rows):
        out = plain(rows)
        read.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "_list_table", counted)
    got = sorted(map(tuple, ngram_join.join(docs(texts)).collect()))
    assert [r[1:] for r in got] == brute(texts)
    assert len(read) > 1 and max(read[1:]) < read[0] / 4, read


def test_closest_pair_of_two_components(spark):
    """A list of two components gives a pair each, of the least difference, whatever the list's length."""
    for size in (6, 60):
        k = np.arange(size)
        columns = [np.zeros(size, np.int64), k, np.full(size, 100 << 32), k % 2, np.where(k < size - 2, (1 << (k % 3 + k % 2)) - 1, 0)]
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "sid", "np", "label", "b0"])
        rows = [r for b in ngram_join._list_pairs(80, True, True)(iter([batch])) for r in zip(*(c.to_pylist() for c in b.columns))]
        assert 0 < len(rows) <= 2 and all(columns[4][a] == columns[4][b] and (a + b) % 2 for a, b in rows)


def test_whole_table_against_sql(spark, sf):
    assert same(queries.op9_ngram_join(spark, sf), OP9, sf)


def test_list_borders_between_batches(spark, docs):
    """The pairs do not depend on how the rows of a partition are cut into batches."""
    rng = np.random.default_rng(1)
    token = np.sort(rng.integers(0, 40, 3000))
    n = np.array([x for t in np.unique(token) for x in np.sort(rng.integers(5, 9, (token == t).sum()))])
    columns = [token, np.arange(3000), (n << 32) + rng.integers(0, 2, 3000), np.zeros(3000, np.int64), np.zeros(3000, np.int64), np.arange(3000)]
    names = ["token", "sid", "np", "b0", "b1", "label"]

    def run(cut, every):
        batches = [pa.RecordBatch.from_arrays([pa.array(c[a:a + cut]) for c in columns], names=names) for a in range(0, 3000, cut)]
        return {r for b in ngram_join._list_pairs(90, every)(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns))}

    assert run(7, True) == run(3000, True) and run(7, False) == run(3000, False)
    seen = ngram_join.Lists(columns, 90)
    i, j = np.meshgrid(np.arange(3000), np.arange(3000), indexing="ij")
    ok = (i > j) & (token[i] == token[j])
    ok[ok] = seen.may_link(i[ok], j[ok])
    assert run(3000, True) == {(int(b), int(a)) for a, b in zip(*np.nonzero(ok))}


def test_edges(spark, docs):
    texts = ["x y z " * 100_000, "x y z " * 100_000, None, "", "q", "q"]
    got = sorted(map(tuple, ngram_join.join(docs(texts, ids=[5, 3, 1, 2, 8, 8])).collect()))
    assert got == [(1, 0, 1), (2, 0, 2), (3, 3, 3), (5, 3, 3), (8, 1, 8), (8, 1, 8)]
    assert ngram_join.join(docs(texts).limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    rng = random.Random(2)
    nodes = list(range(200))
    rng.shuffle(nodes)
    edges = spark.createDataFrame(list(zip(nodes[:150], nodes[1:151])), "a bigint, b bigint")
    got = {r.node: r.label for r in components.components(edges).collect()}
    assert set(got.values()) == {min(nodes[:151])} and len(got) == 151


def test_components_read_long_paths_a_few_times(spark, monkeypatch):
    """A chain of near copies: the rounds shrink, all together write a few times the edges; other shapes too."""
    rng = random.Random(3)
    nodes = list(range(2000))
    rng.shuffle(nodes)
    edges = list(zip(nodes, nodes[1:])) + [(5000 + k % 7, 6000 + k) for k in range(300)] + [(9001, 9000), (9000, 9001), (9100, 9100)]
    rows, plain = [], components.written

    def counted(df):
        out = plain(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(components, "written", counted)
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {x: 0 for x in nodes} | {9000: 9000, 9001: 9000, 9100: 9100}
    want |= {5000 + k: 5000 + k for k in range(7)} | {6000 + k: 5000 + k % 7 for k in range(300)}
    assert got == want and sum(rows) < 12 * len(edges)


def test_row_sets_are_distinct_and_sorted():
    w = next(chunks(pa.array(["a b c a b c", "", "a", "a b", "x y z"]), SPACE_WORDS))
    flat, offsets = ngram_join.row_sets(w, 3)
    assert np.diff(offsets).tolist() == [3, 0, 1, 1, 1] and all(np.all(np.diff(flat[a:b].astype(object)) > 0) for a, b in zip(offsets, offsets[1:]))


def test_without_drops_exactly_the_given_keys(spark, docs):
    from promspark.llm.bloom import without
    df = docs([f"t{k}" for k in range(3000)] + ["null"] * 2, ids=[*range(3000), None, None])
    gone = spark.range(0, 6000, 7).withColumnRenamed("id", "doc_id")
    got = [r.doc_id for r in without(df, "doc_id", gone).collect()]
    assert sorted(k for k in got if k is not None) == [k for k in range(3000) if k % 7] and got.count(None) == 2
    assert without(df, "doc_id", gone.limit(0)).count() == 3002 and without(df.limit(0), "doc_id", gone).count() == 0
