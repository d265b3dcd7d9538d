import random

import numpy as np
import pyarrow as pa
import pytest

from promspark.llm import passages as P
from promspark.llm import queries
from promspark.llm.words import LETTER_WORDS, chunks

from .test_decontaminate import words


#: Words at the two ends of a stretch that hold no whole window of seeds; they are found by extension
#: along the one text that a seed is matched with, which may end there.
ENDS = 2 * (P.K + P.WINDOW - 2)


def covered(texts, least=P.LEAST):
    """{doc: places} in exact runs of ``least`` words that another document has too."""
    seen, out = {}, {}
    split = [words(t) for t in texts]
    for d, w in enumerate(split):
        for i in range(len(w) - least + 1):
            seen.setdefault(tuple(w[i:i + least]), []).append((d, i))
    for places in seen.values():
        if len({d for d, _ in places}) > 1:
            for d, i in places:
                out.setdefault(d, set()).update(range(i, i + least))
    return out


def found(rows):
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    return out


def text(rng, vocabulary, n):
    return rng.choices(vocabulary, k=n)


@pytest.mark.parametrize("seed,often,block", [(1, 32, 1 << 20), (2, 3, 300)])
def test_planted_passages(spark, docs, monkeypatch, seed, often, block):
    monkeypatch.setattr(P, "FREQUENT", often)
    monkeypatch.setattr(P, "BLOCK_SEEDS", block)
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    shared = [text(rng, vocabulary, n) for n in (53, 60, 120, 200)]
    bodies, planted = [], {}
    for d in range(80):
        body = text(rng, vocabulary, rng.randint(0, 150))
        if d % 2:
            p = list(shared[d // 2 % 4])
            for _ in range(len(p) // 25 * (d % 3)):  # up to two edits in 25 words, of three kinds
                at = rng.randrange(1, len(p) - 1)
                kind = rng.randrange(3)
                p[at:at + (kind != 1)] = [] if kind == 0 else [rng.choice(vocabulary)]
            at = rng.randint(0, len(body))
            planted[d] = (at, at + len(p))
            body = body[:at] + p + body[at:]
        bodies.append(" ".join(body).capitalize() + ".")
    got = found(P.find(docs(bodies)).collect())
    lost = set(planted) - set(got)  # two texts with an edit in 12 words each may share too few seeds
    assert set(got) <= set(planted) and all(d % 3 == 2 for d in lost) and len(lost) <= 2
    for d in got:
        a, b = planted[d]
        inside = len(got[d] & set(range(a, b)))
        # an edit near an end may cut off up to a window of words there
        assert inside >= (0.5 * (b - a) if d % 3 == 2 else b - a - 2 * P.WINDOW) and len(got[d]) <= inside + 8
    for d, places in covered(bodies).items():
        assert len(places - got[d]) <= ENDS


def test_whole_table_has_every_exact_repeat(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    ids = [r.doc_id for r in rows]
    got = found(queries.op1_passages(spark, sf).collect())
    want = covered([r.text for r in rows])
    assert want and all(len(places - got.get(ids[d], set())) <= ENDS for d, places in want.items())
    lost = sum(len(places - got.get(ids[d], set())) for d, places in want.items())
    assert lost <= 0.01 * sum(map(len, want.values()))


def test_chains_against_all_orders():
    """The best chain has the score of a dynamic program over all pairs of segments."""
    rng = np.random.default_rng(4)
    for _ in range(60):
        parts = np.stack([rng.integers(0, 60, 12), rng.integers(0, 60, 12), rng.integers(5, 12, 12)], axis=1)
        order = parts[np.lexsort((parts[:, 1], parts[:, 0]))].tolist()
        score = []
        for s, (i, j, n) in enumerate(order):
            best = max([score[t] - P.GAP_COST * (i - a - m + j - b - m) for t, (a, b, m) in enumerate(order[:s]) if a + m <= i and b + m <= j], default=0)
            score.append(n + max(best, 0))
        monkey, P.LARGEST_GAP = P.LARGEST_GAP, 10 ** 6
        try:
            got = parts[P.chains(parts)[0]].tolist()
        finally:
            P.LARGEST_GAP = monkey
        total = sum(n for _, _, n in got) - sum(P.GAP_COST * (c[0] - a[0] - a[2] + c[1] - a[1] - a[2]) for a, c in zip(got, got[1:]))
        assert total == pytest.approx(max(score))


def plain_ends(a, b):
    i = j = same = 0
    while True:
        while i < len(a) and j < len(b) and a[i] == b[j]:
            i, j, same = i + 1, j + 1, same + 1
        for s, t in P.SKIPS:
            if a[i + s:i + s + 3] == b[j + t:j + t + 3] and len(a[i + s:i + s + 3]) == 3:
                i, j = i + s, j + t
                break
        else:
            return i, j, same


def test_ends_of_many_chains_at_once():
    """All ends of a batch in one call, as one by one; lists of other lengths, backwards too."""
    rng = random.Random(8)
    pairs = []
    for _ in range(300):
        a = rng.choices(range(50), k=rng.randint(0, 24))
        b = [x for x in a if rng.random() > 0.08]
        pairs.append((a, [rng.randrange(50) if rng.random() < 0.08 else x for x in b] + rng.choices(range(50), k=rng.randint(0, 3))))
    flat = [(np.append(0, np.cumsum([len(p[k]) for p in pairs])), np.array([x for p in pairs for x in p[k]], np.int32)) for k in (0, 1)]
    for step in (1, -1):
        rows = [P._stretch(o, v, np.zeros(300, np.int64) if step > 0 else np.diff(o) - 1, np.diff(o), step, none) for (o, v), none in zip(flat, (-1 << 40, -2 << 40))]
        assert list(zip(*(c.tolist() for c in P.extended(*rows)))) == [plain_ends(a[::step], b[::step]) for a, b in pairs]


def test_chains_of_pairs_come_as_lists():
    """Pairs of one segment, of several on one diagonal, and of two chains."""
    x, y, i, j = zip(*[(1, 2, 5, 9), (1, 3, 0, 0), (1, 3, 4, 4), (1, 3, 40, 42), (2, 3, 0, 500), (2, 3, 400, 0)])
    batch = pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(i, pa.int32()), pa.array(j, pa.int32())], names=["x", "y", "i", "j"])
    got = [tuple(map(str, r.values())) for b in P._chained(iter([batch])) for r in b.to_pylist()]
    assert sorted(got) == sorted([("1", "2", "[5]", "[9]", "[5]"), ("1", "3", "[0]", "[0]", "[9]"), ("1", "3", "[40]", "[42]", "[5]"), ("2", "3", "[0]", "[500]", "[5]"), ("2", "3", "[400]", "[0]", "[5]")])


def test_minimizers_of_a_shared_stretch_are_shared():
    rng = random.Random(0)
    for _ in range(50):
        run = [f"s{rng.randrange(50)}" for _ in range(P.K + P.WINDOW - 1)]
        texts = [" ".join([f"x{rng.randrange(50)}" for _ in range(rng.randrange(20))] + run + [f"y{rng.randrange(50)}" for _ in range(rng.randrange(20))]) for _ in range(2)]
        seeds = [set(P.minimizers(next(chunks(pa.array([t]), LETTER_WORDS)))[0].tolist()) for t in texts]
        assert seeds[0] & seeds[1]


def test_edges(spark, docs):
    rng = random.Random(9)
    long = " ".join(text(rng, [f"v{k}" for k in range(9000)], 20_000))
    alone = " ".join(["one", "two", "three"] * 50)
    texts = [None, "", "short text", "short text", long, long, long + " end", alone, "x " * 30]
    got = {r.doc_id: r for r in P.find(docs(texts, ids=[0, 1, 2, 3, 4, 5, 6, 7, 8]).withColumnRenamed("lang", "text_")).collect()}
    assert set(got) == {4, 5, 6} and all(r.start_word == 0 and r.end_word >= 20_000 for r in got.values())
    assert P.find(docs(texts).limit(0)).count() == 0


@pytest.mark.parametrize("repeats", [1, 40])
def test_frequent_seeds_of_one_block_meet_other_blocks(spark, tmp_path, repeats):
    """A line of 40 texts of one block, or 40 times in one text of it, and once in another block."""
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(9000)]
    line = text(rng, vocabulary, 60)
    hot = [[*text(rng, vocabulary, 30), *line] for _ in range(40)] if repeats == 1 else [[w for _ in range(repeats) for w in [*text(rng, vocabulary, 9), *line]]]
    rows = [(k, " ".join(w)) for k, w in enumerate([*hot, text(rng, vocabulary, 30) + line])]
    for name, part in (("a", rows[:-1]), ("b", rows[-1:])):
        spark.createDataFrame(part, "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/{name}")
    both = spark.read.parquet(f"{tmp_path}/a").union(spark.read.parquet(f"{tmp_path}/b"))
    assert both.rdd.getNumPartitions() == 2
    got, want = found(P.find(both).collect()), covered([t for _, t in rows])
    assert set(got) == set(want) == {k for k, _ in rows}
    assert all(len(places - got[d]) <= ENDS * repeats for d, places in want.items())


def test_recall_of_short_fuzzy_passages(spark, docs):
    """Passages of 60 words in two texts, with a substitution in every 6, 7, 8 or 10 words of one of them."""
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(30_000)]
    bodies, steps = [], (6, 7, 8, 10)
    for step in steps:
        for _ in range(60):
            line = text(rng, vocabulary, 60)
            for copy in (line, [f"x{rng.random()}"[2:] if k % step == step - 1 else w for k, w in enumerate(line)]):
                bodies.append(" ".join(text(rng, vocabulary, 30) + copy + text(rng, vocabulary, 30)))
    got = found(P.find(docs(bodies)).collect())
    for k, step in enumerate(steps):
        both = [len(got.get(d, set()) & set(range(30, 90))) for d in range(120 * k, 120 * k + 120)]
        share = sum(n >= P.LEAST for n in both) / len(both)
        print(f"likeness {1 - 1 / step:.3f}: {share:.3f}")
        assert share >= 0.95
