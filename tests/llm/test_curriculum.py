import hashlib
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from promspark.llm import curriculum, queries
from promspark.llm.oracles import OP11

from .duck import same


def brute_targets(sizes, weights, share, most):
    """Reshares the excess by weight until no source is above its cap."""
    target, open_ = {s: 0.0 for s in sizes}, {s for s in sizes if sizes[s]}
    left = share * sum(sizes.values())
    while open_ and left > 1e-9:
        w = sum(weights[s] for s in open_)
        for s in open_:
            target[s] += left * weights[s] / w
        left = sum(max(0.0, target[s] - most * sizes[s]) for s in open_)
        for s in [s for s in open_ if target[s] >= most * sizes[s]]:
            target[s] = most * sizes[s]
            open_.remove(s)
    return target


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, text string")


def corpus(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        source = "hot" if rng.random() < 0.35 else rng.choice(["a", "b", "Z", "ü", "", None])
        text = rng.choice([None, "", " \t\n"]) if rng.random() < 0.1 else " ".join(f"w{rng.randrange(99)}" for _ in range(rng.choice([1, 3, 20, 300])))
        rows.append((rng.choice([None, k, k % 7]), source, text))
    return rows + [(5, "b", "same row")] * 30 + [(None, "hot", "x " * 5000)]


@pytest.mark.parametrize("share, most", [(1.5, 2), (0.3, 1), (2.0, 2)])
def test_against_brute_force(spark, share, most):
    rows = corpus(3)
    got = curriculum.plan(table(spark, rows).repartition(5), share=share, most=most).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = {}
    for k, s, t in rows:
        by.setdefault(s, []).append((hashlib.md5(f"{'' if k is None else k}:{t or ''}".encode()).hexdigest(), k, size(t)))
    names = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    sizes = {s: sum(x[2] for x in by[s]) for s in names}
    want = brute_targets(sizes, weights, share, most)
    for s in names:
        mine = [r for r in got if r.source == s]
        assert all(abs(r.target - want[s]) < 1e-6 and r.source_size == sizes[s] for r in mine)
        assert sum(r.taken for r in mine) == int(want[s] + 1e-9) and all(r.taken <= most * r["size"] for r in mine)
        start, expect = 0, []
        for o, k, n in sorted(by[s], key=lambda x: (x[0], x[2])):
            expect.append((k is None, k or 0, n, sum(max(0, min(n, int(want[s] + 1e-9) - e * sizes[s] - start)) for e in range(most))))
            start += n
        assert sorted(expect) == sorted((r.doc_id is None, r.doc_id or 0, r["size"], r.taken) for r in mine)


def test_positions_invert_the_cumulative_demand(spark):
    plan = curriculum.plan(table(spark, corpus(8)))
    uses = curriculum.sequence(plan).collect()
    goals = {r.source: r.target for r in plan.select("source", "target").distinct().collect()}
    assert [u.position for u in uses] == sorted(u.position for u in uses)
    assert sum(u.words for u in uses) == plan.agg(F.sum("taken")).first()[0]
    names = sorted(goals, key=lambda s: (s is None, (s or "").encode()))
    knots = {s: curriculum.SCHEDULES[i % 3] for i, s in enumerate(names)}
    area = lambda s, p: knots[s][0][1] * p + (knots[s][1][1] - knots[s][0][1]) * p * p / 2
    done = dict.fromkeys(names, 0)
    by_source = {s: sorted((x for r in plan.collect() if r.source == s for x in r.uses), key=lambda x: x.progress) for s in names}
    for s in names:
        for u in by_source[s]:
            assert abs(goals[s] * area(s, u.progress) / area(s, 1.0) - done[s]) < 1e-6 * (1 + goals[s])
            assert abs(u.position - sum(goals[x] * area(x, u.progress) / area(x, 1.0) for x in names)) < 1e-6 * sum(goals.values())
            done[s] += u.words


def test_more_pieces_and_zero_weights(spark):
    knots = ((0.0, 0.0), (0.25, 4.0), (0.5, 0.0), (0.75, 0.0), (1.0, 8.0))
    assert abs(curriculum.weight(knots) - 2.0) < 1e-12
    rows = [(k, "s", "a b c") for k in range(100)]
    at = [u.progress for r in curriculum.plan(table(spark, rows), schedules=[knots], share=1.0, most=1).collect() for u in r.uses]
    assert len(at) == 100 and sum(p <= 0.5 for p in at) == 50 and not any(0.5 < p < 0.75 for p in at)
    with pytest.raises(ValueError):
        curriculum.segments(((0.0, 1.0), (0.5, 1.0)))


def test_edges_and_reruns(spark):
    empty = table(spark, [])
    assert curriculum.digest(curriculum.plan(empty)).count() == 0
    blank = table(spark, [(1, "a", None), (None, None, "")])
    assert [(r.target, r.taken) for r in curriculum.plan(blank).collect()] == [(0.0, 0), (0.0, 0)]
    clash = table(spark, corpus(4)).withColumns({c: F.lit("x") for c in ("size", "target", "order", "lane", "before", "uses", "n_chars", "number", "one")})
    rows = [sorted(map(repr, curriculum.digest(curriculum.plan(d)).collect())) for d in (clash, clash.repartition(9), clash.coalesce(1))]
    assert rows[0] == rows[1] == rows[2]


def test_whole_table_against_sql(spark, sf):
    assert same(queries.op11_curriculum(spark, sf), OP11, sf)


def test_sql_handles_the_edges(spark, tmp_path):
    rows = [r for r in dict.fromkeys(corpus(5))]
    docs = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "source": [r[1] for r in rows], "text": [r[2] for r in rows]})
    import pyarrow.parquet as pq
    pq.write_table(docs, tmp_path / "documents.parquet")
    assert same(queries.op11_curriculum(spark, str(tmp_path)), OP11, str(tmp_path))
