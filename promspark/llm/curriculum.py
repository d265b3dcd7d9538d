"""Operator 11: a mix of sources whose weights change over the training run, DataFrame functions only.

Each source has a weight schedule over the progress p of the run (0 to 1), linear between knots.  Its
integral is the source's weight; the weights share the mix, and no source is read more than ``most`` times.

1. Sizes of documents (words) are summed by source; ``targets`` shares ``share`` times all words by weight,
   stops each source at ``most`` times its size, and shares the excess again until none is above.
2. The words of a source are laid end to end in the order of a hash of the document, as often as the target
   asks for; a running sum over ranges gives the words before each document.
3. The source's demand up to p is its target times the integral of its schedule up to p.  Its inverse at
   the words before a document is the progress at which the document is read; the demand of all sources
   up to there is its position in the sequence, in words.
4. ``sequence`` range-sorts the uses by position.

Rules: words are runs of anything but 0x20 and 0x09-0x0D.  Sources are numbered by code point, null last,
and take the schedules in turn.  The mix of a source ends exactly at its target (rounded down): the document
that crosses it is cut there.  Null and empty texts have size 0 and are never taken.  Rows with the same key
and text are interchangeable; rows with a null key are told apart by their text.  A table without words has
targets of 0.  Extra columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.running import running_sums
from .common import written

#: (progress, weight) knots; the integrals are 5, 2 and 1.
SCHEDULES = (((0.0, 7.5), (1.0, 2.5)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 0.5), (1.0, 1.5)))
SHARE, MOST = 1.5, 2


def segments(knots: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float]]:
    """(progress, weight, slope, integral before) of each linear piece; the knots must run from 0 to 1."""
    if len(knots) < 2 or knots[0][0] != 0 or knots[-1][0] != 1 or min(w for _, w in knots) < 0:
        raise ValueError("a schedule runs from progress 0 to 1 with weights of 0 and more")
    out, area = [], 0.0
    for (p0, w0), (p1, w1) in zip(knots, knots[1:]):
        if p1 <= p0:
            raise ValueError("the progress of a schedule grows")
        out.append((p0, w0, (w1 - w0) / (p1 - p0), area))
        area += (p1 - p0) * (w0 + w1) / 2
    return out


def weight(knots: Sequence[tuple[float, float]]) -> float:
    """The integral of a schedule."""
    return sum((p1 - p0) * (w0 + w1) / 2 for (p0, w0), (p1, w1) in zip(knots, knots[1:]))


def _pieces(schedules, number: Column) -> Column:
    """The pieces of the schedule that a source of this number takes."""
    each = [F.array(*[F.struct(*(F.lit(float(x)).alias(n) for x, n in zip(s, ("p", "w", "slope", "area")))) for s in segments(k)]) for k in schedules]
    return F.get(F.array(*each), (number % len(schedules)).cast("int"))


def _progress(pieces: Column, area: Column) -> Column:
    """Where the integral of a schedule reaches ``area``."""
    def inside(s: Column) -> Column:
        d = area - s["area"]
        root = s["w"] + F.sqrt(F.greatest(s["w"] * s["w"] + 2 * s["slope"] * d, F.lit(0.0)))
        return F.when(d > 0, s["p"] + 2 * d / root).otherwise(s["p"])

    reached = F.filter(pieces, lambda s: s["area"] <= area)
    return F.get(F.transform(F.slice(reached, -1, 1), inside), 0)


def _integral(knots, progress: Column) -> Column:
    """The integral of a schedule up to ``progress``."""
    out = F.lit(0.0)
    for p, w, slope, area in segments(knots):
        d = progress - p
        out = F.when(d >= 0, area + w * d + slope / 2 * d * d).otherwise(out)
    return out


def targets(sizes: DataFrame, schedules=SCHEDULES, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, number, weight, target) from a table (source, size) of documents."""
    per = written(sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("last", F.col("source").isNull()))
    numbered = running_sums(per.withColumn("one", F.lit(1)), ["last", "source"], {"one": "number"}).drop("one", "last")
    weights = F.get(F.array(*[F.lit(weight(k)) for k in schedules]), (F.col("number") % len(schedules)).cast("int"))
    caps = numbered.withColumn("weight", weights).withColumn("cap", F.col("source_size") * most)
    caps = written(caps.withColumn("ratio", F.col("cap") / F.col("weight")))
    total = caps.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    words, all_weight = float(total["words"] or 0) * share, total["weight"] or 0.0
    # with the sources of lower ratio stopped, the others share what is left
    level = (F.lit(words) - F.col("cap_before")) / (F.lit(all_weight) - F.col("weight_before"))
    filled = running_sums(caps, ["ratio", "number"], {"cap": "cap_before", "weight": "weight_before"}).withColumn("level", level)
    least = filled.where(F.col("level") * F.col("weight") <= F.col("cap")).agg(F.min_by("level", F.struct("ratio", "number"))).first()[0]
    cap = F.col("cap").cast("double")
    target = cap if least is None else F.least(cap, F.lit(least) * F.col("weight"))
    return caps.select("source", "source_size", "number", "weight", target.alias("target"))


def plan(docs: DataFrame, schedules=SCHEDULES, share: float = SHARE, most: int = MOST, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Per document: key, source, size, source_size, target, taken (words, repeats counted), and ``uses``, one
    (pass, words, progress, position) per pass that reads words of it."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    name = F.concat(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), F.lit(":"), body)
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"), F.md5(name).alias("order"),
                       F.spark_partition_id().alias("lane"), F.regexp_count(body, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"))
    # lane: equal rows of several files may lie in several ranges.  Written first: the range bounds are sampled
    # from these narrow rows, and the texts are read once
    rows = written(running_sums(written(rows), ["order", "lane"], {"size": "before"}, ["source"]))
    goals = written(targets(rows, schedules, share, most))
    demand = goals.groupBy((F.col("number") % len(schedules)).alias("k")).agg(F.sum("target").alias("t")).collect()
    goals = goals.withColumnRenamed("source", "from")
    rows = rows.join(goals, F.col("source").eqNullSafe(F.col("from"))).drop("from")
    budget = F.floor("target")

    def use(k: int) -> Column:
        start = F.col("before") + k * F.col("source_size")
        words = F.greatest(F.lit(0), F.least(F.col("size"), budget - start)).cast("long")
        return F.struct(F.lit(k + 1).alias("pass"), words.alias("words"), _progress(F.col("pieces"), start / F.col("target") * F.col("weight")).alias("progress"))

    def placed(u: Column) -> Column:
        at = sum((F.lit(r["t"] / weight(schedules[r["k"]])) * _integral(schedules[r["k"]], u["progress"]) for r in demand if r["t"] > 0), F.lit(0.0))
        return F.struct(u["pass"].alias("pass"), u["words"].alias("words"), u["progress"].alias("progress"), at.alias("position"))

    rows = rows.withColumn("pieces", _pieces(schedules, F.col("number")))
    uses = F.when(F.col("target") > 0, F.filter(F.array(*[use(k) for k in range(most)]), lambda u: u["words"] > 0))
    rows = rows.withColumn("uses", F.transform(F.coalesce(uses, F.array().cast("array<struct<pass int, words bigint, progress double>>")), placed))
    taken = F.aggregate("uses", F.lit(0).cast("long"), lambda a, u: a + u["words"])
    return rows.select("key", "source", "size", "source_size", "target", taken.alias("taken"), "uses", "order", "lane").withColumnRenamed("key", key)


def sequence(planned: DataFrame, key: str = "doc_id") -> DataFrame:
    """(position, key, source, pass, words) of every use, range-sorted by position."""
    uses = planned.select(F.explode("uses").alias("u"), key, "source", "order", "lane")
    return uses.select("u.position", key, "source", "u.pass", "u.words", "order", "lane").orderBy("position", "order", "lane").drop("order", "lane")


def digest(planned: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document, range-sorted by the position of its first use (documents that are not used come first)."""
    at = [F.get("uses", k)["progress"].alias(n) for k, n in enumerate(("first_at", "second_at"))]
    rows = written(planned.select(key, "size", "source_size", "target", "taken", *at, "order", "lane"))
    return rows.orderBy("first_at", "order", "lane").drop("order", "lane")
