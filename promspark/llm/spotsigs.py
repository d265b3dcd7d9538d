"""Operator 2: SpotSigs document fingerprints, DataFrame functions only.

Each occurrence of a common word (an anchor) opens a chain of the next
``length`` content words, ``distance`` apart; anchor and chain are one spot
signature.  The set of a text's signatures is its fingerprint, two texts are
as alike as their sets (Jaccard).

``near_duplicates`` finds the pairs at or over a threshold.  Sets are split
into length ranges whose bounds grow by 1/threshold, so a set only meets sets
of its own and the next range; within a range an inverted index on the rarest
signatures proposes pairs (sets at the threshold must share one of them), and
the length ratio prunes them before the sets are compared.

Rules: words are runs of letters and digits in lower case.  A text without a
signature (no anchor, or no content words after it) has one signature, its
whole word sequence; a text without words, empty or null, has the empty set,
which is 1 alike to another empty set and 0 to others.  Equal texts have
equal fingerprints.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .common import written

# fixed values: common words of four languages
ANCHORS = (
    "the of and to a in is that it was for on are as with he be by at this had but from they which or we an were you not have "
    "der die das und zu den von mit sich des auf für ist im dem nicht ein eine als auch "
    "le la les des et à un une du en que qui dans pour par sur au ne pas "
    "el los las de y que un una del en por con para su no se al lo"
).split()
ANCHORS = tuple(dict.fromkeys(ANCHORS))
DISTANCE, LENGTH, THRESHOLD = 1, 2, 0.8
WORD_BREAK = r"[^\p{L}\p{N}]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.get(F.transform(F.array(value), body), 0)


def signatures(text: Column, distance: int = DISTANCE, length: int = LENGTH) -> Column:
    """The sorted distinct spot signatures of a text, as strings: anchor and chain joined by spaces."""
    def anchor(word: Column) -> Column:
        return word.isin(*ANCHORS)

    def of_words(words: Column) -> Column:
        places = F.filter(F.transform(words, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: anchor(s["x"]))

        def spots(content: Column) -> Column:
            def spot(s: Column, rank: Column) -> Column:  # the anchor has i - rank content words before it
                chain = [F.get(content, s["i"] - rank + (k + 1) * distance - 1) for k in range(length)]
                return F.concat(s["x"], *(p for c in chain for p in (F.lit(" "), c)))

            return F.filter(F.transform(places, spot), F.isnotnull)

        found = let(F.filter(words, lambda x: ~anchor(x)), spots)
        whole = F.when(F.size(words) > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))
        return let(F.array_sort(F.array_distinct(found)), lambda f: F.when(F.size(f) > 0, f).otherwise(whole))

    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_BREAK), lambda x: x != "")
    return let(words, of_words)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two signature sets; 1 for two empty sets."""
    return let(F.size(F.array_intersect(a, b)), lambda both: F.when(
        F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both)))


def fingerprint(sigs: Column) -> Column:
    return F.array_join(sigs, "|")


def fingerprints(df: DataFrame, text: str = "text", out: str = "signatures") -> DataFrame:
    """``df`` with the signature set of each text; a column named ``out`` is replaced."""
    return df.withColumn(out, signatures(F.col(f"`{text}`")))


def in_order(df: DataFrame, key: str, groups: int | None = None) -> tuple[DataFrame, WindowSpec]:
    """Rows in descending order of an integer key (null keys last, equal keys by hash of the row), and
    the window in which ``lead`` finds the row that follows; after the last row comes the first.

    Rows go to groups of neighbouring keys, and each group is sorted on its own; the first row of the
    group that follows is added to it as a last row, marked ``added``: drop those rows when done.  To
    the driver come the bounds and one key per group."""
    spark = df.sparkSession
    groups = groups or 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.coalesce(F.col(key), F.lit(-(1 << 63)))
    keys = df.select(order.alias("order"))
    shares = F.array(*[F.lit(k / groups) for k in range(1, groups)])
    bounds = sorted(set((keys.agg(F.percentile_approx("order", shares, F.lit(100 * groups))).first()[0] or []) if groups > 1 else []))
    group = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("order"))) if bounds else F.lit(0)
    first = {r[0]: r[1] for r in keys.groupBy(group.alias("group")).agg(F.max("order")).collect()}
    rows = df.withColumn("order", order).withColumn("tie", F.xxhash64(*df.columns)).withColumn("group", group).withColumn("added", F.lit(False))
    window = Window.partitionBy("group").orderBy("added", F.desc("order"), "tie")
    if not first:
        return rows, window
    used = sorted(first)  # the group below comes next; below the last, the top one
    above = {first[used[k - 1]]: g for k, g in enumerate(used)}
    ahead = rows.where(F.col("order").isin(*above)).groupBy("order").agg(F.min_by(F.struct(*(c for c in rows.columns if c != "order")), "tie").alias("r"))
    ahead = ahead.select("order", "r.*")
    goes = F.create_map(*(F.lit(x) for pair in above.items() for x in pair))
    ahead = ahead.withColumn("group", goes[F.col("order")]).withColumn("added", F.lit(True))
    return rows.unionByName(ahead.select(*rows.columns)), window


def edited_digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: its fingerprint, that of its edited text (the last half replaced by the begin of the
    next document) and the likenesses to the edited text and to the next document.

    Only keys and texts are shuffled, once; signatures are made behind the shuffle."""
    rows, window = in_order(docs.select(F.col(key).alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")), "key")
    place = ["key", "order", "tie", "group", "added"]
    rows = rows.withColumn("ahead", F.lead("text").over(window)).withColumn("n_chars", F.char_length("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.select(*place, "n_chars", "text", F.concat(F.substring("text", F.lit(1), F.col("n_chars") - half), F.substring("ahead", F.lit(1), half)).alias("edited"))
    rows = rows.select(*place, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), signatures(F.col("text")).alias("own"), signatures(F.col("edited")).alias("changed"))
    rows = rows.withColumn("ahead", F.lead("own").over(window)).where(~F.col("added"))
    return rows.select(F.col("key").alias(key), F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256",
                       fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("changed")).alias("edited_fingerprint"),
                       likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("ahead")).alias("near_next"))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id): documents with equal fingerprints share the smallest key of them."""
    rows = docs.select(F.col(key), F.md5(fingerprint(signatures(F.col(f"`{text}`")))).alias("f"))
    return rows.join(rows.groupBy("f").agg(F.min(key).alias("class_id")), "f").select(key, "class_id")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b, jaccard) of the class representatives at or over the threshold, a < b; ``classes`` has the
    members of each class.  Texts without words are in no pair."""
    sets = written(fingerprints(docs.select(F.col(key).alias("id"), F.col(f"`{text}`").alias("text")), "text", "s").where(F.size("s") > 0)
                   .groupBy("s").agg(F.min("id").alias("id")).withColumn("n", F.size("s")))
    part = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(threshold)) + 1e-9)
    uses = sets.select("id", F.explode("s").alias("sig"))
    ranked = uses.join(uses.groupBy("sig").agg(F.count("*").alias("df")).where("df > 1"), "sig")
    rare = ranked.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("shared"))
    # the signatures of a set that no other set has come first in the order of rarity
    rare = rare.join(sets.select("id", "n", part.alias("part")), "id").withColumn(
        "take", F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1 - (F.col("n") - F.size("shared")))
    index = rare.where("take > 0").select("id", "n", "part", F.explode(F.slice("shared", F.lit(1), F.col("take").cast("int"))["sig"]).alias("sig"))
    index = written(index)
    probe = index.withColumn("part", F.explode(F.array("part", F.col("part") - 1)))
    x, y = index.alias("x"), probe.alias("y")
    met = x.join(y, ["part", "sig"]).where((F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.id") < F.col("y.id"))))
    met = met.where(F.col("x.n") >= F.col("y.n") * threshold - 1e-9).select(F.col("x.id").alias("p"), F.col("y.id").alias("q")).distinct()
    met = met.join(sets.select(F.col("id").alias("p"), F.col("s").alias("sp")), "p").join(sets.select(F.col("id").alias("q"), F.col("s").alias("sq")), "q")
    near = met.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), likeness(F.col("sp"), F.col("sq")).alias("jaccard"))
    return near.where(F.col("jaccard") >= threshold)
