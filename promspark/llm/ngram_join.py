"""Operator 9: exact Jaccard join of word n-gram sets, by set relations.

A document's set holds its distinct runs of ``n`` words; a document with
fewer words has its whole sequence as its one element.  Documents link when
100 * |A & B| >= percent * |A | B|.

1. Documents with equal sets are one set from the start.
2. Elements have one global order, rare ones first.  Sets that link share an
   element among the first ``size - ceil(percent/100 * size) + 1`` of each, so
   only those are indexed: an index list per element, with size and position
   of each set.  The order uses document counts over all documents, exact
   per 32-bit hash; the most frequent elements (at most ``MOST_FREQUENT``)
   come last by their count, the rest by hash.
3. A list is read in blocks.  The position tells how many elements two sets
   can share at most, so blocks that cannot hold a partner are skipped, and a
   short parity bitmap of each set bounds the difference from below; a longer
   one does so again for the pairs that are left.
4. Answers come from similar sets: the first set of a list is compared with
   the others, those that may link with it are answered by it and not
   compared again.  Verified on the whole sets, such links join sets to
   components.  A first answer need not be a link, so a group may still be in
   parts: up to ``ROUNDS`` more readings make one pair per list and component,
   with the closest set of another one by parity bitmaps of ``FINE`` bits, and
   the links among these join the parts.  A last reading compares only sets that are still in
   different components, all of them.  These readings take the lists in which the first one found a pair
   that may link: it has tried all pairs of the others; lists of one component are left out.
   Nothing is sampled or capped, so the components are those of the full join,
   without a group's pairs being made.

Rules: words are runs of anything but 0x20 and 0x09-0x0D, A-Z lower-cased.
Null and empty texts and texts without words have the empty set, no link and
their own id as component.  Repeated rows give a row each.  A null id is in no
minimum.  Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import bitmap, probe
from .common import bounded_batches, written
from .components import components
from .words import _ODD, SPACE_WORDS, Words, chunks, mix, ngrams, tidy

PERCENT, N = 90, 3
LEAST_COUNT, MOST_FREQUENT, BUCKET_BITS = 16, 1 << 20, 10
FLUSH, SEEN, SMALL_LIST, BLOCK, FINE, ROUNDS = 4 << 20, 200_000, 24, 64, 512, 2


def row_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(elements, offsets): the sorted distinct n-grams of each row."""
    sizes = np.diff(words.offsets)
    counts = np.where(sizes >= n, sizes - n + 1, (sizes > 0).astype(np.int64))
    offsets = np.append(0, np.cumsum(counts))
    flat = np.zeros(int(offsets[-1]), np.uint64)
    long = np.ones(len(flat), bool)
    for k in range(1, n):
        at = np.flatnonzero(sizes == k)
        if len(at):
            h = sum(words.hashes[words.offsets[at] + i] * _ODD[i] for i in range(k))
            flat[offsets[at]] = mix(h + np.uint64(k))
            long[offsets[at]] = False
    flat[long] = ngrams(words, n)[0]
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        flat[a:b].sort()
    keep = np.ones(len(flat), bool)
    keep[1:] = flat[1:] != flat[:-1]
    keep[offsets[:-1][counts > 0]] = True
    return flat[keep], np.append(0, np.cumsum(keep))[offsets]


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.append(np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype))
    return total[offsets[1:]] - total[offsets[:-1]]


def digests(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, in two halves."""
    return tuple(_sums(mix(flat ^ np.uint64(c)), offsets).view(np.int64) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))


def parity(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits per set, each the parity of the elements that fall on it."""
    out = []
    bit = (flat >> np.uint64(40)) & np.uint64(127)
    for half in (0, 1):
        one = np.where((bit >> np.uint64(6)) == half, np.uint64(1) << (bit & np.uint64(63)), np.uint64(0))
        total = np.append(np.zeros(1, np.uint64), np.bitwise_xor.accumulate(one)) if len(one) else np.zeros(1, np.uint64)
        out.append((total[offsets[1:]] ^ total[offsets[:-1]]).view(np.int64))
    return tuple(out)


def wide_parity(elements: np.ndarray) -> bytes:
    """As many parity bits as a set has elements, rounded up to a power of two, at least ``FINE``; see ``folded``."""
    bits = max(FINE, 1 << min(20, (len(elements) - 1).bit_length()))
    return np.packbits((np.bincount((elements & np.uint64(bits - 1)).view(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The parity bits of a set at a smaller size: bits that fall together are added."""
    return np.bitwise_xor.reduce(bits.reshape(-1, size), axis=0)


def fine_parity(wide: str) -> list[Column]:
    """``FINE`` parity bits, 64 a column, from those of ``wide_parity``."""
    @F.arrow_udf("array<bigint>")
    def fold(column: pa.Array) -> pa.Array:
        rows = [folded(np.frombuffer(x.as_buffer(), np.uint8), FINE // 8).view(np.int64) for x in column]
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * (FINE // 64)), pa.array(flat))

    bits = fold(F.col(wide))
    return [bits[k].alias(f"b{k}") for k in range(FINE // 64)]


def _near_enough(percent: int):
    """Drops the pairs (a, b, n and wide parity of both) whose parities differ at more bits than linked sets may."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            most = both - 2 * ((percent * both + 99 + percent) // (100 + percent))
            kept = []
            for k, (x, y) in enumerate(zip(batch.column(4), batch.column(5))):
                x, y = (np.frombuffer(v.as_buffer(), np.uint8) for v in (x, y))
                size = min(len(x), len(y))
                if int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()) <= most[k]:
                    kept.append(k)
            take = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take)], names=["a", "b"])
    return run


def _partial_counts(n: int):
    """Rows (bucket, counts by upper half, lower halves) of the 32-bit hashes of all sets' elements."""
    span = 1 << (16 - BUCKET_BITS)

    def rows(held: list[np.ndarray]) -> pa.RecordBatch:
        all_ = np.sort(np.concatenate(held))
        edges = np.searchsorted(all_, np.arange(0, (1 << 16) + 1, dtype=np.uint64) << np.uint64(16))
        high, low = np.diff(edges).astype(np.uint32), all_.astype(np.uint16)
        at = edges[::span]
        some = np.flatnonzero(np.diff(at))
        return pa.RecordBatch.from_arrays([
            pa.array(some.astype(np.int32)), pa.array([high[k * span:(k + 1) * span].tobytes() for k in some], pa.binary()),
            pa.array([low[at[k]:at[k + 1]].tobytes() for k in some], pa.binary())], names=["bucket", "high", "low"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for w in chunks(batch.column(0), SPACE_WORDS):
                flat, _ = row_sets(w, n)
                held.append((flat >> np.uint64(32)).astype(np.uint64))
                size += len(flat)
                if size >= FLUSH:
                    yield rows(held)
                    held, size = [], 0
        if size:
            yield rows(held)
    return run


def _total_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, count) at LEAST_COUNT and over; the buckets of a partition come one after another."""
    span = 1 << (16 - BUCKET_BITS)
    bucket, total = None, None

    def row() -> pa.RecordBatch:
        at = np.flatnonzero(total >= LEAST_COUNT)
        return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64) + (bucket << (32 - BUCKET_BITS))), pa.array(total[at])], names=["hash", "count"])

    for batch in batches:
        for b, high, low in zip(*(c.to_pylist() for c in batch.columns)):
            if b != bucket:
                if total is not None:
                    yield row()
                bucket, total = b, np.zeros(span << 16, np.int64)
            upper = np.repeat(np.arange(span, dtype=np.int64), np.frombuffer(high, np.uint32))
            at, times = np.unique((upper << 16) + np.frombuffer(low, np.uint16), return_counts=True)
            total[at] += times
    if total is not None:
        yield row()


def frequent(texts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted 32-bit hashes, level) of the most frequent elements; the level is the count's logarithm."""
    parts = texts.mapInArrow(tidy(_partial_counts(n)), "bucket int, high binary, low binary")
    counts = written(parts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_total_counts, "hash bigint, count bigint"))
    level = F.floor(F.log2("count")).cast("int")
    sizes, least, total = counts.groupBy(level.alias("level")).count().collect(), 64, 0
    for k, size in sorted(sizes, reverse=True):
        total += size
        if total > MOST_FREQUENT:
            break
        least = k
    got = counts.where(level >= least).select("hash", level.alias("level")).toArrow()  # at most MOST_FREQUENT rows
    hashes, levels = got.column(0).to_numpy(), got.column(1).to_numpy()
    order = np.argsort(hashes)
    return hashes[order].astype(np.uint64), levels[order].astype(np.uint8)


class Order:
    """Level of elements: 0 unless frequent."""

    def __init__(self, hashes: np.ndarray, levels: np.ndarray):
        self.hashes, self.levels = hashes, levels
        self.some = np.zeros(1 << 24, bool)
        self.some[(hashes >> np.uint64(8)).astype(np.int64)] = True

    def __call__(self, flat: np.ndarray) -> np.ndarray:
        out = np.zeros(len(flat), np.uint8)
        at = np.flatnonzero(self.some[(flat >> np.uint64(40)).astype(np.int64)])
        if len(at):
            h = flat[at] >> np.uint64(32)
            k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            out[at] = np.where(self.hashes[k] == h, self.levels[k], 0)
        return out


def _indexed(n: int, percent: int, hashes: np.ndarray, levels: np.ndarray):
    """A row per document: its set's size, digest and, once per set and task, its parity and first elements."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = Order(hashes, levels), set()
        for batch in batches:
            for w in chunks(batch.column(1), SPACE_WORDS):
                flat, offsets = row_sets(w, n)
                sizes = np.diff(offsets)
                h1, h2 = digests(flat, offsets)
                level = order(flat)
                rare = _sums((level > 0).astype(np.int64), offsets) == 0
                first, new, wide = [], [], []
                for k, key in enumerate(zip(h1.tolist(), h2.tolist())):
                    new.append(sizes[k] > 0 and key not in seen)
                    wide.append(None)
                    if new[-1]:
                        seen.add(key)
                        a, b = offsets[k], offsets[k + 1]
                        wide[-1] = wide_parity(flat[a:b])
                        take = sizes[k] - (percent * sizes[k] + 99) // 100 + 1
                        first.append(flat[a:a + take] if rare[k] else flat[a + np.argsort(level[a:b], kind="stable")[:take]])
                if len(seen) > SEEN:
                    seen.clear()
                bounds = np.append(0, np.cumsum([len(f) for f in first])) if first else np.zeros(1)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array((np.concatenate(first) if first else flat[:0]).view(np.int64)))
                new = np.array(new, bool)
                place = pa.array(np.cumsum(new) - 1, mask=~new)
                b0, b1 = parity(flat, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.first, w.n), *map(pa.array, (sizes.astype(np.int64), h1, h2, b0, b1)), pa.array(wide, pa.binary()), lists.take(place)],
                                                 names=["doc_id", "n", "h1", "h2", "b0", "b1", "wide", "first"])
    return run


class Lists:
    """Index lists, one after another: sets of a list by size.  Without labels each set is its own component."""

    def __init__(self, columns: list[np.ndarray], percent: int, labelled: bool = True):
        self.token, self.sid, both, self.label, *bits = columns if labelled else [*columns[:3], columns[1], *columns[3:]]
        self.bits = [b.view(np.uint64) for b in bits]
        self.n, self.rest = both >> 32, (both >> 32) - (both & 0xFFFFFFFF)  # rest: the element itself and those after it
        self.percent = percent

    def place(self, at: np.ndarray) -> np.ndarray:
        """Size and position of places, as the columns had them."""
        return (self.n[at] << 32) + self.n[at] - self.rest[at]

    def may_link(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For pairs of places, j with the smaller set: whether size, position and parity allow a link."""
        p, both = self.percent, self.n[i] + self.n[j]
        common = (p * both + 99 + p) // (100 + p)
        ok = (100 * self.n[j] >= p * self.n[i]) & (np.minimum(self.rest[i], self.rest[j]) >= common) & (self.label[i] != self.label[j])
        ok[ok] = self.difference(i[ok], j[ok]) <= (both - 2 * common)[ok]
        return ok

    def difference(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Parity bits that differ, for pairs of places."""
        return sum(np.bitwise_count(b[i] ^ b[j]).astype(np.int64) for b in self.bits)

    def closest(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs of places, the one with the least difference for each list and component."""
        if not len(i):
            return i, j
        keys = np.stack([np.tile(self.token[i], 2), np.concatenate([self.label[i], self.label[j]])])
        order = np.lexsort((np.tile(self.difference(i, j), 2), *keys[::-1]))
        keys = keys[:, order]
        at = np.unique(order[np.append(True, (keys[:, 1:] != keys[:, :-1]).any(0))] % len(i))
        return i[at], j[at]

    def blocks(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, most elements left, smallest set) per block of a list."""
        at = np.arange(a, b, BLOCK)
        return at, np.maximum.reduceat(self.rest[a:b], at - a), np.minimum.reduceat(self.n[a:b], at - a)

    def larger(self, j: int, b: int, blocks) -> np.ndarray:
        """Places after j in blocks that can hold a partner of it."""
        at, most, least = blocks
        p = self.percent
        ok = (at + BLOCK > j + 1) & (100 * self.n[j] >= p * least) & ((100 + p) * np.minimum(most, self.rest[j]) >= p * (self.n[j] + least))
        out = (at[ok][:, None] + np.arange(BLOCK)).reshape(-1)
        return out[(out > j) & (out < b)]

    def pairs(self, every: bool, one: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of places that may link: all, the closest ``one`` of each component in a list, or for each place
        the first set that may answer it; and the places of the lists that have any."""
        starts = np.flatnonzero(np.append(True, self.token[1:] != self.token[:-1])) if len(self.token) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(self.token))
        if every and len(starts):  # a list whose sets are all in one component has nothing left to find
            some = np.minimum.reduceat(self.label, starts) != np.maximum.reduceat(self.label, starts)
            open_ = np.repeat(some, ends - starts)
            if not open_.all():
                columns = [c[open_] for c in (self.token, self.sid, self.n, self.rest, self.label)]
                self.token, self.sid, self.n, self.rest, self.label = columns
                self.bits = [b[open_] for b in self.bits]
                ends = np.cumsum((ends - starts)[some])
                starts = ends - np.diff(np.append(0, ends))
        size = np.repeat(ends - starts, ends - starts)
        place = np.arange(len(self.token)) - np.repeat(starts, ends - starts)
        left, right, held = [], [], 0
        first = np.full(len(self.token), -1)
        for lag in range(1, SMALL_LIST):
            i = np.flatnonzero((place >= lag) & (size <= SMALL_LIST))
            if not len(i):
                break
            i = i[self.may_link(i, i - lag)]
            if every:
                left.append(i)
                right.append(i - lag)
            else:
                first[i] = i - lag
        for a, b in zip(starts[ends - starts > SMALL_LIST].tolist(), ends[ends - starts > SMALL_LIST].tolist()):
            blocks = self.blocks(a, b)
            for j in range(a, b):
                if every or first[j] < 0:
                    i = self.larger(j, b, blocks)
                    i = i if every else i[first[i] < 0]
                    i = i[self.may_link(i, np.full(len(i), j))] if len(i) else i
                    if every:
                        i, js = self.closest(i, np.full(len(i), j)) if one else (i, np.full(len(i), j))
                        left.append(i)
                        right.append(js)
                        held += len(i)
                        if one and held > SEEN:
                            left, right = ([x] for x in self.closest(np.concatenate(left), np.concatenate(right)))
                            held = 0
                    else:
                        first[i] = j
        if not every:
            left, right = [np.flatnonzero(first >= 0)], [first[first >= 0]]
        left, right = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        left, right = self.closest(left, right) if one else (left, right)
        used = np.isin(np.repeat(np.arange(len(starts)), ends - starts), np.unique(np.searchsorted(starts, left, "right") - 1))
        return left, right, np.flatnonzero(used)


def _list_pairs(percent: int, every: bool, one: bool = False):
    """Rows (a, b) of sets to compare, see ``Lists.pairs``; in the first reading also the lists that have any, as
    rows (set, null, token, size and position)."""
    def found(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        lists = Lists(columns, percent, every)
        left, right, used = lists.pairs(every, one)
        a, b = np.minimum(lists.sid[left], lists.sid[right]), np.maximum(lists.sid[left], lists.sid[right])
        both = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        pairs = [pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())]
        if every:
            yield pa.RecordBatch.from_arrays(pairs, names=["a", "b"])
        else:
            yield pa.RecordBatch.from_arrays([*pairs, *[pa.nulls(len(both), pa.int64())] * 2], names=["a", "b", "token", "np"])
            yield pa.RecordBatch.from_arrays([pa.array(lists.sid[used]), pa.nulls(len(used), pa.int64()), pa.array(lists.token[used]), pa.array(lists.place(used))],
                                             names=["a", "b", "token", "np"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([c.to_numpy() for c in batch.columns])
            size += batch.num_rows
            if size >= 100_000:
                columns = [np.concatenate(c) for c in zip(*held)]
                whole = int(np.searchsorted(columns[0], columns[0][-1]))
                if whole:  # the last list may go on
                    yield from found([c[:whole] for c in columns])
                held, size = [[c[whole:] for c in columns]], size - whole
        if held:
            yield from found([np.concatenate(c) for c in zip(*held)])
    return run


def _list_table(rows: DataFrame) -> DataFrame:
    """The index lists of rows (token, sid, np: size and position, a label unless each set is its own, parity bits)."""
    label = [c for c in rows.columns if c == "label"]
    bits = sorted(c for c in rows.columns if c[0] == "b")
    return rows.select("token", "sid", "np", *label, *bits).repartition("token").sortWithinPartitions("token", "np")


def _open_lists(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The lists (token, sid, np) whose sets are not all in one component.  Components only grow: the others have
    nothing left to find in any reading."""
    now = lists.select("token", "sid").join(labels.withColumnRenamed("node", "sid"), "sid", "left").select("token", F.coalesce("label", "sid").alias("label"))
    some = now.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("token")
    return lists.join(some, "token", "left_semi")


def _named_sets(n: int, bits: np.ndarray):
    """(h1, h2, elements) of the sets whose digest is in the bitmap, once per set and task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for w in chunks(batch.column(0), SPACE_WORDS):
                flat, offsets = row_sets(w, n)
                h1, h2 = digests(flat, offsets)
                rows = []
                for k in probe(bits, h1.view(np.uint64)).tolist():
                    key = (int(h1[k]), int(h2[k]))
                    if key not in seen:
                        seen.add(key)
                        rows.append(k)
                if len(seen) > SEEN:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(h1[rows]), pa.array(h2[rows]), pa.array([flat[offsets[k]:offsets[k + 1]].tobytes() for k in rows], pa.binary())], names=["h1", "h2", "elements"])
    return run


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int((y[at] == x).sum())
                if 100 * common >= percent * (len(x) + len(y) - common):
                    kept.append(k)
            take = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take)], names=["a", "b"])
    return run


def _links(pairs: DataFrame, sets: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of sets that link, compared on their whole sets."""
    x, y = (sets.select(F.col("sid").alias(s), F.col("n").alias(f"n_{s}"), F.col("wide").alias(f"wide_{s}")) for s in "ab")
    near = pairs.join(x, "a").join(y, "b").select("a", "b", "n_a", "n_b", "wide_a", "wide_b")
    pairs = written(near.mapInArrow(_near_enough(percent), "a bigint, b bigint"))
    named = written(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "sid").join(sets.select("sid", "h1", "h2"), "sid"))
    bits = bitmap(named, "h1", named.count())
    whole = texts.mapInArrow(tidy(_named_sets(n, bits)), "h1 bigint, h2 bigint, elements binary").dropDuplicates(["h1", "h2"])
    whole = written(whole.join(named, ["h1", "h2"]).select("sid", "elements"))
    x, y = (whole.select(F.col("sid").alias(s), F.col("elements").alias(f"of_{s}")) for s in "ab")
    both = pairs.join(y, "b").join(x, "a").select("a", "b", "of_a", "of_b")
    return written(both.mapInArrow(tidy(_verified(percent)), "a bigint, b bigint"))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """One row per document: its key, ``n_shingles`` and ``component_id``, the smallest key it is linked to by any path."""
    rows = bounded_batches(docs).select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    texts = rows.select("text")
    hashes, levels = frequent(texts, n)
    each = written(rows.mapInArrow(tidy(_indexed(n, percent, hashes, levels)), "doc_id bigint, n bigint, h1 bigint, h2 bigint, b0 bigint, b1 bigint, wide binary, first array<bigint>"))
    sets = each.where("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), *(F.max(c).alias(c) for c in ("n", "b0", "b1")),
                                                            *(F.first(c, True).alias(c) for c in ("wide", "first")))
    sets = written(sets.withColumn("sid", F.monotonically_increasing_id()))

    whole = sets.select("sid", "n", "b0", "b1", F.posexplode("first").alias("pos", "token")).withColumn("np", F.shiftleft("n", 32) + F.col("pos"))
    found = written(_list_table(whole).mapInArrow(tidy(_list_pairs(percent, False)), "a bigint, b bigint, token bigint, np bigint"))
    links = _links(written(found.where("b is not null").select("a", "b").distinct()), sets, texts, n, percent)
    labels = components(links)
    lists = written(_open_lists(found.where("b is null").select("token", F.col("a").alias("sid"), "np"), labels))
    first = lists.groupBy("sid").agg(F.collect_list(F.struct("token", "np")).alias("first"))
    active = written(sets.select("sid", "wide").join(first, "sid").select("sid", "first", *fine_parity("wide")))
    readings = [True] * ROUNDS + [False]
    while readings:
        one = readings.pop(0)
        now = active.join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
        rest = _list_table(now.select("*", F.inline("first"))).mapInArrow(tidy(_list_pairs(percent, True, one)), "a bigint, b bigint")
        rest = written(rest.distinct())
        if rest.isEmpty():
            break
        more = _links(rest, sets, texts, n, percent)
        if not more.isEmpty():
            links = links.union(more)
            labels = components(links)
        elif one:
            readings = [False]

    named = sets.join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    named = written(named.select("h1", "h2", "label", "least"))
    least = written(named.groupBy("label").agg(F.min("least").alias("component_id")))
    named = written(named.join(least, "label").select("h1", "h2", "component_id"))
    out = each.select("doc_id", "n", "h1", "h2").join(named, ["h1", "h2"], "left")
    return out.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
