"""Operator 3: SentencePiece encoding and decoding by a relational word lattice.

A text is "space + text" with spaces as the mark U+2581, as in SentencePiece.
It is cut into words wherever two neighbouring ASCII characters (or marks)
stand side by side in no piece, such as before a mark or a new line.  No piece
crosses such a cut, so the best segmentation of a text is that of its words.

1. Documents are read in packs (consecutive rows up to ``PACK_BYTES``), each
   with its list of distinct words.
2. Words, distinct over the corpus, are exploded into their substrings of at
   most the longest piece's length; an equi-join with the piece table keeps
   the pieces, and the edges are grouped by word.
3. A Viterbi fold (``aggregate`` over the edges) gives the best score of each
   prefix; a second fold walks back.  Ties go to the longer last piece.  A
   character that is no piece costs ``UNKNOWN_COST`` more than the worst
   piece and becomes its UTF-8 bytes' pieces.
4. The ids go back to the packs that asked, and each pack's documents are
   put together from the ids of its words.

Only words and packed word numbers are shuffled, never whole texts; the
piece table is the only broadcast and its size is checked.

Rules: null and empty texts have no ids and decode to the empty text.  A
literal U+2581 decodes to a space.  Repeated rows and ids give a row each; a
null key stays null.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches
from .spotsigs import let
from .words import _BYTE, _POWERS, give_back, mix, string_buffers, tidy

PACK_BYTES, CHUNK_BYTES, RUN, GROUPS, MERGED = 64 << 20, 1 << 20, 256, 6, 3
UNKNOWN_COST, BROADCAST_PIECES, ID_ZERO = 10, 1_000_000, 1 << 31
MARK = "▁"


@dataclass
class Pieces:
    """A piece table: rows (piece, id, score) and the ids of bytes."""

    rows: list[tuple[str, int, int]]
    byte_ids: np.ndarray

    @property
    def cuts(self) -> np.ndarray:
        """Per pair of bytes (256 * first + second): True if a text is cut between them."""
        out = np.zeros((256, 256), bool)
        out[:128, :128] = True
        for p, _, _ in self.rows:
            p = p.replace(MARK, " ")
            for x, y in zip(p, p[1:]):
                if x < "\x80" and y < "\x80":
                    out[ord(x), ord(y)] = False
        out[128:, 32] = True  # a mark only begins a piece
        return out.reshape(-1)

    @property
    def longest(self) -> int:
        return max((len(p) for p, _, _ in self.rows), default=1)

    @property
    def unknown(self) -> int:
        return min((s for _, _, s in self.rows), default=0) - UNKNOWN_COST

    def table(self, spark: SparkSession) -> DataFrame:
        frame = spark.createDataFrame(self.rows, "piece string, id int, score bigint")
        return F.broadcast(frame) if len(self.rows) <= BROADCAST_PIECES else frame

    def decoded(self) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets by id) of what each piece stands for."""
        last = max([i for _, i, _ in self.rows] + self.byte_ids.tolist())
        said = [b""] * (last + 1)
        for k, i in enumerate(self.byte_ids.tolist()):
            said[i] = bytes([k])
        for p, i, _ in self.rows:
            said[i] = p.replace(MARK, " ").encode()
        return np.frombuffer(b"".join(said), np.uint8), np.append(0, np.cumsum([len(x) for x in said]))


def load(model_file: str) -> Pieces:
    """The pieces and scores of a sentencepiece model file with byte pieces; scores are whole numbers there."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = range(model.get_piece_size())
    rows = [(model.id_to_piece(i), i, int(model.get_score(i))) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
    if any(MARK in p.lstrip(MARK) for p, _, _ in rows):
        raise ValueError("a piece of this model goes on over white space; its words cannot be cut there")
    return Pieces(rows, byte_ids)


class Numbers:
    """Numbers of 64-bit hashes in the order they come."""

    def __init__(self):
        self.keys, self.number, self.order = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of each hash, an index of each hash that is new, in order of number)."""
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), bool)
        known[at < len(self.keys)] = self.keys[at[at < len(self.keys)]] == unique[at < len(self.keys)]
        number = np.zeros(len(unique), np.int64)
        number[known] = self.number[at[known]]
        new = np.flatnonzero(~known)
        new = new[np.argsort(first[new])]
        number[new] = len(self.keys) + np.arange(len(new))
        self.order.append(unique[new])
        self.keys, self.number = np.insert(self.keys, at[~known], unique[~known]), np.insert(self.number, at[~known], number[~known])
        return number[inverse.reshape(-1)], first[new]


def cut_words(data: np.ndarray, rows: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word begins, hashes, word offsets by row) of rows that lie one after another; words cover all bytes."""
    start = np.zeros(len(data) + 1, bool)
    start[rows] = True
    start[1:-1] |= cuts[(data[:-1].astype(np.uint16) << 8) | data[1:]]
    begins = np.flatnonzero(start[:-1])
    at = np.arange(len(data)) - np.repeat(begins, np.diff(np.append(begins, len(data))))
    v = _BYTE[data] * _POWERS[at & 0xFFFF] * ((at >> 16).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    hashes = mix(np.add.reduceat(v, begins) + np.diff(np.append(begins, len(data))).astype(np.uint64)) if len(begins) else np.zeros(0, np.uint64)
    return begins, hashes, np.searchsorted(begins, rows)


def _spaced(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows with a space before each that is not empty."""
    some = np.diff(rows) > 0
    return np.insert(data, rows[:-1][some], 32), rows + np.append(0, np.cumsum(some))


def _packs(cuts: np.ndarray, words: bool, pack_bytes: int):
    """Rows of the packs: their words, or their documents as word numbers.  Both readings make the same
    packs; a pack's name is the digest of its words, so equal names mean equal numbers."""
    def said(pack: dict) -> Iterator[pa.RecordBatch]:
        keys = np.concatenate(pack["numbers"].order)
        name = int(np.bitwise_xor.reduce(mix(keys + np.arange(1, len(keys) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))) >> 1 if len(keys) else 0
        if words:
            for a, texts in pack["words"]:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(texts), name)), pa.array((a + np.arange(len(texts))).astype(np.int32)),
                                                  pa.array(texts, pa.string())], names=["pack", "number", "word"])
        else:
            for ids, counts, crc, blob in pack["rows"]:
                one = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                yield pa.RecordBatch.from_arrays([pa.array([name]), one, pa.array([counts.tolist()], pa.list_(pa.int32())), pa.array([crc], pa.list_(pa.int64())), pa.array([blob], pa.binary())],
                                                 names=["pack", "doc_id", "counts", "crc", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        fresh = lambda: {"numbers": Numbers(), "words": [], "rows": [], "size": 0}
        pack, press = fresh(), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            give_back()
            offsets, data = string_buffers(batch.column(1))
            i = 0
            while i < batch.num_rows:
                j = min(batch.num_rows, max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, "right")) - 1))
                part, rows = _spaced(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                begins, hashes, at = cut_words(part, rows, cuts)
                count = len(pack["numbers"].keys)
                numbers, new = pack["numbers"].of(hashes)
                raw = part.tobytes()
                if words:
                    ends = np.append(begins[1:], len(part))
                    pack["words"].append((count, [raw[a:b].decode("utf-8") for a, b in zip(begins[new].tolist(), ends[new].tolist())]))
                else:
                    crc = [zlib.crc32(raw[a + 1:b].replace(MARK.encode(), b" ")) if b > a else 0 for a, b in zip(rows[:-1].tolist(), rows[1:].tolist())]
                    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
                    pack["rows"].append((batch.column(0).slice(i, j - i), np.diff(at).astype(np.int32), crc, press.compress(planes)))
                pack["size"] += len(part)
                if pack["size"] >= pack_bytes:
                    yield from said(pack)
                    pack = fresh()
                i = j
        if pack["size"] or pack["rows"]:
            yield from said(pack)
    return run


def _push(run: Column, done: Column, x: Column) -> tuple[Column, Column]:
    """A list in two levels, so that adding to a long one copies little: (last part, full parts)."""
    full = F.size(run) >= RUN
    return F.when(full, F.array(x)).otherwise(F.concat(run, F.array(x))), F.when(full, F.concat(done, F.array(run))).otherwise(done)


def viterbi(edges: Column, length: Column, longest: int) -> Column:
    """The ids of the best path over edges (e, s, score, via), sorted by end and start; every end has one.
    ``via`` is the edge's start and id in one number, see ``segmented``.

    The state has the end in work with its best score and edge, the best scores of the ``longest`` ends
    before it, and the best edges of all ends before it."""
    none, parts = F.array().cast("array<bigint>"), F.array().cast("array<array<bigint>>")
    zero = F.lit(0).cast("long")

    def state_of(at, top, via, best, run, done) -> Column:
        return F.struct(at.alias("at"), top.alias("top"), via.alias("via"), best.alias("best"), run.alias("run"), done.alias("done"))

    def step(state: Column, edge: Column) -> Column:
        top, best, back = state["top"], state["best"], edge["e"] - edge["s"]
        kept = F.when(F.size(best) < longest, best).otherwise(F.slice(best, 2, longest - 1)) if longest > 1 else none
        first = F.when(back == 1, top).otherwise(F.get(best, F.size(best) - back + 1)) + edge["score"]
        next_ = F.get(best, F.size(best) - back) + edge["score"]
        return F.when(edge["e"] > state["at"], state_of(edge["e"], first, edge["via"], F.concat(kept, F.array(top)), *_push(state["run"], state["done"], state["via"]))).when(
            next_ > top, state_of(state["at"], next_, edge["via"], best, state["run"], state["done"])).otherwise(state)

    def ended(state: Column) -> Column:
        return F.flatten(F.concat(state["done"], F.array(F.concat(state["run"], F.array(state["via"])))))

    ids, id_parts = F.array().cast("array<int>"), F.array().cast("array<array<int>>")
    walk_start = F.struct(length.alias("at"), ids.alias("run"), id_parts.alias("done"))

    def walk(back: Column) -> Column:
        def one(state: Column, place: Column) -> Column:
            here = F.get(back, place)
            run, done = _push(state["run"], state["done"], (here.bitwiseAND(F.lit(0xFFFFFFFF)) - ID_ZERO).cast("int"))
            return F.when(place == state["at"], F.struct(F.shiftright(here, 32).cast("int").alias("at"), run.alias("run"), done.alias("done"))).otherwise(state)

        return F.aggregate(F.sequence(length, F.lit(1), F.lit(-1)), walk_start, one, lambda s: F.reverse(F.flatten(F.concat(s["done"], F.array(s["run"])))))

    return let(F.aggregate(edges, state_of(F.lit(0), zero, zero, none, none, parts), step, ended), walk)


def segmented(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(h, uses, ids) of distinct words (h, word, uses): explode substrings, join the pieces, group by word, fold.

    The groups are made where the words are: the join is a broadcast join and the words are dealt by h."""
    spark, longest = words.sparkSession, pieces.longest
    rows = words.select("h", F.regexp_replace("word", " ", MARK).alias("word"), "uses").withColumn("length", F.char_length("word"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("length") - 1)).alias("s"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.col("length") - F.col("s")))).alias("n"))
    rows = rows.select("h", "length", "s", "n", F.substring("word", F.col("s") + 1, F.col("n")).alias("piece"),
                       F.when((F.col("s") == 0) & (F.col("n") == 1), F.col("uses")).alias("uses"))
    rows = rows.join(pieces.table(spark), "piece", "left").where((F.col("n") == 1) | F.col("id").isNotNull())
    # a character that is no piece: minus its code point, replaced by its bytes' ids in the end
    code = F.conv(F.hex(F.encode("piece", "utf-32")), 16, 10).cast("int")
    edge = F.struct((F.col("s") + F.col("n")).alias("e"), F.col("s"), F.coalesce("score", F.lit(pieces.unknown)).alias("score"),
                    (F.shiftleft(F.col("s").cast("long"), 32) + F.coalesce("id", -code - 1) + ID_ZERO).alias("via"))
    grouped = rows.groupBy("h").agg(F.collect_list(edge).alias("edges"), F.max("length").alias("length"), F.flatten(F.collect_list("uses")).alias("uses"))
    grouped = grouped.select("h", "uses", "length", F.sort_array("edges").alias("edges"))
    return grouped.select("h", "uses", viterbi(F.col("edges"), F.col("length"), longest).alias("ids"))


def _put_together(byte_ids: np.ndarray, decoded: tuple[np.ndarray, np.ndarray], key: str, whole: bool):
    """The documents of a pack from the ids of its words."""
    said, bounds = decoded

    def flat(size: np.ndarray, begin: np.ndarray) -> np.ndarray:
        ends = np.cumsum(size)
        return np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)

    def run(words: pa.Table, rows: pa.Table) -> pa.Table:
        import zstandard

        give_back()
        words, size = words.combine_chunks(), np.zeros(0, np.int64)
        if words.num_rows:
            number, lists = words.column("number").to_numpy(), words.column("ids").combine_chunks()
            value, off = lists.values.to_numpy().astype(np.int64), lists.offsets.to_numpy().astype(np.int64)
            size, begin = np.zeros(int(number.max()) + 1, np.int64), np.zeros(int(number.max()) + 1, np.int64)
            odd = np.flatnonzero(value < 0)
            if len(odd):  # characters without a piece become the pieces of their bytes
                each = [byte_ids[list(chr(-int(value[k]) - 1).encode())] for k in odd]
                times = np.ones(len(value), np.int64)
                times[odd] = [len(x) for x in each]
                moved = np.append(0, np.cumsum(times))
                new = np.repeat(value, times)
                for k, x in zip(odd, each):
                    new[moved[k]:moved[k + 1]] = x
                value, off = new, moved[off]
            size[number], begin[number] = np.diff(off), off[:-1]
        kind = rows.schema.field("doc_id").type.value_type
        names = [key, "n_tokens", *["ids"] * whole, "ids_crc32", "round_trip"]
        types = [kind, pa.int64(), *[pa.list_(pa.int32())] * whole, pa.int64(), pa.bool_()]
        out = []
        for r in range(rows.num_rows):
            planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(rows.column("blob")[r].as_py()), np.uint8)
            numbers = np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)
            counts = np.array(rows.column("counts")[r].as_py(), np.int64)
            at = np.append(0, np.cumsum(counts))
            if len(numbers) and numbers.max() >= len(size):
                raise ValueError("the words of a pack are not those of its documents: its rows came in another order")
            of_word = size[numbers] if len(numbers) else numbers
            ids = value[flat(of_word, begin[numbers])].astype("<u4") if len(numbers) else np.zeros(0, "<u4")
            ends = np.append(0, np.cumsum(of_word))[at]
            text_size = np.diff(bounds)[ids]
            text = said[flat(text_size, bounds[ids])].tobytes()
            text_ends = np.append(0, np.cumsum(text_size))[ends].tolist()
            crc = rows.column("crc")[r].as_py()
            columns = [rows.column("doc_id")[r].values, pa.array(np.diff(ends))]
            if whole:
                columns.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.view(np.int32))))
            columns.append(pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])], pa.int64()))
            columns.append(pa.array([zlib.crc32(text[a + 1:b]) == c if b > a else c == 0 for a, b, c in zip(text_ends[:-1], text_ends[1:], crc)], pa.bool_()))
            out.append(pa.RecordBatch.from_arrays(columns, names=names))
        return pa.Table.from_batches(out, pa.schema(zip(names, types)))
    return run


def encode(docs: DataFrame, pieces: Pieces, key: str = "doc_id", text: str = "text", ids: bool = True, pack_bytes: int | None = None) -> DataFrame:
    """Per row: key, ``n_tokens``, ``ids`` (unless told not to), the CRC-32 of the ids as little-endian
    32-bit numbers, and whether they decode to the text.  ``pack_bytes`` (``PACK_BYTES`` unless given) is the text
    of a pack: a smaller one holds less in a task and asks for more words; the rows are the same."""
    pack_bytes = pack_bytes or PACK_BYTES
    rows = bounded_batches(docs).select(F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    # a pack spans a few small input splits, so that fewer packs ask for the same words
    rows = rows.coalesce(max(1, rows.rdd.getNumPartitions() // MERGED))
    asked = rows.mapInArrow(tidy(_packs(pieces.cuts, True, pack_bytes)), "pack bigint, number int, word string")
    # small groups of words: a group's edges, tens per word, are sorted in memory
    groups = GROUPS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = asked.repartition(groups, F.xxhash64("word")).withColumn("h", F.xxhash64("word"))
    same = F.when(F.min("word") == F.max("word"), F.min("word")).otherwise(F.raise_error(F.lit("two words with one hash")))
    words = asked.groupBy("h").agg(same.alias("word"), F.collect_list(F.struct("pack", "number")).alias("uses"))
    answers = segmented(words, pieces).select(F.explode("uses").alias("use"), "ids").select("use.pack", "use.number", "ids")
    packs = rows.mapInArrow(tidy(_packs(pieces.cuts, False, pack_bytes)), f"pack bigint, doc_id array<{kind}>, counts array<int>, crc array<bigint>, blob binary")
    out = f"`{key}` {kind}, n_tokens bigint, {'ids array<int>, ' if ids else ''}ids_crc32 bigint, round_trip boolean"
    return answers.groupBy("pack").cogroup(packs.groupBy("pack")).applyInArrow(_put_together(pieces.byte_ids, pieces.decoded(), key, ids), out)


def decode(df: DataFrame, pieces: Pieces, ids: str = "ids", out: str = "text") -> DataFrame:
    """``df`` with the text that each list of ids stands for; a null list stays null."""
    said, bounds = pieces.decoded()

    @F.arrow_udf("string")
    def run(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
        raw = said.tobytes()
        for batch in lists:
            texts = []
            for x in batch.to_pylist():
                texts.append(None if x is None else b"".join(raw[bounds[i]:bounds[i + 1]] for i in x)[1:].decode("utf-8", "replace"))
            yield pa.array(texts, pa.string())
    return df.withColumn(out, run(F.col(f"`{ids}`")))
