"""Operator 4: language by segmentation-marginalised piece unigrams.

A text is a sequence of words, a word a run of letters (lower case).  Over a
fixed public vocabulary of pieces, a language gives each piece a probability,
and a word the sum over all its segmentations into pieces of their products
(forward algorithm).  The text goes to the language with the largest prior
times product over its words; the score is that language's posterior.

Learning: with the same piece prior for all languages (by vocabulary rank),
a forward-backward pass over labelled texts gives the expected uses of each
piece per language, marginal over segmentations; smoothed, they are the
language's piece probabilities.  The pass reads a bounded sample of labelled
rows: ``max_documents`` (a hash of the text chooses them; with fewer rows,
all).  Everything else covers all rows.

The model is a vocabulary x languages table, whose size does not depend on
the documents.  Each task scores a distinct word once and keeps a bounded
cache.  Runs of over ``LONGEST`` letters count as words of that length at
most, so a text without spaces is read whole with bounded work per letter.

Rules: null text or text without a letter is ``und`` with score 0; ties go to
the first language by name; without labelled text all rows are ``und``.  Rows
are independent; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .words import ALPHA_WORDS, chunks, give_back, mix, tidy

MAX_DOCUMENTS, LONGEST, CACHE_CELLS = 20_000, 32, 1_600_000
UNKNOWN = 1e-8  # probability of a letter that is no piece
SMOOTH = 20.0  # uses that the prior counts for, times the vocabulary's share
START = "▁"
UND = "und"


def vocabulary(model_file: str) -> list[str]:
    """Letter pieces of a sentencepiece vocabulary in lower case, in rank order; a leading mark stands for a word's begin."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return list(dict.fromkeys(p for p in pieces if p.removeprefix(START).isalpha()))


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(texts x width matrix of code points padded by 0, lengths)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    width = int(lengths.max()) if len(texts) else 0
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    out = np.zeros((len(texts), width), np.uint64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out, lengths


class Lattice:
    """Finds the pieces of words: equal-length substrings are hashed and looked up together."""

    def __init__(self, pieces: list[str]):
        by_length: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            by_length.setdefault(len(p), []).append(k)
        self.tables = {}
        for n, ids in by_length.items():
            points, _ = _code_points([pieces[k] for k in ids])
            h = np.zeros(len(ids), np.uint64)
            for k in range(n):
                h = mix(h * _MULTIPLIER + points[:, k])
            order = np.argsort(h)
            self.tables[n] = h[order], np.array(ids, np.int32)[order]
        self.longest = max(self.tables, default=0)

    def edges(self, points: np.ndarray, lengths: np.ndarray) -> list[np.ndarray | None]:
        """Per substring length n: the piece (or -1) that begins at each place."""
        rows, width = points.shape
        h, out = np.zeros((rows, width), np.uint64), [None]
        for n in range(1, min(self.longest, width) + 1):
            h = mix(h[:, :width - n + 1] * _MULTIPLIER + points[:, n - 1:])
            if n not in self.tables:
                out.append(None)
                continue
            keys, ids = self.tables[n]
            at = np.searchsorted(keys, h)
            at[at == len(keys)] = 0
            inside = np.arange(width - n + 1) + n <= lengths[:, None]
            out.append(np.where(inside & (keys[at] == h), ids[at], -1))
        return out


def forward(edges: list, points: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Sum over segmentations of each prefix: rows x (width + 1) x languages."""
    rows, width = points.shape
    a = np.zeros((rows, width + 1, p.shape[1]))
    a[:, 0] = 1
    for j in range(1, width + 1):
        none = edges[1][:, j - 1] < 0 if len(edges) > 1 and edges[1] is not None else np.ones(rows, bool)
        a[none, j] = a[none, j - 1] * UNKNOWN
        for n in range(1, min(j, len(edges) - 1) + 1):
            if edges[n] is not None:
                ids = edges[n][:, j - n]
                k = np.flatnonzero(ids >= 0)
                if len(k):
                    a[k, j] += a[k, j - n] * p[ids[k]]
    return a


def backward(edges: list, points: np.ndarray, lengths: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Sum over segmentations of each suffix under one piece distribution: rows x (width + 1)."""
    rows, width = points.shape
    b = np.zeros((rows, width + 1))
    b[np.arange(rows), lengths] = 1
    for j in range(width - 1, -1, -1):
        inside = np.flatnonzero(lengths > j)
        none = inside[edges[1][inside, j] < 0] if len(edges) > 1 and edges[1] is not None else inside
        b[none, j] = b[none, j + 1] * UNKNOWN
        for n in range(1, min(width - j, len(edges) - 1) + 1):
            if edges[n] is not None:
                ids = edges[n][:, j]
                k = np.flatnonzero(ids >= 0)
                if len(k):
                    b[k, j] += p[ids[k]] * b[k, j + n]
    return b


def _runs(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """(runs of at most LONGEST letters, the text each belongs to); a text's first run carries the begin mark."""
    runs, owner = [], []
    for k, t in enumerate(texts):
        for i in range(0, max(len(t), 1), LONGEST):
            runs.append(START + t[:LONGEST] if i == 0 else t[i:i + LONGEST])
            owner.append(k)
    return runs, np.array(owner, np.int64)


def _blocks(runs: list[str], size: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(indexes, code points, lengths) of runs of like length."""
    order = np.argsort(np.fromiter(map(len, runs), np.int64, len(runs)), kind="stable")
    for k in range(0, len(order), size):
        at = order[k:k + size]
        yield at, *_code_points([runs[i] for i in at])


def unique_words(words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    unique, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
    return unique, first, inverse.reshape(-1)


def word_texts(words, at: np.ndarray) -> list[str]:
    data = words.data.tobytes()
    return [data[words.starts[i]:words.ends[i]].decode("utf-8").lower() for i in at]


def prior(pieces: list[str]) -> np.ndarray:
    """Piece probabilities by rank."""
    p = 1.0 / (np.arange(len(pieces)) + 50.0)
    return p / p.sum()


@dataclass
class Model:
    pieces: list[str]
    languages: list[str]
    p: np.ndarray  # pieces x languages
    log_prior: np.ndarray


def _expected(pieces: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, p = Lattice(pieces), prior(pieces)
        uses: dict[str, np.ndarray] = {}
        documents: dict[str, int] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for w in chunks(batch.column(1), ALPHA_WORDS):
                own = langs[w.first:w.first + w.n]
                unique, first, inverse = unique_words(w)
                row = np.repeat(np.arange(w.n), np.diff(w.offsets))
                names = sorted(set(own))
                number = np.array([names.index(x) for x in own])
                weight = np.zeros((len(unique), len(names)))
                if len(row):
                    np.add.at(weight, (inverse, number[row]), 1)
                for x in names:
                    uses.setdefault(x, np.zeros(len(pieces)))
                    documents[x] = documents.get(x, 0) + int((own == x).sum())
                runs, owner = _runs(word_texts(w, first))
                for at, points, lengths in _blocks(runs):
                    edges = lattice.edges(points, lengths)
                    a, b = forward(edges, points, p[:, None])[:, :, 0], backward(edges, points, lengths, p)
                    total = b[:, 0]
                    for n, ids in enumerate(edges):
                        if ids is None:
                            continue
                        r, i = np.nonzero(ids >= 0)
                        use = a[r, i] * p[ids[r, i]] * b[r, i + n] / total[r]
                        for k, x in enumerate(names):
                            uses[x] += np.bincount(ids[r, i], use * weight[owner[at[r]], k], len(pieces))
        for x, u in uses.items():
            some = np.flatnonzero(u)
            yield pa.RecordBatch.from_arrays([pa.array([x] * (len(some) + 1)), pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(u[some], documents[x]))],
                                             names=["lang", "piece", "uses"])
    return run


def hash_bound(count: int, most: int) -> int:
    """Hashes of 62 bits below this choose about ``most`` of ``count`` texts, all if there are no more."""
    return (1 << 62) * min(most, count) // max(1, count)


def fit(df: DataFrame, model_file: str, text: str = "text", lang: str = "lang", max_documents: int = MAX_DOCUMENTS) -> Model:
    """Learns from rows with a language; what comes to the driver is vocabulary x languages numbers."""
    pieces = vocabulary(model_file)
    rows = bounded_batches(df).select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")).where("lang is not null and text is not null")
    # chosen by 62 bits of the text's hash; a text that is repeated often counts once per language
    rows = rows.where(F.shiftrightunsigned(F.xxhash64("text"), 2) < hash_bound(rows.count(), max_documents)).distinct()
    uses = rows.mapInArrow(tidy(_expected(pieces)), "lang string, piece int, uses double").groupBy("lang", "piece").agg(F.sum("uses").alias("uses"))
    got = uses.toArrow()
    names, piece, value = np.array(got.column(0).to_pylist(), object), got.column(1).to_numpy(), got.column(2).to_numpy()
    languages = sorted(set(names))
    c, documents = np.zeros((len(pieces), len(languages))), np.ones(len(languages))
    for k, x in enumerate(languages):
        own = (names == x) & (piece >= 0)
        c[piece[own], k] = value[own]
        documents[k] = value[(names == x) & (piece < 0)].sum()
    p = c + SMOOTH * len(pieces) / 100 * prior(pieces)[:, None]
    return Model(pieces, languages, p / p.sum(axis=0), np.log(documents / documents.sum()))


class Scorer:
    """Log-probabilities of words per language, each distinct word computed once while cached."""

    def __init__(self, model: Model):
        self.model, self.lattice = model, Lattice(model.pieces)
        self.limit = max(10_000, CACHE_CELLS // max(1, len(model.languages)))
        self.entry: dict[int, int] = {}
        self.values = np.zeros((0, len(model.languages)))

    def log_p(self, texts: list[str]) -> np.ndarray:
        runs, owner = _runs(texts)
        each = np.zeros((len(runs), len(self.model.languages)))
        for at, points, lengths in _blocks(runs):
            a = forward(self.lattice.edges(points, lengths), points, self.model.p)
            each[at] = np.log(a[np.arange(len(at)), lengths])
        out = np.zeros((len(texts), each.shape[1]))
        np.add.at(out, owner, each)
        return out

    def rows(self, words) -> np.ndarray:
        """Sum of the words' log-probabilities per row and language."""
        unique, first, inverse = unique_words(words)
        keys = unique.tolist()
        if len(self.entry) + len(keys) > self.limit:
            self.entry, self.values = {}, self.values[:0]
        new = [k for k, h in enumerate(keys) if h not in self.entry]
        if new:
            self.entry.update(zip((keys[k] for k in new), range(len(self.values), len(self.values) + len(new))))
            self.values = np.concatenate([self.values, self.log_p(word_texts(words, first[new]))])
        at = np.fromiter((self.entry[h] for h in keys), np.int64, len(keys))
        row = np.repeat(np.arange(words.n), np.diff(words.offsets))
        per_word = self.values[at] if len(at) else self.values[:0]
        return np.stack([np.bincount(row, per_word[inverse, k], words.n) for k in range(per_word.shape[1])], axis=1)


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def predicted(model: Model, text: Column) -> Column:
    """(lang_pred, score) of a text column."""
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(model) if model.languages else None
        names = np.array([*model.languages, UND], object)
        for batch in texts:
            best, score = np.full(len(batch), len(model.languages)), np.zeros(len(batch))
            for w in chunks(batch, ALPHA_WORDS) if scorer else ():
                total = scorer.rows(w) + model.log_prior
                top = total.argmax(axis=1)
                posterior = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                some = np.diff(w.offsets) > 0
                ascii_letter = ((w.data | 0x20) >= 97) & ((w.data | 0x20) <= 122)
                seen = np.append(0, np.cumsum(ascii_letter))
                for k in np.flatnonzero(some & (seen[w.rows[1:]] == seen[w.rows[:-1]])):
                    some[k] = _has_letter(batch[w.first + int(k)].as_py())
                here = slice(w.first, w.first + w.n)
                best[here] = np.where(some, top, len(model.languages))
                score[here] = np.where(some, np.minimum(posterior, 1.0), 0.0)
            yield pa.StructArray.from_arrays([pa.array(names[best].tolist(), pa.string()), pa.array(score)], fields=list(kind))
        scorer = None
        give_back()
    # once per row, also where a filter on the result is pushed down
    return run.asNondeterministic()(text)


def identify(df: DataFrame, model: Model, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``df`` with the predicted language of each text and its score."""
    df = bounded_batches(df)
    got = F.col(f"`{text}`")
    names = [c for c in df.columns if c not in (lang_pred, score)]
    rows = df.select(*(F.col(f"`{c}`") for c in names), predicted(model, got).alias("__language"))
    return rows.select(*(F.col(f"`{c}`") for c in names), F.col("__language.lang_pred").alias(lang_pred), F.col("__language.score").alias(score))
