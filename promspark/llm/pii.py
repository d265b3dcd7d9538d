"""Operator 6: personal data by pattern, checksum and context.

Patterns propose spans, checksums and range checks confirm them (Luhn for
cards, mod-97 for IBANs, byte ranges for addresses, digit counts for phone
numbers), and words near a span raise or lower its score.

Kinds ``email``, ``ip``, ``card`` and ``phone`` are the base: a proposal that
passes its check is a span whatever its score.  ``iban``, ``ssn`` and
``secret`` are added by the method: they are spans if checked and if their
score, moved by context words, reaches ``threshold``.

Everything is one pass over the rows without a shuffle.  A null text has no
spans; an empty one neither.  Rows are independent, so ties and repeated
rows need no rule.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE = KINDS[:4]

# fixed values: patterns of the kinds
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # whole digit runs: the same matches as without the look-behind, in linear time
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
SECRET = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36})(?![0-9A-Za-z])")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# fixed values: score before context, and words that move it by ``STEP``
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.4, "secret": 0.4}
CONTEXT = {
    "email": re.compile(r"e-?mail|contact|correo|courriel", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|adresse", re.I),
    "card": re.compile(r"card|visa|credit|debit|carte|karte|tarjeta", re.I),
    "phone": re.compile(r"phone|call|tel|mobile|fax|anruf", re.I),
    "iban": re.compile(r"iban|account|bank|konto|compte|cuenta", re.I),
    "ssn": re.compile(r"ssn|social|security|taxpayer", re.I),
    "secret": re.compile(r"token|secret|api|key|passw|credential|bearer", re.I),
}
AGAINST = re.compile(r"example|sample|dummy|isbn|version|commit|sha-?1|sha-?256|md5|checksum", re.I)
STEP, NEAR = 0.3, 40


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of ``[local]+@label(.label)+``.

    No local character is an at sign, so each match holds the run before one
    at sign, cut at the end of the match before it."""
    done, at = 0, text.find("@")
    while at >= 0:
        tail = DOMAIN.match(text, at + 1)
        if tail:
            start = at
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                done = tail.end()
                yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds."""
    out = [(a, 0, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= sum(map(str.isdigit, m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return out


def added_spans(text: str) -> list[tuple[int, int, int]]:
    out = []
    for m in IBAN.finditer(text):
        plain = m[0].replace(" ", "")
        if 15 <= len(plain) <= 34 and mod97(plain):
            out.append((m.start(), 4, m.end()))
    for m in SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            out.append((m.start(), 5, m.end()))
    out += [(m.start(), 6, m.end()) for m in SECRET.finditer(text)]
    return out


def score(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - NEAR):start] + " " + text[end:end + NEAR]
    value = SCORE[kind] + STEP * bool(CONTEXT[kind].search(near)) - STEP * bool(AGAINST.search(near))
    return round(min(1.0, max(0.0, value)), 3)


def find(text: str | None, threshold: float = 0.5) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of every span, by start, then kind."""
    if not text:
        return []
    found = [(a, k, b, score(text, KINDS[k], a, b)) for a, k, b in base_spans(text)]
    for a, k, b in added_spans(text):
        s = score(text, KINDS[k], a, b)
        if s >= threshold:
            found.append((a, k, b, s))
    return [(KINDS[k], a, b, s) for a, k, b, s in sorted(found)]


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
SPAN_SQL = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def _spans_udf(threshold: float):
    @F.arrow_udf(SPAN_SQL)
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            rows = ([{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in find(t, threshold)] for t in batch.to_pylist())
            yield pa.array(rows, pa.list_(SPAN))
    return run


def spans(df: DataFrame, text: str = "text", threshold: float = 0.5, out: str = "pii") -> DataFrame:
    """``df`` with a column ``out`` of (kind, start, end, score); a column of that name is replaced."""
    return bounded_batches(df).withColumn(out, _spans_udf(threshold)(F.col(f"`{text}`")))


def masked(text: str | None, threshold: float) -> str | None:
    """The text with each run of overlapping spans replaced by the kind of its first one."""
    if not text:
        return text
    out, done = [], 0
    for kind, a, b, _ in find(text, threshold):
        if a >= done:
            out += [text[done:a], f"<{kind}>"]
        done = max(done, b)
    return "".join(out) + text[done:] if out else text


def redact(df: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``df`` with personal data in ``text`` replaced by its kind; a null text stays null."""
    @F.arrow_udf("string")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([masked(t, threshold) for t in batch.to_pylist()], pa.string())
    return bounded_batches(df).withColumn(text, run(F.col(f"`{text}`")))


def digest(df: DataFrame, text: str = "text", threshold: float = 0.5, key: str = "doc_id") -> DataFrame:
    """Per row: the key, span counts of the base kinds, the SHA-256 of the base spans and all spans
    as ``kind:start:end``, by start and then kind."""
    def joined(column: str):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    rows = spans(df.select(F.col(key), F.col(f"`{text}`").alias("text")), "text", threshold, "pii")
    rows = rows.select(key, "pii", F.filter("pii", lambda s: s["kind"].isin(*BASE)).alias("base"))
    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return rows.select(key, *map(count, BASE), F.sha2(joined("base"), 256).alias("base_sha256"), joined("pii").alias("spans"),
                       F.transform("pii", lambda s: s["score"]).alias("scores"))
