import hashlib
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from promspark.llm import pii, queries

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def brute(text):
    """The base kinds straight from their definition."""
    out = []
    for k, p in enumerate((EMAIL, re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"))):
        for m in p.finditer(text or ""):
            d = [int(c) for c in m[0] if c.isdigit()]
            luhn = sum(d[::-1][0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[::-1][1::2])
            if [True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 14 <= len(d) <= 19 and luhn % 10 == 0, 10 <= len(d) <= 15][k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1.@-+ 9éB(4", max_size=40))
def test_base_spans_follow_the_patterns(text):
    assert sorted(pii.base_spans(text)) == brute(text)


def test_checks():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")
    kinds = lambda t: [s[0] for s in pii.find(t)]
    assert kinds("IBAN GB82 WEST 1234 5698 7654 32.") == ["iban"]
    assert kinds("ssn 123-45-6789") == ["ssn"] and kinds("row 123-45-6789") == []
    assert kinds("token = " + "0af3" * 10) == ["secret"] and kinds("sha256 " + "0af3" * 16) == []


def test_context_moves_the_score_but_keeps_base_spans():
    with_, against = pii.find("card 4111111111111111"), pii.find("sample isbn 4111111111111111")
    assert with_[0][3] > against[0][3] and against[0][0] == "card"


def test_query_over_whole_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op6_pii(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        base = brute(texts[r.doc_id])
        said = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert set(said.split(",")) - {""} <= set(r.spans.split(","))


def test_edges(spark, docs):
    df = docs([None, "", "x" * 200_000 + " a@b.co", "a@b.co", "a@b.co"]).withColumnRenamed("source", "pii")
    rows = pii.spans(df).collect()
    assert [len(r.pii) for r in rows] == [0, 0, 1, 1, 1]
    assert rows[2].pii[0].start == 200_001
    assert pii.digest(df.limit(0)).count() == 0
    assert [r.text for r in pii.redact(df).collect()][-2:] == ["<email>"] * 2
    assert pii.redact(df).first().text is None


@pytest.mark.parametrize("text,want", [("a 1.2.3.4 b@c.de f", "a <ip> <email> f"), ("none", "none")])
def test_mask(text, want):
    assert pii.masked(text, 0.5) == want


def test_long_digit_runs_take_linear_time():
    for text in ("7" * 400_000, "1.1.1." + "7" * 400_000, "7" * 200_000 + ".1.1.1", "1." * 200_000):
        start = time.perf_counter()
        found = list(pii.base_spans(text))
        assert time.perf_counter() - start < 10
        assert not any(k == 1 and e - s > 20 for s, k, e in found)
