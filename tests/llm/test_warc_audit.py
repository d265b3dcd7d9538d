import gzip
import hashlib

import pytest

from promspark.llm import queries
from promspark.llm import warc_audit as W
from promspark.llm.oracles import OP8

from .duck import same

SCHEMA = "page_id bigint, url string, html string, record string"
ROWS = [(k, f"http://x/{k}" if k % 5 else None, ["<p>text\r\n\r\nmore</p>" * (k % 7), None, "", "é\nü", "WARC/1.0\r\n\r\nContent-Length: 3\r\n\r\n"][k % 5], "x") for k in range(200)]
ROWS += [(None, "u\r\nv", "<p>", "x"), (7, "u", "<p>", "x"), (7, "u", "<p>", "x"), (900, "u", "y" * 400_000, "x")]


@pytest.fixture()
def replicas(spark, tmp_path):
    """Two equal replicas of small files; and the files of the second, to damage."""
    record = W.records(spark.createDataFrame(ROWS, SCHEMA).repartition(3)).select("record").cache()
    for s in "ab":
        W.write(record, str(tmp_path / s), records_per_file=10)
    files = sorted((tmp_path / "b").glob("part-*.gz"), key=lambda f: W.FILE.search(f.name).groups())
    for crc in (tmp_path / "b").glob(".*.crc"):
        crc.unlink()
    return str(tmp_path / "a"), str(tmp_path / "b"), files


def found(spark, a, b, fanout=3):
    return W.audit(W.leaves(spark, a), W.leaves(spark, b), fanout).orderBy("file_no", "idx").collect()


def test_files_are_whole_and_parse(spark, replicas):
    a, _, files = replicas
    rows = W.leaves(spark, a).collect()
    assert len(rows) == len(ROWS) and all(r.sound for r in rows)
    assert sorted(r.payload for r in rows) == sorted(hashlib.sha256((h or "").encode()).hexdigest() for _, _, h, _ in ROWS)
    text = gzip.decompress(files[0].read_bytes())
    assert text.startswith(b"WARC/1.0\r\n") and text.endswith(b"\r\n\r\n") and len(files) > 15
    first = min((r for r in rows), key=lambda r: (r.file_no, r.idx))
    assert first.start == 0 and {r.idx for r in rows} <= set(range(10))


def test_equal_replicas_have_equal_roots(spark, replicas):
    a, b, _ = replicas
    x, y = (W.leaves(spark, p) for p in (a, b))
    both = x.withColumn("side", W.F.lit("a")).union(y.withColumn("side", W.F.lit("b")))
    got = W.roots(both, 3)
    assert got["a"] == got["b"] and found(spark, a, b) == []


def test_one_byte_is_located(spark, replicas):
    a, b, files = replicas
    data = bytearray(gzip.decompress(files[4].read_bytes()))
    at = data.index(b"WARC-Date") + 15
    data[at] ^= 1
    files[4].write_bytes(gzip.compress(bytes(data)))
    got = found(spark, a, b)
    assert len(got) == 1 and got[0].start_b <= at < got[0].start_b + got[0].length_b and got[0].damaged == "neither"


def test_damage_to_payloads_ends_streams_and_whole_files(spark, replicas):
    a, b, files = replicas
    data = bytearray(gzip.decompress(files[2].read_bytes()))
    want = [r for r in sorted(W.leaves(spark, a).collect(), key=lambda r: (r.file_no, r.idx))]
    names = sorted({r.file_no for r in want})
    number = {f.name: W.FILE.search(f.name) for f in files}
    no = lambda f: int(number[f.name][1]) * W.FILES_PER_PART + int(number[f.name][2] or 0)
    hit = next(r for r in want if r.file_no == no(files[2]) and r.payload == hashlib.sha256('é\nü'.encode()).hexdigest())
    data[hit.start + hit.length - 5] ^= 1  # in the payload
    files[2].write_bytes(gzip.compress(bytes(data)))
    files[5].write_bytes(files[5].read_bytes()[:-40])  # cut off
    files[7].unlink()
    files[9].write_bytes(b"not gzip")
    got = found(spark, a, b)
    by_file = {n: [r for r in got if r.file_no == n] for n in names}
    assert [(r.idx, r.damaged) for r in by_file[no(files[2])]] == [(hit.idx, "b")]
    assert by_file[no(files[5])] and all(r.damaged in ("b", "both") for r in by_file[no(files[5])])
    for gone in (7, 9):
        assert len([r for r in by_file[no(files[gone])] if r.record_id_a]) == sum(r.file_no == no(files[gone]) for r in want)
    assert sum(map(len, by_file.values())) == len(got) and {r.file_no for r in got} == {no(files[k]) for k in (2, 5, 7, 9)}


def test_empty_table(spark, tmp_path):
    none = W.records(spark.createDataFrame([], SCHEMA)).select("record")
    W.write(none, str(tmp_path / "e"))
    assert W.leaves(spark, str(tmp_path / "e")).count() == 0 and found(spark, str(tmp_path / "e"), str(tmp_path / "e")) == []


def test_query_against_sql(spark):
    assert same(queries.op8_warc_audit(spark, "/root/testdata/sf0.01"), OP8, "/root/testdata/sf0.01")


def test_files_of_a_task_have_numbers_of_their_own(spark, tmp_path):
    name = "file:/x/part-%05d-0b1c2d3e-aaaa-bbbb-cccc-0123456789ab-c%03d.txt.gz"
    seen = [W.file_number(name % (t, c)) for t in range(3) for c in (0, 1, 4095, 4096, 999_999)]
    assert seen == sorted(set(seen))
    with pytest.raises(ValueError):
        W.file_number(name % (0, 1 << 20))
    rows = spark.range(0, 4200, 1, 2).selectExpr("id page_id", "'u' url", "'text' html").coalesce(1).union(spark.range(4200, 4203, 1, 1).selectExpr("id", "'u'", "'text'"))
    W.write(W.records(rows).select("record"), str(tmp_path / "many"), records_per_file=1)
    got = W.leaves(spark, str(tmp_path / "many"))
    assert got.count() == got.select("file_no", "idx").distinct().count() == 4203
