import hashlib
import random
import shutil

from cases import CLASHES
from pyspark.sql import functions as F

from arborspark.llm import merkle, warc

SCHEMA = "page_id bigint, url string, html string"


def pages(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("x").alias(c) for c in CLASHES if c not in ("url", "html")])


def faults(spark, a, b, **options):
    return {(r.page_id, r.fault) for r in merkle.audit(pages(spark, a), pages(spark, b), **options).collect()}


def test_faults_are_located(spark):
    rng = random.Random(4)
    ids = rng.sample(range(-50, 5000), 120)
    a = [(i, f"http://x/{i}", f"<p>{i}</p>" * rng.randint(1, 9)) for i in ids]
    altered, missing, extra = ids[:4], ids[4:9], [10_000, -400]
    b = [(i, u, h + "!" if i in altered else h) for i, u, h in a if i not in missing] + [(i, "u", "h") for i in extra]
    want = {(i, "altered") for i in altered} | {(i, "missing") for i in missing} | {(i, "extra") for i in extra}
    assert faults(spark, a, b) == want


def test_many_small_files(spark, monkeypatch):
    """Sparse 64-bit ids over many files; records before the first and behind the last one are extra too."""
    monkeypatch.setattr(merkle, "FILE_RECORDS", 8)
    rng = random.Random(5)
    ids = sorted({rng.randrange(-(2**62), 2**62) for _ in range(300)})
    a = [(i, "u", f"page {i}") for i in ids]
    altered, missing = ids[17:20], ids[100:112]
    extra = [-(2**63), 2**63 - 1, *(i + 1 for i in ids[40:80])]
    b = [(i, u, h + "!" if i in altered else h) for i, u, h in a if i not in missing] + [(i, "u", "h") for i in extra]
    got = merkle.audit(pages(spark, a), pages(spark, b)).collect()
    assert {(r.page_id, r.fault) for r in got} == {(i, "altered") for i in altered} | {(i, "missing") for i in missing} | {(i, "extra") for i in extra}
    assert all(r.file_id == max(0, sum(x <= r.page_id for x in ids) - 1) // 8 for r in got)


def test_string_ids(spark):
    df = lambda rows: spark.createDataFrame(rows, "page_id string, url string, html string")
    got = merkle.audit(df([("a", "u", "1"), ("b", "u", "2"), (None, "u", "3")]), df([("a", "u", "1"), ("b", "u", "x"), ("c", "u", "3")])).collect()
    assert {(r.page_id, r.fault) for r in got} == {("b", "altered"), (None, "missing"), ("c", "extra")}


def test_warc_files(spark, tmp_path):
    """Written, read back, and audited after a flipped byte, a lost record, an added file and a cut one."""
    rows = [(i, f"http://x/{i}", f"<p>{i} é</p>" * (i % 40 + 1), f"f{i // 25}") for i in range(100)] + [(100, None, None, "f3")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, file string")
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    for folder in (a, b):
        warc.write(df, folder)
    back = warc.read(spark, a).orderBy("file", "ordinal").collect()
    assert [(r.record_id, r.url, r.payload.decode(), r.date) for r in back] == [(f"<urn:page:{i}>", u, h or "", "1970-01-01T00:00:00Z") for i, u, h, _ in rows]
    for r in back:
        assert hashlib.sha256(open(f"{a}/{r.file}", "rb").read()[r.offset : r.offset + r.length]).hexdigest() == r.digest
    assert merkle.audit_files(spark, a, b).collect() == []
    at = {r.record_id: r for r in back}

    def damage(file, change):
        data = bytearray(open(f"{b}/{file}", "rb").read())
        with open(f"{b}/{file}", "wb") as f:
            f.write(change(data))

    flipped, lost, ended = at["<urn:page:5>"], at["<urn:page:30>"], at["<urn:page:74>"]
    damage("f0.warc.gz", lambda d: d[: flipped.offset + 30] + bytes([d[flipped.offset + 30] ^ 1]) + d[flipped.offset + 31 :])
    damage("f1.warc.gz", lambda d: d[: lost.offset] + d[lost.offset + lost.length :])
    damage("f2.warc.gz", lambda d: d[:-5])
    shutil.copy(f"{a}/f3.warc.gz", f"{b}/f9.warc.gz")
    got = merkle.audit_files(spark, a, b).collect()
    extra = [r for r in got if r.file == "f9.warc.gz"]
    assert len(extra) == 26 and {r.fault for r in extra} == {"extra"}
    assert {(r.file, r.record_id, r.fault, r.offset, r.length) for r in got if r.file != "f9.warc.gz"} == {(r.file, r.record_id, fault, r.offset, r.length) for r, fault in ((flipped, "altered"), (lost, "missing"), (ended, "altered"))}


def test_null_id_beside_minus_one(spark):
    a = [(None, "u", "h"), (-1, "u", "g")]
    assert faults(spark, a, a[1:]) == {(None, "missing")} and faults(spark, a[1:], a) == {(None, "extra")}


def test_offsets_and_digests(spark, monkeypatch):
    monkeypatch.setattr(merkle, "FILE_RECORDS", 2)
    a = [(3, "u", "abc"), (1, "u", "é"), (4096, "u", "z")]
    b = [(3, "u", "abd"), (1, "u", "é"), (4096, "u", "y")]
    got = {r.page_id: r for r in merkle.audit(pages(spark, a), pages(spark, b)).collect()}
    record = lambda html: f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: u\r\nContent-Length: {len(html.encode())}\r\n\r\n{html}\r\n\r\n".encode()
    assert (got[3].offset, got[3].length, got[3].digest) == (len(record("é")), len(record("abc")), hashlib.sha256(record("abc")).hexdigest())
    assert (got[4096].file_id, got[4096].offset) == (1, 0)


def test_odd_rows(spark):
    odd = [(None, "u", "h"), (1, None, "h"), (2, "u", None), (3, "u", ""), (4, "u", "x"), (4, "u", "x"), (5, "u", "long " * 100_000)]
    assert faults(spark, odd, odd) == set()
    assert faults(spark, odd, odd[::-1]) == set()
    assert faults(spark, odd, [(2, "u", "") if r == (2, "u", None) else r for r in odd]) == {(2, "altered")}
    assert faults(spark, odd, odd[:5] + odd[6:]) == {(4, "altered")}
    assert faults(spark, [], []) == set()
    assert faults(spark, odd, []) == {(i, "missing") for i in (None, 1, 2, 3, 4, 5)}
    assert faults(spark, [], [(7, "u", "h")]) == {(7, "extra")}


def test_query_against_its_planted_faults(spark, sf_dir):
    from arborspark.llm.queries import op8_merkle

    ids = [r.page_id for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id").collect()]
    want = {(i, "missing") for i in ids if i % 503 == 11} | {(i, "altered") for i in ids if i % 211 == 7 and i % 503 != 11} | {(i + 100_000_000, "extra") for i in ids if i % 997 == 5}
    assert {(r.page_id, r.fault) for r in op8_merkle(spark, sf_dir).collect()} == want
