import base64
import gzip
import hashlib
import random

import pytest

from tablework.llm import warc as X

PAGES = "page_id long, url string, html string"


def sha(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


def brute(rows, min_bytes=0):
    out = []
    for i, _, h in rows:
        n = len((h or "").encode())
        ids = [j for j, _, x in rows if (x or "") == (h or "") and j is not None]
        head = max(ids) if ids else i
        if n < min_bytes or i == head:
            out.append((i, n, sha(h), "response", None))
        else:
            out.append((i, n, sha(h), "revisit", head))
    return sorted(out, key=lambda r: tuple((v is None, v) for v in r))


def made(seed, n):
    rng = random.Random(seed)
    body = ["<html>é</html>", "", None, "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nx", "x" * 100_000, "\r\n", "日本"]
    return [(i, rng.choice([f"http://h.example/{i}\r\nX: y", None, "nonsense"]), rng.choice([*body, f"page {i}\n"])) for i in range(n)]


def result(spark, rows, tmp_path, **k):
    path = f"{tmp_path}/warc"
    X.write_archives(spark.createDataFrame([(*r, "c") for r in rows], PAGES + ", record_type string"), path, **k)
    return X.assemble(X.read_records(spark, path)), path


@pytest.mark.parametrize("min_bytes", [0, 10])
def test_round_trip(spark, tmp_path, min_bytes):
    rows = made(1, 80)
    got, _ = result(spark, rows, tmp_path, min_bytes=min_bytes)
    rows_by = {i: h for i, _, h in rows}
    seen = []
    for r in got.collect():
        f = r.metadata.fields
        i = int(f["pageId"])
        head = int(f["refersToPage"]) if "refersToPage" in f else None
        seen.append((i, int(f["payloadLength"]), r.response.payload_digest, r.record_type, head))
        assert r.request is not None
        if r.record_type == "response":
            assert bytes(r.response.payload) == (rows_by[i] or "").encode()
        else:
            assert r.response.refers_to_id == X.record_id(head, r.response.payload_digest, 0, "response")
    assert sorted(seen, key=lambda r: tuple((v is None, v) for v in r)) == brute(rows, min_bytes)


def test_query(spark, tmp_path):
    rows = made(2, 60)
    spark.createDataFrame(rows, PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    out = X.query(spark, str(tmp_path))
    got = sorted((tuple(r) for r in out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()),
                 key=lambda r: tuple((v is None, v) for v in r))
    assert got == brute(rows)


def test_null_and_repeated_ids(spark, tmp_path):
    rows = [(None, "u", "a"), (5, "u", "a"), (5, "u", "a"), (4, "u", "a"), (5, "u", "b"), (None, "u", "c"), (None, "v", "c")]
    got, _ = result(spark, rows, tmp_path)
    seen = [(r.metadata.fields.get("pageId"), r.record_type, r.metadata.fields.get("refersToPage")) for r in got.collect()]
    assert sorted(map(str, seen)) == sorted(map(str, [(None, "revisit", "5"), ("5", "response", None), ("5", "response", None), ("4", "revisit", "5"),
                                                      ("5", "response", None), (None, "response", None), (None, "response", None)]))


def test_empty_table(spark, tmp_path):
    got, _ = result(spark, [], tmp_path)
    assert got.count() == 0


def test_files_are_bounded_and_readable(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "CAPTURES", 5)
    got, path = result(spark, made(3, 60), tmp_path)
    assert got.count() == 60
    import glob
    files = glob.glob(f"{path}/part-*")
    assert len(files) >= 12 and all(gzip.open(f).read(8) == b"WARC/1.1" for f in files)


def test_a_broken_record_ends_its_archive():
    good = X.capture(1, "http://a/", "x", 0, None)
    raw = "\r\n\r\n".join([*good, "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99\r\n\r\nshort"]).encode()
    assert [r["fields"]["warc-type"] for r in X.parse(raw)] == ["request", "response", "metadata"]


def test_files_of_large_payloads_are_bounded(spark, tmp_path, monkeypatch):
    import glob
    monkeypatch.setattr(X, "FILE_BYTES", 1 << 20)
    big = [(i, f"http://a/{i}", f"{i} " + "x" * 300_000) for i in range(12)]
    got, path = result(spark, big, tmp_path)
    assert sorted((r.record_type, r.response.payload_bytes) for r in got.collect()) == sorted(("response", len(h)) for _, _, h in big)
    sizes = [sum(len(r["block"]) for r in X.parse(open(f, "rb").read())) for f in glob.glob(f"{path}/part-*")]
    assert max(sizes) < 1.1 * (1 << 20) and len(sizes) >= 4
