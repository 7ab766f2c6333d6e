import base64
import gzip
import hashlib
import io
from pathlib import Path

from sparkveil.llm import warc


def brute(rows, least):
    first = {}
    for i, h in rows:
        p = (h or "").encode()
        if len(p) >= least and i is not None:
            first[p] = min(i, first.get(p, i))
    out = []
    for i, h in rows:
        p = (h or "").encode()
        refers = first.get(p) if len(p) >= least and first.get(p) != i else None
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if refers is not None else "response", refers))
    return sorted(out, key=str)


def pages(spark, rows):
    return spark.createDataFrame([(i, f"http://x/{i}\r\nevil: 1", h, "q") for i, h in rows], "page_id long, url string, html string, digest string")


def test_round_trip_matches_brute_force(spark):
    rows = [(i, f"<p>é {i % 7}</p>\r\n\r\nWARC/1.1\r\n" * (i % 3)) for i in range(80)] + [(100, None), (101, ""), (102, "x" * 3_000_000), (103, "x" * 3_000_000), (None, "lone"), (5, "again"), (5, "again")]
    for least in (0, 40):
        got = warc.round_trip(pages(spark, rows), least).drop("url")
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows, least)
    assert warc.round_trip(pages(spark, [])).collect() == []


def test_chunks_carry_running_digests_and_files_are_warc(spark, tmp_path):
    body = "é<b>" * 400_000
    recs = warc.with_references(pages(spark, [(1, body), (2, body), (3, "a")])).select("page_id", "url", "payload", "digest", "refers_to")
    archives = warc.write_archives(recs, f"file://{tmp_path}/a")
    chunks = warc.read_archives(archives, chunk_bytes=100_000).collect()
    mine = sorted((c for c in chunks if c.page_id == 1), key=lambda c: c.chunk_no)
    seen = b""
    for k, c in enumerate(mine):
        seen += c.data
        assert (c.chunk_no, c.payload_bytes, c.is_last) == (k, len(seen), k == len(mine) - 1)
        assert c.payload_digest == base64.b32encode(hashlib.sha1(seen).digest()).decode()
        assert len(c.data) <= 100_000
    assert seen == body.encode() and len(mine) == 20
    for file in Path(tmp_path, "a").glob("*.warc.gz"):
        raw = gzip.open(file).read()
        assert raw.startswith(b"WARC/1.1\r\n")
        assert [f["WARC-Type"] for f, p in warc.records_of(io.BytesIO(file.read_bytes())) if [*p] or True]


def test_archive_table_reads_like_archives(spark, tmp_path, monkeypatch):
    rows = [(i, f"<p>{i % 5}</p>" * (i % 40)) for i in range(60)] + [(99, "y" * 2_500_000)]
    monkeypatch.setattr(warc, "arrow_opens", lambda uri: False)
    assert sorted(map(tuple, warc.round_trip(pages(spark, rows)).drop("url").collect()), key=str) == brute(rows, 0)
    monkeypatch.undo()
    assert warc.arrow_opens(f"file://{tmp_path}") and not warc.arrow_opens("viewfs://store/x")
