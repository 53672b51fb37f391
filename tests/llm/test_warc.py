import hashlib
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from corvane.llm import warc as W


@pytest.fixture
def pages(spark):
    rng = random.Random(4)
    big = "<p>" + "same " * 400 + "</p>"
    rows = [(i, f"http://h/{i}", "<b>" + "".join(rng.choices("abc é漢\r\n", k=rng.choice([0, 10, 999, 1000, 3000]))) + "</b>") for i in range(60)]
    rows += [(100 + i, f"http://copy/{i}", big) for i in range(30)] + [(200, None, None), (201, "http://x/a b\r\nc", ""), (None, "http://n", big), (None, "http://n", "tiny"), (7, "http://again", "x" * 1200), (7, "http://again", "x" * 1200), (-5, "u", "x" * 1200), (300, "u", "long " * 200_000), (2**63 - 1, "m", "m"), (-(2**63), "m", "m")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for n in ("id", "body", "sha1", "bundle"):
        df = df.withColumn(n, F.lit("x"))
    return rows, df


def brute(rows):
    most = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000:
            most[b] = max(most.get(b, (False, 0)), (i is not None, i or 0))
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        m = most.get(b)
        again = m is not None and m[0] and i != m[1]
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", m[1] if again else None))
    return sorted(out, key=str)


def test_round_trip(spark, pages, tmp_path):
    rows, df = pages
    path = f"file://{tmp_path}/out"
    W.write_warc(df, path)
    t = W.read_warc(spark, path, payloads=True).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in t), key=str) == brute(rows)
    texts = {}
    for i, _, h in rows:
        texts.setdefault(i, set()).add((h or "").encode())
    assert all(bytes(r.payload) in texts[r.page_id] for r in t if r.record_type == "response")


def test_bundles_follow_the_seekable_format(spark, pages, tmp_path, monkeypatch):
    rows, df = pages
    path = f"{tmp_path}/out"
    W.write_warc(df.coalesce(1), f"file://{path}")
    files = list(tmp_path.glob("out/bundle=*/*.txt"))
    assert files
    n = 0
    for f in files:
        body = f.read_bytes()
        assert body[-4:] == W.SEEKABLE_MAGIC
        table = W.seek_table(body)
        assert len(table) > 2  # more than one frame of records
        # any reader of the format inflates the whole file: skippable frames hold nothing
        whole = zstandard.ZstdDecompressor().stream_reader(body, read_across_frames=True).read()
        assert len(whole) == sum(x for *_, x in table) and whole.startswith(b"WARC/1.1\r\n")
        for record, frame, offset in W.record_index(body):
            at, size, inflated = table[frame]
            got = W.parse(zstandard.ZstdDecompressor().decompress(body[at : at + size], max_output_size=inflated), offset)
            assert got["page_id"] == W.page_of(record)
            n += 1
        one = list(W.fetch(body, 300))
        assert all(x["payload_bytes"] == 1_000_000 for x in one)
    assert n == len(rows)


@pytest.mark.parametrize("x", [None, 0, 1, -1, 2**62, 2**63 - 1, -(2**63)])
def test_identifiers_fit_in_records(x):
    u = W.record_uuid(x)
    assert W.page_of(u) == x and u.version == 8


def test_small_bundles(spark, pages, tmp_path, monkeypatch):
    b = W.Bundle()
    for i in range(500):
        b.add(i, W.record(i, "u", b"x" * 2000, hashlib.sha1(b"x" * 2000).hexdigest(), None, False))
    body = b.finish()
    assert len(W.seek_table(body)) == -(-500 * (2000 + 300) // W.FRAME_BYTES) + 1 or len(W.seek_table(body)) > 3
    assert [r["page_id"] for r in W.fetch(body, 321)] == [321]


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    W.write_warc(df, f"file://{tmp_path}/none")
    assert W.read_warc(spark, f"file://{tmp_path}/none").count() == 0
