import hashlib
import io

import pytest

from tideline.llm import queries, warc

BIG = "<p>é payload</p>" * 200
PAGES = [(1, "http://a/\r\nx", BIG), (7, None, BIG), (3, "http://b", BIG), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (8, "u", ""), (9, "u", "x" * 300_000), (9, "u", "x" * 300_000), (None, "n", BIG), (None, "n", None)]


def test_round_trip(spark):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, digest string")
    manifest = warc.write(pages, archive_bytes=2000)
    got = warc.read(manifest).collect()
    assert len(got) == len(PAGES) and sum(r.records for r in manifest.collect()) == len(PAGES)
    want = []
    for page, url, html in PAGES:
        body = (html or "").encode()
        ref = 7 if body == BIG.encode() and page != 7 else None
        want.append((page, url and url.replace("\r\n", "%0D%0A"), "revisit" if ref else "response", len(body), hashlib.sha1(body).hexdigest(), ref, None if ref else body))
    key = lambda r: repr(r[:4])
    assert sorted([(*r[:6], r[6] if r[6] is None else bytes(r[6])) for r in got], key=key) == sorted(want, key=key)


def test_archive_is_a_dictionary_frame_and_independent_records(spark):
    import zstandard

    pages = spark.createDataFrame([(i, "u", f"<html>{i} some body text</html>" * 9) for i in range(50)], "page_id long, url string, html string")
    path = warc.write(pages.coalesce(1)).first().path
    store, inside = warc.filesystem(path)
    raw = store.open_input_stream(inside).read()
    assert int.from_bytes(raw[:4], "little") == warc.DICTIONARY_FRAME
    size = int.from_bytes(raw[4:8], "little")
    shared = zstandard.ZstdCompressionDict(raw[8 : 8 + size])
    rest, n = raw[8 + size :], 0
    while rest:
        one = zstandard.ZstdDecompressor(dict_data=shared).decompressobj()
        assert one.decompress(rest).startswith(b"WARC/1.1\r\nWARC-Type: response")
        rest, n = one.unused_data, n + 1
    assert n == 50


def test_faults_are_found():
    digest = hashlib.sha1(b"abc").hexdigest()
    good = warc.record(1, "u", b"abc", digest, None, "d")
    assert warc.parse(good)["payload"] == b"abc"
    with pytest.raises(ValueError):
        warc.parse(good.replace(b"\r\n\r\nabc", b"\r\n\r\nabd"))
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(b"\0" * 20)))


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(warc.write(pages)).count() == 0


def test_op2_has_every_page(spark):
    sf = "/root/testdata/sf0.01"
    assert queries.op2_warc(spark, sf).count() == spark.read.parquet(f"{sf}/pages.parquet").count()
