import struct
import uuid

import pytest
import zstandard

from tarnwell.llm import common as C
from tarnwell.llm import warc as W

SCHEMA = "page_id long, url string, html string, file string, at string"


def pages(spark):
    body = "<html><body>" + "<p>some text of the page</p>" * 20
    rows = [(i, f"http://h{i % 3}.example.com/{i}", f"{body}<p>{i}</p>\r\n\r\n") for i in range(200)]
    rows += [(None, None, None), (7, "http://x/\r\ny", ""), (7, "http://x/\r\ny", ""), (300, "http://é.example/漢", "é漢😀" * 100_000), (None, "http://n", "x")]
    return spark.createDataFrame([(*r, "own", "own") for r in rows], SCHEMA)


def key(r):
    return (str(r[0]), (r[1] or "").replace("\r", "").replace("\n", ""), r[2] or "")


def test_round_trip_and_single_records(spark, tmp_path):
    folder = f"file://{tmp_path}/warc"
    df = pages(spark).repartition(3)
    index = C.durable(W.write(df, folder), "index").collect()
    want = sorted(key(r) for r in df.collect())
    assert sorted(key(r) for r in W.read(spark, folder).collect()) == want and len(index) == len(want)
    for r in index[::23]:
        fields, body = W.fetch(folder, r.file, r.at, r.length)
        assert fields["WARC-Payload-Digest"] == r.digest and int(fields["Content-Length"]) == len(body) and fields.get("X-Page-ID") == (None if r.page_id is None else str(r.page_id))
    assert not [p for p in (tmp_path / "warc").iterdir() if p.name.startswith(".part")]


def test_layout(spark, tmp_path):
    W.write(pages(spark).coalesce(1), f"file://{tmp_path}/w").collect()
    data = next((tmp_path / "w").glob("*.warc.zst")).read_bytes()
    magic, n = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D
    raw = zstandard.ZstdDecompressor().decompress(data[8 : 8 + n])
    assert raw[:4] == b"\x37\xa4\x30\xec"  # a Zstandard dictionary
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    first = d.decompressobj().decompress(data[8 + n :])
    assert first.startswith(b"WARC/1.1\r\n") and first.endswith(b"\r\n\r\n") and first.count(b"WARC/1.1") == 1


def test_dictionary_helps(spark, tmp_path):
    df = pages(spark).where("page_id < 200")
    a = sum(r.length for r in W.write(df, f"file://{tmp_path}/a").collect())
    b = sum(r.length for r in W.write(df, f"file://{tmp_path}/b", W.WarcConfig(sample=0)).collect())
    assert a < 0.7 * b


def test_dictionary_of_a_repeated_key(spark, tmp_path):
    html = "<html>" + "".join(f"<p>{i * i} of the one page</p>" for i in range(300)) + "</html>"
    one = spark.range(6000).selectExpr("7L AS page_id", "'http://x/' AS url", f"'{html}' AS html")
    data = W.build_dictionary(one, W.WarcConfig())
    assert len(data) > 5000 and data == W.record(7, "http://x/", html, W.WarcConfig())[-(64 << 10) :]
    many = spark.range(6000).selectExpr("7L AS page_id", "'http://x/' AS url", f"concat('{html}', id) AS html")
    assert W.build_dictionary(many, W.WarcConfig())[:4] == b"\x37\xa4\x30\xec"
    folder = f"file://{tmp_path}/one"
    index = W.write(one.limit(50), folder).collect()
    assert sum(r.length for r in index) < 50 * 200 and {r.html for r in W.read(spark, folder).collect()} == {html}
    assert W.fetch(folder, index[-1].file, index[-1].at, index[-1].length)[1].decode() == html


def test_the_sample_is_bounded_in_bytes(spark):
    df = spark.range(40).selectExpr("id AS page_id", "'http://x/' AS url", "repeat(cast(id AS string), 1000) AS html").union(spark.sql("SELECT 99L, 'u', repeat('x', 100000)"))
    few = W.build_dictionary(df, W.WarcConfig(sample_bytes=20_000, dictionary_bytes=1 << 20))
    assert 0 < len(few) < 20_000 + 40 * 400 and b"xxxxx" not in few
    assert W.build_dictionary(df, W.WarcConfig(sample_bytes=8)) == b""


def test_empty_and_damaged(spark, tmp_path):
    assert W.archive(pages(spark).limit(0)).collect() == []
    with pytest.raises(ValueError):
        W.dictionary_of(b"12345678")
    with pytest.raises(ValueError):
        W.parse(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n")
    assert W.archive(pages(spark)).select("folder").distinct().count() == 1
    assert uuid.UUID(W.parse(W.record(1, "u", "h", W.WarcConfig()))[0]["WARC-Record-ID"][10:-1])
