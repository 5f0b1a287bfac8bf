import base64
import hashlib
from pathlib import Path

import pytest

from dayglass.llm import warc
from dayglass.llm.common import shared_path

FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: {0}\r\n\r\n{1}\r\n\r\n"
PAGES = [
    (1, "http://a", "<p>one</p>"),
    (2, "http://b", None),
    (3, None, ""),
    (4, "http://d\r\nWARC-Type: revisit", "<p>one</p>"),
    (5, "http://e", "before " + FAKE.format(4, "fake") + FAKE.format(10**15, "huge") + "WARC/1.0\r\n\r\n after"),
    (6, "http://f", FAKE.format(7, "é😀!") * 40),
    (7, "http://g", "\r\n\r\n\r\n\r\n"),
    (8, "http://h", "long " * 60_000),
    (None, "http://i", "<p>one</p>"),
    (9, "http://a", "<p>one</p>"),
    (9, "http://a", "<p>one</p>"),
]


def expected(least):
    out = []
    for page, _, html in PAGES:
        payload = (html or "").encode()
        same = [p for p, _, h in PAGES if (h or "") == (html or "") and p is not None]
        last = max(same)
        revisit = page is not None and len(payload) >= least and page < last
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((page or -1, len(payload), digest, "revisit" if revisit else "response", last if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 5])
@pytest.mark.parametrize("range_bytes", [1 << 22, 97])
def test_round_trip(spark, least, range_bytes):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").selectExpr("*", "1 as digest", "2 as n", "'x' as value")
    path = shared_path(spark, "test-archives")
    warc.write_archives(pages.coalesce(1), path, least)
    found = warc.candidates(spark, path, range_bytes)
    assert found.where("page_id = 666").count() >= 40
    got = warc.reachable(found).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(((r[0] or -1, *r[1:]) for r in map(tuple, got.collect())), key=repr) == expected(least)


def test_whole_operator_and_empty_table(spark):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    got = [((r[0] or -1), *r[1:]) for r in map(tuple, warc.round_trip(pages).collect())]
    assert sorted(got, key=repr) == expected(0)
    assert warc.round_trip(pages.where("false")).count() == 0


@pytest.mark.parametrize("range_bytes", [1 << 22, 50_000])
def test_heads_of_any_length(spark, range_bytes):
    sizes = {1: 70_000, 2: 10, 3: 65_536, 4: 300_000, 5: 20, 6: 65_300}
    rows = [(k, f"data:{k},WARC/1.0 " + "u" * n, f"<p>{k}</p>") for k, n in sizes.items()]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    path = shared_path(spark, "test-long-heads")
    warc.write_archives(pages.coalesce(1), path)
    got = warc.reachable(warc.candidates(spark, path, range_bytes)).collect()
    assert sorted(r.page_id for r in got) == sorted(sizes)
    assert sorted(r.page_id for r in warc.round_trip(pages).collect()) == sorted(sizes)


@pytest.mark.parametrize("cut", [1, 40, 150])
def test_broken_chain_is_an_error(spark, tmp_path, cut):
    path = shared_path(spark, "test-broken")
    warc.write_archives(spark.createDataFrame(PAGES[:1], "page_id bigint, url string, html string").coalesce(1), path)
    whole = b"".join(p.read_bytes() for p in Path(path).glob("part-*"))
    (tmp_path / "one.warc").write_bytes(whole + whole[:-cut])
    with pytest.raises(ValueError, match="one.warc"):
        warc.read_archives(spark, str(tmp_path))
