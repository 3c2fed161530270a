import base64
import gzip
import hashlib
import io

import pytest

from plumbline.llm.common import new_path
from plumbline.llm.warc import WarcError, members, page_record, parse, read_pages, warc_round_trip, write_archives

PAGES = "page_id long, url string, html string, _sum string, uri string"


def test_round_trip(spark):
    same = "<p>repeated</p>"
    rows = [(5, "http://a/é", same), (2, "http://b", same), (9, None, None), (4, "x", ""), (1, "u", "héllo\r\n\r\nworld"), (2, "http://b", same), (None, "n", "z")]
    rows += [(100 + k, "u", "hot") for k in range(50)]
    df = spark.createDataFrame([(*r, "s", "u") for r in rows], PAGES)
    got = sorted(map(tuple, warc_round_trip(df, "page_id", "url", "html").collect()), key=str)
    want = []
    for i, _, html in rows:
        body = (html or "").encode()
        first = min(k for k, _, h in rows if (h or "") == (html or "") and k is not None) if i is not None else None
        revisit = i is not None and i != first
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=str)
    assert warc_round_trip(df.limit(0), "page_id", "url", "html").count() == 0


def test_members_across_any_chunk():
    whole = b"".join(page_record(str(k), "u", b"x" * k, None if k % 2 else "0") for k in range(40))
    for chunk in (1, 7, 1 << 20):
        assert len(list(members(io.BytesIO(whole), chunk))) == 40
    assert [r[1] for r in read_pages(io.BytesIO(whole))] == list(range(40))


def test_damage_is_found():
    whole = page_record("1", "u", b"payload", None)
    with pytest.raises(WarcError):
        list(members(io.BytesIO(whole[:-3])))
    plain = gzip.decompress(whole)
    for bad in (plain.replace(b"payload\r\n", b"paylaod\r\n"), plain[:-1], plain.replace(b"Content-Length: ", b"Content-Length: 1", 2), b"no record"):
        with pytest.raises(WarcError):
            parse(bad)


def test_ids_of_any_text_long_pages_and_small_archives(spark):
    long = "é<p>" * 800_000
    rows = [("None", "u", "a"), (None, "u", "a"), ("a b/ü>\n", "u", "a"), ("x", None, long), ("y", None, long), ("", "u", "b"), ("z", "u", "c"), ("zz", "u", "c")]
    df = spark.createDataFrame([(*r, "s", "u") for r in rows], PAGES.replace("page_id long", "page_id string"))
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc_round_trip(df, "page_id", "url", "html").collect()}
    assert got == {"None": (1, "response", None), None: (1, "response", None), "a b/ü>\n": (1, "revisit", "None"), "x": (4_000_000, "response", None), "y": (4_000_000, "revisit", "x"), "": (1, "response", None), "z": (1, "response", None), "zz": (1, "revisit", "z")}
    again = warc_round_trip(df, "page_id", "url", "html", at_least=2, archive=100).collect()
    assert {r.page_id: r.record_type for r in again if r.payload_bytes == 1} == dict.fromkeys(["None", None, "a b/ü>\n", "", "z", "zz"], "response")
    manifest = write_archives(df, "page_id", "url", "html", new_path(spark, "w"), archive=1)
    assert [r.n_records for r in manifest.selectExpr("sum(n_records) n_records").collect()] == [8] and manifest.count() == 8
