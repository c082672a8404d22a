import base64
import hashlib
import random

from primeweft.llm.op5_warc import archive_and_read, parse, record, surt


def test_surt():
    assert surt("https://WWW.Example.org/a/b?q=1#f") == "org,example,www)/a/b?q=1"
    assert surt("http://x.com") == "com,x)/"
    assert surt(None) == surt("") == "-"


def test_record_round_trip():
    got = parse(record(7, "http://a.b/ c\n", b"x\r\n\r\ny", base64.b32encode(hashlib.sha1(b"x\r\n\r\ny").digest()).decode(), None))
    assert (got["page_id"], got["record_type"], got["payload"]) == (7, "response", b"x\r\n\r\ny")


def brute(rows, least=0):
    out = []
    for page, _, html, *_ in rows:
        payload = (html or "").encode()
        same = [p for p, _, h, *_ in rows if (h or "").encode() == payload and p is not None]
        best = max(same, default=None)
        revisit = best is not None and best != page and len(payload) >= least
        out.append((page, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", best if revisit else None))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    r = random.Random(2)
    bodies = ["", None, "<p>a</p>", "é\r\n\r\nx", "z" * 200_000] + [str(r.random()) for _ in range(40)]
    rows = [(i, r.choice(["http://h.org/%d" % (i % 7), "https://H.org", None, "", "a b\tc", "http://user@x.y:80/?q#z"]), r.choice(bodies), "extra") for i in range(1200)]
    rows += [rows[3], rows[3], (None, "http://n.org/", "only null", "e"), (None, None, None, "e"), (-5, "http://h.org/1", "<p>a</p>", "e")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, start string")
    for least in (0, 9):
        got = archive_and_read(pages, least=least, parts=3, payloads=True).collect()
        assert sorted((tuple(x)[:5] for x in got), key=str) == brute(rows, least)
    assert archive_and_read(pages.limit(0)).count() == 0
