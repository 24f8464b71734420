"""Web archives: exact round trips, the index against a scan, and the rules of revisits."""

import random
from base64 import b32encode
from hashlib import sha1

import pytest
from pyspark.sql import functions as F

from flowsentry.llm import warc
from flowsentry.llm.common import file_store, shared_folder

SCHEMA = "page_id long, url string, html string, key string, first int, salt int, file string, payload string"
HOSTS = ["www.a.org", "b.a.org", "A.org", "x.example.com:8080", "[::1]", "10.0.0.1", "é.fr"]


def pages(seed=5, n=300):
    rng = random.Random(seed)
    rows = [(i, f"http://{rng.choice(HOSTS)}/p{rng.randint(0, 40)}{rng.choice(['', '?q=1', '#top'])}",
             f"<p>{rng.randint(0, 120)}</p>") for i in range(n)]
    rows += [(1000 + i, "https://hot.example.com/", "the same on a third of all pages") for i in range(150)]
    rows += [(2000, None, "x"), (2001, "", None), (2002, "http://[bad", ""), (2003, "no host\r\nWARC-Type: evil", "y"),
             (2004, "http://a.org/", "<b>café \U0001f600\r\n\r\n</b>" * 3), (2005, "http://a.org/long", "z" * 3_000_000),
             (None, "http://a.org/none", "<p>7</p>"), (None, "http://a.org/none", "only without an id"),
             (5, rows[5][1], rows[5][2]), (5, rows[5][1], rows[5][2]), (5, "http://zzz.org/", rows[5][2])]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 2, "f", "p") for r in rows], SCHEMA).repartition(5)


def order(page_id):
    return page_id is None, page_id or 0


def expected(rows, min_bytes=0):
    groups, out = {}, []
    for page_id, url, html in rows:
        groups.setdefault((html or "").encode(), []).append((order(page_id), url or "", page_id))
    for payload, members in groups.items():
        members.sort(key=lambda m: m[:2])
        digest = b32encode(sha1(payload).digest()).decode()
        for nth, (_, url, page_id) in enumerate(members):
            revisit = nth > 0 and len(payload) >= min_bytes
            out.append((page_id, len(payload), digest, "revisit" if revisit else "response",
                        members[0][2] if revisit else None))
    return sorted(out, key=str)


def facts(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                   for r in df.drop("payload").collect()), key=str)


@pytest.fixture(scope="module")
def folder(spark):
    """An archive with blocks of seven lines and files of a few records."""
    before = warc.BLOCK_LINES, warc.FILE_BYTES, warc.READ_BYTES
    warc.BLOCK_LINES, warc.FILE_BYTES, warc.READ_BYTES = 7, 2000, 900
    path = shared_folder(spark, "warc")
    manifest = warc.write_archives(frame(spark, pages()), path)
    assert manifest.agg(F.sum("captures")).first()[0] == len(pages())
    assert manifest.filter("blocks > 1").count() > 0
    yield path
    warc.BLOCK_LINES, warc.FILE_BYTES, warc.READ_BYTES = before


def test_every_page_comes_back_by_its_url(spark, folder):
    found = warc.read_records(warc.find(spark, folder, frame(spark, pages())), folder).cache()
    assert facts(found) == expected(pages())
    html = {}
    for page_id, url, text in pages():
        html.setdefault(page_id, set()).add((text or "").encode())
    for r in found.collect():
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) in html[r.page_id]


def test_search_gives_the_captures_of_the_key_alone(spark, folder):
    wanted = ["http://www.a.org/p3", "http://WWW.A.ORG:80/p3#x", "http://a.org/p3", "http://none.org/", None,
              "https://hot.example.com", "http://www.a.org/p3?q=1", "\U0010ffff"]
    for url in wanted:
        urls = spark.createDataFrame([(url,), (url,)], "url string")
        got = sorted((r.page_id for r in warc.find(spark, folder, urls).collect()), key=order)
        want = sorted((p for p, u, _ in pages() if warc.url_key(u or "") == warc.url_key(url or "")), key=order)
        assert got == want
    assert warc.url_key("http://www.a.org/p3") == "org,a,www)/p3"


def test_records_are_well_formed_members(folder):
    import zlib

    store, path = file_store(f"{folder}/archive")
    from pyarrow import fs

    files = store.get_file_info(fs.FileSelector(path))
    assert len(files) > 10
    seen = set()
    for info in files:
        data = store.open_input_file(info.path).read()
        while data:
            one = zlib.decompressobj(31)
            text = one.decompress(data) + one.flush()
            data = one.unused_data
            head = text.split(b"\r\n\r\n")[0].decode().split("\r\n")
            assert head[0] == "WARC/1.1" and sum(h.startswith("WARC-Type: ") for h in head) == 1
            seen.add(next(h for h in head if h.startswith("WARC-Record-ID")))
            assert text.endswith(b"\r\n\r\n")
    assert len(seen) == len(pages())


def test_small_payloads_are_never_revisits(spark):
    path = shared_folder(spark, "warc")
    rows = [(i, f"http://h{i % 3}.org/", "tiny" if i % 2 else "large enough") for i in range(20)]
    warc.write_archives(frame(spark, rows), path, min_bytes=5)
    got = warc.read_records(warc.find(spark, path, frame(spark, rows)), path)
    assert facts(got) == expected(rows, 5)


def test_damaged_payload_is_noticed():
    data = warc.record(1, "http://a.org/", b"body", warc.digest_text(b"body"), 1)
    assert warc.parse(data)[:3] == (1, "http://a.org/", "response")
    with pytest.raises(ValueError):
        warc.parse(data.replace(b"body", b"bodx"))


def test_empty_table(spark):
    path = shared_folder(spark, "warc")
    none = frame(spark, pages(n=1)).limit(0)
    warc.write_archives(none, path)
    assert warc.read_records(warc.find(spark, path, none), path).isEmpty()
    assert warc.find(spark, path, frame(spark, pages(n=1))).isEmpty()
