import base64
import gzip
import hashlib

import pytest

from riskframe.llm import warc

SCHEMA = "page_id long, url string, html string, at int, digest string, path string, refers_to long"
HTML = ["<p>one</p>", "<p>two</p>", "a\r\n\r\nb", "", "Ünï — 日本", "x" * 300_000]


def rows():
    out = [(i, f"http://h/{i}", HTML[i % len(HTML)]) for i in range(20)]
    out += [(30, None, None), (None, "http://none/", "<p>one</p>"), (19, "http://h/19", HTML[1]), (19, "http://h/19", HTML[1])]
    out += [(40, "http://h/ space\r\nX: y", "unique")]
    return [(*r, 1, "d", "p", 2) for r in out]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.mark.parametrize("least", [0, 8])
def test_equals_brute_force(spark, least):
    path, out = warc.deduplicate_pages(spark.createDataFrame(rows(), SCHEMA), least_bytes=least)
    got = [tuple(r) for r in out.collect()]
    best = {}
    for page, _, html, *_ in rows():
        if len((html or "").encode()) >= least:
            best[digest(html)] = max(best.get(digest(html), -1), -1 if page is None else page)
    want, used = [], set()
    for page, _, html, *_ in sorted(rows(), key=lambda r: -1 if r[0] is None else r[0]):
        d, size = digest(html), len((html or "").encode())
        # Of repeated rows of the largest page_id one is the response.
        first = size < least or (page == best[d] and d not in used)
        used |= {d} if size >= least and first else set()
        want.append((page, size, d, "response" if first else "revisit", None if first else best[d]))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_archives_hold_whole_payloads_and_fresh_headers(spark, tmp_path):
    path, out = warc.deduplicate_pages(spark.createDataFrame(rows(), SCHEMA), folder=f"{tmp_path}/warc")
    assert path == f"{tmp_path}/warc"
    payloads, ids, refers = {}, [], []
    for r in warc.read_archives(spark, path).collect():
        assert gzip.decompress(r["content"]).startswith(b"WARC/1.1\r\n")
        for fields, _, payload in warc.read_records(bytes(r["content"])):
            ids.append(fields["WARC-Record-ID"])
            if fields["WARC-Type"] == "response":
                payloads[fields["WARC-Record-ID"]] = payload
            else:
                assert payload == b"" and fields["WARC-Profile"] == warc.PROFILE
                refers.append((fields["WARC-Refers-To"], fields["WARC-Payload-Digest"]))
    assert len(set(ids)) == len(ids) == len(rows())
    assert {p.decode() for p in payloads.values()} == {r[2] or "" for r in rows()}
    assert all("sha1:" + warc.payload_digest(payloads[to]) == d for to, d in refers)


def test_small_archives_and_empty_table(spark, monkeypatch):
    assert warc.deduplicate_pages(spark.createDataFrame([], SCHEMA))[1].count() == 0
    chunks = warc._Chunks()
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 10)
    assert [chunks.place(b"12345678") for _ in range(4)] == [0, 0, 1, 2]


def test_damaged_archive_is_told(spark):
    good = warc.response_record("1", "u", b"abc", "n")
    with pytest.raises(ValueError):
        list(warc.read_records(gzip.compress(good + b"\r\nxx")))
    with pytest.raises(ValueError):
        list(warc.read_records(gzip.compress(b"HTTP/1.1 200\r\nContent-Length: 0\r\n\r\n\r\n\r\n")))
