"""Fingerprints against a plain edit; archives against what was written."""

import base64
import gzip
import hashlib
import io
import random
import struct
from collections import Counter

from pyspark.sql import functions as F

from lattice.llm import merkle, warc

DOCS = "doc_id long, text string, k long, bucket string, borrowed int"


def _plain_likeness(a, b):
    """Share of characters in clauses that both texts have, without digests or trees."""
    if a == b:
        return 1.0
    x, y = (Counter(merkle._CLAUSE.findall(t)) for t in (a, b))
    return 2 * sum(n * len(c) for c, n in (x & y).items()) / (len(a) + len(b))


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], DOCS)


def test_edit_fingerprints_against_brute_force(spark):
    rnd = random.Random(3)
    texts = [None, "", "one", "." * 700 + " " * 900 + "a" * 300, "." * 700 + " " * 800 + "a" * 300, "Same text here. And more.\n\nNew section, with words.", "Same text here. And more.\n\nNew section, with words.", "x" * 5000]
    texts += ["\n".join(" ".join(rnd.choice("ab cd ef gh ij kl".split()) + rnd.choice(["", ".", ","]) for _ in range(rnd.randint(1, 40))) for _ in range(rnd.randint(1, 9))) for _ in range(60)]
    ids = rnd.sample(range(-500, 5000), len(texts))
    got = {r.doc_id: r for r in merkle.edit_fingerprints(spark, _docs(spark, zip(ids, texts, strict=True))).collect()}
    order = sorted(zip(ids, [t or "" for t in texts], strict=True))
    make = merkle.Fingerprinter()
    assert len(got) == len(texts)
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        n = len(t) // 4
        edited = t[: len(t) - n] + after[:n] if n else t
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == make(t) and r.edited_fingerprint == make(edited)
        assert abs(r.near_edited - _plain_likeness(t, edited)) < 1e-9 and abs(r.near_next - _plain_likeness(t, after)) < 1e-9
        assert 0 <= r.near_edited <= 1


def test_edges_of_the_table(spark):
    assert merkle.edit_fingerprints(spark, _docs(spark, [])).count() == 0
    one = merkle.edit_fingerprints(spark, _docs(spark, [(7, "only one. Text here.")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    same = merkle.edit_fingerprints(spark, _docs(spark, [(1, "a b c d"), (1, "a b c d"), (None, "z"), (2, None)])).collect()
    assert len(same) == 4 and len({r.fingerprint for r in same if r.doc_id == 1}) == 1


def test_roots_and_differing_branches():
    make = merkle.Fingerprinter()
    a, b = make("One. Two.\nThree.\n\nFour, five."), make("One. Two.\nThree!\n\nFour, five.")
    assert merkle.root(a) != merkle.root(b) and merkle.differences(a, b) == [(0, 1)] and merkle.differences(a, a) == []
    assert merkle.root(make("x\n")) != merkle.root(make("x"))


PAGES = "page_id long, url string, html string, digest string, head_id long, n long"


def _pages(spark, rows):
    return spark.createDataFrame([(*r, "d", 5, 6) for r in rows], PAGES)


def test_warc_round_trip_with_revisits(spark):
    rows = [(1, "http://a/\r\nX: 1", "<p>é</p>"), (2, None, "<p>é</p>"), (9, "http://b/", "<p>é</p>"), (3, "http://c/", None), (4, "http://d/", ""), (5, "http://e/", "y" * 300_000), (9, "http://b/", "<p>é</p>"), (None, "http://f/", "z")]
    got = warc.round_trip(spark, _pages(spark, rows)).collect()
    assert len(got) == len(rows) and all(r.digest_ok for r in got)
    by = {r.page_id: r for r in got}
    sha = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    assert by[5].payload_digest == sha("y" * 300_000) and by[5].payload_bytes == 300_000
    assert [(by[i].record_type, by[i].refers_to) for i in (1, 2, 9, 3, 4)] == [("revisit", 9), ("revisit", 9), ("response", None), ("revisit", 4), ("response", None)]
    assert by[1].payload_bytes == len("<p>é</p>".encode()) and by[None].record_type == "response"
    assert warc.round_trip(spark, _pages(spark, [])).count() == 0


def test_payloads_predicates_and_threshold(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_pages(spark, _pages(spark, [(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbb"), (4, "u", "bbbb")]), path, min_bytes=3)
    df = warc.read(spark, path, "bytes")
    kept = df.where(F.col("record_type") == "response").select("record_id", "payload").collect()
    assert sorted(bytes(r.payload).decode() for r in kept) == ["aa", "aa", "bbbb"]
    assert warc.read(spark, path).where("record_type = 'warcinfo'").count() >= 1
    reader = warc.WarcReader(path, "none", 1 << 20)
    assert list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit")])) == [] and not reader._wanted({"record_type": "response"})


def test_foreign_archives_are_read():
    block = warc.record("response", "urn:x:1", "2020-01-01T00:00:00Z", warc.http_head(5) + b"hello", "http://x/", Content_Type="application/http; msgtype=response")
    other = warc.record("request", "urn:x:2", "2020-01-01T00:00:00Z", b"GET / HTTP/1.1\r\n\r\n" + b"q" * 50_000, "http://x/")
    for data, gz in ((other + block, False), (gzip.compress(other) + gzip.compress(block), True), (warc.gzip_member(other) + warc.gzip_member(block), True)):
        rows = list(warc.read_records(io.BytesIO(data), gz, lambda r: r["record_type"] == "response", "bytes"))
        assert len(rows) == 1 and rows[0][-1] == b"hello" and rows[0][6] == 5


def test_appends_add_and_overwriting_clears(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    pages = lambda: sorted(warc.page_id(r.record_id) for r in warc.read(spark, path).where("record_type = 'response'").collect())
    for i in (1, 2):
        warc.write_pages(spark, _pages(spark, [(i, "u", f"text {i}")]), path)
        assert pages() == list(range(1, i + 1))
    row = _pages(spark, [(3, "u", "x")]).selectExpr("page_id", "url", "cast(html as binary) as payload", "'D' as digest", "cast(null as long) as refers_to", "cast(null as string) as refers_to_url")
    row.write.format("warc").mode("overwrite").save(path)
    assert pages() == [3] and len(list((tmp_path / "w").glob("*.warc.gz"))) == 1


def test_members_with_other_extra_fields():
    block = warc.record("response", "urn:x:1", "2020-01-01T00:00:00Z", warc.http_head(5) + b"hello", "http://x/", Content_Type="application/http; msgtype=response")
    plain = gzip.compress(block)
    extra = b"sl" + struct.pack("<HII", 8, len(plain), len(block))  # two lengths of 32 bits, as other writers have them
    member = plain[:3] + b"\x04" + plain[4:10] + struct.pack("<H", len(extra)) + extra + plain[10:]
    for kind in ("response", "none"):
        assert len(list(warc.read_records(io.BytesIO(member * 5), True, lambda r, k=kind: r["record_type"] == k, "none"))) == (5 if kind == "response" else 0)


def test_rows_of_one_id_are_dealt_out(spark):
    rows = [(7, f"text number {i}. And more") for i in range(400)] + [(i, "z") for i in range(20)]
    dealt, _ = merkle._with_successor(spark, _docs(spark, rows).select("doc_id", "text"))
    assert max(r["count"] for r in dealt.where("borrowed = 0").groupBy("bucket").count().collect()) < 150
    assert merkle.edit_fingerprints(spark, _docs(spark, rows)).count() == len(rows)
