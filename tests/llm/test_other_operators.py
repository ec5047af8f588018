"""WARC, nearest neighbours, URL filters and the pipeline."""

import hashlib
import os
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import cases  # noqa: E402
import corpus_pipeline  # noqa: E402
from tradewind.llm import ann, common, urls, warc  # noqa: E402


def pages(spark):
    big = "é" * 700
    rows = [(i, f"http://h{i}.example.org/p {i}", "x" * (10 * i)) for i in range(120)]
    rows += [(500, "u", big), (501, None, big), (502, "v", big), (502, "v", big), (None, "w", big), (503, "y", None), (504, "z", ""), (505, "q", "x" * 999), (506, "q", "x" * 999)]
    rows.append((600, "gz", "\x1f\x8b\x08" * 50_000))
    return spark.createDataFrame([(*r, "extra", 1) for r in rows], "page_id long, url string, html string, id string, payload int").repartition(3), rows


@pytest.mark.parametrize("split", [977, 8 << 20])
def test_warc_round_trip(spark, split):
    frame, rows = pages(spark)
    manifest = warc.write_archives(warc.with_revisits(frame, "page_id", "url", "html"), archive_bytes=20_000)
    got = warc.read_archives(manifest, split_bytes=split).collect()
    want = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        largest = max((p for p, _, h in rows if len(raw) >= 1000 and h == html and p is not None), default=page_id)
        want.append((page_id, len(raw), hashlib.sha1(raw).hexdigest(), "response" if page_id == largest else "revisit", None if page_id == largest else largest))
    assert sorted(((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.payload == next((h or "").encode() for p, _, h in rows if p == r.id) for r in got if r.record_type == "response" and r.id is not None)
    empty = warc.write_archives(warc.with_revisits(frame.limit(0), "page_id", "url", "html"))
    assert warc.read_archives(empty).count() == 0


def test_members_in_foreign_bytes():
    def member(text):
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        return packer.compress(text) + packer.flush()

    records = [b"WARC/1.0\r\nWARC-Type: x\r\nContent-Length: 0\r\n\r\n" + bytes([i]) * i * 50 for i in range(40)]
    data = b"junk\x1f\x8b\x08junk" + b"".join(member(r) for r in records[:20]) + member(b"no record") + b"\x1f\x8b" + b"".join(member(r) for r in records[20:])
    broken = data + member(records[3])[:-9]
    file = pa.BufferReader(broken)
    for step in (7, 64, 1000, len(broken)):
        found = [m for a in range(0, len(broken), step) for m in warc.members(file, a, min(len(broken), a + step), 50)]
        assert found == [*records, None]


def test_foreign_records(spark, tmp_path):
    import base64

    body, http = b"<p>x</p>", b"HTTP/1.1 200 OK\r\nX: \xff\r\nContent-Length: 99\r\n\r\n"
    raw = hashlib.sha1(body).digest()

    def record(kind, block, *fields, length=None):
        head = [b"WARC/1.0", *([b"WARC-Type: " + kind] if kind else []), *fields]
        head += [] if length == "none" else [b"Content-Length: " + (b"%d" % len(block) if length is None else length)]
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        return packer.compress(b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()

    sent = b"Content-Type: application/http; msgtype=response"
    digest = lambda text: b"WARC-Payload-Digest: " + text
    parts = [
        (record(b"warcinfo", b"software: x\r\n"), ("warcinfo", 13, None)), (record(b"request", b"GET / HTTP/1.1\r\n\r\n", sent), ("request", 0, None)),
        (record(b"response", http + body, sent, digest(b"sha1:" + base64.b32encode(raw))), ("response", 8, None)),
        (record(b"response", http + body, sent, digest(b"SHA1:" + raw.hex().upper().encode()), length="none"), ("response", 8, None)),
        (record(b"resource", body, digest(b"md5:abc"), b"WARC-Target-URI: \xff\xfe"), ("resource", 8, None)),
        (record(b"response", http + b"other", sent, digest(b"sha1:" + base64.b32encode(raw).lower())), ("broken", 5, "payload differs from its digest")),
        (record(b"metadata", body, length=b"900"), ("broken", None, "block shorter than its Content-Length")),
        (record(b"metadata", body, length=b"x"), ("broken", None, "Content-Length is no number")),
        (record(None, body), ("broken", 8, "no WARC-Type")), (record(b"metadata", body)[:-9], ("broken", None, "breaks off"))]
    data = b"".join(p for p, _ in parts)
    (tmp_path / "a.warc.gz").write_bytes(data)
    manifest = spark.createDataFrame([(f"file:{tmp_path}/a.warc.gz", len(data), len(parts))], "path string, bytes long, records long")
    for split in (61, 1 << 20):
        got = sorted(((r.record_type, r.payload_bytes, r.reason) for r in warc.read_archives(manifest, split_bytes=split).collect()), key=repr)
        assert got == sorted((want for _, want in parts), key=repr)


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(900, 12))
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    rows += [(2000 + i, [float(x) for x in v[4]]) for i in range(400)]  # one vector shared by many
    rows += [(900, None), (920, [0.0] * 12), (940, [float("nan")] + [1.0] * 11), (960, [None] + [1.0] * 11), (980, [1.0] * 3), (None, [1.0] * 12), (20, rows[20][1])]
    frame = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<double>, ids int")
    got = ann.nearest(frame, every=20, k=20).collect()
    good = {i: np.array(e) for i, e in rows if i is not None and e is not None and len(e) == 12 and None not in e and np.isfinite(np.array(e, float)).all() and any(e)}
    found = total = 0
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(by) == {i for i in good if i % 20 == 0}
    for query, near in by.items():
        scores = {i: float((good[query] * e).sum()) for i, e in good.items() if i != query}
        near.sort()
        assert [n[0] for n in near] == list(range(1, 21))
        assert all(abs(s - scores[i]) < 1e-12 for _, i, s in near)
        assert [(-s, i) for _, i, s in near] == sorted((-s, i) for _, i, s in near)
        best = sorted(scores, key=lambda i: (-scores[i], i))[:20]
        found, total = found + len(set(best) & {n[1] for n in near}), total + 20
    assert found >= 0.9 * total
    exact = ann.nearest(frame, every=20, k=20, share=1.0).collect()
    want = {(q, i) for q in by for i in sorted((i for i in good if i != q), key=lambda i: (-float((good[q] * good[i]).sum()), i))[:20]}
    assert {(r.query_id, r.vec_id) for r in exact} == want
    assert ann.nearest(frame.limit(0), every=20).count() == 0
    assert sorted(r.vec_id for r in ann.nearest(frame.filter("vec_id in (20, 21, 22)"), every=20).collect()) == [21, 22]


def test_traversal_follows_the_summed_distance():
    rng = np.random.default_rng(2)
    index = ann.Index(rng.normal(size=(7, 3)), rng.normal(size=(5, 4)))
    index.sizes[:] = rng.integers(0, 4, (7, 5))
    q = rng.normal(size=7)
    sums = -(index.first @ q[:3])[:, None] - (index.second @ q[3:])[None, :]
    for most in (1, 5, 20, 1000):
        want, got = [], 0
        for cell in np.argsort(sums, axis=None):
            if got >= most:
                break
            got += int(index.sizes.ravel()[cell])
            if index.sizes.ravel()[cell]:
                want.append(divmod(int(cell), 5))
        assert sorted((i, j) for i, js in index.traverse(q, most).items() for j in js) == sorted(want)


def test_components_of_hubs_and_chains(spark):
    edges = [(1, i) for i in range(2, 400)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7), (5000, 3), (None, 4)]
    found = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert found == {**{i: 1 for i in range(1, 400)}, 5000: 1, **{i: 1000 for i in range(1000, 1061)}}
    assert common.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_url_rules_and_aliases(spark):
    link = '<html><head><LINK rel="canonical" href="{}"></head>'
    fresh = '<meta http-equiv="refresh" content="0; url={}">'
    rows = [
        (1, "http://a.example.org/es/1", ""), (2, "https://ORG/x?y", None), (3, "http://b.net/one", link.format("http://sub.example.org/es/9")),
        (4, "http://c.net/", fresh.format("https://b.net/one#top")), (5, "http://d.net/", link.format("http://shop.com/fr/1")),
        (6, "http://d.net/", link.format("http://shop.com/de/1")), (7, None, "x"), (8, "no scheme", link.format("http://x.com/de/")), (9, "http://notorg/", ""),
        (10, "http://x.com/de", ""), (11, "http://b.net/one", ""), (12, "HTTP://Example.ORG:80/en/12#f", ""), (13, "http://example.org/en/12?q", "")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, host int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judged(frame).collect()}
    assert got == {
        1: ("a.example.org", "/es/1", "example.org/es/", "block"), 2: ("org", "/x", "org/", "allow"), 3: ("b.net", "/one", None, "block"),
        4: ("c.net", "/", None, "block"), 5: ("d.net", "/", None, "allow"), 6: ("d.net", "/", None, "allow"), 7: ("", "", None, "allow"),
        8: ("", "", None, "allow"), 9: ("notorg", "/", None, "allow"), 10: ("x.com", "/de", None, "allow"), 11: ("b.net", "/one", None, "block"),
        12: ("example.org:80", "/en/12", None, "allow"), 13: ("example.org", "/en/12", "example.org/en/1", "block")}
    assert urls.judged(frame.limit(0)).count() == 0


def test_targets_of_links(spark, tmp_path):
    """Every form of a target, against the address a browser would go to, in the operator and in its SQL."""
    import duckdb

    from tradewind.llm.queries import LLM_QUERIES

    link, fresh = '<link rel="canonical" href="{}">', '<meta http-equiv=Refresh content="{}">'
    page = "http://A.com/x/y/z.html?q=1"
    forms = [
        (link.format("/de/1"), "a.com/de/1"), (link.format("//B.com/de/x?y#z"), "b.com/de/x?y"), (link.format("de"), "a.com/x/y/de"), (link.format("../de/./1"), "a.com/x/de/1"),
        (link.format("../../../../de/.."), "a.com/"), (link.format("?p=2&amp;r=3"), "a.com/x/y/z.html?p=2&r=3"), (link.format("HTTPS://c.com/de/?a=1&#38;b=2"), "c.com/de/?a=1&b=2"),
        (link.format("mailto:x@y"), None), (link.format("#top"), None), (link.format(""), None), ("<!-- " + link.format("/de/1") + " -->", None),
        ("<!-- open " + link.format("/de/1"), None), ("<link href='/de/2' rel='alternate\tCanonical'>", "a.com/de/2"), ("<link rel=canonical href=/de/3>", "a.com/de/3"),
        ('<link rel="canonicals" href="/de/4">', None), ('<link rel="canonical" data-href="/de/5">', None), ('<link rel="next" href="/de/6">', None),
        (fresh.format("0;url=/de/7"), "a.com/de/7"), (fresh.format("0.4 , URL = '/de/8'"), "a.com/de/8"), (fresh.format("3600; url=/de/9"), None), (fresh.format("0"), None),
        ('<meta name="canonical" content="0;url=/de/10">', None), (link.format(" \n/de/\n11 "), "a.com/de/11"), ("", None), (None, None)]
    rows = [(i, page, html) for i, (html, _) in enumerate(forms)] + [(100, "http://a.com", link.format("de/1")), (101, "plain", link.format("/de/1")), (102, None, link.format("/de/1"))]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    edges = sorted((r.left, r.right) for r in urls.link_edges(frame).collect())
    assert edges == sorted([("a.com/x/y/z.html?q=1", want) for _, want in forms if want is not None] + [("a.com", "a.com/de/1")])
    # each page at an address of its own whose target is under a rule, so that a lost or false alias shows in its verdict
    lone = [(i, f"http://h{i}.net/x/y?q", (html or "").replace('"/de', '"http://a.com/de').replace("'/de", "'//a.com/de").replace("=/de", "=//a.com/de")) for i, (html, _) in enumerate(forms)]
    lone += [(200, "http://h200.net/p/q", link.format("../r")), (201, "http://h200.net/r", link.format("http://s.com/de/")), (202, "http://h202.net", link.format("?k&amp;m")),
             (203, "http://h202.net?k&m", fresh.format("0;//s.com/de/1"))]
    folder = str(tmp_path)
    spark.createDataFrame(lone, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    got = sorted(tuple(r) for r in LLM_QUERIES["op10_url_filters"].run(spark, folder).select("page_id", "host", "path", "rule", "verdict").collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    want = sorted(db.execute(LLM_QUERIES["op10_url_filters"].sql).fetchall())
    assert got == want
    blocked = {r[0] for r in got if r[4] == "block"}
    assert {1, 6, 12, 13, 17, 18, 200, 201, 202, 203} <= blocked and not {7, 8, 9, 10, 11, 14, 15, 16, 19, 20, 21, 23, 24} & blocked


def test_pipeline_stages(spark, tmp_path):
    docs = cases.frame(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(cases.items(), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, seen = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = common.stored(stage(spark, now, str(tmp_path)), "test-stage")
        assert now.columns == docs.columns, name
        seen.append({r.doc_id: r.text for r in now.collect()})
    known, unique, cut, clean = seen
    assert {300, 301, 302, 305}.isdisjoint(known) and 1 in known
    assert sum(60 <= i < 70 for i in unique if i is not None) == 1 and 3 in unique and not any(200 <= (i or 0) < 212 for i in unique)
    sources = [i for i in range(160, 170)]
    assert all(len(cases.spaced(cut[i])) == 80 for i in sources)
    assert 312 in cut and 312 not in clean and 313 in clean and set(clean) <= set(cut)
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(clean)
