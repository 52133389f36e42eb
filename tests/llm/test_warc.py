import gzip
import hashlib

from pyarrow import fs

from sparvane.llm import warc

PAYLOAD = "<p>ä</p>" * 30
SCHEMA = "page_id long, url string, html string, payload_bytes string, file string"
PAGES = [(5, "http://a.example.com/x?y#z", PAYLOAD), (3, "http://b.org", PAYLOAD), (9, None, PAYLOAD), (4, "", None), (6, "x://y\nz", "short"), (7, "x://y\nz", "short"), (None, "http://c.d", "q" * 200), (8, "http://c.d", "q" * 200), (None, None, PAYLOAD), (3, "http://b.org", PAYLOAD), (11, "http://a.example.com/x?y#z", "w" * 300_000)]


def wanted(pages):
    rows = []
    for page_id, _, html in pages:
        raw = (html or "").encode()
        same = [i for i, _, h in pages if h == html and i is not None]
        first = min(same, default=None) if len(raw) >= warc.LEAST_SHARED else None
        revisit = first is not None and first != page_id
        rows.append((page_id, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(rows, key=str)


def test_round_trip(spark):
    frame = spark.createDataFrame([(*p, "x", "y") for p in PAGES], SCHEMA)
    got = sorted(map(tuple, warc.round_trip(frame).collect()), key=str)
    assert got == wanted(PAGES)
    assert warc.round_trip(frame.limit(0)).count() == 0


def test_lookup_over_many_blocks_and_shards(spark, monkeypatch):
    pages = [(i, f"http://h{i % 7}.net/{i % 50}", f"body {i % 20} " * 20) for i in range(2000)]
    folder, captures, _ = warc.archive(spark.createDataFrame([(*p, "", "") for p in pages], SCHEMA))
    shards = sorted(map(tuple, warc.index(captures, folder, 5).collect()))
    assert len(shards) > 1
    asked = [warc.capture_key(u, i) for i, u, _ in pages[::17]] + ["absent", "~"]
    got = warc.lookup(spark, spark.createDataFrame([(k,) for k in asked], "key string"), folder, shards, 3).collect()
    assert sorted((r.page_id, r.url) for r in got) == sorted((i, u) for i, u, _ in pages[::17])


def test_members_can_be_read_alone(spark):
    folder, captures, _ = warc.archive(spark.createDataFrame([(*p, "", "") for p in PAGES], SCHEMA))
    system, path = fs.FileSystem.from_uri(folder)
    for c in captures.collect():
        fields = warc.parse(gzip.decompress(system.open_input_file(f"{path}/{c.file}").read_at(c.length, c.offset)))
        assert len(fields["body"]) == int(fields["Content-Length"])
    for name in {c.file for c in captures.collect()}:
        whole = gzip.decompress(system.open_input_file(f"{path}/{name}").readall())
        assert whole.startswith(b"WARC/1.1") and whole.endswith(b"\r\n\r\n")
