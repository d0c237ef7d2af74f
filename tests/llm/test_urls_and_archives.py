"""URL filters by dated lists, and WARC archives with revisits, on small fixtures."""

import hashlib
import random
import re

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from tessera.llm import urlfilter, warc

# URL filters

ENTRIES = "category string, kind string, pattern string, action string, at long"


def slow_filter(captures, entries):
    """[(n_hits, categories, kept)] by looking at every entry for every capture."""
    state = {}
    for e in entries:
        if None not in e:
            state.setdefault(e[:3], {}).setdefault(e[4], set()).add(e[3])
    out = []
    for _, url, at in captures:
        hits = set()
        for (category, kind, pattern), dated in state.items():
            times = [t for t in dated if at is not None and t <= at]
            if url is not None and times and "add" in dated[max(times)]:
                m = re.match(r"[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", url)
                host = re.sub(r"^www\.", "", m[1].lower()) if m else ""
                path = re.match(r"[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/?([^?#]*)", url)
                parts = [x for x in path[1].split("/") if x] if path else []
                match = {"host": host and (host == pattern or host.endswith("." + pattern)), "prefix": host and any("/".join([host, *parts[:k]]) == pattern for k in range(1, len(parts) + 1)), "url": url == pattern}
                if match.get(kind):
                    hits.add((category, kind, pattern))
        names = {h[0] for h in hits}
        out.append((len(hits), ",".join(sorted(names)), not (names - {"allow"} and "allow" not in names)))
    return out


def test_filter_matches_brute_force(spark):
    rng = random.Random(1)
    hosts, paths = ["a.com", "b.a.com", "www.a.com", "com", "c.org", "x.c.org"], ["", "/", "/p", "/p/q", "/p//q?x=1", "/pq#f"]
    urls = [f"{s}://{u}{h}{p}{q}" for s in ("http", "https") for u in ("", "me:pw@") for h in hosts for p in ("", ":80") for q in paths] + ["nonsense", "", None, "HTTP://A.COM/p"]
    captures = [(k, rng.choice(urls), rng.choice([None, *range(0, 400_000, 7_000)])) for k in range(400)]
    patterns = [("host", h) for h in ("a.com", "c.org", "com", "b.a.com")] + [("prefix", p) for p in ("a.com/p", "c.org/p/q", "a.com")] + [("url", u) for u in urls[:30]] + [("odd", "a.com")]
    entries = [(rng.choice(["bad", "worse", "allow"]), *rng.choice(patterns), rng.choice(["add", "add", "remove"]), rng.choice([0, 50_000, 100_000, 100_000, 250_000, 390_000])) for _ in range(160)]
    entries += [(None, "host", "a.com", "add", 1), ("bad", "host", None, "add", 1), ("bad", "host", "a.com", "add", None), *entries[:5]]
    df = spark.createDataFrame(captures, "id long, url string, fetch_time long").withColumns({"kept": F.lit("mine"), "k": F.lit(1), "from": F.lit(2), "category": F.lit(3)})
    found = urlfilter.filter_urls(df, spark.createDataFrame(entries, ENTRIES))
    assert found.columns == ["id", "url", "fetch_time", "k", "from", "category", "n_hits", "categories", "kept"]
    got = {r.id: (r.n_hits, r.categories, r.kept) for r in found.collect()}
    assert [got[c[0]] for c in captures] == slow_filter(captures, entries)


def test_empty_lists_and_captures(spark):
    captures = spark.createDataFrame([(1, "http://a.com/", 5), (1, "http://a.com/", 5)], "id long, url string, fetch_time long")
    empty = spark.createDataFrame([], ENTRIES)
    assert [tuple(r)[3:] for r in urlfilter.filter_urls(captures, empty).collect()] == [(0, "", True)] * 2
    listed = spark.createDataFrame([("bad", "host", "a.com", "add", 5)], ENTRIES)
    assert [tuple(r)[3:] for r in urlfilter.filter_urls(captures, listed).collect()] == [(1, "bad", False)] * 2
    assert urlfilter.filter_urls(captures.limit(0), listed).collect() == []


def test_intervals(spark):
    entries = [("b", "host", "x", "add", 10), ("b", "host", "x", "add", 20), ("b", "host", "x", "remove", 30), ("b", "host", "x", "add", 90_000), ("b", "host", "x", "remove", 90_000), ("b", "host", "x", "add", 400_000)]
    found = urlfilter.intervals(spark.createDataFrame(entries, ENTRIES))
    assert sorted(tuple(r)[3:] for r in found.select("category", "kind", "pattern", "from", F.coalesce("to", F.lit(-1))).collect()) == [(10, 20), (20, 30), (90_000, 400_000), (400_000, -1)]


def test_url_filters_run_no_python(spark):
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    assert not re.search("Python|Pandas|Arrow", urlfilter.op2_url_filters(spark, SMALL)._jdf.queryExecution().explainString(mode))


# Archives


def slow_records(rows):
    """{id: (bytes, digest, type, refers_to)}."""
    raw = {i: p if isinstance(p, bytes) else (p or "").encode() for i, _, _, p in rows}
    out = {}
    for i, b in raw.items():
        last = max(k for k, x in raw.items() if x == b)
        again = len(b) >= 1000 and last != i
        out[i] = (len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", last if again else None)
    return out


def test_records_match_brute_force(spark, tmp_path):
    long, bound, wide = "x" * 1000, "y" * 999, "é" * 500
    rows = [(1, "u1", "d", long), (5, "u2", "d", long), (3, "u3", None, long), (2, "u", "d", bound), (4, "u", "d", bound), (6, None, "d", None), (7, "u\r\nX: y", "d", ""), (8, "u", "d", wide), (9, "u", "d", wide), (10, "u", "d", "WARC/1.1\r\n\r\n\r\n\r\nContent-Length: 3\r\n\r\n" * 40), (11, "u", "d", "z" * 3_000_000)]
    df = spark.createDataFrame(rows, "id long, url string, date string, payload string").withColumns({"original": F.lit(1), "record_type": F.lit("mine"), "value": F.lit(0)})
    found = {r.id: r for r in warc.deduplicate(df, f"file://{tmp_path}/w").collect()}
    assert {i: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to_id) for i, r in found.items()} == slow_records(rows)
    assert found[7].url == "u X: y" and found[6].url == "" and found[3].date == ""


def test_repeated_ids(spark, tmp_path):
    """A row for each row: those with the largest id are responses, the others refer to it once."""
    rows = [(5, "u", "d", "x" * 1200), (5, "u", "d", "x" * 1200), (3, "v", "d", "x" * 1200), (None, "w", "d", "x" * 1200), (None, "w", "d", "y" * 1200), (None, "w", "d", "y" * 1200)]
    found = warc.deduplicate(spark.createDataFrame(rows, "id long, url string, date string, payload string"), f"file://{tmp_path}/w").collect()
    assert sorted(((r.id, r.record_type, r.refers_to_id, r.payload_bytes) for r in found), key=str) == sorted([(5, "response", None, 1200), (5, "response", None, 1200), (3, "revisit", 5, 1200), (None, "revisit", 5, 1200), (None, "response", None, 1200), (None, "response", None, 1200)], key=str)


def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 512_000)
    rows = [(k, "u", "d", f"{k} " + "x" * (600_000 if k % 50 == 7 else 5_000 if k % 7 == 0 else 90)) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, url string, date string, payload string").coalesce(1)
    found = warc.deduplicate(df, f"file://{tmp_path}/w")
    assert sorted((r.id, r.payload_bytes) for r in found.collect()) == sorted((r[0], len(r[3])) for r in rows)
    import gzip

    sizes = [len(gzip.decompress(f.read_bytes())) for f in (tmp_path / "w").glob("*.gz")]
    assert sum(n > 600_000 for n in sizes) == 6 and all(n < 602_000 for n in sizes)


def test_archives_are_plain_warc(spark, tmp_path):
    df = spark.createDataFrame([(k, f"http://x/{k}", "2024", "page " * (300 * (k % 2) + 1)) for k in range(50)], "id long, url string, date string, payload string")
    warc.write_archives(warc.with_types(warc.captures(df)), f"file://{tmp_path}/w", file_records=10)
    files = sorted((tmp_path / "w").glob("*.gz"))
    assert len(files) >= 5
    import gzip

    seen = []
    for f in files:
        raw = gzip.decompress(f.read_bytes())
        while raw:
            head, _, rest = raw.partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            n = int(fields["Content-Length"])
            assert rest[n : n + 4] == b"\r\n\r\n" and head.startswith(b"WARC/1.1\r\n")
            if fields["WARC-Type"] == "response":
                assert fields["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(rest[:n]).hexdigest()
            else:
                assert n == 0 and fields["WARC-Profile"] == warc.PROFILE
            seen.append((fields["WARC-Record-ID"], fields.get("WARC-Refers-To")))
            raw = rest[n + 4 :]
    names = {s[0] for s in seen}
    assert len(seen) == len(names) == 50 and all(r in names for _, r in seen if r)
    back = warc.read_archives(spark, f"file://{tmp_path}/w", with_payload=True).where("record_type = 'response'").collect()
    assert {r.id: r.payload.decode() for r in back}.items() <= {r.id: r.payload for r in df.collect()}.items()


def test_empty_and_repeated(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "d", "q" * 2000)] * 2, "id long, url string, date string, payload string")
    assert [r.record_type for r in warc.deduplicate(df, f"file://{tmp_path}/a").collect()] == ["response"] * 2
    assert warc.deduplicate(df.limit(0), f"file://{tmp_path}/b").collect() == []


def test_binary_payloads(spark, tmp_path):
    rows = [(1, "u", "d", bytes(range(256)) * 5), (2, "u", "d", bytes(range(256)) * 5), (3, "u", "d", b"\xff\xfe")]
    df = spark.createDataFrame(rows, "id long, url string, date string, payload binary")
    found = warc.deduplicate(df, f"file://{tmp_path}/w").collect()
    assert {r.id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to_id) for r in found} == slow_records(rows)


@pytest.mark.parametrize("raw", [b"HTTP/1.1 200\r\n\r\n", b"WARC/1.1\r\nContent-Length: 2\r\n\r\nxxyy"])
def test_broken_archives(raw):
    with pytest.raises(ValueError, match="record"):
        list(warc._parse(raw))
