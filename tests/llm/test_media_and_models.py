"""TIFF pages by round trips; decontamination by brute force; the two classifiers by held-out accuracy."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import decontamination, langid, quality, tiff

# TIFF


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.integers(0, 400))
def test_compressions_round_trip(raw, run):
    for data in (raw, raw[:20] * 40 + b"\0" * run + raw):
        assert tiff.packbits_decode(tiff.packbits_encode(data), len(data)) == data
        assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data


def test_lzw_over_all_code_widths():
    data = np.random.default_rng(1).integers(0, 256, 60_000, np.uint8).tobytes()
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(b"\0" * 100_000), 100_000) == b"\0" * 100_000


def test_known_streams():
    """The worked examples of the TIFF 6.0 specification."""
    packed = bytes([0xFE, 0xAA, 0x02, 0x80, 0x00, 0x2A, 0xFD, 0xAA, 0x03, 0x80, 0x00, 0x2A, 0x22, 0xF7, 0xAA])
    plain = bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22" + "AA" * 10)
    assert tiff.packbits_decode(packed, len(plain)) == plain
    # codes 256, 7, 258, 8, 8, 258, 6, 6, 257 of 9 bits each, the specification's string 7 7 7 8 8 7 7 6 6
    codes = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    raw = int(codes.ljust(-(-len(codes) // 8) * 8, "0"), 2).to_bytes(-(-len(codes) // 8), "big")
    assert tiff.lzw_decode(raw, 9) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6]) and tiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == raw


@pytest.mark.parametrize("compression", [tiff.STORED, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, 16])
def test_files_round_trip(compression, predictor, tile):
    rng = np.random.default_rng(0)
    pages = [rng.integers(0, 4, (h, w), np.uint8) for h, w in ((1, 1), (33, 50), (64, 16), (7, 100))]
    raw = tiff.write_tiff(pages, compression, predictor, 16, tile)
    found = list(tiff.read_tiff(raw))
    assert [(p.height, p.width, p.pixels) for p in found] == [(*x.shape, x.tobytes()) for x in pages]
    assert {(p.compression, p.predictor, p.tiled, p.bits) for p in found} == {(compression, predictor, tile is not None, 8)}


def big_endian_rgb16(width=3, height=2):
    """A file as others write it: big-endian, 16-bit, three samples, horizontal predictor, one deflated strip."""
    image = (np.arange(width * height * 3).reshape(height, width, 3) * 9999 % 65536).astype(">u2")
    diff = np.diff(image.astype(np.int64), axis=1, prepend=np.zeros((height, 1, 3), np.int64)) % 65536
    strip = zlib.compress(diff.astype(">u2").tobytes())
    at = 8 + len(strip) + len(strip) % 2
    tags = [(256, 3, 1, struct.pack(">HH", width, 0)), (257, 3, 1, struct.pack(">HH", height, 0)), (258, 3, 3, struct.pack(">I", at)), (259, 3, 1, struct.pack(">HH", 8, 0)), (262, 3, 1, struct.pack(">HH", 2, 0)), (273, 4, 1, struct.pack(">I", 8)), (277, 3, 1, struct.pack(">HH", 3, 0)), (279, 4, 1, struct.pack(">I", len(strip))), (317, 3, 1, struct.pack(">HH", 2, 0))]
    raw = b"MM" + struct.pack(">HI", 42, at + 6) + strip + b"\0" * (len(strip) % 2) + struct.pack(">HHH", 16, 16, 16)
    return raw + struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHI", *t[:3]) + t[3] for t in tags) + struct.pack(">I", 0), image


def test_other_writers_files():
    raw, image = big_endian_rgb16()
    (page,) = tiff.read_tiff(raw)
    assert (page.width, page.height, page.bits, page.samples) == (3, 2, 16, 3)
    assert np.array_equal(np.frombuffer(page.pixels, "<u2").reshape(image.shape), image)


def test_byte_orders_give_the_same_pixels():
    """One 16-bit image as a file of either byte order."""
    pixels = []
    for order, mark in (("<", b"II"), (">", b"MM")):
        strip = np.array([258, 65535, 1, 4660], order + "u2").tobytes()
        tags = [(256, 4), (257, 1), (258, 16), (259, 1), (262, 1), (273, 8), (277, 1), (279, 8)]
        raw = mark + struct.pack(order + "HI", 42, 16) + strip + struct.pack(order + "H", len(tags))
        raw += b"".join(struct.pack(order + "HHII", tag, 4, 1, value) for tag, value in tags) + struct.pack(order + "I", 0)
        (page,) = tiff.read_tiff(raw)
        pixels.append(page.pixels)
    assert pixels[0] == pixels[1] == np.array([258, 65535, 1, 4660], "<u2").tobytes()


def test_headers_that_claim_too_much(spark):
    """A page of 300,000 x 3,000,000 pixels in a few bytes is an error row, and the next page is read."""
    raw = bytearray(tiff.write_tiff([np.zeros((4, 5), np.uint8), np.ones((2, 2), np.uint8)], tiff.STORED))
    (at,) = struct.unpack_from("<I", raw, 4)
    for k in range(struct.unpack_from("<H", raw, at)[0]):
        tag = struct.unpack_from("<H", raw, at + 2 + 12 * k)[0]
        if tag in (256, 257, 278):
            struct.pack_into("<I", raw, at + 10 + 12 * k, {256: 300_000, 257: 3_000_000, 278: 3_000_000}[tag])
    found = tiff.tiff_pages(spark.createDataFrame([(1, bytes(raw))], "id long, content binary"), "content", ["id"]).orderBy("page").collect()
    assert [r.page for r in found] == [0, 1] and "can't hold" in found[0].error and found[1].pixels == b"\1" * 4


@pytest.mark.parametrize("form", [tiff.Form(tiff.STORED), tiff.Form(tiff.LZW, 1, 16), tiff.Form(tiff.PACKBITS, 1, 16), tiff.Form(tiff.DEFLATE, 2, 16, 192), tiff.Form(tiff.LZW, 2, 32, 64)])
def test_every_form_holds_long_documents(spark, form):
    texts = [(1, "word " * 40_000), (2, "é" * 200_000), (3, "".join(map(chr, range(32, 3000))) * 40)]
    for r in tiff.document_media(spark.createDataFrame(texts, "doc_id long, text string"), form).collect():
        raw = dict(texts)[r.doc_id].encode()
        assert r.payload_sha256 == hashlib.sha256(raw + b"\xff" * (-len(raw) % 576)).hexdigest()


def test_pages_as_rows(spark):
    one = tiff.write_tiff([np.zeros((4, 5), np.uint8), np.ones((2, 2), np.uint8)])
    circle = bytearray(one)
    circle[-4:] = struct.pack("<I", struct.unpack("<I", one[4:8])[0])
    rows = [(1, one, "k"), (2, None, "k"), (3, b"no", "k"), (4, b"", "k"), (5, one[:60], "k"), (6, bytes(circle), "k"), (1, one, "k")]
    df = spark.createDataFrame(rows, "id long, content binary, width string")
    found = tiff.tiff_pages(df, "content", ["id", "width"]).orderBy("id", "page").collect()
    assert [(r.id, r.page) for r in found if r.error is None and r.id == 1] == [(1, 0), (1, 0), (1, 1), (1, 1)]
    assert {r.id for r in found if r.page == -1} == {3, 4, 5, 6} and all(r.id != 2 for r in found)
    assert [r.width for r in found if r.id == 1] == [5, 5, 2, 2]
    assert tiff.tiff_pages(df.limit(0), "content", ["id"]).collect() == []


def test_documents_come_back(spark):
    texts = [(1, None), (2, ""), (3, "é" * 288), (4, "x" * 577), (5, "word " * 60_000), (6, "a"), (7, "a"), (None, "b" * 1200)] + [(10 + k, "t" * (576 * k + 5)) for k in range(6)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"media_bytes": F.lit(0), "page": F.lit(1)})
    found = {r.doc_id: r for r in tiff.document_media(docs).collect()}
    for doc, text in texts:
        raw, r = (text or "").encode(), found[doc]
        padded = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
    assert found[6][1:] == found[7][1:] and found[1][1:] == found[2][1:]
    assert tiff.document_media(docs.limit(0)).collect() == []


def test_query_covers_all_documents(spark):
    found = tiff.op8_tiff_media(spark, SMALL).collect()
    texts = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert {r.doc_id: r.n_bytes for r in found} == {d: len(t) for d, t in texts.items()}
    assert all(r.payload_sha256 == hashlib.sha256(t + b"\xff" * (-len(t) % 576 or 576 * (not t))).hexdigest() for r in found for t in [texts[r.doc_id]])


# Decontamination


def slow_scan(text, items, size=13):
    cut = lambda x: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
    words, hit, found = cut(text), set(), set()
    for item, body in items:
        ws = cut(body)
        n = min(size, len(ws))
        windows = {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)} if ws else set()
        for k in range(len(words) - n + 1):
            if tuple(words[k : k + n]) in windows:
                hit |= set(range(k, k + n))
                found.add("null" if item is None else str(item))
    return len(words), len(hit), sorted(found)


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"), (2, "Short question?"), (10, "three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"), (3, None), (4, "!!"), (None, "nameless thing here"), (2, "Short question?"), (5, "été à Æon")]


def test_scan_matches_brute_force(spark):
    rng = random.Random(3)
    pool = " ".join(t for _, t in ITEMS if t).split()
    long = " ".join(t for _, t in ITEMS if t)
    texts = [None, "", "...", long, long.upper(), long.replace(" ", "-"), "été à Æon", "short question short question", "nameless thing", "x " * 50_000 + long] + [" ".join(rng.choices(pool, k=rng.randrange(1, 60))) for _ in range(200)]
    texts += [" ".join(["pad"] * rng.randrange(5) + ITEMS[0][1].split()[rng.randrange(4) :] + ["pad"] * rng.randrange(300)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"hits": F.lit("mine"), "items": F.lit(1)})
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("answer", F.lit("x"))
    for block in (1 << 22, 60):
        found = decontamination.scan(docs, benchmark, block_bytes=block, keep=["doc_id"]).select("doc_id", "n_words", decontamination.hit_words().alias("n"), F.array_sort("items").alias("items")).collect()
        assert {r.doc_id: (r.n_words, r.n, r["items"]) for r in found} == {k: slow_scan(t, ITEMS) for k, t in enumerate(texts)}


def test_spans_go(spark):
    body = ITEMS[0][1]
    rows = [(1, f"Before, {body}! After " + "pad " * 400, 5), (2, body, 6), (3, None, None), (4, "clean text", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    found = {r.doc_id: r for r in decontamination.decontaminate(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).collect()}
    assert found[1].text == "Before, ! After " + "pad " * 400 and found[1].n_chars == len(found[1].text)
    assert 2 not in found and found[3].text is None and found[4].n_chars == 10
    assert decontamination.decontaminate(docs, spark.createDataFrame([], "item_id long, text string")).count() == 4
    assert decontamination.decontaminate(docs.limit(0), spark.createDataFrame(ITEMS, "item_id long, text string")).collect() == []
    named = docs.withColumns({"items": F.lit(3), "n_words": F.lit("w"), "hits": F.lit(None).cast("double"), "found": F.lit(1), "text_0": F.lit(2)})
    for block in (1 << 22, 60):
        again = {r.doc_id: r for r in decontamination.decontaminate(named, spark.createDataFrame(ITEMS, "item_id long, text string"), block_bytes=block).collect()}
        assert {d: r.text for d, r in again.items()} == {d: r.text for d, r in found.items()}
        assert all((r["items"], r.n_words, r.hits, r.found, r.text_0) == (3, "w", None, 1, 2) for r in again.values())


# Language ID


def slow_phrases(text, labelled):
    """Longest matches found by searching the labelled text for each prefix, over the whole text."""
    n = at = 0
    while at < len(text):
        k = 1
        while at + k < len(text) and text[at : at + k + 1] in labelled:
            k += 1
        at, n = at + k, n + 1
    return n


@pytest.mark.parametrize("dense", [langid.DENSE, 10])
def test_phrases_match_brute_force(monkeypatch, dense):
    monkeypatch.setattr(langid, "DENSE", dense)
    rng = random.Random(9)
    learnt = [(name, ["".join(rng.choices(letters, k=300)) for _ in range(3)]) for name, letters in (("x", "abc de"), ("y", "cde fé"), ("z", "aeiou "))]
    learnt.append(("w", ["a" * 3000]))
    model = langid.Languages(learnt)
    texts = ["", "a", "ß", "abcabcabc", *["".join(rng.choices("abcdefé iouß", k=rng.choice([5, 80, 700, 1500]))) for _ in range(40)], "a" * 4000, "q" * 1100, "a" * 511 + "b" + "a" * 700, "ab" * 900]
    coded = [langid.symbols(t) for t in texts]
    labelled = ["".join(map(chr, np.concatenate([y for t in parts for y in (langid.symbols(t), np.zeros(1, np.uint32))]).tolist())) for _, parts in sorted(learnt)]
    want = [[slow_phrases("".join(map(chr, c.tolist())), text) for text in labelled] for c in coded]
    assert model.phrases(coded).tolist() == want


def test_many_letters_take_little_memory():
    """5,000 letters: the table holds the transitions there are, not a place for each state and letter."""
    import tracemalloc

    rng = random.Random(1)
    text = "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(24_000))
    tracemalloc.start()
    model = langid.Languages([("zh", [text]), ("en", ["the cat and the dog " * 1000])])
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 100 << 20 and model.predict([text[100:200], "the dog"])[0] == ["zh", "en"]


def test_prediction_matches_brute_force():
    """The whole decision: fewest phrases, each weighted with the bits that name a place in the labelled text."""
    rng = random.Random(4)
    learnt = [(name, ["".join(rng.choices(letters, k=400))]) for name, letters in (("x", "abc de"), ("y", "cde fé"), ("z", "aeiou "))]
    texts = ["".join(rng.choices("abcdefé iou", k=rng.choice([1, 9, 60, 900]))) for _ in range(60)] + ["", "12"]
    code = lambda t: "".join(map(chr, langid.symbols(t).tolist()))
    labelled = {name: code(parts[0]) + "\0" for name, parts in learnt}
    names, scores = langid.Languages(learnt).predict(texts)
    for text, name, score in zip(texts, names, scores):
        bits = {n: slow_phrases(code(text), labelled[n]) * np.log2(len(labelled[n])) for n in sorted(labelled)}
        low, then = sorted(bits.values())[:2]
        assert (name, round(score, 9)) == ((min(bits, key=bits.get), round(1 - low / then, 9)) if code(text) else ("und", 0.0))


def test_symbols():
    assert "".join(map(chr, langid.symbols(" -Hé,  12 ß! "))) == "hé\0ß"
    assert len(langid.symbols("12 !")) == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    found = langid.op10_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert len(found) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in found)


def test_language_cases(spark):
    rows = [(k, t, la) for k, (t, la) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr"), (None, "en"), ("the end", None), ("12 34", "fr")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(1, "the dog"), (2, "le chien"), (3, None), (4, ""), (5, "1 2 !"), (6, "the dog " * 40_000), (7, "日本語"), (7, "日本語")], "doc_id long, text string").withColumn("score", F.lit("mine"))
    found = langid.identify(asked, docs).collect()
    got = {r.doc_id: r.lang_pred for r in found}
    assert (got[1], got[2], got[3], got[4], got[5], got[6]) == ("en", "fr", "und", "und", "und", "en") and got[7] in ("en", "fr") and len(found) == 8
    assert {r.lang_pred for r in langid.identify(asked, docs.limit(0)).collect()} == {"und"}
    assert {r.lang_pred for r in langid.identify(asked, docs.where("lang = 'en'")).collect()} == {"en", "und"}
    assert langid.identify(asked.limit(0), docs).collect() == []


# Quality


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.col("source").alias("host"), F.col("lang").alias("path"))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    learnt, held = labels.where("doc_id % 5 <> 0"), labels.where("doc_id % 5 = 0")
    found = quality.classify(docs, learnt).select("doc_id", "good_score", "toxic_score").join(held, "doc_id").collect()
    for score, target in (("good_score", "quality"), ("toxic_score", "toxic")):
        right = sum((r[score] >= 0.5) == (r[target] == 1) for r in found) / len(found)
        base = max(sum(r[target] for r in found), sum(1 - r[target] for r in found)) / len(found)
        up, down = [r[score] for r in found if r[target]], [r[score] for r in found if not r[target]]
        auc = sum((a > b) + (a == b) / 2 for a in up for b in down) / (len(up) * len(down))
        assert right >= base and auc > 0.85, (target, right, base, auc)


def slow_sites(rows):
    """{doc_id: [posterior of each target]}: rates of hosts and of paths in them, shrunk, without the document itself."""
    out = {r[0]: [] for r in rows}
    for k in (3, 4):
        overall = min(1 - quality.LEAST, max(quality.LEAST, sum(r[k] for r in rows) / len(rows)))
        by_host, by_path = {}, {}
        for r in rows:
            by_host.setdefault(r[1], []).append(r[k])
            by_path.setdefault(r[1:3], []).append(r[k])

        def strength(groups):  # [(values, mean of the parent)]
            n, sizes = sum(len(v) for v, _ in groups), [len(v) for v, _ in groups]
            if n <= len(groups) or sum(m * m for m in sizes) >= n * n:
                return 1e3
            between = sum(len(v) * (np.mean(v) - parent) ** 2 for v, parent in groups)
            within = sum(float(((np.array(v) - np.mean(v)) ** 2).sum()) for v, _ in groups)
            spread = (between - (len(groups) - 1) * within / (n - len(groups))) / (n - sum(m * m for m in sizes) / n)
            return min(1e6, max(1.0, overall * (1 - overall) / max(spread, 1e-9) - 1))

        of_hosts = strength([(v, overall) for v in by_host.values()])
        of_paths = strength([(v, np.mean(by_host[key[0]])) for key, v in by_path.items()])
        for r in rows:
            host = (sum(by_host[r[1]]) - r[k] + of_hosts * overall) / (len(by_host[r[1]]) - 1 + of_hosts)
            path = (sum(by_path[r[1:3]]) - r[k] + of_paths * host) / (len(by_path[r[1:3]]) - 1 + of_paths)
            path = min(1 - quality.LEAST, max(quality.LEAST, path))
            odds = r[k] / (1 - r[k]) * path / (1 - path) * (1 - overall) / overall
            out[r[0]].append(odds / (1 + odds))
    return out


def test_sites_match_plain_python(spark):
    rng = random.Random(3)
    rows = []
    for k in range(400):
        host, path = rng.choice(["a", "b", "c", None, f"small{k}"]), rng.choice(["x", "y", None])
        lean = {"a": 0.7, "b": 0.2}.get(host, 0.5)
        rows.append((k, host, path, min(0.99, max(0.01, rng.gauss(lean, 0.2))), min(0.99, max(0.01, rng.gauss(0.1, 0.1)))))
    found = quality.with_sites(spark.createDataFrame(rows, "doc_id long, host string, path string, good double, toxic double"))
    want = slow_sites(rows)
    for r in found.collect():
        assert np.allclose([r.good_score, r.toxic_score], want[r.doc_id], rtol=1e-6)


def test_evidence_matches_plain_python(spark):
    """A model's probabilities for texts, worked out by hand from its lexicons, scaling and weights."""
    rng = random.Random(6)
    docs = [(k, " ".join(rng.choices(["good", "fine", "plain", "word"] if k % 2 else ["bad", "ugly", "plain", "word"], k=30)), "h", "p") for k in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string, host string, path string")
    model = quality.fit(df, spark.createDataFrame([(k, k % 2, 1 - k % 2) for k in range(60)], "doc_id long, quality int, toxic int"))
    for r in quality.document_evidence(df, model).collect():
        x = (np.array(quality.features(docs[r.doc_id][1], model.lexicons)) - model.mean) / model.scale
        want = [1 / (1 + np.exp(-np.clip(sum(a * b for a, b in zip(x, w[:-1])) + w[-1], -30, 30))) for w in model.weights]
        assert np.allclose([r.good, r.toxic], np.clip(want, quality.LEAST, 1 - quality.LEAST))


def test_quality_cases(spark):
    texts = [(k, ("good words in a calm sentence. " if k % 2 else "BAD!!! bad | bad ") * 5, "h", "p") for k in range(60)]
    docs = spark.createDataFrame([*texts, (100, None, "h", None), (101, "", None, "p"), (102, "x " * 50_000, None, None), (102, "again", None, None), (None, "z", "h", "p")], "doc_id long, text string, host string, path string").withColumns({"good": F.lit("mine"), "n": F.lit(1), "site_host": F.lit(2)})
    labels = spark.createDataFrame([(k, k % 2, 1 - k % 2) for k in range(40)] + [(1, 0, 0), (50, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    found = quality.classify(docs, labels).collect()
    assert len(found) == 65 and all(0 < r.good_score < 1 and 0 < r.toxic_score < 1 for r in found)
    late = {r.doc_id: r for r in found if r.doc_id is not None and 40 <= r.doc_id < 60}
    assert all(r.keep == (d % 2 == 1) for d, r in late.items())
    one = quality.classify(docs, labels.where("quality = 1 AND toxic = 0")).collect()
    assert len(one) == 65
    assert len(quality.classify(docs, labels.limit(0)).collect()) == 65
    assert quality.classify(docs.limit(0), labels).collect() == []


def test_sites_shrink_toward_their_parents(spark):
    """One bad document on a good host moves little; a host of bad documents moves each of them."""
    rows = [(k, "good.org", "a", 0.9, 0.1) for k in range(200)] + [(200, "good.org", "b", 0.4, 0.1)]
    rows += [(300 + k, "bad.org", "a", 0.1, 0.1) for k in range(200)] + [(500, "bad.org", "b", 0.5, 0.1), (600, "new.org", "a", 0.5, 0.1)]
    each = spark.createDataFrame(rows, "doc_id long, host string, path string, good double, toxic double")
    got = {r.doc_id: r.good_score for r in quality.with_sites(each).collect()}
    assert got[200] > 0.4 and got[500] < 0.5 and got[500] < got[600] < got[200] + 0.5
    assert abs(got[600] - 0.5) < 0.05


def test_all_chosen_texts_teach(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    long, short = " ".join(word() for _ in range(20_000)), [" ".join(word() for _ in range(60)) for _ in range(30)]
    rows = [(0, long, "xx"), *[(k, "the same text again", "xx") for k in range(1, 200)], *[(200 + k, t, "xx") for k, t in enumerate(short)]]
    ((_, parts),) = langid.training_text(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(parts) == 32 and set(short) < set(parts) and parts.count("the same text again") == 1
    assert langid.TRAIN_CHARS - 5 <= sum(len(langid.symbols(t)) + 1 for t in parts) <= langid.TRAIN_CHARS
    assert [len(langid.symbols(t)) for t in langid.even_shares(["ab", "c" * 99, "d" * 99], 23)] == [2, 9, 9]


def plain_tiff(pages):
    """(bits, samples, planar, predictor, width, height, strips) each, stored or PackBits, little-endian."""
    out, link = bytearray(b"II" + struct.pack("<HI", 42, 0)), 4
    for bits, samples, planar, predictor, width, height, compression, strips in pages:
        places = []
        for part in strips:
            places.append(len(out))
            out += part
        lists = len(out)
        out += struct.pack(f"<{2 * len(strips)}I", *places, *map(len, strips)) + struct.pack(f"<{samples}H", *[bits] * samples)
        refer = lambda k: lists + 4 * k * len(strips) if len(strips) > 1 else (places, [len(p) for p in strips])[k][0]  # noqa: B023, E731
        widths = lists + 8 * len(strips) if samples > 2 else int.from_bytes(struct.pack("<2H", bits, bits), "little")
        tags = [(256, 4, 1, width), (257, 4, 1, height), (258, 3, samples, widths), (259, 3, 1, compression), (273, 4, len(strips), refer(0)), (277, 3, 1, samples), (278, 4, 1, height), (279, 4, len(strips), refer(1)), (284, 3, 1, planar), (317, 3, 1, predictor)]
        out[link : link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags)
        link = len(out)
        out += struct.pack("<I", 0)
    return bytes(out)


def test_narrow_and_planar_pages_and_pages_after_a_bad_one(spark):
    raw = plain_tiff([
        (1, 1, 1, 1, 10, 2, tiff.PACKBITS, [tiff.packbits_encode(bytes([0b10110000, 0b01000000, 0b00000001, 0b11000000]))]),
        (32, 1, 1, 3, 1, 1, tiff.STORED, [b"\0\0\0\0"]),
        (4, 1, 1, 1, 3, 1, tiff.STORED, [bytes([0x5A, 0xC0])]),
        (2, 1, 1, 1, 5, 1, tiff.STORED, [bytes([0b00011011, 0b10000000])]),
        (8, 3, 2, 1, 2, 1, tiff.STORED, [b"\1\2", b"\3\4", b"\5\6"]),
    ])
    found = tiff.tiff_pages(spark.createDataFrame([(1, raw)], "id long, content binary"), "content", ["id"]).orderBy("page").collect()
    assert [r.page for r in found] == [0, 1, 2, 3, 4] and [r.error is None for r in found] == [True, False, True, True, True]
    assert [r.bits for r in found] == [1, None, 4, 2, 8]
    assert list(found[0].pixels) == [1, 0, 1, 1, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 1, 1, 1]
    assert list(found[2].pixels) == [5, 10, 12] and list(found[3].pixels) == [0, 1, 2, 3, 2] and list(found[4].pixels) == [1, 3, 5, 2, 4, 6]
