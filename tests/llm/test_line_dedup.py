"""Fuzzy line dedup against a brute-force version."""

import random
import re
import time

import pytest
import xxhash
from conftest import SMALL
from pyspark.sql import functions as F

from tessera.llm import linededup


def normal(line):
    """As the operator does: runs of anything but letters, marks and digits are one space."""
    import regex

    return regex.sub(r"[^\p{L}\p{M}\p{N}]+", " ", line).lower().strip(" ")


def distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def views(line):
    """{kind: (number of features, for each block its votes or None)} of a normalised line."""
    words = set(line.split(" "))
    grams = {line[k : k + 3] for k in range(max(1, len(line) - 2))}
    kinds = {}
    if len(words) >= 4:
        kinds[0] = words
    if len(words) < 5 or len(line) < 40:
        kinds[1] = grams
    out = {}
    for kind, features in kinds.items():
        blocks = [[] for _ in range(8)]
        for h in (xxhash.xxh64_intdigest(x.encode(), 42) for x in features):
            blocks[h >> 61].append(h)
        out[kind] = len(features), [[2 * sum(h >> j & 1 for h in block) > len(block) for j in range(28)] if block else None for block in blocks]
    return out


def windows(kind, n, blocks):
    sizes = [2] if kind else [w for low, high, w in ((5, 10, 4), (10, 20, 3), (20, 50, 2), (50, 10**9, 1)) if 0.8 * low <= n < high]
    for w in sizes:
        for c in range(8):
            part = [blocks[(c + k) % 8] for k in range(w)]
            if any(x is not None for x in part):
                yield kind, w, c, str([x or [False] * 28 for x in part])


def similar(a, b, similarity=0.8):
    """By words, and for lines of under ten words also by characters."""
    wa, wb = a.split(" "), b.split(" ")
    near = lambda x, y: distance(x, y) <= int(max(len(x), len(y)) * (1 - similarity) + 1e-9)
    return near(wa, wb) or (len(wa) < 10 and len(wb) < 10 and near(a, b))


def linked_lines(texts):
    """Pairs of different normalised lines that share a window and are near by fingerprint."""
    seen = {x: views(x) for x in texts}
    buckets = {}
    for x in texts:
        for kind, (n, blocks) in seen[x].items():
            for w in windows(kind, n, blocks):
                buckets.setdefault(w, []).append(x)
    for (kind, *_), members in buckets.items():
        for i, a in enumerate(members):
            for b in members[i + 1 :]:
                fa, fb = ([y for x in seen[z][kind][1] for y in (x or [False] * 28)] for z in (a, b))
                if sum(p != q for p, q in zip(fa, fb)) <= 40:
                    yield a, b


def slow(spark, rows):
    """[(row, kept lines)] by comparing lines pair by pair."""
    lines = [(r, k, normal(x)) for r, (_, text) in enumerate(rows) if text is not None for k, x in enumerate(text.split("\n"))]
    lines = [x for x in lines if x[2]]
    texts = sorted({x[2] for x in lines})
    group = {x: {x} for x in texts}
    for a, b in linked_lines(texts):
        if group[a] is not group[b] and similar(a, b):
            group[a] |= group[b]
            for x in group[b]:
                group[x] = group[a]
    place = {}
    for r, k, x in lines:
        key = (rows[r][0] is not None, rows[r][0] or 0, k)
        name = min(group[x])
        place[name] = min(place.get(name, (key, r)), (key, r))
    gone = {(r, k) for r, k, x in lines if place[min(group[x])] != ((rows[r][0] is not None, rows[r][0] or 0, k), r)}
    return [None if text is None else [x for k, x in enumerate(text.split("\n")) if (r, k) not in gone] for r, (_, text) in enumerate(rows)]


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r for r in linededup.with_kept_lines(docs).collect()}


def test_table_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = sorted(map(tuple, docs.collect()))
    want = slow(spark, rows)
    found = kept(spark, rows)
    for (doc, text), lines in zip(rows, want):
        assert found[doc].text == "\n".join(lines) or (not lines and found[doc].text == ""), doc
        assert found[doc].n_lines == text.count("\n") + 1 and found[doc].n_dropped == found[doc].n_lines - len(lines)
    query = {r.doc_id: r for r in linededup.op4_line_dedup(spark, SMALL).collect()}
    assert {d: r.n_dropped for d, r in query.items()} == {d: r.n_dropped for d, r in found.items()}


def test_variants_of_lines_match_brute_force(spark):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in "bcdfghklm" for b in ("ando", "erin", "ulat", "opis")]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(5, 40))) for _ in range(25)]

    def variant(line):
        parts = line.split(" ")
        for _ in range(rng.randrange(0, 3)):
            k = rng.randrange(len(parts))
            parts[k] = rng.choice([parts[k] + "s", parts[k][:-1], parts[k].upper(), parts[k] + ",", parts[k]])
        return " ".join(parts)

    rows = [(d, "\n".join(variant(rng.choice(base)) for _ in range(rng.randrange(1, 9)))) for d in range(60)]
    found = kept(spark, rows)
    for (doc, _), lines in zip(rows, slow(spark, rows)):
        assert found[doc].text == "\n".join(lines), doc


def test_cases(spark):
    line = "the very same line of text again"
    rows = [(2, f"{line}\nshort one\n\nshort one"), (1, f"x\n{line}"), (3, None), (4, ""), (5, f"{line.upper()}!!"), (None, "nobody knows where this came from"), (7, "nobody knows where this came from"), (8, " ".join(["long"] * 30_000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"dk": F.lit(1), "dropped": F.lit("mine"), "n_chars": F.length("text").cast("long"), "node": F.lit(2)})
    found = {r.doc_id: r for r in linededup.dedup_lines(docs).collect()}
    assert linededup.dedup_lines(docs).columns == docs.columns
    assert found[1].text == f"x\n{line}" and found[2].text == "short one\n" and found[2].n_chars == 10
    assert found[3].text is None and found[4].text == "" and 5 not in found and 7 not in found and None in found and 8 in found
    assert found[1].dropped == "mine"
    assert linededup.dedup_lines(docs.limit(0)).collect() == []


def test_equal_rows_keep_the_same_lines(spark):
    rows = [(1, "one line with enough words in it\nother"), (1, "one line with enough words in it\nother")]
    assert [r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [rows[0][1]] * 2


@pytest.mark.parametrize("n", [1, 4, 5, 127, 128, 129, 3000, 40_000])
def test_fingerprints_of_any_number_of_words(spark, n):
    """Packed counters and those of single blocks give what counting gives."""
    words = [f"w{k}" for k in range(n)]
    found = {r.kind: r for r in linededup.fingerprints(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).collect()}
    want = views(" ".join(words))
    assert set(found) == set(want)
    for kind, (count, blocks) in want.items():
        row = found[kind]
        assert row.features == count
        for c, block in enumerate(blocks):
            assert (row.held >> 7 * c & 127 > 0) == (block is not None)
            got = [bool(row[f"q{j // 7}"] >> (7 * c + j % 7) & 1) for j in range(28)]
            assert got == (block or [False] * 28)


def test_recall_of_similar_lines(spark):
    """Of all pairs that are similar by edit distance, whatever their fingerprints, nine in ten are linked, at each length."""
    rng = random.Random(11)
    words = [f"{a}{b}{c}" for a in "bcdfghklmnprst" for b in ("a", "e", "o", "ui") for c in ("n", "rt", "lo", "mi", "s")]
    for low, high in ((3, 5), (5, 10), (10, 20), (20, 50), (50, 120)):
        near = []
        while len(near) < 150:
            line = [rng.choice(words) for _ in range(rng.randrange(low, high))]
            other = list(line)
            for _ in range(rng.randrange(1, 2 + len(line) // 12)):
                k = rng.randrange(len(other))
                other[k : k + 1] = rng.choice(([], [rng.choice(words)], [other[k], rng.choice(words)], [other[k] + "s"], [other[k]]))
            a, b = " ".join(line), " ".join(other)
            if a != b and b and distance(a, b) <= int(max(len(a), len(b)) * 0.2 + 1e-9):
                near.append((a, b))
        docs = spark.createDataFrame([(2 * k + side, pair[side]) for k, pair in enumerate(near) for side in (0, 1)], "doc_id long, text string")
        stay = {r.doc_id for r in linededup.dedup_lines(docs).collect()}
        assert sum(2 * k + 1 not in stay for k in range(150)) >= 0.9 * 150, (low, high)


def test_many_variants_of_one_line(spark):
    """A crowd of variants, each a word from the first, is one group; lines that share a passage with them are not in it."""
    rng = random.Random(2)
    base = [f"word{rng.randrange(500)}" for _ in range(40)]
    rows = [(k, " ".join(f"x{k}" if j == k % 40 else w for j, w in enumerate(base))) for k in range(600)]
    rows += [(1000 + k, " ".join(base[:20] + [f"own{k}a{j}" for j in range(20)])) for k in range(300)]
    stay = sorted(r.doc_id for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert stay == [0, *range(1000, 1300)]


def test_columns_of_any_name_stay(spark):
    rows = [(1, "same line of words here\nother", 7, 8, 9), (2, "same line of words here", 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, of_doc int, GONE int").withColumn("__id", F.lit(5))
    found = linededup.dedup_lines(docs)
    assert found.columns == docs.columns and [tuple(r) for r in found.collect()] == [(1, rows[0][1], 7, 8, 9, 5)]


def test_main_path_has_no_python(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    assert not re.search("Python|Pandas|Arrow", linededup.lines_of(docs)._jdf.queryExecution().explainString(mode))
    assert not re.search("Python|Pandas|Arrow", linededup.with_kept_lines(docs)._jdf.queryExecution().explainString(mode))


def test_short_lines_and_scripts_without_spaces_take_part(spark):
    chinese = "今天天气很好我们一起去公园散步然后回家吃饭看书睡觉明天再去学校上课"
    rows = [(1, "read more\nfirst own text of this page\n\n..."), (2, f"Read more!\n{chinese}\n\n..."), (3, f"{chinese}\nmenu\nmenu"), (4, "อ่านเพิ่มเติม"), (5, "อ่านเพิ่มเติม\nx")]
    found = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: rows[0][1], 2: f"{chinese}\n\n...", 3: "menu", 4: rows[3][1], 5: "x"}


def test_few_lines_go_on_to_the_join_of_texts(spark, monkeypatch):
    """Where places are too many to broadcast, little but what they hold is shuffled, and nothing that they hold is missed."""
    docs = spark.createDataFrame([(d, "\n".join(f"line {k} of document {d}" for k in range(20))) for d in range(400)], "doc_id long, text string")
    places = linededup.lines_of(docs).where("line_no = 7 AND doc_id % 10 = 0").select(*linededup.names(), "doc_id", "line_no")
    places = linededup.cut(places.select(*[F.col(c).alias(f"w_{c}") for c in ("id", "doc_id", "line_no")]), "test-places")
    monkeypatch.setattr(linededup, "BROADCAST_ROWS", 5)
    found = [(r.doc_id, r.line_no) for r in linededup._lines_at(docs, places).collect()]
    assert {(d, 7) for d in range(0, 400, 10)} <= set(found) and len(found) < 0.2 * 8000


def test_shuffled_files_go_with_their_query(spark):
    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before = files()
    counts = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    assert linededup.cut(counts, "test-counts").count() == 7
    for _ in range(50):
        left = {f for f in files() - before if f.endswith(".data") and f.startswith("shuffle_")}
        if len(left) <= 1:  # the count's own
            break
        time.sleep(0.2)
    assert len(left) <= 1
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_crowds_that_share_a_passage_make_few_pairs(spark, monkeypatch):
    """Lines with a common passage but words of their own are not met pair by pair; those of a crowd that are similar are found."""
    rng = random.Random(3)
    passage = [f"word{k}" for k in range(45)]
    rows = [(k, " ".join([f"own{k}a{j}" for j in range(13)] + passage)) for k in range(900)]
    rows += [(1000 + k, " ".join([f"own{k}a{j}" for j in range(13)] + ["more"] * (k % 4) + passage[: 45 - k % 3])) for k in rng.sample(range(900), 180)]
    made, real = {}, linededup.cut

    def counting(df, name):
        out = real(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(linededup, "cut", counting)
    stay = {r.doc_id for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert made["lines-apart"] < 10 * len(rows)
    assert stay >= set(range(900)) and len(stay) <= 900 + 18


@pytest.mark.parametrize("rows", [0, 400_000])
def test_crowds_and_many_places_match_brute_force(spark, monkeypatch, rows):
    """As test_variants_of_lines_match_brute_force, with every bucket a crowd, and lines of few words among them."""
    monkeypatch.setattr(linededup, "CROWD", 0)
    monkeypatch.setattr(linededup, "BROADCAST_ROWS", rows)
    rng = random.Random(8)
    words = [f"{a}{b}" for a in "bcdf" for b in ("ando", "erin", "ulat", "opis")]
    base = [" ".join(rng.choice(words) for _ in range(rng.choice((1, 2, 3, 5, 8, 9, 10, 11, 25, 60)))) for _ in range(30)]

    def variant(line):
        parts = line.split(" ")
        for _ in range(rng.randrange(0, 2 + len(parts) // 8)):
            k = rng.randrange(len(parts))
            parts[k : k + 1] = rng.choice([[parts[k] + "s"], [parts[k][:-1]], [parts[k], parts[k]], [rng.choice(words)], [parts[k]], [parts[k] + " 今天"]])
        return " ".join(parts)

    docs = [(d, "\n".join(variant(rng.choice(base)) for _ in range(rng.randrange(1, 9)))) for d in range(60)]
    found = kept(spark, docs)
    for (doc, _), lines in zip(docs, slow(spark, docs)):
        assert found[doc].text == "\n".join(lines), doc


def test_crowded_lines_are_told_apart_without_a_row_for_each_word(spark):
    """A row a line and kind holds the parts that it meets by, with no join by word; similar lines have one or two in common."""
    rng = random.Random(4)
    words = [f"{a}{b}" for a in "bcdf" for b in ("ando", "erin", "ulat", "opis")]
    lines = [" ".join(rng.choice(words) for _ in range(rng.choice((1, 2, 4, 8, 9, 10, 25, 60)))) for _ in range(150)]
    lines += [" ".join(w for w in line.split(" ") if rng.random() > 0.05) for line in lines] + [line + "s" for line in lines]
    lines = sorted(set(lines) - {""})
    texts = spark.createDataFrame(list(enumerate(lines)), "id long, norm string").withColumn("words", linededup.words_as_characters(F.col("norm")))
    texts = linededup.cut(texts.withColumn("norm", F.when(F.length("words") < 10, F.col("norm"))), "test-texts")
    found = linededup.rare_parts(texts, 0.8)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    assert not re.search("HashJoin|SortMergeJoin", found._jdf.queryExecution().explainString(mode))
    rows = {(r.id, r.kind): r for r in found.collect()}
    assert len(rows) == sum(1 + (len(x.split(" ")) < 10) for x in lines) and all(len(r.parts) <= r.d + 2 for r in rows.values())
    pairs = 0
    for i, a in enumerate(lines):
        for j, b in enumerate(lines[:i]):
            for kind, x, y in ((0, a.split(" "), b.split(" ")), (1, a, b)):
                one, two = rows.get((i, kind)), rows.get((j, kind))
                if not one or not two or abs(len(x) - len(y)) > 0.2 * max(len(x), len(y)) or distance(x, y) > int(max(len(x), len(y)) * 0.2 + 1e-9):
                    continue
                pairs += 1
                both = [p for p in one.parts if p in two.parts]
                assert both and both == [p for p in two.parts if p in one.parts]
                assert both[0] in one.parts[: one.d + 1] and both[0] in two.parts[: two.d + 1]
                assert len(both) > 1 or (len(one.parts) <= one.d + 1 and len(two.parts) <= two.d + 1)
    assert pairs > 150
