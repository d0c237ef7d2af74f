"""SimHash near-duplicates against a brute-force version."""

import numpy as np
import pytest
import xxhash
from conftest import SMALL
from pyspark.sql import functions as F

from tessera.llm import simhash


def slow_fingerprint(text, words=4):
    found, low = [], "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    word = ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            found += [word] if word else []
            word = ""
        else:
            word += c
    if not found:
        return 0
    shingles = [" ".join(found[k : k + words]) for k in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps, radius=4):
    """{fingerprint: its group's members} by comparing all pairs."""
    fps = sorted(set(fps))
    group = {f: {f} for f in fps}
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= radius and group[a] is not group[b]:
                group[a] |= group[b]
                for f in group[b]:
                    group[f] = group[a]
    return group


def expected(rows):
    each = [(d, slow_fingerprint(t)) for d, t in rows]
    group = slow_components([f for _, f in each])
    least = {f: min((d for d, g in each if g in group[f] and d is not None), default=None) for f in group}
    return sorted(((d, f"{f:016x}", least[f]) for d, f in each), key=str)


def test_query_matches_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    found = simhash.op1_simhash_near_dedup(spark, SMALL)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, found.collect()), key=str) == expected(rows)


def test_cases(spark):
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (4, "One"), (5, "one"), (6, "ONE two"), (7, long), (8, long.upper()), (9, long + " tail"), (None, "one"), (None, "alone in the world"), (10, "É é \x85 x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit("mine"), "component_id": F.lit(0), "least_id": F.lit(1)})
    found = simhash.near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id")
    assert sorted(map(tuple, found.collect()), key=str) == expected(rows)
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_forest_links_what_all_pairs_link():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**64, 40, dtype=np.uint64)
    near = [c ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False))) for c in centres for _ in range(40)]
    fps = np.unique(np.array([*near, 0, 2**64 - 1], np.uint64))
    group = slow_components(fps.tolist())
    u, v = simhash.forest_of(fps, None)
    root = {f: f for f in fps.tolist()}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in zip(u.tolist(), v.tolist()):
        assert top(a) != top(b)  # a forest: no link is told twice
        root[top(a)] = top(b)
    assert {f: top(f) for f in root} == {f: top(next(iter(sorted(group[f])))) for f in root}
    half = rng.permutation(fps)
    a, b = np.sort(half[::2]), np.sort(half[1::2])
    for x, y in zip(*map(np.ndarray.tolist, simhash.forest_of(a, b))):
        assert group[x] is group[y]


def test_crowded_tiles_cost_their_area(spark):
    """Thousands of fingerprints that all link give one group and a forest of n - 1 links."""
    fps = np.unique(np.array([(1 << a) | (1 << b) for a in range(64) for b in range(64)], np.uint64))
    u, _ = simhash.forest_of(fps, None)
    assert len(u) == len(fps) - 1


@pytest.mark.parametrize("strips", [1, 3])
def test_strips_do_not_matter(spark, monkeypatch, strips):
    monkeypatch.setattr(simhash, "STRIPS", strips)
    rows = [(k, f"some words {'x' * (k % 5)} and more of them {k // 20}") for k in range(60)]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id")
    assert sorted(map(tuple, found.collect()), key=str) == expected(rows)


def test_one_of_each_group_stays(spark):
    rows = [(3, "a b c d e f", "x"), (1, "a b c d e f", "y"), (1, "a b c d e f", "z"), (2, "quite other words here now", "q"), (None, "a b c d e f", "n"), (9, None, "m"), (8, "", "l"), (None, "nobody named this text of words", "o")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id string").withColumns({"of_row": F.lit(1), "STAYS": F.lit(2), "first": F.lit(3)})
    found = [tuple(r) for r in simhash.deduplicate(docs).collect()]
    assert sorted((r[0] for r in found), key=str) == [1, 2, 8, None] and (None, "nobody named this text of words", "o", 1, 2, 3) in found
    assert simhash.deduplicate(docs).columns == docs.columns
    assert simhash.deduplicate(docs.limit(0)).collect() == []


def test_texts_under_one_id_are_told_apart(spark):
    a, b, c, d = ("first words of the first text here", "second text with words of its own", "third one is about something else", "fourth and last of them all today")
    docs = spark.createDataFrame([(1, a), (1, b), (2, c), (3, c), (3, d), (3, d)], "doc_id long, text string")
    assert sorted(map(tuple, simhash.deduplicate(docs).collect())) == sorted([(1, a), (1, b), (2, c), (3, d)])


def stage_groups(rows):
    """{doc_id: smallest doc_id of its group} by the exact similarity of all pairs of texts."""
    each = [(d, shingles(t)) for d, t in rows]
    group = {d: {d} for d, _ in rows}
    for i, (a, x) in enumerate(each):
        for b, y in each[i + 1 :]:
            if group[a] is not group[b] and min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y):
                group[a] |= group[b]
                for d in group[b]:
                    group[d] = group[a]
    return {d: min(g) for d, g in group.items()}


def shingles(text, words=5):
    w = text.encode().lower().split()
    return {b" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    for share in (0.3, 0.6, 0.8, 0.95):
        off = []
        for _ in range(60):
            hashes = rng.integers(0, 2**64, 4000, np.uint64)
            both = int(4000 * share)
            a, b = hashes[: both + (4000 - both) // 2], np.concatenate([hashes[:both], hashes[both + (4000 - both) // 2 :]])
            agree = (np.frombuffer(simhash.signature(a), np.uint8) == np.frombuffer(simhash.signature(b), np.uint8)).sum()
            off.append(agree / simhash.LANES - (share * 255 + 1) / 256)
        assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.06


def test_stage_finds_edited_copies_and_nothing_else(spark):
    """Copies with one word in 60 changed (similarity about 0.85) are found; texts that share half of theirs are not."""
    import random

    rng = random.Random(8)
    words = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "rt", "lo", "mi", "s")]
    rows, near = [], 0
    for k in range(60):
        text = rng.choices(words, k=rng.randrange(120, 600))
        rows.append((3 * k, " ".join(text)))
        edited = [rng.choice(words) if j % 60 == 30 else w for j, w in enumerate(text)]
        rows.append((3 * k + 1, " ".join(edited)))
        rows.append((3 * k + 2, " ".join(text[: len(text) // 2] + rng.choices(words, k=len(text) - len(text) // 2))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id for r in simhash.deduplicate(docs).collect()}
    texts = dict(rows)
    for k in range(60):
        assert 3 * k in found and 3 * k + 2 in found
        a, b = shingles(texts[3 * k]), shingles(texts[3 * k + 1])
        near += (3 * k + 1 not in found) == (len(a & b) / len(a | b) >= 0.8)
    assert near >= 54
    groups = stage_groups(rows)
    assert found == {d for d, g in groups.items() if d == g}


def test_crowded_group_of_edited_copies(spark):
    """Many copies of one text, each edited elsewhere: one group, of which one document stays."""
    import random

    rng = random.Random(4)
    text = [f"word{rng.randrange(5000)}" for _ in range(400)]
    rows = [(k, " ".join("other" if j == (7 * k) % 400 else w for j, w in enumerate(text))) for k in range(1500)]
    assert [r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0]


def test_stage_links_what_exact_similarity_links(spark):
    """Pairs at similarities around 0.8: what exact Jaccard links is linked, and what is under 0.8 stays."""
    import random

    rng = random.Random(6)
    rows = []
    for k in range(150):
        text = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(150, 400))]
        edited = list(text)
        for at in rng.sample(range(0, len(text) - 9, 10), round(len(text) * (0.10 + 0.01 * rng.random()) / 4.6)):
            edited[at + 4] = "edited"
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(edited))]
    texts, found = dict(rows), {r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    similar = [len(a & b) / len(a | b) for k in range(150) for a, b in [(shingles(texts[2 * k]), shingles(texts[2 * k + 1]))]]
    assert sum(0.8 <= s < 0.83 for s in similar) > 20 and sum(0.76 < s < 0.8 for s in similar) > 20
    assert found == {2 * k for k in range(150)} | {2 * k + 1 for k in range(150) if similar[k] < 0.8}
