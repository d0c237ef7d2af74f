"""SimHash near-duplicates: 64-bit fingerprints, exact tiled comparison, connected groups.

Fingerprints that differ in at most RADIUS bits are linked. Distinct fingerprints are dealt into strips by hash, and
each pair of strips is one task: numpy exclusive-ors tile against tile and counts bits, skipping tile pairs whose
population counts (of the whole and of its quarters) differ beyond the radius. A task returns a spanning forest of
the links it finds, never the links themselves, so a group of n near copies costs n rows and not n squared.

deduplicate(), the pipeline's stage, links what shares 0.8 (Jaccard) of its sets of five-word shingles, counted exactly.
Fingerprints and MinHash signatures of LANES bytes only find candidates, with room: at 0.8 texts differ in 10 of 64 bits and
agree in 102 lanes on average, and candidates are what differs in at most STAGE_RADIUS and agrees in at least LOOSE. A first
pass returns a forest of the pairs that agree as 0.8 does, made of pairs that were compared; those are verified and
merged. A second pass returns all candidates that are still apart, and those are verified. So every candidate is verified
or implied by pairs that were, and a group of n near copies costs about n rows, unless many of its pairs are just below 0.8.
Sizes of sets that are further apart than 0.8 are skipped, as they can't reach it.

Shuffled volume is 8 bytes (the stage: 160, twice) x strips for each distinct fingerprint. The number of strips is fixed until a strip would
pass STRIP_ROWS; beyond that it grows with the input and the comparison with its square, as exact comparison must.

Defined cases: null or blank text has fingerprint zero and is linked like any other. Equal rows each give a row. A
null doc_id never names a group; a group with no other id has a null component_id. Further columns are ignored; the
stage keeps them, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, free_name, small, sliced, table
from tessera.llm.components import connected_components

WORDS, RADIUS = 4, 4
STAGE_WORDS, STAGE_RADIUS, SIMILARITY, LANES, LOOSE = 5, 24, 0.8, 128, 78
STRIPS, STRIP_ROWS = 12, 1_000_000
TILE_A, TILE_B, AT_ONCE = 256, 1024, 1 << 15
_LANES = np.random.default_rng(42).integers(0, 2**63, (2, LANES, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """XXH64 of each word shingle of a text, A-Z lower-cased, repeats included."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    whole = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    last = min(words, len(tokens)) - 1
    begin, end = (ends - sizes)[: len(tokens) - last].tolist(), ends[last:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(whole[a:b], 42) for a, b in zip(begin, end)], np.uint64)


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        part = hashes[k : k + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a text; zero if it has no word."""
    return _majority(shingle_hashes(text, words))


def signature(hashes: np.ndarray) -> bytes:
    """MinHash of a set of hashes, a byte a lane; zeros if there is none."""
    least = np.full(LANES, 2**64 - 1, np.uint64)
    for k in range(0, len(hashes), 1 << 12):
        np.minimum(least, (hashes[None, k : k + (1 << 12)] * _LANES[0] + _LANES[1]).min(1), out=least)
    return (least >> np.uint64(7)).astype(np.uint8).tobytes() if len(hashes) else bytes(LANES)


def lanes_agreeing(similarity: float) -> int:
    """How many lanes agree, on average, for sets of a similarity; different minima share a byte once in 256 times."""
    return round(LANES * (similarity * 255 + 1) / 256)


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp) for each row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            fps = [fingerprint(t.as_py(), words) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


class _Forest:
    """Union-find over positions, flattened after each change."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def spanning(self, a: np.ndarray, b: np.ndarray) -> list[int]:
        """Unites a[i] with b[i] in turn; those i that weren't together yet."""
        root, made = self.root, []
        for n, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
            while root[x] != x:
                x = root[x]
            while root[y] != y:
                y = root[y]
            if x != y:
                root[max(x, y)] = min(x, y)
                made.append(n)
        while not np.array_equal(up := root[root], root):
            root[:] = up
        return made

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Unites a[i] with b[i]; both hold roots."""
        root = self.root
        for x, y in set(zip(a.tolist(), b.tolist())):
            while root[x] != x:
                x = root[x]
            while root[y] != y:
                y = root[y]
            root[max(x, y)] = min(x, y)
        while not np.array_equal(up := root[root], root):
            root[:] = up


def _link_tile(hit: np.ndarray, a: np.ndarray, b: np.ndarray, forest: _Forest) -> None:
    """Unites what a tile links; labels spread over a crowded tile until they are stable, so its cost is its area."""
    was_a, was_b = forest.root[a], forest.root[b]
    if np.count_nonzero(hit) <= 2 * (len(a) + len(b)):
        i, k = np.nonzero(hit)
        forest.join(was_a[i], was_b[k])
        return
    now_a, now_b, far = was_a.copy(), was_b.copy(), len(forest.root)
    while True:
        new_b = np.minimum(now_b, np.where(hit, now_a[:, None], far).min(0))
        new_a = np.minimum(now_a, np.where(hit, new_b[None, :], far).min(1))
        if np.array_equal(new_a, now_a) and np.array_equal(new_b, now_b):
            break
        now_a, now_b = new_a, new_b
    forest.join(np.concatenate([was_a, was_b]), np.concatenate([now_a, now_b]))


def _counts(fp: np.ndarray) -> np.ndarray:
    """Population counts of the whole and of its four 16-bit quarters, a column each."""
    quarters = np.bitwise_count(fp.view(np.uint16).reshape(-1, 4)).astype(np.int16)
    return np.column_stack([quarters.sum(1, dtype=np.int16), quarters])


def _tiles(counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts = np.arange(0, len(counts), n)
    return starts, np.minimum.reduceat(counts, starts, axis=0), np.maximum.reduceat(counts, starts, axis=0)


def forest_of(a: np.ndarray, b: np.ndarray | None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (node, its group's first node) of the links between a and b, or within a where b is None."""
    empty = np.array([], np.uint64)
    if not len(a) or (b is not None and not len(b)):
        return empty, empty
    sides = []
    for fp in [a] if b is None else [a, b]:
        counts = _counts(fp)
        order = np.lexsort(counts.T[::-1])
        sides.append((fp[order], counts[order]))
    (fa, ca), (fb, cb) = sides[0], sides[-1]
    nodes, shift = (fa, 0) if b is None else (np.concatenate([fa, fb]), len(fa))
    forest = _Forest(len(nodes))
    (sa, low_a, high_a), (sb, low_b, high_b) = _tiles(ca, TILE_A), _tiles(cb, TILE_B)
    for k, at in enumerate(sa):
        gap = np.maximum(0, np.maximum(low_a[k] - high_b, low_b - high_a[k]))
        near = np.maximum(gap[:, 0], gap[:, 1:].sum(1)) <= radius
        rows = np.arange(at, min(at + TILE_A, len(fa)))
        for start in sb[near].tolist():
            cols = np.arange(start, min(start + TILE_B, len(fb)))
            if b is None and cols[-1] <= at:
                continue
            first = forest.root[rows[0]]
            if (forest.root[rows] == first).all() and (forest.root[cols + shift] == first).all():
                continue
            hit = np.bitwise_count(fa[rows, None] ^ fb[None, cols]) <= radius
            if b is None:
                hit &= rows[:, None] < cols[None, :]
            if hit.any():
                _link_tile(hit, rows, cols + shift, forest)
    moved = np.flatnonzero(forest.root != np.arange(len(nodes)))
    return nodes[moved], nodes[forest.root[moved]]


def _cells(distinct: DataFrame, by: str, strips: int) -> DataFrame:
    """distinct dealt into strips by a hash of a column, and copied to the cell of each pair of strips."""
    strip = F.pmod(F.xxhash64(by), F.lit(strips)).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.lit(strips - 1)), lambda t: F.struct((F.least(t, F.col("s")) * strips + F.greatest(t, F.col("s"))).alias("cell"), (F.col("s") > t).alias("second")))
    dealt = distinct.select("*", strip.alias("s")).select(*distinct.columns, F.explode(cells).alias("c"))
    return dealt.select(*distinct.columns, "c.cell", "c.second").groupBy("cell")


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): edges of forests that connect exactly what links of at most radius bits connect. distinct: (fp), none twice."""
    strips = max(STRIPS, -(-distinct.count() // STRIP_ROWS))

    def run(group: pa.Table) -> pa.Table:
        fp = group.column("fp").to_numpy().view(np.uint64)
        side = group.column("second").to_numpy(zero_copy_only=False)
        cell = group.column("cell")[0].as_py()
        u, v = forest_of(fp[~side], fp[side] if cell // strips != cell % strips else None, radius)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    return _cells(distinct, "fp", strips).applyInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for each row; component_id is the smallest doc_id reachable by links."""
    each = cut(fingerprints(docs, words), "simhash-each")
    distinct = cut(each.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    groups = connected_components(links(distinct.select("fp"), radius), "u", "v")
    return each.join(_least(distinct, groups, "fp"), "fp").select("doc_id", "fp", F.col("least").alias("component_id"))


def _least(distinct: DataFrame, groups: DataFrame, by: str) -> DataFrame:
    """(by, least) with the least of each group. distinct: (by, least) of each node."""
    grouped = cut(distinct.join(groups.withColumnRenamed("node", by), by, "left").select(by, "least", F.coalesce("component", by).alias("component")), "simhash-grouped")
    return cut(grouped.drop("least").join(grouped.groupBy("component").agg(F.min("least").alias("least")), "component").select(by, "least"), "simhash-named")


# The stage: exact similarity of sets of shingles


def shingle_set(text: str | None, words: int = STAGE_WORDS) -> np.ndarray:
    """The distinct shingles of a text, as sorted hashes."""
    return np.unique(shingle_hashes(text, words))


def set_key(hashes: np.ndarray) -> int:
    """Names a set of shingles, as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 42)).astype(np.int64))


def sketches(docs: DataFrame, words: int = STAGE_WORDS) -> DataFrame:
    """(doc_id, rk, key, n, fp, sig) for each row: names of the row and of its set of shingles, the set's size and sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            rows = []
            for t in b.column(2):
                hashes = shingle_set(t.as_py(), words)
                rows.append((set_key(hashes), len(hashes), int(np.uint64(_majority(hashes)).astype(np.int64)), signature(hashes)))
            made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], ["doc_id", "rk", "key", "n", "fp", "sig"])

    return _rows(docs).mapInArrow(run, "doc_id long, rk long, key long, n long, fp long, sig binary")


def _rows(docs: DataFrame) -> DataFrame:
    id_and_text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return id_and_text.select("doc_id", F.xxhash64("doc_id", "text").alias("rk"), "text")


def pairs_of(a: dict[str, np.ndarray], b: dict[str, np.ndarray] | None, radius: int, least: int, similarity: float, forest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the candidate pairs between a and b, or within a where b is None; or of a forest of them.

    a and b hold arrays key, n, fp, sig and group; what has one group is no candidate. With forest, a pair is left out if
    the pairs before it connect its ends; pairs whose signatures agree most come first.
    """
    sides = [{name: x[order] for name, x in side.items()} for side in ([a] if b is None else [a, b]) for order in [np.argsort(side["n"], kind="stable")]]
    a, b, shift = sides[0], sides[-1], 0 if b is None else len(sides[0]["n"])
    union, rng, u, v = _Forest(shift + len(b["n"])), np.random.default_rng(7), [], []
    begin = np.searchsorted(b["n"], np.floor(a["n"] * similarity - 1e-6), side="left")
    end = np.searchsorted(b["n"], np.ceil(a["n"] / similarity + 1e-6), side="right")
    for at in range(0, len(a["n"]), TILE_A):
        rows = np.arange(at, min(at + TILE_A, len(a["n"])))
        for start in range(max(begin[at], 0 if shift else at), end[rows[-1]], TILE_B):
            cols = np.arange(start, min(start + TILE_B, end[rows[-1]]))
            hit = np.bitwise_count(a["fp"][rows, None] ^ b["fp"][None, cols]) <= radius
            hit &= a["group"][rows, None] != b["group"][None, cols]
            if not shift:
                hit &= rows[:, None] < cols[None, :]
            i, k = np.nonzero(hit)
            i, k = rows[i], cols[k]
            while len(i):
                if forest:
                    apart = union.root[i] != union.root[k + shift]
                    i, k = i[apart], k[apart]
                now_i, now_k, i, k = i[:AT_ONCE], k[:AT_ONCE], i[AT_ONCE:], k[AT_ONCE:]
                agree = np.count_nonzero(a["sig"][now_i] == b["sig"][now_k], axis=1)
                good = np.flatnonzero(agree >= least)
                if forest and len(good):
                    # equals in a random order, so that no text is an end of most pairs
                    good = good[np.lexsort((rng.permutation(len(good)), -agree[good]))]
                    good = good[union.spanning(now_i[good], now_k[good] + shift)]
                u.append(a["key"][now_i[good]])
                v.append(b["key"][now_k[good]])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *u]), np.concatenate([none, *v])


def candidates(distinct: DataFrame, radius: int, least: int, similarity: float, forest: bool) -> DataFrame:
    """(u, v): pairs_of() all of distinct: (key, n, fp, sig, group), no key twice."""
    strips = max(STRIPS, -(-distinct.count() // (STRIP_ROWS // 8)))  # a signature takes sixteen times a fingerprint's room

    def run(group: pa.Table) -> pa.Table:
        held = {c: group.column(c).to_numpy() for c in ("key", "n", "group")}
        held["fp"] = group.column("fp").to_numpy().view(np.uint64)
        held["sig"] = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint8).reshape(-1, LANES)
        side = group.column("second").to_numpy(zero_copy_only=False)
        cell = group.column("cell")[0].as_py()
        one, two = ({c: x[part] for c, x in held.items()} for part in (~side, side))
        u, v = pairs_of(one, two if cell // strips != cell % strips else None, radius, least, similarity, forest)
        return pa.table({"u": u, "v": v})

    return _cells(distinct, "key", strips).applyInArrow(run, "u long, v long")


def verified(docs: DataFrame, distinct: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those pairs (u, v) whose sets of shingles are that similar, counted on the texts. distinct: (key, rk, ..)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            for t in b.column(2):  # a text at a time, as its hashes take more room than itself
                hashes = shingle_set(t.as_py(), words)
                made = [pa.array([set_key(hashes)], pa.int64()), pa.array([hashes.view(np.int64)], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(made, ["key", "hashes"])

    nodes = pairs.select(F.explode(F.array("u", "v")).alias("key")).distinct()
    wanted = small(cut(distinct.join(nodes, "key").select("rk"), "simhash-wanted"))
    sets = cut(_rows(docs).join(wanted, "rk", "left_semi").select("doc_id", "rk", "text").mapInArrow(run, "key long, hashes array<long>").dropDuplicates(["key"]), "simhash-sets")
    both = pairs.join(sets.toDF("u", "hu"), "u").join(sets.toDF("v", "hv"), "v")
    shared = both.select("u", "v", F.size(F.array_intersect("hu", "hv")).alias("common"), (F.size("hu") + F.size("hv")).alias("total"))
    return cut(shared.where(F.col("common") >= F.lit(similarity) * (F.col("total") - F.col("common")) - 1e-9).select("u", "v"), "simhash-links")


def similar_documents(docs: DataFrame, words: int = STAGE_WORDS, radius: int = STAGE_RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, rk, first) for each row: first is the (nameless, doc_id, rk) that comes first in its group.

    rk is a hash of doc_id and text. Links are sets of shingles of that similarity, found as the module says.
    """
    each = cut(sketches(docs, words), "simhash-each")
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "rk")
    distinct = cut(each.groupBy("key").agg(F.min(row).alias("least"), F.min("rk").alias("rk"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("sig").alias("sig")), "simhash-distinct")
    sketched = distinct.select("key", "n", "fp", "sig", F.col("key").alias("group"))
    pairs = cut(candidates(sketched, radius, lanes_agreeing(similarity), similarity, True), "simhash-forest")
    found = verified(docs, distinct, pairs, words, similarity)
    groups = connected_components(found, "u", "v")
    grouped = sketched.join(groups, F.col("key") == F.col("node"), "left").select("key", "n", "fp", "sig", F.coalesce("component", "key").alias("group"))
    least = min(LOOSE, lanes_agreeing(similarity))
    more = cut(candidates(grouped, radius, least, similarity, False).join(pairs.select(F.least("u", "v").alias("x"), F.greatest("u", "v").alias("y")), (F.least("u", "v") == F.col("x")) & (F.greatest("u", "v") == F.col("y")), "left_anti"), "simhash-apart")
    if not more.isEmpty():
        groups = connected_components(found.unionByName(verified(docs, distinct, more, words, similarity)), "u", "v")
    return each.select("doc_id", "rk", "key").join(_least(distinct.select("key", "least"), groups, "key"), "key").select("doc_id", "rk", F.col("least").alias("first"))


def deduplicate(docs: DataFrame, words: int = STAGE_WORDS, radius: int = STAGE_RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each group: that with the smallest doc_id, and of different texts under that doc_id the one that comes
    first in order of a hash.

    Rows are told apart by doc_id and text, so different texts under one doc_id are decided on each for itself. Of rows equal in
    both, any one stays. Rows without a doc_id come last and take part like any other.
    """
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "rk")
    found = similar_documents(docs, words, radius, similarity).select("doc_id", "rk", (row == F.col("first")).alias("stays"))
    rows = found.groupBy("rk", "doc_id").agg(F.min("stays").alias("stays"), F.count("*").alias("rows"))
    special = cut(rows.where("NOT stays OR rows > 1").select("rk", "doc_id", "stays"), "simhash-special")
    key, of_doc, stays, name = (free_name(x, docs.columns) for x in ("of_row", "of_doc", "stays", "row_name"))
    named = docs.withColumn(name, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    joined = named.join(small(special).toDF(key, of_doc, stays), (F.col(name) == F.col(key)) & F.col("doc_id").cast("long").eqNullSafe(F.col(of_doc)), "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    single = joined.where(F.col(key).isNull()).select(*columns)
    if special.where("stays").isEmpty():
        return single
    return single.unionByName(joined.where(stays).dropDuplicates([name, "doc_id"]).select(*columns))


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
