"""Fuzzy line dedup in DataFrame operations only: SimHash, pigeonhole blocks, edit similarity, connected groups.

1. Lines are normalised (runs of anything but letters, marks and digits become a space; lower case); all that aren't empty
   then count. Equal lines are merged first, so that each is fingerprinted once.
2. A line's SimHash has BLOCKS blocks of BITS bits, and each word votes only in the block that its hash names. So a changed
   word disturbs the block it left and the one it came to, and no other, however long the line: lines a few words apart
   agree on whole blocks, where bits of an ordinary SimHash would flip all over. Words count once a line. Lines of under
   GRAM_CHARS characters or under five different words, as in short lines and in scripts without spaces, (also) have a SimHash
   over their runs of GRAM characters.
3. Lines that agree on a window of adjacent blocks meet. Windows hold about five words: the longer the line, the fewer
   blocks (TIERS). A line is in each tier that a line of 0.8 to 1.25 times its words is in, so similar lines share one.
4. Lines that meet are linked if their fingerprints differ in at most RADIUS bits and their edit similarity,
   1 - distance / longer length, is at least SIMILARITY in words or, for lines of under FEW_WORDS words, in characters. At first each line meets one line of each of its buckets, and
   what links is merged. Then only lines of a bucket that are in different groups meet, and in buckets of over CROWD rows outside one group
   only those that share one of the rarest fifth (and one more) of their words, as similar lines do (rare_parts() says why); where over
   CROWD rows share a word too, those that share two. So every
   link between lines that share a window is found or implied, many variants of one line cost as many rows as there are
   variants, and a passage that many else different lines hold doesn't make a pair of each two of them.
5. Each group keeps its first occurrence, by (doc_id, line number); all others go, with repeats of equal lines.

The counters of a block's bits sit side by side in longs, BLOCKS lanes in each, for lines of at most MOST different words; for
longer ones each block is counted by itself. Lines are named by 64-bit hashes of their text. Texts of candidate lines are
fetched from the documents by position; tables of positions are broadcast only if they have few rows, counted first; beyond that, bitmaps of
the positions are, and only lines that these let through are shuffled.

Defined cases: null text has no lines and stays null; lines without a letter, mark or digit are always kept; a document that
loses every line goes, others keep their order of lines; equal rows (same doc_id and text) keep the same lines; null
doc_ids come first; an empty table gives an empty table; columns other than text and n_chars are kept as they are,
whatever their names.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import BROADCAST_ROWS, cut, free_name, remove, small, table
from tessera.llm.components import connected_components

SIMILARITY, RADIUS = 0.8, 40
#: Lines of fewer words are also compared by characters.
FEW_WORDS = 10
BLOCKS, BITS, LANE = 8, 28, 7
GRAM, GRAM_CHARS = 3, 40
#: Different words from (with those 0.8 times as many) and below, and the blocks in a window.
TIERS, GRAM_WINDOW = ((5, 10, 4), (10, 20, 3), (20, 50, 2), (50, 1 << 31, 1)), 2
#: Rows of a bucket outside one of its groups beyond which not all of its lines meet.
CROWD = 100
#: Lines, about, that tell which parts are usual, and how many parts at most count as such.
USUAL_LINES, USUAL_PARTS = 4096, 1024
#: Bits of a bitmap, bits for each place that is looked for, and bitmaps at most (32 MB).
_MAP_BITS, SIEVE_BITS, SIEVE_MAPS = 1 << 15, 16, 8192
MOST = (1 << LANE) - 1
_ONES = sum(1 << (LANE * c) for c in range(BLOCKS))
_QUARTERS = [f"q{k}" for k in range(BITS // LANE)]
_PLACE, _ONE = ["doc_id", "dk", "line_no"], ["doc_id", "line_no"]
#: Anything but letters, marks and digits; ASCII is spelt out, as it is tested fastest.
_GAP = r"[\x00-/:-@\[-`{-\x7F[\x{80}-\x{10FFFF}&&[^\p{L}\p{M}\p{N}]]]+"

#: What is between gaps, in lower case; the pattern of regexp_extract_all is compiled once, that of split for each line.
_WORD = r"[a-z0-9[\x{80}-\x{10FFFF}&&[\p{L}\p{M}\p{N}]]]+"


def normalised(line: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(line, _GAP, " ")))


def document_key() -> Column:
    """With doc_id, names a document row by its content."""
    return F.xxhash64("doc_id", "text")


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, dk, line_no, line) of each line that isn't empty."""
    keyed = docs.select("doc_id", document_key().alias("dk"), "text")  # by itself, so that the text is hashed once and not for each line
    return _exploded(keyed)


def _exploded(keyed: DataFrame) -> DataFrame:
    return keyed.select(*[c for c in keyed.columns if c != "text"], F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).where("line <> ''")


def names() -> list[Column]:
    """A line's name among candidates, and what tells apart lines of one name where equal ones are dropped."""
    return [F.xxhash64("line").alias("id"), F.hash("line").alias("id2")]


def fingerprints(docs: DataFrame) -> DataFrame:
    """A row for each different line and kind of fingerprint: kind 0 is over words, kind 1 over runs of characters.

    id, id2: name; main: true in one row a line; n: occurrences; doc_id, line_no: where one of them is; features: how many; held: which blocks have any; q0 to q3: LANE bits of each block in each.
    """
    lettered = _exploded(docs.select("doc_id", "text")).where(F.col("line").rlike(r"[\p{L}\p{M}\p{N}]"))
    merged = lettered.groupBy(*names()).agg(F.first("line").alias("line"), *[F.first(c).alias(c) for c in _ONE], F.count("*").alias("n"))
    line = merged.select("id", "id2", "n", *_ONE, F.length("line").alias("length"), F.regexp_extract_all(F.lower("line"), F.lit(_WORD), F.lit(0)).alias("all"))
    split = line.withColumn("words", F.array_distinct("all"))
    few, short = F.size("words") < 4, (F.size("words") < 5) | (F.col("length") < GRAM_CHARS)
    split = split.withColumn("chars", F.when(short, F.split(F.array_join("all", " "), "", -1)))
    grams = F.transform(F.slice("chars", 1, F.greatest(F.size("chars") - GRAM + 1, F.lit(1))), lambda c, k: F.concat(c, *[F.coalesce(F.get("chars", k + i), F.lit("")) for i in range(1, GRAM)]))
    view = lambda kind, of, main: F.struct(F.lit(kind).alias("kind"), main.alias("main"), of.alias("of"))
    views = F.array_compact(F.array(F.when(~few, view(0, F.col("words"), F.lit(True))), F.when(short, view(1, F.array_distinct(grams), few))))
    base = ["id", "id2", "n", *_ONE]
    seen = split.select(*base, F.explode(views).alias("view")).select(*base, "view.kind", "view.main", F.size("view.of").alias("features"), F.explode("view.of").alias("x"))
    keys, rest = ["id", "id2", "kind"], ["n", *_ONE, "main", "features"]
    hashed = seen.select(*keys, *rest, F.xxhash64("x").alias("h")).withColumn("block", F.shiftrightunsigned("h", 61).cast("int"))
    # the rows are already dealt by (id, id2), so what follows doesn't shuffle
    votes = hashed.select(*keys, *rest, "h", F.when(F.col("features") > MOST, F.col("block")).otherwise(-1).alias("alone"), F.when(F.col("features") > MOST, 0).otherwise(F.col("block") * LANE).alias("at"))
    same = [F.max(c).alias(c) for c in rest]  # the line's, in each of its rows
    ones = [F.sum(F.expr(f"shiftleft(shiftrightunsigned(h, {j}) & 1L, at)")).alias(f"s{j}") for j in range(BITS)]
    counted = votes.groupBy(*keys, "alone").agg(*same, *ones, F.sum(F.expr("shiftleft(1L, at)")).alias("c"))
    # a count is over half of its block's c if adding top - 1 - floor(c / 2) reaches the bit that is worth top
    packed, high = F.col("alone") < 0, 8 * LANE - 9
    half = F.shiftrightunsigned("c", 1)
    room = F.when(packed, F.lit(_ONES * 63) - half.bitwiseAND(F.lit(_ONES * 63))).otherwise(F.lit((1 << high) - 1) - half)
    top = F.when(packed, F.lit(_ONES << (LANE - 1))).otherwise(F.lit(1 << high))
    ready = counted.withColumns({"room": room, "top": top})

    def quarter(k: int) -> Column:
        bits = [F.shiftrightunsigned((F.col(f"s{k * LANE + j}") + F.col("room")).bitwiseAND(F.col("top")), LANE - 1 - j) for j in range(LANE)]
        return functools.reduce(Column.bitwiseOR, bits)

    quarters = ready.select(*keys, *rest, "alone", "c", *[quarter(k).alias(q) for k, q in enumerate(_QUARTERS)])
    to = F.col("alone") * LANE
    placed = {q: F.when(packed, F.col(q)).otherwise(F.call_function("shiftleft", F.shiftrightunsigned(q, high - LANE + 1), to)) for q in _QUARTERS}
    held = F.when(packed, F.col("c")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), to))
    bits = quarters.select(*keys, *rest, held.alias("held"), *[placed[q].alias(q) for q in _QUARTERS])
    return bits.groupBy(*keys).agg(*same, *[F.bit_or(c).alias(c) for c in ("held", *_QUARTERS)])


def buckets(prints: DataFrame) -> DataFrame:
    """(bk, id, kind) for each window of a fingerprint that has a feature."""
    within = [F.when((F.col("kind") == 0) & (F.col("features") >= -(-low * 4 // 5)) & (F.col("features") < high), w) for low, high, w in TIERS]
    tiers = F.array_compact(F.array(*within, F.when(F.col("kind") == 1, GRAM_WINDOW)))
    window = prints.select("id", "kind", "held", *_QUARTERS, F.explode(tiers).alias("w")).select("*", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("b"))
    whole = BLOCKS * LANE
    mask = F.expr(f"(shiftleft(shiftleft(1L, {LANE} * w) - 1L, {LANE} * b) | shiftrightunsigned(shiftleft(1L, {LANE} * w) - 1L, {whole} - {LANE} * b)) & {(1 << whole) - 1}L")
    masked = window.withColumn("mask", mask).where("held & mask <> 0")
    return masked.select(F.xxhash64("kind", "w", "b", *[F.col(q).bitwiseAND(F.col("mask")) for q in _QUARTERS]).alias("bk"), "id", "kind")


def _near(a: str, b: str, radius: int) -> Column:
    """Whether the fingerprints of two lines (prefixes of columns) allow a link."""
    return sum((F.bit_count(F.col(f"{a}{q}").bitwiseXOR(F.col(f"{b}{q}"))) for q in _QUARTERS), F.lit(0)) <= radius


def words_as_characters(norm: Column) -> Column:
    """A text with a character for each word, named by the word's hash in 0xF0000."""
    code = lambda w: F.hex(F.pmod(F.xxhash64(w), F.lit(0xF0000)) + 0x10000)  # five digits
    return F.decode(F.unhex(F.concat(F.lit("000"), F.array_join(F.transform(F.split(norm, " ", -1), code), "000"))), "UTF-32")


def _sieve(places: DataFrame, n: int) -> tuple[DataFrame, int]:
    """Bitmaps (sieve, bits) of the hashes (w_hash) of n places, SIEVE_BITS bits a place while that is at most SIEVE_MAPS bitmaps; and their number."""
    maps = min(SIEVE_MAPS, n * SIEVE_BITS // _MAP_BITS + 1)
    at = F.shiftrightunsigned("w_hash", 15)
    return places.groupBy(F.pmod(at, F.lit(maps)).alias("sieve")).agg(F.bitmap_construct_agg(F.col("w_hash").bitwiseAND(F.lit(_MAP_BITS - 1))).alias("bits")), maps


def _lines_at(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) that hold the lines at places, a table, with few others if these are too many to broadcast.

    What goes on to a join is thus in proportion to the places, and not all texts.
    """
    n = places.count()
    if n <= BROADCAST_ROWS:
        docs = docs.join(F.broadcast(places.select("w_doc_id").distinct()), F.col("doc_id").eqNullSafe(F.col("w_doc_id")), "left_semi")
        return _exploded(docs.select("doc_id", "text"))
    bits, maps = _sieve(places.withColumn("w_hash", F.xxhash64("w_id", "w_doc_id", "w_line_no")), n)
    hashed = _exploded(docs.select("doc_id", "text")).withColumn("hash", F.xxhash64(F.xxhash64("line"), "doc_id", "line_no"))
    met = hashed.join(F.broadcast(bits), F.pmod(F.shiftrightunsigned("hash", 15), F.lit(maps)) == F.col("sieve"))
    at = F.col("hash").bitwiseAND(F.lit(_MAP_BITS - 1)).cast("int")
    byte = F.ascii(F.decode(F.substring("bits", F.shiftright(at, 3) + 1, F.lit(1)), "ISO-8859-1"))
    return met.where(F.call_function("shiftright", byte, at.bitwiseAND(7)).bitwiseAND(1) == 1).select("doc_id", "line_no", "line")


def texts_of(docs: DataFrame, prints: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, words, norm) of the lines of ids (w_id): a character for each word, and the text of those of under FEW_WORDS words."""
    places = cut(prints.where("main").join(ids, F.col("id") == F.col("w_id")).select("w_id", *[F.col(c).alias(f"w_{c}") for c in _ONE]), "lines-places")
    wanted = small(places)
    # documents may share an id, so a line is the one that is wanted only if its name is
    here = (F.xxhash64("line") == F.col("w_id")) & (F.col("line_no") == F.col("w_line_no")) & F.col("doc_id").eqNullSafe(F.col("w_doc_id"))
    found = _lines_at(docs, places).join(wanted, here)
    texts = found.select(F.col("w_id").alias("id"), normalised(F.col("line")).alias("norm")).dropDuplicates(["id"])
    texts = texts.select("id", words_as_characters(F.col("norm")).alias("words"), "norm")
    texts = cut(texts.select("id", "words", F.when(F.length("words") < FEW_WORDS, F.col("norm")).alias("norm")), "lines-texts")
    remove(places)
    return texts


def _bound(x: str, y: str, similarity: float, share: float = 1) -> str:
    """The distance up to which two texts of those lengths are similar."""
    return f"CAST(floor(greatest({x}, {y}) * {(1 - similarity) * share!r} + 1e-9) AS INT)"


def verified(texts: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (a, b, ..) of lines whose edit similarity suffices. pairs, texts: tables."""
    both = pairs.join(texts.toDF("a", "wa", "ta"), "a").join(texts.toDF("b", "wb", "tb"), "b")
    # the distance costs length x bound, so a smaller bound, which most links meet, is tried first
    within = lambda x, y, share=1: f"levenshtein({x}, {y}, {_bound(f'length({x})', f'length({y})', similarity, share)}) >= 0"
    return cut(both.where(F.expr(f"{within('wa', 'wb', 0.5)} OR {within('wa', 'wb')} OR (ta IS NOT NULL AND tb IS NOT NULL AND {within('ta', 'tb')})")).select(*pairs.columns), "lines-links")


def rare_parts(texts: DataFrame, similarity: float) -> DataFrame:
    """(id, kind, size, d, parts) of each line of texts, a table: similar lines have one of the first d + 1 parts in common; size is the number of words.

    Two texts of at most n words that are d words apart share all but d words of the longer. So, whatever order different
    words are taken in, the first that both hold is among the first d + 1 of each; words that few lines hold come first. For
    lines of under FEW_WORDS words the same goes for pairs of characters, of which an edit changes two at most (rounded down
    after doubling, as the longer text of the two may have a distance more). If a line has more than d + 1 parts, it has two
    in common with a similar one, both among the first d + 2, which is how many parts holds.
    """
    most = lambda x, each: F.floor(F.length(x) * ((1 - similarity) * each) + 1e-9).cast("int")
    pairs = F.transform(F.split(F.concat("norm", F.lit(" ")), "", -1), lambda c, k: F.concat(c, F.coalesce(F.get(F.split(F.concat(F.lit(" "), "norm"), "", -1), k), F.lit(""))))
    view = lambda kind, of, d: F.struct(F.lit(kind).alias("kind"), F.array_distinct(F.transform(of, lambda x: F.hash(F.lit(kind), x))).alias("of"), d.alias("d"))
    views = F.array_compact(F.array(view(0, F.split("words", "", -1), most("words", 1)), F.when(F.col("norm").isNotNull(), view(1, pairs, most("norm", 2)))))
    seen = texts.select("id", F.length("words").alias("size"), F.explode(views).alias("view")).select("id", "size", "view.*")
    # the order is one for all lines, and any would do: a sample tells the usual parts, which come last, the most frequent at the end
    sample = seen.where(F.pmod("id", F.lit(texts.count() // USUAL_LINES + 1)) == 0).select(F.explode("of").alias("part"))
    usual = sample.groupBy("part").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "part").limit(USUAL_PARTS)
    usual = usual.agg(F.array_sort(F.collect_list(F.struct("n", "part"))).alias("u")).select(F.col("u.part").alias("usual"))
    order = F.concat(F.array_sort(F.array_except("of", "usual")), F.array_intersect("usual", "of"))
    return seen.crossJoin(F.broadcast(usual)).select("id", "kind", "size", "d", F.slice(order, F.lit(1), F.col("d") + 2).alias("parts"))


def _mixed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows of keys that have several groups (g), with low, one of these, and others, the number of rows outside it."""
    key = Window.partitionBy(*keys)
    return rows.withColumn("low", F.min("g").over(key)).withColumn("others", F.count_if(F.col("g") != F.col("low")).over(key)).where("others > 0")


def linked(docs: DataFrame, prints: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """(node, component) of each line that is linked to another, by id. prints: a table of fingerprints()."""
    bucket = Window.partitionBy("bk")
    met = buckets(prints).withColumn("c", F.count("*").over(bucket)).where("c > 1").select("bk", "id", "kind")
    shared = cut(met.join(prints.select("id", "kind", *_QUARTERS), ["id", "kind"]).select("bk", "id", *_QUARTERS), "lines-shared")

    # at first, each line meets one line of each of its buckets
    head = F.min(F.struct("id", *_QUARTERS)).over(bucket)
    stars = shared.select("*", head.alias("h")).where("h.id <> id").select("*", *[F.col(f"h.{c}").alias(f"h_{c}") for c in ("id", *_QUARTERS)])
    stars = cut(stars.where(_near("", "h_", radius)).select(F.least("id", "h_id").alias("a"), F.greatest("id", "h_id").alias("b")).distinct(), "lines-met")
    texts = texts_of(docs, prints, stars.select(F.explode(F.array("a", "b")).alias("w_id")).distinct())
    groups = connected_components(verified(texts, stars, similarity), "a", "b")
    remove(texts)

    # what is still apart in a bucket meets; what is together needn't
    group = small(groups).withColumnsRenamed({"node": "g_id", "component": "g"})
    placed = shared.join(group, F.col("id") == F.col("g_id"), "left").select(*shared.columns, F.coalesce("g", "id").alias("g"))
    mixed = cut(_mixed(placed, ["bk"]), "lines-mixed")
    remove(shared)
    more = _apart(docs, prints, mixed, stars, radius, similarity)
    for used in (mixed, stars):
        remove(used)
    if more.isEmpty():
        return groups
    texts = texts_of(docs, prints, more.select(F.explode(F.array("a", "b")).alias("w_id")).distinct())
    joins = verified(texts, more, similarity)
    remove(texts)
    merged = connected_components(joins, "ga", "gb").toDF("g", "whole")
    alone = joins.select(F.explode(F.array("ga", "gb")).alias("node")).distinct().join(groups, "node", "left_anti").select("node", F.col("node").alias("component"))
    return cut(groups.unionByName(alone).join(merged, F.col("component") == F.col("g"), "left").select("node", F.coalesce("whole", "component").alias("component")), "lines-groups")


def _apart(docs: DataFrame, prints: DataFrame, mixed: DataFrame, stars: DataFrame, radius: int, similarity: float) -> DataFrame:
    """(a, b, ga, gb): lines of a bucket in different groups that may be similar, without those of stars; a table. mixed, stars: tables.

    In crowded buckets those that share a rare part meet, and where those of a word are a crowd again, those that share two.
    """

    def met(rows: DataFrame, keys: list[str]) -> DataFrame:
        one, two = (rows.select(*keys, *[F.col(c).alias(f"{side}_{c}") for c in rows.columns if c not in keys]) for side in "xy")
        apart = (F.col("x_g") != F.col("y_g")) & ((F.col("x_g") == F.col("x_low")) | (F.col("x_id") < F.col("y_id")))
        return one.join(two.where("y_g <> y_low").drop("y_low"), keys).where(apart).where(_near("x_", "y_", radius))

    found = [F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b"), *[F.when(F.col("x_id") < F.col("y_id"), F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in (("x_g", "y_g", "ga"), ("y_g", "x_g", "gb"))]]
    few, many = mixed.where(F.col("others") <= CROWD).drop("others"), mixed.where(F.col("others") > CROWD).drop("others", "low")
    pairs, used = met(few, ["bk"]).select(*found), []
    if not many.isEmpty():
        texts = texts_of(docs, prints, many.select(F.col("id").alias("w_id")).distinct())
        parts = cut(rare_parts(texts, similarity), "lines-parts")
        remove(texts)
        once = cut(_mixed(many.join(parts, "id").select("*", F.posexplode(F.slice("parts", F.lit(1), F.col("d") + 1)).alias("at", "part")), ["bk", "part"]), "lines-crowds")
        used = [parts, once]
        # lines of at most d + 1 parts may have but one in common, which then is named twice; two pairs of characters tell little more than one
        again = F.when(F.size("parts") <= F.col("d") + 1, F.array("part")).otherwise(F.array().cast("array<int>"))
        second = F.when((F.col("kind") == 0) & (F.col("others") > CROWD), F.concat(F.slice("parts", F.col("at") + 2, F.size("parts")), again)).otherwise(F.array("part"))
        twice = once.select("*", F.explode(second).alias("next")).drop("others", "kind", "d", "at")
        # of sizes that similar lines have, and at the first part that both have
        sizes = f"abs(x_size - y_size) <= {_bound('x_size', 'y_size', similarity)} OR greatest(x_size, y_size) < {FEW_WORDS}"
        crowds = met(twice, ["bk", "part", "next"])
        pairs = pairs.unionByName(crowds.where(F.expr(sizes)).where("get(array_intersect(x_parts, y_parts), 0) = part").select(*found))
    more = cut(pairs.distinct().join(stars, ["a", "b"], "left_anti"), "lines-apart")
    for x in used:
        remove(x)
    return more


def dropped_lines(docs: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, dk, dropped): the numbers of the lines that each document loses."""
    docs = docs.select("doc_id", "text")
    prints = cut(fingerprints(docs), "lines-prints")
    groups = linked(docs, prints, radius, similarity)
    joined = prints.where("main").select("id", "id2", "n").join(groups, F.col("id") == F.col("node"), "left")
    several = cut(joined.where("n > 1 OR component IS NOT NULL").select(F.col("id").alias("g_id"), F.col("id2").alias("g_id2"), F.coalesce("component", "id").alias("g")), "lines-several")
    named = lines_of(docs).select(*_PLACE, *names())
    held = cut(named.join(small(several), (F.col("id") == F.col("g_id")) & (F.col("id2") == F.col("g_id2"))).select("g", *_PLACE), "lines-repeated")
    place = F.struct("doc_id", "line_no", "dk")
    firsts = small(cut(held.groupBy("g").agg(F.min(place).alias("keep")), "lines-firsts"))
    gone = held.join(firsts, "g").where(~place.eqNullSafe(F.col("keep")))
    out = cut(gone.groupBy("doc_id", "dk").agg(F.collect_set("line_no").alias("dropped")), "lines-dropped")
    for used in (prints, several, held):
        remove(used)
    return out


def with_kept_lines(docs: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """docs with text reduced to the lines that stay, and n_lines and n_dropped, which replace columns of those names."""
    return _kept(docs, "n_lines", "n_dropped", radius, similarity)


def _kept(docs: DataFrame, n_lines: str, n_dropped: str, radius: int, similarity: float) -> DataFrame:
    of_doc, of_key, gone = (free_name(x, docs.columns) for x in ("of_doc", "of_key", "gone"))
    lost = small(dropped_lines(docs, radius, similarity)).toDF(of_doc, of_key, gone)
    found = docs.join(lost, (document_key() == F.col(of_key)) & F.col("doc_id").eqNullSafe(F.col(of_doc)), "left")
    lines, loses = F.split("text", "\n", -1), F.col(gone).isNotNull()
    rest = F.array_join(F.filter(lines, lambda x, k: ~F.array_contains(F.col(gone), k)), "\n")
    columns = [F.when(loses, rest).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in (n_lines, n_dropped)]
    return found.select(*columns, F.coalesce(F.size(lines), F.lit(0)).cast("long").alias(n_lines), F.when(loses, F.size(gone)).otherwise(0).cast("long").alias(n_dropped))


def dedup_lines(docs: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """docs without repeated lines; n_chars, if there, follows the text. Documents that lose all lines go."""
    n_lines, n_dropped = (free_name(x, docs.columns) for x in ("n_lines", "n_dropped"))
    found = _kept(docs, n_lines, n_dropped, radius, similarity).where((F.col(n_dropped) == 0) | (F.col(n_dropped) < F.col(n_lines)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        found = found.withColumn("n_chars", F.when(F.col(n_dropped) == 0, F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_kept_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
