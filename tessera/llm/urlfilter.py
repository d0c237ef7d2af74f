"""URL filters against dated lists: a temporal as-of join, in DataFrame operations only.

A list entry is (category, kind, pattern, action, at): at second `at` (epoch seconds), the pattern is added to or removed
from the category's list. Kinds: host (a host and all below it), prefix (host and leading path segments), url (exact).
Entries become validity intervals: each holds until the pattern's next entry. A capture's URL yields the keys that can
match it; an equi-join on the key with `from <= fetch_time < to` finds the entries active when it was fetched. A capture
is dropped if a category matches and none of the allow list does.

Scale: intervals are found day by day and then across days, so that a pattern with very many entries is no single
window (at most 86,400 rows, and one row a day). The join is left to Spark: a small list is broadcast after its size
is known at run time, a large one is sort-merge joined, where adaptive execution splits a host that has a third of the captures.

Defined cases: null or unparsable URLs and null fetch times match nothing and are kept; null fields make an entry
void; an add and a remove at the same second count as an add; repeated entries count once; equal captures get equal
results; empty lists keep everything. Other capture columns are kept, save those named like the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import table

ALLOW, DAY = "allow", 86_400
_KEY = ["category", "kind", "pattern"]


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and leading www., or '' if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(host, r"^www\.", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/?([^?#]*)", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """(category, kind, pattern, from, to) while a pattern is listed; to is null while it lasts."""
    dated = entries.select(*[F.col(c).cast("string").alias(c) for c in _KEY], (F.col("action") == "add").alias("adds"), F.col("at").cast("long").alias("at")).dropna()
    dated = dated.groupBy(*_KEY, "at").agg(F.max("adds").alias("adds")).withColumn("day", F.floor(F.col("at") / DAY))
    within = dated.withColumn("next", F.lead("at").over(Window.partitionBy(*_KEY, "day").orderBy("at")))
    days = dated.groupBy(*_KEY, "day").agg(F.min("at").alias("first"))
    days = days.withColumn("later", F.lead("first").over(Window.partitionBy(*_KEY).orderBy("day"))).drop("first")
    joined = within.join(days, [*_KEY, "day"]).where("adds")
    return joined.select(*_KEY, F.col("at").alias("from"), F.coalesce("next", "later").alias("to"))


def keys_of(url: Column) -> Column:
    """array<struct<kind, pattern>> of everything a list could hold against a URL."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("host").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")))
    paths = F.transform(F.sequence(F.lit(0), F.size(segments)), lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat_ws("/", host, F.slice(segments, F.lit(1), i)).alias("pattern")))
    exact = F.array(F.struct(F.lit("url").alias("kind"), url.alias("pattern")))
    return F.when(host != "", F.concat(hosts, F.slice(paths, 2, F.size(paths)), exact)).otherwise(exact)


def match(captures: DataFrame, listed: DataFrame) -> DataFrame:
    """(url, fetch_time, n_hits, categories, dropped) of each distinct (url, fetch_time) that an active entry matches."""
    keys = captures.select("url", "fetch_time").dropna().select("url", "fetch_time", F.explode(keys_of(F.col("url"))).alias("k")).select("url", "fetch_time", "k.kind", "k.pattern")
    active = (F.col("from") <= F.col("fetch_time")) & (F.col("to").isNull() | (F.col("fetch_time") < F.col("to")))
    hits = keys.join(listed, ["kind", "pattern"]).where(active)
    grouped = hits.groupBy("url", "fetch_time", *_KEY).agg(F.lit(1).alias("one")).groupBy("url", "fetch_time")
    return grouped.agg(F.count("*").alias("n_hits"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"), (F.max((F.col("category") != ALLOW).cast("int")) > F.max((F.col("category") == ALLOW).cast("int"))).alias("dropped"))


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (with url and fetch_time in epoch seconds) with n_hits, categories and kept."""
    rest = [c for c in captures.columns if c not in ("n_hits", "categories", "kept", "dropped")]
    captures = captures.select(*[F.col(f"`{c}`") for c in rest])
    found = captures.join(match(captures, intervals(entries)), ["url", "fetch_time"], "left")
    return found.select(*[F.col(f"`{c}`") for c in rest], F.coalesce("n_hits", F.lit(0)).alias("n_hits"), F.coalesce("categories", F.lit("")).alias("categories"), (~F.coalesce("dropped", F.lit(False))).alias("kept"))


def _digit(text: Column, k: int) -> Column:
    return F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(text), k, 1)) - 1


def sample_entries(pages: DataFrame) -> DataFrame:
    """A dated list made from the pages' own URLs, as the tables hold none: it grows with the crawl, as real lists do."""
    start = 1_704_067_200
    seen = pages.select("url", host_of(F.col("url")).alias("host"), F.element_at(F.split(path_of(F.col("url")), "/"), 1).alias("top")).where("host <> ''")

    def of(category: str, kind: str, pattern: Column, digits: tuple[int, ...], steps: tuple[tuple[str, int], ...]) -> DataFrame:
        chosen = seen.select(pattern.alias("pattern")).distinct().where(_digit(F.col("pattern"), 1).isin(*digits))
        dated = F.explode(F.array(*[F.struct(F.lit(a).alias("action"), (F.lit(start) + DAY * (_digit(F.col("pattern"), 2) + d)).cast("long").alias("at")) for a, d in steps]))
        return chosen.select(F.lit(category).alias("category"), F.lit(kind).alias("kind"), "pattern", dated.alias("e")).select("category", "kind", "pattern", "e.action", "e.at")

    return (
        of("malware", "host", F.col("host"), (0, 1, 2, 3), (("add", 0), ("remove", 10), ("add", 20)))
        .unionByName(of("adult", "prefix", F.concat_ws("/", "host", "top"), (4, 5, 6), (("add", 5), ("remove", 30))))
        .unionByName(of("allow", "url", F.col("url"), (7, 8), (("add", 8),)))
    )


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", (F.lit(1_704_067_200) + F.col("page_id") * 2_220 % (DAY * 60)).alias("fetch_time"))
    return filter_urls(pages, sample_entries(pages)).select("page_id", "url", "fetch_time", "n_hits", "categories", "kept")


OP2_SQL = r"""
WITH p AS (SELECT page_id, url, CAST(1704067200 + page_id * 2220 % 5184000 AS BIGINT) AS fetch_time,
    regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\.', '') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/?([^?#]*)', 1) AS path FROM pages),
src AS (SELECT 'malware' AS category, 'host' AS kind, host AS pattern FROM p WHERE host <> '' UNION
    SELECT 'adult', 'prefix', host || '/' || string_split(path, '/')[1] FROM p WHERE host <> '' UNION SELECT 'allow', 'url', url FROM p WHERE host <> ''),
dig AS (SELECT *, strpos('0123456789abcdef', substr(md5(pattern), 1, 1)) - 1 AS d1, 1704067200 + 86400 * (strpos('0123456789abcdef', substr(md5(pattern), 2, 1)) - 1) AS t FROM src),
iv AS (SELECT category, kind, pattern, t AS a, t + 864000 AS b FROM dig WHERE kind = 'host' AND d1 IN (0, 1, 2, 3) UNION ALL
    SELECT category, kind, pattern, t + 1728000, NULL FROM dig WHERE kind = 'host' AND d1 IN (0, 1, 2, 3) UNION ALL
    SELECT category, kind, pattern, t + 432000, t + 2592000 FROM dig WHERE kind = 'prefix' AND d1 IN (4, 5, 6) UNION ALL
    SELECT category, kind, pattern, t + 691200, NULL FROM dig WHERE kind = 'url' AND d1 IN (7, 8)),
lab AS (SELECT page_id, url, fetch_time, host, string_split(host, '.') AS l, list_filter(string_split(path, '/'), lambda s: s <> '') AS s FROM p),
k AS (SELECT url, fetch_time, 'host' AS kind, array_to_string(l[i:], '.') AS pattern FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM lab WHERE host <> '') UNION
    SELECT url, fetch_time, 'prefix', host || '/' || array_to_string(s[:i], '/') FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM lab WHERE host <> '') UNION
    SELECT url, fetch_time, 'url', url FROM lab),
h AS (SELECT DISTINCT url, fetch_time, category, kind, pattern FROM k JOIN iv USING (kind, pattern) WHERE a <= fetch_time AND (b IS NULL OR fetch_time < b)),
m AS (SELECT url, fetch_time, count(*) AS n_hits, string_agg(DISTINCT category, ',' ORDER BY category) AS categories, bool_or(category <> 'allow') AND NOT bool_or(category = 'allow') AS dropped FROM h GROUP BY url, fetch_time)
SELECT page_id, url, fetch_time, coalesce(n_hits, 0) AS n_hits, coalesce(categories, '') AS categories, NOT coalesce(dropped, false) AS kept FROM p LEFT JOIN m USING (url, fetch_time)
"""
