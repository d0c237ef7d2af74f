"""Benchmark decontamination: a broadcast hash set of the benchmark's word windows, scanned over whole documents.

Text is lower-cased (A-Z) and cut into words; a window is WINDOW consecutive words of an item, and an item with fewer
words is one window. Items become a vocabulary and a dictionary from windows (of word numbers, so that a hit is exact)
to their items. A document is translated, split and numbered; only runs of benchmark words at least a window long are
looked up. A word inside any occurrence of a window is hit.

The dictionary is broadcast. Its size follows the benchmark's, which is measured first: above BLOCK_BYTES of text the
benchmark is dealt into blocks of about that size, and the documents are scanned once for each block. Of those scans only
the hits of texts that have any are kept, and joined to the documents by two hashes and the length of the text. No
block's results depend on another's, so the outcome is the same.

Defined cases: null text has no words and no hits; an item without words never occurs; equal items count once by
item_id, a null item_id as the string null; repeated documents each give a row; an empty table gives no rows. scan()
keeps all columns of a document save those named like its results, which are replaced; decontaminate() keeps all.
"""

from __future__ import annotations

import functools
import itertools
import re
import uuid
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import cut, free_name, once, sliced, table

WINDOW, BLOCK_BYTES, HIT_SHARE = 13, 4 << 20, 20
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_FIELDS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD).split()


class Windows:
    """The windows of some items, by the numbers of their words."""

    def __init__(self, items: list[tuple[str, str | None]], size: int = WINDOW):
        self.numbers: dict[bytes, int] = {}
        self.found: dict[int, dict[bytes, list[str]]] = {}
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            ids = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words], np.uint32)
            n = min(size, len(ids))
            of_size = self.found.setdefault(n, {})
            for k in range(len(ids) - n + 1):
                owners = of_size.setdefault(ids[k : k + n].tobytes(), [])
                if item not in owners:
                    owners.append(item)

    def scan(self, text: str | None) -> tuple[int, list[int], set[str]]:
        """Number of words, hit runs as a flat list of first and past-last word, and items that occur."""
        words = words_of(text)
        items: set[str] = set()
        ids = np.fromiter(map(self.numbers.get, words, repeat(0)), np.uint32, len(words))
        unknown = np.flatnonzero(ids == 0)
        hit = None
        for n, windows in self.found.items():
            if len(ids) < n:
                continue
            edges = np.concatenate([[-1], unknown, [len(ids)]])
            for a, b in zip(edges[:-1][long := np.diff(edges) > n].tolist(), edges[1:][long].tolist()):
                for k in range(a + 1, b - n + 1):
                    if owners := windows.get(ids[k : k + n].tobytes()):
                        hit = np.zeros(len(ids) + 2, np.int8) if hit is None else hit
                        hit[k + 1 : k + n + 1] = 1
                        items.update(owners)
        return len(words), [] if hit is None else np.flatnonzero(np.diff(hit)).tolist(), items


def _union(runs: list[int], more: list[int]) -> list[int]:
    if not runs or not more:
        return runs or more
    out: list[int] = []
    for a, b in sorted([*zip(runs[::2], runs[1::2]), *zip(more[::2], more[1::2])]):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str | None]]]:
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r.item_id, r.text) for r in part.collect()]


def _with_hits(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int) -> tuple[DataFrame, str | None, Callable]:
    """docs, the name of a column with hits already found in it (an array of runs and items) if any, and what finds others.

    With one block, nothing is found yet and the function scans for it. With more, each block is scanned for by itself,
    only the hits of each text that has any are kept, by names of the texts, and then joined to the documents.
    """
    blocks = _blocks(benchmark, block_bytes)
    first, more = next(blocks), next(blocks, None)
    context = docs.sparkSession.sparkContext
    if more is None:
        return docs, None, _scanner(context.broadcast(first), window)
    names = [free_name(f"text_{k}", docs.columns) for k in range(3)]
    named = docs.select(F.col("text").cast("string").alias("text")).select(*[c.alias(k) for c, k in zip((F.xxhash64("text"), F.hash("text"), F.octet_length("text")), names)], "text")
    schema = T.StructType([*(named.schema[k] for k in names), *_FIELDS.fields[1:]])
    parts = [cut(named.mapInArrow(_only_hits(names, _scanner(context.broadcast(items), window)), schema), "decontamination-hits") for items in itertools.chain((first, more), blocks)]
    union = functools.reduce(DataFrame.unionByName, parts)
    merged = union.groupBy(*names).agg(F.struct(F.collect_set("hits").alias("hits"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")).alias(found := free_name("found", docs.columns)))
    keyed = docs.withColumns(dict(zip(names, (F.xxhash64(F.col("text").cast("string")), F.hash(F.col("text").cast("string")), F.octet_length(F.col("text").cast("string"))))))
    return keyed.join(merged, names, "left").drop(*names), found, _merger


def _scanner(shared, window: int) -> Callable:
    key = uuid.uuid4().hex

    def scan_texts(texts: pa.Array, found: None) -> list[tuple[int, list[int], list[str]]]:
        windows = once(key, lambda: Windows(shared.value, window))
        return [(n, hits, sorted(items)) for n, hits, items in (windows.scan(t.as_py()) for t in texts)]

    return scan_texts


def _merger(texts: pa.Array, found: pa.Array) -> list[tuple[int, list[int], list[str]]]:
    out = []
    for text, one in zip(texts, found.to_pylist()):
        hits = functools.reduce(_union, one["hits"], []) if one else []
        out.append((len(words_of(text.as_py())), hits, sorted(one["items"]) if one else []))
    return out


def _only_hits(names: list[str], scan_texts: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            out = scan_texts(b.column("text"), None)
            rows = [k for k, (_, hits, _) in enumerate(out) if hits]
            kept = [b.column(k).take(pa.array(rows, pa.int64())) for k in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([out[k][1] for k in rows], pa.list_(pa.int64())), pa.array([out[k][2] for k in rows], pa.list_(pa.string()))], [*names, "hits", "items"])

    return run


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None) -> DataFrame:
    """docs (or the columns in keep) with n_words, hits (flat array of runs of hit words) and items."""
    kept = [c for c in (docs.columns if keep is None else keep) if c not in _FIELDS.names]
    docs, found, find = _with_hits(docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*kept, "text"])]), benchmark, window, block_bytes)
    schema = T.StructType([*(docs.schema[c] for c in kept), *_FIELDS.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            n, hits, items = zip(*find(b.column("text"), b.column(found) if found else None))
            made = [pa.array(n, pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *made], names=schema.names)

    return docs.mapInArrow(run, schema)


def hit_words() -> F.Column:
    """Number of hit words of a scanned row."""
    return F.aggregate(F.transform("hits", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)


def contaminated() -> F.Column:
    return (hit_words() > 0) & (F.lit(HIT_SHARE) * hit_words() >= F.col("n_words"))


def without_spans(text: str, hits: list[int]) -> str:
    """The text without its hit runs, each cut from the first byte of its first word to the last of its last."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(_WORD))]
    out, done = [], 0
    for a, b in zip(hits[::2], hits[1::2]):
        out.append(raw[done : at[a][0]])
        done = at[b - 1][1]
    return b"".join([*out, raw[done:]]).decode("utf-8", "surrogatepass")


def is_contaminated(n_words: int, hits: list[int]) -> bool:
    """As contaminated()."""
    n_hit = sum(hits[1::2]) - sum(hits[::2])
    return n_hit > 0 and HIT_SHARE * n_hit >= n_words


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without contaminated documents, and without the hit spans of those that stay; n_chars follows the text if present.

    One Python pass finds, decides and cuts; all other columns stay, whatever their names.
    """
    columns, schema = docs.columns, docs.schema
    docs, found, find = _with_hits(docs, benchmark, window, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            out = find(b.column("text"), b.column(found) if found else None)
            stay = [k for k, (n, hits, _) in enumerate(out) if not is_contaminated(n, hits)]
            b = b.select(columns).take(pa.array(stay, pa.int64()))
            if any(out[k][1] for k in stay):
                texts = [without_spans(t, out[k][1]) if out[k][1] else t for k, t in zip(stay, b.column("text").to_pylist())]
                made = {"text": pa.array(texts, b.column("text").type)}
                if "n_chars" in columns:
                    sizes = [len(t) if out[k][1] else n for k, t, n in zip(stay, texts, b.column("n_chars").to_pylist())]
                    made["n_chars"] = pa.array(sizes, b.column("n_chars").type)
                b = pa.RecordBatch.from_arrays([made.get(c, b.column(c)) for c in columns], names=columns)
            yield b

    return docs.mapInArrow(run, schema)


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    ids = F.array_join(F.array_sort("items"), ",")
    return found.select("doc_id", "n_words", hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), contaminated().alias("contaminated"))


#: Items with fewer words than a window are one window, so windows come in more than one length.
OP9_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[k : k + least(13, len(w)) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, k, array_to_string(w[k : k + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT r, k, n, item_id FROM dw JOIN bw USING (n, g)),
hw AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM h) GROUP BY r),
hi AS (SELECT r, count(DISTINCT CAST(item_id AS VARCHAR)) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)
"""
