"""Quality classifier: document evidence combined with the posteriors of a document's host and path.

1. Labelled rows, at most SAMPLE_ROWS for each combination of labels (those first in hash order of doc_id), give a lexicon
   (words whose document frequency differs between the classes by at least Z standard errors, at most LEXICON a target)
   and then logistic weights for style features and lexicon counts. Nothing else is sampled.
2. Every document gets its evidence: a probability for each target (good, toxic) at the labels' base rates.
3. Grouped sums of evidence by path and host give each level's mean. A level is shrunk toward the one above it,
   path to host to corpus, with a strength that the spread between its groups decides (method of moments): sparse sites
   get their parent's rate. A document's own evidence is left out of its site's.
4. Posterior odds = evidence odds x (site odds / corpus odds).

Sums combine before the shuffle, so a host with a third of all documents is one row a task; the site table goes back to
the documents by a join whose kind Spark picks by the table's size.

Defined cases: null or empty text has the features of no words; null host or path is a group of its own; a document
with conflicting labels counts for each; without both classes of a target, its evidence is its base rate; an empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import cut, table
from tessera.llm.decontamination import words_of

SAMPLE_ROWS, LEXICON, Z, LEAST_DOCS = 800, 500, 4.0, 5
TARGETS = ("good", "toxic")
LEAST = 1e-4


def style(text: str | None) -> list[float]:
    """How a text looks, whatever its words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256, np.int64)
    size, upper, lower, wide = max(1, len(raw)), int(n[65:91].sum()), int(n[97:123].sum()), int(n[128:].sum())
    letters = max(1, upper + lower + wide)
    signs = int(n[33:48].sum() + n[58:65].sum() + n[91:97].sum() + n[123:127].sum())
    words = words_of(text)
    count = max(1, len(words))
    common = Counter(words).most_common(1)[0][1] if words else 0
    lines = [x for x in raw.split(b"\n") if x]
    return [
        np.log1p(len(words)), upper / letters, signs / size, int(n[46] + n[44]) / count, int(n[33] + n[63]) / count, int(n[124]) / count,
        int(n[48:58].sum()) / size, common / count, len(set(words)) / count, letters / count / 10, 1 - len(set(lines)) / max(1, len(lines)), np.log1p(len(words) / max(1, len(lines))),
    ]


STYLES = len(style(""))


def features(text: str | None, lexicons: list[dict[bytes, float]]) -> list[float]:
    """Style, and for each lexicon how many of its words occur, for and against, and their mean weight in the text."""
    found, out = set(words_of(text)), style(text)
    for words in lexicons:
        weights = [words[w] for w in found & words.keys()]
        up = sum(1 for w in weights if w > 0)
        out += [np.log1p(up), np.log1p(len(weights) - up), sum(weights) / max(1, len(found))]
    return out


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights (the last is the constant) by penalised Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), np.diag([penalty] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    """Lexicons, scaling and weights, one of each a target, and the base rates."""

    def __init__(self, lexicons: list[dict[bytes, float]], rows: np.ndarray, labels: np.ndarray, base: list[float]):
        self.lexicons, self.base = lexicons, base
        self.mean, self.scale = (rows.mean(0), rows.std(0) + 1e-6) if len(rows) else (np.zeros(1), np.ones(1))
        self.weights: list[np.ndarray | None] = []
        for k in range(len(TARGETS)):
            y = labels[:, k] if len(labels) else np.zeros(0)
            if not 0 < y.sum() < len(y):
                self.weights.append(None)
                continue
            w = logistic((rows - self.mean) / self.scale, y)
            share = y.mean()
            w[-1] += np.log(base[k] / (1 - base[k])) - np.log(share / (1 - share))  # the sample's rates are not the labels'
            self.weights.append(w)

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        x = (np.array([features(t, self.lexicons) for t in texts]) - self.mean) / self.scale
        out = np.empty((len(texts), len(TARGETS)))
        for k, w in enumerate(self.weights):
            out[:, k] = self.base[k] if w is None else 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
        return np.clip(out, LEAST, 1 - LEAST)


def _sample(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """(text, good, toxic) of the sample; ids are ranked, with a limit before the shuffle, before they fetch their texts."""
    ranked = labels.select("doc_id", "good", "toxic", F.row_number().over(Window.partitionBy("good", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id")).alias("k"))
    chosen = ranked.where(F.col("k") <= sample_rows).select("doc_id", "good", "toxic").distinct()
    return cut(docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "good", "toxic"), "quality-sample")


def _lexicon(sample: DataFrame, target: str) -> dict[bytes, float]:
    """Words whose document frequencies in the sample's classes differ by Z standard errors, with their log odds."""
    words = F.array_distinct(F.split(F.lower(F.col("text")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
    n = {r[0]: r[1] for r in sample.where(F.col("text").isNotNull()).groupBy(target).count().collect()}
    if len(n) < 2:
        return {}
    each = sample.select(F.explode(words).alias("w"), F.col(target).alias("y")).where("w <> ''").groupBy("w").agg(F.sum("y").alias("b"), F.count("*").alias("n")).where(F.col("n") >= LEAST_DOCS)
    pb, pa_, p = F.col("b") / n[1], (F.col("n") - F.col("b")) / n[0], F.col("n") / (n[0] + n[1])
    z = (pb - pa_) / F.sqrt(p * (1 - p + 1e-9) * (1 / n[0] + 1 / n[1]))
    odds = F.log((F.col("b") + 0.5) / (n[1] - F.col("b") + 0.5)) - F.log((F.col("n") - F.col("b") + 0.5) / (n[0] - F.col("n") + F.col("b") + 0.5))
    strong = each.select("w", z.alias("z"), odds.alias("odds")).where(F.abs("z") >= Z).orderBy(F.abs("z").desc(), "w").limit(LEXICON)
    return {r.w.encode("utf-8", "surrogatepass"): r.odds for r in strong.collect()}


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """labels: (doc_id, quality, toxic) with 0 or 1; rows with a null are left out."""
    labels = labels.select("doc_id", F.col("quality").cast("int").alias("good"), F.col("toxic").cast("int").alias("toxic")).dropna()
    total = labels.agg(F.count("*"), *[F.sum(t) for t in TARGETS]).first()
    base = [min(1 - LEAST, max(LEAST, ((total[k + 1] or 0) + 0.5) / (total[0] + 1))) for k in range(len(TARGETS))]
    sample = _sample(docs, labels, sample_rows)
    lexicons = [_lexicon(sample, t) for t in TARGETS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array([[float(v) for v in features(t.as_py(), lexicons)] for t in b.column(0)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([x, b.column(1), b.column(2)], names=["x", "good", "toxic"])

    rows = sample.mapInArrow(run, "x array<double>, good int, toxic int").collect()
    return Model(lexicons, np.array([r.x for r in rows]), np.array([[r.good, r.toxic] for r in rows]), base)


def document_evidence(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, host, path, good, toxic): the classifier's probabilities. docs: (doc_id, text, host, path)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, len(b), 1000):
                part = b.slice(k, 1000)
                p = shared.value.evidence([t.as_py() for t in part.column(3)])
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(p[:, 0]), pa.array(p[:, 1])], names=["doc_id", "host", "path", *TARGETS])

    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("host", "path", "text")])
    return each.mapInArrow(run, "doc_id long, host string, path string, good double, toxic double")


def _strength(groups: DataFrame, n: Column, mean: Column, parent: Column, squares: Column, overall: float) -> float:
    """How many documents a parent's rate counts for, from the spread of group means around their parents'."""
    r = groups.agg(F.count("*").alias("h"), F.sum(n).alias("n"), F.sum(n * n).alias("n2"), F.sum(n * (mean - parent) ** 2).alias("between"), F.sum(squares - n * mean * mean).alias("within")).first()
    if not r.n or r.n <= r.h or r.n2 >= r.n * r.n:
        return 1e3
    spread = (r.between - (r.h - 1) * r.within / (r.n - r.h)) / (r.n - r.n2 / r.n)
    return float(min(1e6, max(1.0, overall * (1 - overall) / max(spread, 1e-9) - 1)))


def with_sites(each: DataFrame) -> DataFrame:
    """(doc_id, good, toxic, good_score, toxic_score) of evidence rows; the scores are posteriors. each should be a table."""
    sums = [f(t).alias(f"{t}_{k}") for t in TARGETS for k, f in (("s", F.sum), ("q", lambda t: F.sum(F.col(t) * F.col(t))))]
    paths = cut(each.groupBy("host", "path").agg(F.count("*").alias("n"), *sums), "quality-paths")
    hosts = paths.groupBy(F.col("host").alias("h")).agg(F.sum("n").alias("hn"), *[F.sum(f"{t}_{k}").alias(f"h{t}_{k}") for t in TARGETS for k in "sq"])
    sites = cut(paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h"), "quality-sites")
    total = sites.agg(F.sum("n"), *[F.sum(f"{t}_s") for t in TARGETS]).first()
    # host and path may be null, so a group is named by its value or its absence
    on = F.col("host").eqNullSafe(F.col("site_host")) & F.col("path").eqNullSafe(F.col("site_path"))
    joined = each.join(sites.withColumnsRenamed({"host": "site_host", "path": "site_path"}), on, "left")
    scores = []
    for k, t in enumerate(TARGETS):
        rate = min(1 - LEAST, max(LEAST, (total[k + 1] or 0) / (total[0] or 1)))
        in_host = hosts.select(F.col("hn").alias("n"), F.col(f"h{t}_s").alias("s"), F.col(f"h{t}_q").alias("q"))
        host_strength = _strength(in_host, F.col("n"), F.col("s") / F.col("n"), F.lit(rate), F.col("q"), rate)
        path_strength = _strength(sites, F.col("n"), F.col(f"{t}_s") / F.col("n"), F.col(f"h{t}_s") / F.col("hn"), F.col(f"{t}_q"), rate)
        host = (F.col(f"h{t}_s") - F.col(t) + host_strength * rate) / (F.col("hn") - 1 + host_strength)
        path = (F.col(f"{t}_s") - F.col(t) + path_strength * host) / (F.col("n") - 1 + path_strength)
        path = F.least(F.greatest(path, F.lit(LEAST)), F.lit(1 - LEAST))
        odds = F.col(t) / (1 - F.col(t)) * path / (1 - path) * ((1 - rate) / rate)
        scores.append((odds / (1 + odds)).alias(f"{t}_score"))
    return joined.select("doc_id", *TARGETS, *scores)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, good, toxic, good_score, toxic_score, keep) of docs (doc_id, text, host, path)."""
    each = cut(document_evidence(docs, fit(docs, labels)), "quality-evidence")
    return with_sites(each).withColumn("keep", (F.col("good_score") >= 0.5) & (F.col("toxic_score") < 0.5))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's host is its source, and its path the section of its language, as in the pages' URLs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("host"), F.col("lang").alias("path"))
    return classify(docs, table(spark, sf_dir, "labels"))
