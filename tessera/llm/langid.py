"""Language ID by cross-parsing entropy over suffix automata.

For each language, labelled text of at most TRAIN_CHARS symbols becomes a suffix automaton. A text is cross-parsed against
it: each phrase is the longest prefix of what remains that occurs in the labelled text (a symbol that doesn't occur there
is a phrase), and the language needing the fewest phrases, each weighted with log2 of the automaton's text length (the
bits that name a place in it) and divided by the text's symbols, wins. Ties go to the first language in order.

The automaton is laid out as a table in which the step that ends a phrase also begins the next, so that parsing is one
look-up a symbol, done by numpy for many stretches of STRETCH symbols at once. Stretches are first parsed from nothing, then
each again from the state that the one before ends in, until the two parses meet, which they soon do (looked for at
MARKS; if not there, the stretch is parsed to its end). So the result is that
of one unbroken parse. The table has a place for each state and symbol while that is at most DENSE places; for languages of very
many letters it holds only the transitions there are.

Symbols are letters, lower-cased; each run of anything else is one gap.

The bound on training: for each language, SAMPLE_ROWS different texts that come first in hash order of their doc_id, and
TRAIN_CHARS symbols, shared evenly: a text teaches from its begin up to its share, and what short texts leave goes to the
longer ones. Nothing else is sampled: every text is predicted whole.

Defined cases: null text, or text without a letter, is und with score 0; rows with null text or null language teach
nothing; without any labelled text all is und; equal rows get equal results; one language alone wins with score 1.
Columns besides doc_id, text and lang are ignored, or kept where `keep` names them.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.llm.common import once, sliced, table

SAMPLE_ROWS, TRAIN_CHARS, STRETCH = 48, 24_000, 512
DENSE, MARKS, FEW = 1 << 22, (48, 96, 192), 60
UNKNOWN = "und"
AT_ONCE = 2_000_000  # bytes of text parsed at once
_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """By code point: its lower-case letter, or 0 for what isn't a letter."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if (x := chr(c)).isalpha():
                low = x.lower()
                _LETTER[c] = ord(low) if len(low) == 1 else c
    return _LETTER


def symbols(text: str) -> np.ndarray:
    """Code points of lower-cased letters, with 0 for each run of anything else; no gap at either end."""
    x = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = x != 0
    if not keep.any():
        return x[:0]
    keep[1:] |= keep[:-1]  # the first of each run of gaps stays
    x = x[keep]
    return x[int(x[0] == 0) : len(x) - int(x[-1] == 0)]


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the empty string, all states accept a factor."""
    step: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in text:
        new = len(step)
        step.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p != -1:
            q = step[p][c]
            if size[p] + 1 == size[q]:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p != -1 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return step


class Languages:
    """Parsing tables for some languages over one alphabet."""

    def __init__(self, texts: list[tuple[str, list[str]]], train_chars: int = TRAIN_CHARS):
        trained = []
        for name, parts in sorted(texts):
            x = np.concatenate([np.zeros(0, np.uint32), *[y for t in parts for y in (symbols(t), np.zeros(1, np.uint32))]])[:train_chars]
            if x.any():
                trained.append((name, x))
        self.names = [name for name, _ in trained]
        known = np.unique(np.concatenate([x for _, x in trained])) if trained else np.zeros(0, np.uint32)
        self.code = np.full(0x110000, len(known), np.int32)  # the last code: in no labelled text
        self.code[known] = np.arange(len(known))
        self.width = len(known) + 1
        self.tables, self.bits = [], []
        self.kind = np.int32 if self.width * 2 * max([1, *(len(x) for _, x in trained)]) * 4 + 8 < 2**31 else np.int64
        for _, x in trained:
            self.tables.append(self._table(suffix_automaton(self.code[x].tolist())))
            self.bits.append(float(np.log2(max(2, len(x)))))

    def _table(self, step: list[dict[int, int]]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """From states (times width) and symbols to next state * width * 4 + phrases that end. State 0 holds no phrase; others hold an open one."""
        size = np.fromiter(map(len, step), np.int64, len(step))
        state = np.repeat(np.arange(len(step)), size)
        char = np.fromiter((c for d in step for c in d), np.int64, int(size.sum()))
        to = np.fromiter((t for d in step for t in d.values()), np.int64, int(size.sum())) * self.width * 4
        root = np.full(self.width, 1, np.int64)  # a symbol that doesn't occur: a phrase, and none open
        root[char[state == 0]] = to[state == 0]
        if len(step) * self.width <= DENSE:
            out = np.repeat((root + 1).astype(self.kind)[None, :], len(step), axis=0)  # the open phrase ends first
            out[0] = root
            out[state, char] = to
            flat = out.ravel()

            def dense(at: np.ndarray, c: np.ndarray) -> np.ndarray:
                return flat[at + c]

            dense.one = flat.item  # type: ignore[attr-defined]
            return dense
        key = state * self.width + char
        order = np.argsort(key)
        keys, to = np.append(key[order], np.iinfo(np.int64).max), np.append(to[order], 0)

        def look(at: np.ndarray, c: np.ndarray) -> np.ndarray:
            wanted = at.astype(np.int64) + c
            k = np.searchsorted(keys, wanted)
            return np.where(keys[k] == wanted, to[k], root[c] + (at > 0)).astype(self.kind)

        return look

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Number of phrases of each text (an array of symbols) in each language."""
        counts = np.array([-(-len(x) // STRETCH) for x in texts], np.int64)
        total = np.zeros((len(texts), len(self.names)), np.int64)
        if not counts.sum() or not self.names:
            return total
        owner = np.repeat(np.arange(len(texts)), counts)
        sizes = np.full(len(owner), STRETCH, np.int64)
        ends = np.cumsum(counts)[counts > 0] - 1
        sizes[ends] = [len(x) - (n - 1) * STRETCH for x, n in zip(texts, counts) if n]
        begins = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        follows = np.where(np.append(owner[1:], -1) == owner, np.append(place[1:], -1), -1)[order]  # the text's next stretch
        owner, sizes, begins = owner[order], sizes[order], begins[order]
        flat = self.code[np.concatenate(texts)]
        live = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")  # stretches of at least so many symbols
        grid = np.zeros((len(live), len(sizes)), np.int32)
        for k, n in enumerate(live):
            grid[k, :n] = flat[begins[:n] + k]
        for lang, look in enumerate(self.tables):
            at, done = np.zeros(len(sizes), self.kind), np.zeros(len(sizes), np.int32)
            marked: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for k, n in enumerate(live):
                found = look(at[:n], grid[k, :n])
                done[:n] += found & 3
                np.right_shift(found, 2, out=at[:n])
                if k + 1 in MARKS:
                    marked[k + 1] = at.copy(), done.copy()
            self._carry(look, grid, live, sizes, follows, marked, at, done)
            open_at_end = (follows < 0) & (at > 0)
            total[:, lang] = np.bincount(owner, done + open_at_end, len(texts))
        return total

    @staticmethod
    def _carry(look: Callable, grid: np.ndarray, live: np.ndarray, sizes: np.ndarray, follows: np.ndarray, marked: dict, at: np.ndarray, done: np.ndarray) -> None:
        """Makes at and done (end state and phrases of stretches parsed from nothing) those of an unbroken parse of each text.

        marked has, by symbol, the states and phrases that the parses from nothing had there.
        """
        first, whole = at.copy(), done.copy()
        left = np.flatnonzero((follows >= 0) & (at > 0))
        while len(left):
            order = np.argsort(follows[left])  # longer stretches have smaller numbers
            which, now, k, moved = follows[left][order], at[left][order], 0, []
            held = np.zeros(len(which), np.int32)
            for mark in (*sorted(marked), len(live)):
                for k in range(k, mark):  # noqa: B020
                    n = int(np.searchsorted(which, live[k]))
                    found = look(now[:n], grid[k, which[:n]])
                    held[:n] += found & 3
                    np.right_shift(found, 2, out=now[:n])
                k = mark
                over = sizes[which] <= mark
                met = ~over & (now == marked[mark][0][which]) if mark in marked else np.zeros(len(which), bool)
                for stop in (over, met) if mark in marked else (over,):
                    mine = which[stop]
                    done[mine] = held[stop] if stop is over else whole[mine] + held[stop] - marked[mark][1][mine]
                    fresh = now[stop] if stop is over else first[mine]
                    moved.append(mine[(at[mine] != fresh) & (follows[mine] >= 0)])
                    at[mine] = fresh
                go = ~(met | over)
                which, now, held = which[go], now[go], held[go]
                if len(which) < FEW and (one := getattr(look, "one", None)):  # numpy's calls would cost more than the symbols
                    for x, state, n in zip(which.tolist(), now.tolist(), held.tolist()):
                        for c in grid[k : sizes[x], x].tolist():
                            found = one(state + c)
                            n, state = n + (found & 3), found >> 2
                        done[x] = n
                        if at[x] != state and follows[x] >= 0:
                            moved.append(np.array([x]))
                        at[x] = state
                    break
            left = np.concatenate(moved)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """A language and a score from 0 to 1 for each text: how much shorter the winner's parse is than the next one's."""
        coded = [symbols(t or "") for t in texts]
        counts = self.phrases(coded)
        if not self.names:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        bits = counts * np.array(self.bits)
        best = bits.argmin(1)
        ranked = np.sort(bits, axis=1)
        low, then = ranked[:, 0], ranked[:, 1] if len(self.names) > 1 else np.full(len(texts), np.inf)
        score = np.where(np.isinf(then), 1.0, 1 - low / np.maximum(then, 1e-9))
        lettered = [len(x) > 0 for x in coded]
        return [self.names[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered)], [s if ok else 0.0 for s, ok in zip(score.tolist(), lettered)]


def even_shares(texts: list[str], budget: int) -> list[str]:
    """Begins of texts whose symbols, with a gap after each, are within the budget; what a text leaves goes to longer ones."""
    sizes = [len(symbols(t)) + 1 for t in texts]
    out = list(texts)
    for left, k in zip(range(len(texts), 0, -1), sorted(range(len(texts)), key=sizes.__getitem__)):
        room = budget // left
        if sizes[k] > room:
            out[k] = texts[k][: bisect_right(range(len(texts[k]) + 1), room - 1, key=lambda n: len(symbols(texts[k][:n]))) - 1] if room else ""  # noqa: B023
        budget -= min(sizes[k], room)
    return out


def training_text(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, train_chars: int = TRAIN_CHARS) -> list[tuple[str, list[str]]]:
    """For each language at most sample_rows different labelled texts, those first in hash order of doc_id, cut to even shares of train_chars.

    Ids are ranked without their texts, with a limit a language before the shuffle; the few chosen then fetch theirs.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("th"))
    first = known.groupBy("lang", "th").agg(F.min(F.struct("h", "doc_id")).alias("first"))
    labelled = first.select("lang", "th", "first.h", "first.doc_id").where("doc_id IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    chosen = [(r.doc_id, r.lang, r.th) for r in labelled.withColumn("rank", rank).where(F.col("rank") <= sample_rows).select("doc_id", "lang", "th").collect()]
    ids, hashes = [list({r[k] for r in chosen}) for k in (0, 2)]
    texts: dict[str, dict] = {lang: {} for _, lang, _ in chosen}
    if chosen:
        rows = docs.where(F.col("doc_id").isin(ids)).select("doc_id", F.col("lang").cast("string").alias("lang"), F.xxhash64("text").alias("th"), "text").where(F.col("th").isin(hashes))
        for r in rows.dropDuplicates(["doc_id", "lang", "th"]).collect():
            if (r.doc_id, r.lang, r.th) in set(chosen):
                texts[r.lang][r.doc_id, r.th] = r.text
    return [(lang, even_shares([found[k] for k in sorted(found)], train_chars)) for lang, found in texts.items()]


def teaching_row() -> Column:
    """Whether a row may be learnt from: crc32 of its id, as text, mod 3 is not 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1, F.lit(False))


def identify(docs: DataFrame, learn_from: DataFrame, keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs' columns in keep (default: all) with a language and a score, learnt from learn_from (doc_id, text, lang).

    The two columns have the given names, and replace columns of those names.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(training_text(learn_from))
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names]
    docs = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*kept, "text"])])
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    columns, key = schema.names, uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text", AT_ONCE):
            model = once(key, lambda: Languages(shared.value))
            name, score = model.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(name, pa.string()), pa.array(score, pa.float64())], names=columns)

    return docs.mapInArrow(run, schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs, docs.where(teaching_row()), keep=["doc_id"])
    return found.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
