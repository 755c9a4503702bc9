"""Quality rules judged together by an isolation forest.

The base counts (word_chars, n_symbols, n_dup_lines, n_repeat_words) follow fixed
definitions; some further rule statistics join them as ratios.  Trees of random
splits are grown on labelled good documents; a document whose statistics are
isolated after few splits is anomalous.  As the method has it, a tree takes about
256 rows, but each tree draws its own from all labelled good rows, and the range of
the splits is that of all of them.  The limit on the score is exact over all labelled
rows of both kinds: each tree draws from one half of the good rows, and a good row is
scored by the trees of the other half.  Texts are counted once, for fit and verdict.

Edge cases: a null or empty text has zero counts and fails the base rule (fewer
than 10 words); repeated rows and null ids keep their own rows; other columns
are ignored; an empty table gives an empty result; with no labelled good row the
forest accepts everything the base rule accepts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loxodrome.llm import _textkit as tk
from loxodrome.llm._common import ship, table

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[10] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
PUNCT = np.zeros(256, bool)
PUNCT[[ord(c) for c in "!?.,;:\"'()[]{}"]] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_punct", "n_distinct", "n_lines"]
BASE = COUNTS[:5]


def _repeats(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Of hashes h in texts doc: how often each one occurs in its text, in the given order."""
    key = tk.mix(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    s = key[order]
    new = np.concatenate(([True], s[1:] != s[:-1])) if len(s) else np.zeros(0, bool)
    run = np.cumsum(new) - 1
    out = np.empty(len(h), np.int64)
    out[order] = np.bincount(run)[run] if len(s) else 0
    return out


def rule_counts(b: tk.Block) -> dict[str, np.ndarray]:
    """The counts named in COUNTS, for each text of a block."""
    w = tk.find_words(b)
    roll = tk.Rolling(b.data)
    h = roll.spans(w.start, w.end)
    n_words = np.diff(w.first)
    ok = tk.grams_inside(w, 5)
    g = tk.gram_hashes(h, 5)[ok]
    at = np.flatnonzero(ok)
    again = at[_repeats(w.doc[at], g) >= 2]
    in_repeat = tk.covered(again, 5, len(h))
    space = tk.IS_SPACE[b.data]
    # a line ends at \n or at its text's end
    ends = np.union1d(np.flatnonzero(b.data == 10), b.off[1:]) if len(b.data) else b.off[1:]
    starts = np.concatenate(([0], ends[:-1]))
    starts = starts + (b.data[np.minimum(starts, len(b.data) - 1)] == 10) * (starts > 0) * ~np.isin(starts, b.off[:-1]) if len(b.data) else starts
    first = np.searchsorted(w.start, starts)
    has_word = (first < len(w.start)) & (w.start[np.minimum(first, max(len(w.start) - 1, 0))] < ends) if len(w.start) else np.zeros(len(ends), bool)
    ls, le = starts[has_word], ends[has_word]
    ldoc = np.searchsorted(b.off, ls, "right") - 1
    key = np.unique(tk.mix(roll.spans(ls, le) + ldoc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    lines = np.bincount(ldoc, minlength=b.rows)
    distinct_lines = np.bincount(ldoc[key], minlength=b.rows)
    words_once = np.unique(tk.mix(h + w.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    return {
        "n_words": n_words,
        "word_chars": tk.per_row_sum(((b.data & 0xC0) != 0x80) & ~space, b.off),
        "n_symbols": tk.per_row_sum(SYMBOL[b.data], b.off),
        "n_dup_lines": lines - distinct_lines,
        "n_repeat_words": np.bincount(w.doc[in_repeat], minlength=b.rows),
        "n_upper": tk.per_row_sum(UPPER[b.data], b.off),
        "n_digits": tk.per_row_sum(DIGIT[b.data], b.off),
        "n_punct": tk.per_row_sum(PUNCT[b.data], b.off),
        "n_distinct": np.bincount(w.doc[words_once], minlength=b.rows),
        "n_lines": lines,
    }


def statistics(c: dict[str, np.ndarray]) -> np.ndarray:
    """Counts to rule statistics that do not grow with the text: one row for each text."""
    n, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    return np.column_stack([
        c["word_chars"] / n, c["n_symbols"] / n, c["n_dup_lines"] / np.maximum(c["n_lines"], 1), c["n_repeat_words"] / n,
        c["n_upper"] / chars, c["n_digits"] / chars, c["n_punct"] / n, np.log1p(c["n_distinct"]) / np.log1p(n),
    ]).astype(np.float64)


class IsolationForest:
    """Random splits; the score is 2^(-mean path / expected path), near 1 for anomalies."""

    def __init__(self, trees: int = 100, draw: int = 256, seed: int = 5) -> None:
        self.trees, self.draw, self.seed, self.grown, self.limit = trees, draw, seed, [], 2.0

    @staticmethod
    def expected(n: np.ndarray | float) -> np.ndarray:
        n = np.asarray(n, float)
        return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))

    def fit(self, x: np.ndarray) -> IsolationForest:
        rng = np.random.default_rng(self.seed)
        draws = [x[rng.permutation(len(x))[: self.draw]] for _ in range(self.trees)] if len(x) else []
        return self.grow(draws, x.min(axis=0), x.max(axis=0), len(x)) if draws else self.grow([], None, None, 0)

    def grow(self, draws: list[np.ndarray], low: np.ndarray | None, high: np.ndarray | None, rows: int) -> IsolationForest:
        """A tree for each draw, in this order; low and high are the range of all ``rows`` rows."""
        self.size = min(self.draw, max(rows, 2))
        self.depth = max((int(np.ceil(np.log2(max(2, len(x))))) for x in draws), default=0)
        if not draws:
            return self
        rng = np.random.default_rng(self.seed)
        #: Splits reach past the seen range, so that what lies outside it is isolated early.
        margin = 0.5 * (high - low) + 0.02
        for pick in draws:
            depth_limit = int(np.ceil(np.log2(max(2, len(pick)))))
            feature, cut, left, right, value = [], [], [], [], []

            def grow(rows: np.ndarray, depth: int, lo: np.ndarray, hi: np.ndarray) -> int:
                k = len(feature)
                for a, v in ((feature, -1), (cut, 0.0), (left, k), (right, k), (value, depth + float(self.expected(len(rows))))):
                    a.append(v)
                if depth >= depth_limit or len(rows) <= 1:
                    return k
                f = int(rng.integers(rows.shape[1]))
                at = rng.uniform(lo[f], hi[f])
                feature[k], cut[k] = f, at
                below = rows[:, f] < at
                hi2, lo2 = hi.copy(), lo.copy()
                hi2[f] = lo2[f] = at
                left[k] = grow(rows[below], depth + 1, lo, hi2)
                right[k] = grow(rows[~below], depth + 1, lo2, hi)
                return k

            lo, hi = (pick.min(axis=0), pick.max(axis=0)) if len(pick) else (low, high)
            grow(pick, 0, lo - margin, hi + margin)
            self.grown.append([np.array(a) for a in (feature, cut, left, right, value)])
        return self

    def score(self, x: np.ndarray, half: np.ndarray | None = None) -> np.ndarray:
        """With ``half``: trees of that parity alone judge a row of the other half, all trees a row of no half (-1)."""
        if not self.grown:
            return np.zeros(len(x))
        total, by = np.zeros(len(x)), np.zeros(len(x))
        rows = np.arange(len(x))
        for t, (feature, cut, left, right, value) in enumerate(self.grown):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                go_left = x[rows, np.maximum(f, 0)] < cut[at]
                at = np.where(f < 0, at, np.where(go_left, left[at], right[at]))
            judges = 1 if half is None else half != t % 2
            total += value[at] * judges
            by += judges
        return 2.0 ** (-total / np.maximum(by, 1) / max(float(self.expected(self.size)), 1e-9))

    def calibrate(self, good: np.ndarray, bad: np.ndarray) -> IsolationForest:
        """The limit with the best balance of both error rates, where a lost good row counts four times."""
        if not len(good):
            return self
        sg, sb = np.sort(self.score(good)), np.sort(self.score(bad))
        marks = np.unique(np.concatenate([sg, sb]))
        at = (marks[1:] + marks[:-1]) / 2 if len(marks) > 1 else marks + 1e-6
        at = np.append(at, marks[-1] + 1e-3)
        lost = 1 - np.searchsorted(sg, at, "right") / len(sg)
        passed = np.searchsorted(sb, at, "right") / max(len(sb), 1)
        self.limit = float(at[int(np.argmin(4 * lost + passed))])
        return self


SCHEMA = ", ".join(f"{c} long" for c in COUNTS)


def count_rules(docs: DataFrame, forest: IsolationForest | None = None) -> DataFrame:
    """doc_id, the counts and, with a forest, anomaly (its score) of every document."""
    ship(docs.sparkSession)
    cast = docs.sparkSession.sparkContext.broadcast(forest)

    def run(source):
        f = cast.value
        for batch in source:
            if not batch.num_rows:
                continue
            parts = [rule_counts(b) for b in tk.text_blocks(batch.column(1))]
            c = {k: np.concatenate([p[k] for p in parts]) for k in COUNTS}
            score = f.score(statistics(c)) if f else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c[k].astype(np.int64)) for k in COUNTS), pa.array(score)], names=["doc_id", *COUNTS, "anomaly"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {SCHEMA}, anomaly double")


def _fit(counted: DataFrame, labels: DataFrame, trees: int) -> IsolationForest:
    """Grows and calibrates on all labelled rows of count_rules."""
    marked = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg((F.max("quality") == 1).alias("good"))
    # a row's hash decides its half and the trees it grows, wherever the row lies
    key = F.xxhash64("doc_id", *COUNTS)
    rows = table(counted.join(marked, "doc_id").select(key.alias("key"), "good", F.when(F.col("good"), F.pmod(F.xxhash64("key", F.lit(10)), F.lit(2))).otherwise(-1).cast("int").alias("half"), *COUNTS))
    forest = IsolationForest(trees)
    held = {r["half"]: r["n"] for r in rows.where("good").groupBy("half").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not held:
        return forest
    n_stat = statistics({c: np.zeros(1, np.int64) for c in COUNTS}).shape[1]

    def draw(source):
        low, high = np.full(n_stat, np.inf), np.full(n_stat, -np.inf)
        for batch in source:
            c = {k: batch.column(k).to_numpy() for k in COUNTS}
            key, half, x = batch.column("key").to_numpy(), batch.column("half").to_numpy(), statistics(c)
            if not len(x):
                continue
            low, high = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
            for t in range(trees):
                own = held.get(t % 2, 0)
                # no row in one half: its trees draw from the other
                mine = half == (t % 2 if own else 1 - t % 2)
                chance = forest.draw / (own or held[1 - t % 2])
                place = tk.mix(key.astype(np.uint64) + np.uint64((t + 1) * 0x9E3779B97F4A7C15 % 2**64))
                at = np.flatnonzero(mine & (place.astype(np.float64) / 2.0**64 < chance))
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array(place[at].astype(np.int64)), pa.array(list(x[at]))], names=["tree", "place", "x"])
        if np.isfinite(low).all():
            yield pa.RecordBatch.from_arrays([pa.array([-1, -2], pa.int32()), pa.array([0, 0], pa.int64()), pa.array([low, high])], names=["tree", "place", "x"])

    taken: dict[int, list] = {}
    for r in rows.where("good").mapInArrow(draw, "tree int, place long, x array<double>").collect():
        taken.setdefault(r["tree"], []).append((r["place"], r["x"]))
    draws = [np.array([x for _, x in sorted(taken.get(t, []))], float).reshape(-1, n_stat) for t in range(trees)]
    forest.grow(draws, np.min([x for _, x in taken[-1]], axis=0), np.max([x for _, x in taken[-2]], axis=0), max(held.values()))
    # with one half alone there is no other to judge it
    marks = _scored(rows if len(held) == 2 else rows.withColumn("half", F.lit(-1)), forest).groupBy("anomaly").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    forest.limit = best_limit(marks, sum(held.values()))
    return forest


def best_limit(marks: DataFrame, n_good: int, bins: int = 1 << 14) -> float:
    """The limit of IsolationForest.calibrate, exact, from the rows (good, bad) at each anomaly of a table of any size: sums by bin reach the driver, running sums stay in bins."""
    marks = table(marks.withColumn("bin", F.floor(F.col("anomaly") * bins)))
    sums = sorted(tuple(r) for r in marks.groupBy("bin").agg(F.sum("good"), F.sum("bad"), F.min("anomaly")).collect())
    goods, bads = np.cumsum([[0, 0], *[r[1:3] for r in sums]], axis=0).T
    n_bad = max(int(bads[-1]), 1)
    before = marks.sparkSession.createDataFrame([(r[0], int(g), int(b), n[3] if n else None) for r, g, b, n in zip(sums, goods, bads, [*sums[1:], None], strict=False)], "bin long, g long, b long, after double")
    w = Window.partitionBy("bin").orderBy("anomaly")
    run = marks.join(F.broadcast(before), "bin").select("anomaly", F.coalesce(F.lead("anomaly").over(w), "after").alias("next"), (F.col("g") + F.sum("good").over(w)).alias("g"), (F.col("b") + F.sum("bad").over(w)).alias("b"))
    cost = 4 * (1 - F.col("g") / n_good) + F.col("b") / n_bad
    at = run.agg(F.min(F.struct(cost.alias("cost"), "anomaly", "next")).alias("m")).first()["m"]
    return at["anomaly"] + 1e-3 if at["next"] is None else (at["anomaly"] + at["next"]) / 2


def _scored(counted: DataFrame, forest: IsolationForest) -> DataFrame:
    """count_rules' rows with anomaly, the forest's score; with a column half, by the trees of the other."""
    ship(counted.sparkSession)
    cast = counted.sparkSession.sparkContext.broadcast(forest)
    keep = [c for c in counted.columns if c != "anomaly"]
    halves = "half" in keep

    def run(source):
        for batch in source:
            score = cast.value.score(statistics({k: batch.column(k).to_numpy() for k in COUNTS}), batch.column("half").to_numpy() if halves else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(score)], names=[*keep, "anomaly"])

    types = dict(counted.dtypes)
    return counted.select(*keep).mapInArrow(run, ", ".join([*(f"{c} {types[c]}" for c in keep), "anomaly double"]))


def _judged(scored: DataFrame, forest: IsolationForest) -> DataFrame:
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return scored.withColumn("base_failed", base_failed).withColumn("kept", ~base_failed & (F.col("anomaly") <= F.lit(forest.limit)))


def fit_rule_forest(docs: DataFrame, labels: DataFrame, trees: int = 100) -> IsolationForest:
    """Grows and calibrates on all labelled documents."""
    return _fit(count_rules(docs.join(labels.select("doc_id"), "doc_id", "left_semi")), labels, trees)


def judge_rules(docs: DataFrame, forest: IsolationForest) -> DataFrame:
    return _judged(count_rules(docs, forest), forest)


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    counted = table(count_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("anomaly"))
    forest = _fit(counted, spark.read.parquet(f"{sf_dir}/labels.parquet"), 100)
    return _judged(_scored(counted, forest), forest).select("doc_id", *BASE, "base_failed", "kept", "anomaly")
