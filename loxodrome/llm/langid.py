"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Letters are folded to lower case, each run of other characters is one boundary,
and n-grams of one to three characters are hashed to ``width`` features.  Weights
come from follow-the-regularised-leader with an elastic net; a temperature fitted
on part of the sample the training has not seen calibrates the probabilities.

Edge cases: a null text, an empty one or one without a letter is ``und`` with
score 0; a null or repeated doc_id gets its own row; further columns are ignored;
an empty table gives an empty result; with no labelled row at all, every text is
``und``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loxodrome.llm import _textkit as tk
from loxodrome.llm._common import bounded_sample, crc_mod, ship
from loxodrome.llm._linear import Ftrl, softmax, temperature

#: Rows that the fit, on the driver, holds as dense features at a time.
FIT_ROWS = 32

_fold: dict[str, np.ndarray] = {}


def fold_table() -> np.ndarray:
    """For each code point of the basic plane: its lower case if a letter, else 0."""
    if "t" not in _fold:
        t = np.zeros(0x10000, np.uint32)
        for c in range(0x10000):
            if not 0xD800 <= c < 0xE000 and (s := chr(c)).isalpha():
                t[c] = ord(s.lower()[0])
        _fold["t"] = t
    return _fold["t"]


def _letters(b: tk.Block) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points with runs of 0 cut to one, and the text of each."""
    codes = np.frombuffer(b.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = (b.data & 0xC0) != 0x80
    doc = np.repeat(np.arange(b.rows), np.diff(b.off))[lead]
    table = fold_table()
    folded = table[np.minimum(codes, 0xFFFF)]
    for i in np.flatnonzero(codes > 0xFFFF):
        s = chr(codes[i])
        folded[i] = ord(s.lower()[0]) if s.isalpha() else 0
    keep = np.ones(len(folded), bool)
    keep[1:] = (folded[1:] != 0) | (folded[:-1] != 0) | (doc[1:] != doc[:-1])
    return folded[keep], doc[keep]


def features(b: tk.Block, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed n-grams (rows x width), and whether a text has a letter."""
    c, doc = _letters(b)
    c = c.astype(np.uint64)
    found, rows = [], []
    h = np.zeros(len(c), np.uint64)
    for n in (1, 2, 3):
        m = len(c) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(0x100000001B3) + c[n - 1 :]
        ok = (doc[:m] == doc[n - 1 :]) if n > 1 else c != 0
        found.append((tk.mix(h[ok] + np.uint64(n << 56)) % np.uint64(width)).astype(np.int64))
        rows.append(doc[:m][ok])
    counts = np.bincount(np.concatenate(rows) * width + np.concatenate(found), minlength=b.rows * width) if found else np.zeros(b.rows * width, np.int64)
    letters = np.bincount(doc[c != 0], minlength=b.rows) > 0
    return counts.reshape(b.rows, width), letters


def _tfidf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts, dtype=np.float32) * idf
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)


class SparseRows:
    """Rows of float32 kept as places and values; dense only where they are taken, a few at a time."""

    def __init__(self, width: int) -> None:
        self.width, self.places, self.values = width, [], []

    def append(self, dense: np.ndarray) -> None:
        for row in dense:
            at = np.flatnonzero(row)
            self.places.append(at.astype(np.int32))
            self.values.append(row[at])

    def __getitem__(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), self.width), np.float32)
        for i, k in enumerate(rows):
            out[i, self.places[k]] = self.values[k]
        return out

    def of(self, rows: np.ndarray) -> SparseRows:
        out = SparseRows(self.width)
        out.places, out.values = [self.places[k] for k in rows], [self.values[k] for k in rows]
        return out

    def owners(self) -> np.ndarray:
        """For each place, the rows that have a value there."""
        out = np.zeros(self.width, np.int64)
        for at in self.places:
            out[at] += 1
        return out

    def replace(self, change) -> None:
        """Every row becomes its ``change``; a place without a value keeps none."""
        for k in range(len(self.places)):
            self.values[k] = change(self[[k]])[0, self.places[k]]


class LanguageModel:
    def __init__(self, width: int = 1 << 13) -> None:
        self.width, self.langs, self.t = width, [], 1.0

    def fit(self, texts: list[str], langs: list[str], seed: int = 11, epochs: int = 6) -> LanguageModel:
        self.langs = sorted(set(langs))
        if not self.langs:
            return self
        y = np.array([self.langs.index(x) for x in langs])
        x = SparseRows(self.width)
        for i in range(0, len(texts), FIT_ROWS):
            for b in tk.text_blocks(pa.array(texts[i : i + FIT_ROWS], pa.string())):
                x.append(features(b, self.width)[0].astype(np.float32))
        self.idf = (np.log((1 + len(y)) / (1 + x.owners())) + 1).astype(np.float32)
        x.replace(lambda counts: _tfidf(counts, self.idf))
        aside = np.random.default_rng(seed).random(len(y)) < 0.2
        if aside.all() or len(y) < 20:
            aside[:] = False
        learn, kept = np.flatnonzero(~aside), np.flatnonzero(aside)
        self.w = Ftrl(self.width, len(self.langs)).fit(x.of(learn), y[learn], epochs, 16, seed).astype(np.float32)
        logits = [self.logits(x[kept[i : i + FIT_ROWS]]) for i in range(0, len(kept), FIT_ROWS)]
        self.t = temperature(np.concatenate(logits) if logits else np.zeros((0, len(self.langs))), y[kept])
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w[:-1] + self.w[-1]

    def predict(self, b: tk.Block) -> tuple[list[str], np.ndarray]:
        counts, letters = features(b, self.width)
        if not self.langs:
            return ["und"] * b.rows, np.zeros(b.rows)
        p = softmax(self.logits(_tfidf(counts, self.idf)) / self.t)
        best = p.argmax(axis=1)
        return [self.langs[k] if ok else "und" for k, ok in zip(best, letters, strict=True)], np.where(letters, p[np.arange(len(best)), best], 0.0).astype(float)


def fit_language_model(docs: DataFrame, fit_rows: int = 500, fit_max_chars: int = 60_000, width: int = 1 << 13) -> LanguageModel:
    """Learns from about ``fit_rows`` documents of each language (not held out, of at most ``fit_max_chars`` characters)."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod(F.col("doc_id"), 5) != 0))
    sample = bounded_sample(rows.select("doc_id", "lang", "text"), "doc_id", "lang", fit_rows, 8)
    got = sample.where(F.length("text") <= fit_max_chars).select("doc_id", "lang", "text").collect()
    got.sort(key=lambda r: (str(r[0]), r[2]))
    return LanguageModel(width).fit([r[2] for r in got], [r[1] for r in got])


def identify_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with lang_pred and lang_score; every other column stays (a clashing one is replaced)."""
    ship(docs.sparkSession)
    docs = docs.drop("lang_pred", "lang_score")
    model_cast = docs.sparkSession.sparkContext.broadcast(model)

    def run(source):
        m = model_cast.value
        for batch in source:
            if not batch.num_rows:
                continue
            names, scores = [], []
            for b in tk.text_blocks(batch.column(batch.schema.get_field_index("text"))):
                lang, score = m.predict(b)
                names += lang
                scores.append(score)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(np.concatenate(scores))], names=[*batch.schema.names, "lang_pred", "lang_score"])

    return docs.mapInArrow(run, docs.selectExpr("*", "'' as lang_pred", "0D as lang_score").schema)


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_language_model(docs)
    out = identify_language(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
