"""Quality classifier: a byte-level convolutional network in numpy.

A byte is a learned vector, beside one fixed channel that says whether the eight
bytes here also stand a few bytes before (so a filter can see repetition).  Filters
of eight bytes slide over the whole text at a stride of two; each filter is
max-pooled over overlapping chunks of 512 bytes (step 256), and the chunks are
combined by their maximum and mean into one logistic unit.  Gradients flow through
the pooled positions alone; Adam does the steps, on the driver, over a bounded
sample of labelled rows.

Edge cases: a null or empty text is scored as one chunk of padding; texts of any
length are scored whole; repeated rows and null ids keep their rows; other columns
are ignored; an empty table gives an empty result; with fewer than two classes
labelled, the score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loxodrome.llm import _textkit as tk
from loxodrome.llm._common import bounded_sample, crc_mod, ship

WIDTH, STRIDE, HALF = 8, 2, 128  # bytes a filter sees, bytes a step, steps in half a chunk
LAGS = range(2, 25)


def _repeats_nearby(data: np.ndarray) -> np.ndarray:
    """1 where the eight bytes from here equal those from a start 2 to 24 bytes before."""
    n = len(data)
    out = np.zeros(n, np.float32)
    if n < WIDTH + 2:
        return out
    eight = np.lib.stride_tricks.as_strided(data, (n - 7, 8), (1, 1)).copy().view(np.uint64).ravel()
    seen = np.zeros(len(eight), bool)
    for lag in LAGS:
        if lag < len(eight):
            seen[lag:] |= eight[lag:] == eight[:-lag]
    zeros = np.flatnonzero(eight == 0)  # padding is no text
    seen[zeros] = False
    out[: len(eight)] = seen
    return out


class Laid:
    """The texts of a block with room for a filter after each, and where their steps and half chunks begin."""

    def __init__(self, b: tk.Block) -> None:
        size = np.diff(b.off)
        room = (size + 1) // 2 * 2 + WIDTH
        at = np.concatenate(([0], np.cumsum(room)))
        self.data = np.zeros(at[-1], np.uint8)
        self.data[np.arange(len(b.data)) + np.repeat(at[:-1] - b.off[:-1], size)] = b.data
        self.repeat = _repeats_nearby(self.data)
        steps = np.maximum(1, (size + 1) // 2)
        halves = -(-steps // HALF)
        self.first = np.concatenate(([0], np.cumsum(halves)))
        doc = np.repeat(np.arange(b.rows), halves)
        begin = at[:-1][doc] // 2 + (np.arange(len(doc)) - self.first[doc]) * HALF
        stop = np.minimum(begin + HALF, at[:-1][doc] // 2 + steps[doc])
        self.bounds = np.column_stack([begin, stop])
        self.doc = doc
        self.n_steps = (len(self.data) - WIDTH) // STRIDE + 1


class QualityNet:
    def __init__(self, dim: int = 5, filters: int = 16, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.dim, self.filters = dim, filters
        self.p = {
            "embed": rng.normal(0, 0.5, (256, dim)).astype(np.float32),
            "conv": (rng.normal(0, 1, (WIDTH * (dim + 1), filters)) / np.sqrt(WIDTH * (dim + 1))).astype(np.float32),
            "bias": np.zeros(filters, np.float32),
            "out": rng.normal(0, 0.1, 2 * filters).astype(np.float32),
            "out0": np.zeros(1, np.float32),
        }
        self.constant: float | None = None

    def _columns(self, x: Laid) -> np.ndarray:
        c = self.dim + 1
        v = np.empty((len(x.data), c), np.float32)
        v[:, :-1] = self.p["embed"][x.data]
        v[:, -1] = x.repeat
        return np.lib.stride_tricks.as_strided(v, (x.n_steps, WIDTH * c), (STRIDE * c * 4, 4))

    def _pool(self, x: Laid, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = np.empty((x.n_steps, self.filters), np.float32)
        for i in range(0, x.n_steps, 1 << 15):
            r[i : i + (1 << 15)] = cols[i : i + (1 << 15)] @ self.p["conv"]
        r += self.p["bias"]
        flat = np.minimum(x.bounds.ravel(), x.n_steps - 1)
        if len(flat) and flat[-1] <= flat[-2]:
            flat = flat[:-1]
        half = np.maximum.reduceat(r, flat, axis=0)[::2]
        return r, half

    def _combine(self, x: Laid, half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = np.maximum(half, 0)
        nxt = np.minimum(np.arange(len(h)) + 1, x.first[1:][x.doc] - 1)
        from_next = h[nxt] > h
        chunk = np.where(from_next, h[nxt], h)
        n = np.diff(x.first)
        return h, np.hstack([np.maximum.reduceat(chunk, x.first[:-1], axis=0), np.add.reduceat(chunk, x.first[:-1], axis=0) / n[:, None]]), np.where(from_next, nxt[:, None], np.arange(len(h))[:, None])

    def score(self, b: tk.Block) -> np.ndarray:
        if self.constant is not None:
            return np.full(b.rows, self.constant)
        x = Laid(b)
        _, half = self._pool(x, self._columns(x))
        f = self._combine(x, half)[1]
        return 1 / (1 + np.exp(-np.clip(f @ self.p["out"] + self.p["out0"], -30, 30)).astype(float))

    def _gradients(self, b: tk.Block, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        x = Laid(b)
        cols = self._columns(x)
        r, half = self._pool(x, cols)
        h, f, source = self._combine(x, half)
        p = 1 / (1 + np.exp(-np.clip(f @ self.p["out"] + self.p["out0"], -30, 30)))
        d = ((p - y) * weight / len(y)).astype(np.float32)
        g = {"out": f.T @ d, "out0": np.array([d.sum()], np.float32)}
        df = d[:, None] * self.p["out"]
        k = self.filters
        chunk = np.take_along_axis(h, source, axis=0)
        top = np.maximum.reduceat(chunk, x.first[:-1], axis=0)
        is_top = chunk == top[x.doc]
        share = np.add.reduceat(is_top.astype(np.float32), x.first[:-1], axis=0)
        dc = is_top / share[x.doc] * df[x.doc, :k] + df[x.doc, k:] / np.diff(x.first)[x.doc][:, None]
        dh = np.zeros_like(h)
        np.add.at(dh, (source, np.arange(k)[None, :]), dc)
        dh *= half > 0
        rows, at, value = [], [], []
        for i, (lo, hi) in enumerate(x.bounds):
            rows.append(lo + r[lo:hi].argmax(axis=0))
            at.append(np.arange(k))
            value.append(dh[i])
        rows, at, value = np.concatenate(rows), np.concatenate(at), np.concatenate(value)
        sel, inv = np.unique(rows, return_inverse=True)
        gr = np.zeros((len(sel), k), np.float32)
        np.add.at(gr, (inv, at), value)
        g["conv"] = cols[sel].T @ gr
        g["bias"] = gr.sum(axis=0)
        dcols = (gr @ self.p["conv"].T).reshape(len(sel), WIDTH, self.dim + 1)[:, :, :-1]
        seen = x.data[sel[:, None] * STRIDE + np.arange(WIDTH)].ravel()
        g["embed"] = np.column_stack([np.bincount(seen, dcols[:, :, c].ravel(), 256) for c in range(self.dim)]).astype(np.float32)
        return g

    def fit(self, texts: list[str], y: np.ndarray, epochs: int = 6, batch: int = 32, rate: float = 0.01, seed: int = 3) -> QualityNet:
        if len(set(y.tolist())) < 2:
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        rng = np.random.default_rng(seed)
        weight = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        t, total = 0, epochs * -(-len(y) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), batch):
                rows = order[i : i + batch]
                (block,) = tk.text_blocks(pa.array([texts[j] for j in rows], pa.string()), block=1 << 40)
                g = self._gradients(block, y[rows], weight[rows])
                t += 1
                lr = rate * (1 - t / (total + 1)) + 1e-4
                for k in self.p:
                    m[k] += 0.1 * (g[k] - m[k])
                    s[k] += 0.005 * (g[k] ** 2 - s[k])
                    self.p[k] -= (lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.995**t)) + 1e-7)).astype(np.float32)
        return self


def fit_quality_net(docs: DataFrame, labels: DataFrame, fit_rows: int = 700, fit_max_chars: int = 30_000) -> QualityNet:
    """Learns from about ``fit_rows`` rows of each label that are not held out, of at most ``fit_max_chars`` characters."""
    marked = labels.where(F.col("quality").isNotNull() & (crc_mod(F.col("doc_id"), 4) != 2)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = bounded_sample(marked, "doc_id", "quality", fit_rows, 2)
    got = docs.select("doc_id", "text").where(F.length(F.coalesce("text", F.lit(""))) <= fit_max_chars).join(F.broadcast(sample), "doc_id").collect()
    got = sorted(((r["doc_id"], r["text"] or "", int(r["quality"])) for r in got), key=lambda r: (r[0], r[1]))
    return QualityNet().fit([r[1] for r in got], np.array([r[2] for r in got]))


def score_texts(docs: DataFrame, model, name: str) -> DataFrame:
    """doc_id and the score of each text; model.score(block) is called on whole texts."""
    ship(docs.sparkSession)
    cast = docs.sparkSession.sparkContext.broadcast(model)

    def run(source):
        m = cast.value
        for batch in source:
            if batch.num_rows:
                score = np.concatenate([m.score(b) for b in tk.text_blocks(batch.column(1), 1 << 18)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score.astype(float))], names=["doc_id", name])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {name} double")


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = fit_quality_net(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_texts(docs, net, "score").select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
