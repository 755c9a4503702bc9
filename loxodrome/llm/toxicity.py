"""Toxicity scores behind a noisy channel.

A writer hides a word by look-alike signs (1d10t), by spacing (i d i o t, i.d.i.o.t)
or by repetition (iiidiot).  Each token that shows such a trace becomes a lattice:
every character offers the letters it may stand for, separators may vanish, and a
run of one letter may be one or two of it.  Viterbi decoding under a trigram model
of characters picks the likeliest letters; the character model counts all
documents.  The restored text is then scored: words and word beginnings that mark
toxic labels, chosen on a bounded sample, are summed by a logistic regression.

Edge cases: a null or empty text has the score of a text without any marked word;
texts are scored whole whatever their length; repeated rows and null ids keep
their rows; other columns are ignored; an empty table gives an empty result; with
fewer than two classes labelled, the score is 0 (or 1 if all labels are 1).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loxodrome.llm import _textkit as tk
from loxodrome.llm._common import bounded_sample, crc_mod, ship
from loxodrome.llm._linear import Ftrl
from loxodrome.llm.quality_cnn import score_texts

#: Letters of the character model: a-z and the lower-case letters of Latin-1 and Latin Extended-A; 0 is a word's edge.
LETTERS = [chr(c) for c in range(97, 123)] + [chr(c) for c in range(0xDF, 0x180) if chr(c).isalpha() and chr(c).islower()]
LETTER_ID = {c: i + 1 for i, c in enumerate(LETTERS)}
SYMBOLS = len(LETTERS) + 1
#: What each sign may stand for.
LOOK_ALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
SEPARATORS = ".-_*~'`,/\\"
SIGN = "0-9@$!|+(€£¡"
_L = r"[^\W\d_]"
#: Tokens with a sign or separator between letters, or a letter three times over; and four or more letters apart.
SUSPECT = re.compile(rf"(?<!\S)(?:\S (?=\S(?!\S))){{3,}}\S(?!\S)|(?<!\S)(?=\S*?(?:{_L}[{SIGN}.\-_*~'`/\\]+{_L}|[{SIGN}]{_L}|({_L})\1\1))\S+", re.I)
HIDE_COST, DROP_COST, RUN_COST = 0.7, 0.5, 0.4

#: Not part of a word: ASCII but letters.
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[65:91] = NOT_LETTER[97:123] = False
NOT_LETTER[128:] = False
PREFIXES = (4, 5, 6, 7, 8, 9)
#: A word marks toxicity from this excess in deviations and this ratio of frequencies on.
MIN_EXCESS, MIN_LIFT = 2.5, 8


def _ids(b: tk.Block) -> np.ndarray:
    """Character-model ids of a block, a 0 after each text, runs of 0 cut to one."""
    if "t" not in _table:
        t = np.zeros(0x10000, np.int16)
        for c in range(0x250):
            t[c] = LETTER_ID.get(chr(c).lower(), 0)
        _table["t"] = t
    codes = np.frombuffer(b.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    ids = _table["t"][np.minimum(codes, 0xFFFF)]
    keep = np.ones(len(ids), bool)
    keep[1:] = (ids[1:] != 0) | (ids[:-1] != 0)
    return ids[keep].astype(np.int64)


_table: dict[str, np.ndarray] = {}


def count_trigrams(docs: DataFrame) -> np.ndarray:
    """Trigram counts of characters over all documents; one row for each trigram and partition reaches the shuffle."""
    ship(docs.sparkSession)

    def run(source):
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in source:
            for b in tk.text_blocks(batch.column(0)):
                c = np.concatenate([[0, 0], _ids(b), [0]])
                total += np.bincount((c[:-2] * SYMBOLS + c[1:-1]) * SYMBOLS + c[2:], minlength=SYMBOLS**3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["gram", "n"])

    out = np.zeros(SYMBOLS**3)
    # at most SYMBOLS^3 rows, whatever the corpus
    for r in docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r[0]] = r[1]
    return out.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


class NoisyChannel:
    def __init__(self, counts: np.ndarray) -> None:
        one = counts.sum(axis=(0, 1)) + 0.5
        two = counts.sum(axis=0)
        p1 = one / one.sum()
        p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
        p3 = (counts + 5 * p2[None]) / (counts.sum(axis=2, keepdims=True) + 5)
        self.cost = -np.log(p3).astype(np.float32)
        self.known: dict[str, str] = {}

    def _lattice(self, token: str) -> list[list[tuple[tuple[int, ...], float]]]:
        """For each position, the letters it may emit (none, one or two) and what that costs."""
        out, i = [], 0
        while i < len(token):
            c = token[i]
            j = i
            while j < len(token) and token[j] == c:
                j += 1
            k = LETTER_ID.get(c)
            if k:
                if j - i >= 3:
                    out.append([((k,), RUN_COST), ((k, k), RUN_COST)])
                else:
                    out += [[((k,), 0.0)]] * (j - i)
            elif c in LOOK_ALIKES:
                choices = [((LETTER_ID[x],), HIDE_COST) for x in LOOK_ALIKES[c]]
                out.append([*choices, ((), 4.0)] if c in "!|+(" else choices)
                if j - i == 2:
                    out.append([((), RUN_COST), *choices])
            else:
                out.append([((), DROP_COST)])
            i = j
        return out

    def decode(self, token: str) -> str:
        """The likeliest letters of a token under the character model."""
        if (done := self.known.get(token)) is not None:
            return done
        paths: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for choices in self._lattice(token.lower().strip(SEPARATORS + "?:;\"[]{})")):
            nxt: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (cost, back) in paths.items():
                for letters, extra in choices:
                    x, y, total, trail = a, b, cost + extra, back
                    for k in letters:
                        total += float(self.cost[x, y, k])
                        x, y, trail = y, k, (trail, k)
                    if (x, y) not in nxt or total < nxt[x, y][0]:
                        nxt[x, y] = (total, trail)
            paths = nxt
        best = min(((cost + float(self.cost[a, b, 0]), back) for (a, b), (cost, back) in paths.items()), key=lambda p: p[0])[1]
        word = []
        while best:
            best, k = best
            word.append(LETTERS[k - 1])
        if len(self.known) > 200_000:
            self.known.clear()
        self.known[token] = out = "".join(reversed(word))
        return out

    def restore(self, text: str) -> str:
        return SUSPECT.sub(lambda m: f" {self.decode(m[0].replace(' ', ''))} ", text)


def _features(b: tk.Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and word beginnings, and the text of each."""
    w = tk.find_words(b, NOT_LETTER)
    roll = tk.Rolling(tk.LOWER[b.data])
    size = w.end - w.start
    h, doc = [roll.spans(w.start, w.end) + np.uint64(1)], [w.doc]
    for n in PREFIXES:
        long = size > n
        h.append(roll.spans(w.start[long], w.start[long] + n))
        doc.append(w.doc[long])
    return np.concatenate(h), np.concatenate(doc)


class ToxicityModel:
    def __init__(self, channel: NoisyChannel, max_features: int = 4096) -> None:
        self.channel, self.max_features, self.constant = channel, max_features, None

    def _restored(self, b: tk.Block) -> tk.Block:
        """The block with every suspect token decoded; a block without any is given back as it is."""
        raw = b.data.tobytes()
        texts = [raw[b.off[i] : b.off[i + 1]].decode("utf-8", "replace") for i in range(b.rows)]
        (out,) = tk.text_blocks(pa.array([self.channel.restore(t) for t in texts], pa.string()), 1 << 60, b.rows)
        return out

    def _rows(self, blocks) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(text, feature, log of 1 + count) of the chosen features."""
        rows, cols, values, n = [], [], [], 0
        for b in blocks:
            h, doc = _features(self._restored(b))
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            hit = self.keys[at] == h
            pair, count = np.unique((doc[hit] + n) * len(self.keys) + at[hit], return_counts=True)
            rows.append(pair // len(self.keys))
            cols.append(pair % len(self.keys))
            values.append(np.log1p(count))
            n += b.rows
        return np.concatenate(rows), np.concatenate(cols), np.concatenate(values), n

    def fit(self, texts: list[str], y: np.ndarray, seed: int = 4) -> ToxicityModel:
        if len(set(y.tolist())) < 2:
            self.constant = float(y.mean()) if len(y) else 0.0
            return self
        blocks = list(tk.text_blocks(pa.array(texts, pa.string())))
        found, n = [], 0
        for b in blocks:
            h, doc = _features(self._restored(b))
            pair = np.unique(np.rec.fromarrays([h, doc + n]))
            found.append((pair.f0, pair.f1))
            n += b.rows
        h, doc = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        keys, inv = np.unique(h, return_inverse=True)
        toxic = np.bincount(inv[y[doc] == 1], minlength=len(keys))
        clean = np.bincount(inv[y[doc] == 0], minlength=len(keys))
        # by how many deviations a feature is more frequent in toxic texts than its overall frequency lets expect
        expected = (toxic + clean) * (y == 1).mean()
        excess = (toxic - expected) / np.sqrt(expected + 1)
        lift = ((toxic + 0.5) / (y == 1).sum()) / ((clean + 0.5) / (y == 0).sum())
        marks = np.flatnonzero((excess >= MIN_EXCESS) & (lift >= MIN_LIFT))
        marks = marks[np.argsort(-excess[marks], kind="stable")[: self.max_features]]
        self.keys = np.sort(keys[marks]) if len(marks) else np.zeros(1, np.uint64)
        rows, cols, values, n = self._rows(blocks)
        x = np.zeros((n, len(self.keys)), np.float32)
        x[rows, cols] = values
        self.w = Ftrl(len(self.keys), 2, alpha=0.5, l1=1e-3, l2=1e-3).fit(x, y, 6, 32, seed)
        return self

    def score(self, b: tk.Block) -> np.ndarray:
        if self.constant is not None:
            return np.full(b.rows, self.constant)
        rows, cols, values, n = self._rows([b])
        w = self.w[:, 1] - self.w[:, 0]
        z = w[-1] + np.bincount(rows, w[:-1][cols] * values, n)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = 1500, fit_max_chars: int = 30_000) -> ToxicityModel:
    """Character model over all documents; scorer from about ``fit_rows`` rows of each label that are not held out, of at most ``fit_max_chars`` characters."""
    model = ToxicityModel(NoisyChannel(count_trigrams(docs)))
    marked = labels.where(F.col("toxic").isNotNull() & (crc_mod(F.col("doc_id"), 5) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = bounded_sample(marked, "doc_id", "toxic", fit_rows, 4)
    got = docs.select("doc_id", "text").where(F.length(F.coalesce("text", F.lit(""))) <= fit_max_chars).join(F.broadcast(sample), "doc_id").collect()
    got = sorted(((r["doc_id"], r["text"] or "", int(r["toxic"])) for r in got), key=lambda r: (r[0], r[1]))
    return model.fit([r[1] for r in got], np.array([r[2] for r in got]))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_texts(docs, model, "score").select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
