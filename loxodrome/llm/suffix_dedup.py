"""Exact substring removal by suffix arrays: every byte of a 400-byte string that also starts elsewhere goes.

1. Anchors (see _anchors) split the windows of all texts into runs; only runs whose
   anchor hash occurs twice can hold repeated windows.  Equal contexts are collapsed
   to one with a count, wherever they come from, so a text copied a million times is
   sorted once.
2. The contexts are dealt to shards by anchor hash.  A shard is one suffix array
   (Larsson-Sadakane refinement, to the depth of the window); Kasai's common
   prefixes join neighbours that agree over the window into runs, and a run whose
   counts add up to two or more repeats.
3. An anchor with more than ``block`` contexts is dealt to several shards, each with
   its own suffix array; every two of them are merged by seeking the runs of one in
   the sorted runs of the other by binary search.  One with more than ``merged``
   blocks (a hot phrase) is first split by longer cores (see _cores), so that a
   context meets a bounded number of others however often the phrase occurs.
4. Repeated window ranges go back to all occurrences, and per document to spans.

Edge cases: a null text is empty; texts shorter than the window keep all bytes;
texts are taken whole, up to 2^28 bytes; repeated rows are copies of each other and
lose what they share; null ids are ids; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loxodrome.llm import _textkit as tk
from loxodrome.llm._common import table
from loxodrome.llm._cores import split_hot
from loxodrome.llm._repeats import Unit, distinct_contexts, keyed, removed_rows, repeated_anchors, with_elements
from loxodrome.llm._suffixes import MAX_ELEMENTS, WindowRuns, ranges, shared_runs

SHARD_BYTES = 1 << 20


def _shard(bodies: list[bytes], window: int) -> WindowRuns:
    size = np.array([len(x) for x in bodies], np.int64)
    end = np.cumsum(size + 1) - 1
    return WindowRuns(np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8), end - size, end, window)


def repeated_in_shard(bodies: list[bytes], counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges (context, first offset, last offset) of windows that occur twice, counts included."""
    w = _shard(bodies, window)
    total = np.bincount(w.run, counts[w.text], w.n_runs)
    flags = total[w.run] >= 2
    first = np.searchsorted(w.text, w.text)
    return ranges(flags, w.text, np.arange(len(w.text)) - first)


def repeated_across(a: list[bytes], b: list[bytes], window: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The ranges of windows of each shard that also occur in the other."""
    wa, wb = _shard(a, window), _shard(b, window)
    return [ranges(hit[w.run], w.text, np.arange(len(w.text)) - np.searchsorted(w.text, w.text)) for w, hit in zip((wa, wb), shared_runs(wa, wb), strict=True)]


def _run_shard(t: pa.Table, window: int) -> pa.Table:
    fp, ctx, m = (t.column(c).to_numpy() for c in ("fp", "ctx", "m"))
    one, other, mine = (t.column(c).to_numpy() for c in ("one", "other", "mine"))
    bodies = t.column("body").to_pylist()
    out = []

    def emit(rows: np.ndarray, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        text, first, last = found
        out.append((fp[rows[text]], ctx[rows[text]], first, last))

    if len(t) and one[0] != other[0]:
        left, right = np.flatnonzero(mine == one), np.flatnonzero(mine == other)
        for rows, found in zip((left, right), repeated_across([bodies[i] for i in left], [bodies[i] for i in right], window), strict=True):
            emit(rows, found)
    else:
        # anchors are independent of each other: as many at a time as an array holds
        order = np.argsort(fp, kind="stable")
        size = np.array([len(bodies[i]) + 1 for i in order])
        group_end = np.flatnonzero(np.concatenate((fp[order][1:] != fp[order][:-1], [True]))) + 1
        total, begin, last = np.concatenate(([0], np.cumsum(size))), 0, 0
        for stop in [*group_end[1:], None]:
            prev = group_end[last]
            last += 1
            if stop is None or total[stop] - total[begin] > MAX_ELEMENTS // 2:
                rows = order[begin:prev]
                emit(rows, repeated_in_shard([bodies[i] for i in rows], m[rows], window))
                begin = prev
    parts = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
    return pa.table({"fp": parts[0].astype(np.int64), "ctx": parts[1].astype(np.int64), "a": parts[2].astype(np.int32), "b": parts[3].astype(np.int32)})


def repeated_spans(docs: DataFrame, window: int = 400, gram: int = 200, block: int = 1000, merged: int = 4) -> DataFrame:
    """doc_id, text_key, start, stop: byte spans of windows that occur elsewhere; docs as made by keyed()."""
    unit = Unit(False, window, gram)
    repeated = repeated_anchors(docs, unit)
    contexts = table(distinct_contexts(repeated))
    hot = F.col("n_ctx") > block * merged
    total, any_hot = contexts.agg(F.sum(F.col("first.hi") - F.col("first.lo") + window), F.max(hot)).first()
    found = _decide(with_elements(docs, contexts.where(~hot), unit), total or 0, window, block)
    if any_hot:
        parts, places = split_hot(with_elements(docs, contexts.where(hot), unit), window, gram, block * merged)
        parts = table(parts)
        total = parts.agg(F.sum(F.octet_length("body"))).first()[0] or 0
        again = _decide(parts, total, window, block).join(places, ["fp", "ctx"])
        found = found.unionByName(again.select(F.col("of_fp").alias("fp"), F.col("of_ctx").alias("ctx"), (F.col("a") + F.col("shift")).alias("a"), (F.col("b") + F.col("shift")).alias("b")))
    return repeated.join(found, ["fp", "ctx"]).select("doc_id", "text_key", (F.col("lo") + F.col("a")).alias("start"), (F.col("lo") + F.col("b") + window).alias("stop"))


def _decide(contexts: DataFrame, total: int, window: int, block: int) -> DataFrame:
    """fp, ctx, a, b: ranges of windows of a context (fp, ctx, m, n_ctx, body; ``total`` bytes in all) that occur twice under one fp."""
    shards = max(1, -(-total // SHARD_BYTES))
    blocks = F.ceil(F.col("n_ctx") / block).cast("int")
    mine = F.pmod(F.xxhash64("ctx"), blocks).cast("int")
    rows = contexts.withColumn("blocks", blocks).withColumn("mine", mine)
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("one", F.least("mine", "with")).withColumn("other", F.greatest("mine", "with"))
    hot = F.col("blocks") > 1
    key = [F.when(hot, F.col("fp")).otherwise(F.pmod(F.xxhash64("fp"), F.lit(shards))).alias("shard"), "one", "other"]
    found = rows.select("fp", "ctx", "m", "body", "mine", *key, hot.alias("hot")).groupBy("hot", "shard", "one", "other").applyInArrow(lambda t: _run_shard(t, window), "fp long, ctx long, a int, b int")
    return table(found)


def _digest(b: tk.Block, start: np.ndarray, stop: np.ndarray, doc: np.ndarray) -> list[pa.Array]:
    n = len(b.data)
    gone = tk.covered(b.off[:-1][doc] + start, stop - start, n)
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    begins[b.off[:-1][b.off[:-1] < n]] |= gone[b.off[:-1][b.off[:-1] < n]]
    sha = []
    for i in range(b.rows):
        x = b.data[b.off[i] : b.off[i + 1]]
        g = gone[b.off[i] : b.off[i + 1]]
        sha.append(hashlib.sha256((x[~g] if g.any() else x).tobytes()).hexdigest())
    return [pa.array(np.diff(b.off)), pa.array(tk.per_row_sum(gone, b.off)), pa.array(tk.per_row_sum(begins, b.off)), pa.array(sha)]


def remove_repeats(docs: DataFrame, window: int = 400, gram: int = 200, block: int = 1000, merged: int = 4) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    d = keyed(docs)
    return removed_rows(d, repeated_spans(d, window, gram, block, merged), _digest, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op1_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
