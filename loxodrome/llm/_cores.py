"""Hot anchors: their contexts are told apart by longer and longer cores, until a group is small.

All windows of a context hold one core, at first the anchor's gram.  A window that
goes ``half`` elements or more beyond the core to the left holds the core lengthened
to the left; any other holds it lengthened to the right by what is left over.  Equal
windows lie alike about the core, so they go the same way, and of any two equal
windows both reach one group.  Every step halves what a window has beyond the core: a core is a
whole window after some log2(window - gram) steps, and then its group is one text.
A row becomes two at most a step, so the work grows with the rows, whatever the size
of a group; equal parts are collapsed to one with a count.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loxodrome.llm import _textkit as tk
from loxodrome.llm._common import table


def _with_cores(rows: DataFrame, gram: int) -> DataFrame:
    """fp, ctx, m, body of contexts of bytes, and ``core``: where the gram with hash fp first begins."""

    def run(source):
        for batch in source:
            if not batch.num_rows:
                continue
            bodies = batch.column(3).to_pylist()
            size = np.array([len(x) for x in bodies])
            first = np.cumsum(size) - size
            data = np.frombuffer(b"".join(bodies), np.uint8)
            at = np.arange(len(data) - gram + 1)
            fp = np.repeat(batch.column(0).to_numpy(), size)[: len(at)]
            hits = np.flatnonzero(tk.Rolling(data).spans(at, at + gram).view(np.int64) == fp)
            core = hits[np.searchsorted(hits, first)] - first
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(core.astype(np.int32))], names=["fp", "ctx", "m", "body", "core"])

    return rows.select("fp", "ctx", "m", "body").mapInArrow(run, "fp long, ctx long, m long, body binary, core int")


def _halves(rows: DataFrame, window: int) -> DataFrame:
    """Each row (key, sub, m, body, core, length) as its one or two parts, with new names and where they begin in it."""
    beyond = window - F.col("length")
    half = F.ceil(beyond / 2).cast("int")
    windows = F.octet_length("body") - window + 1
    cut = F.col("core") - half  # the last window that goes far enough to the left

    def part(side: int, begin, stop, core, length):
        return F.when(stop > begin, F.struct(F.lit(side).alias("side"), begin.cast("int").alias("shift"), F.substring("body", begin + 1, stop - begin + window - 1).alias("body"), core.cast("int").alias("core"), length.cast("int").alias("length")))

    left = part(0, F.lit(0), F.least(windows, cut + 1), cut, F.col("length") + half)
    begin = F.greatest(cut + 1, F.lit(0))
    right = part(1, begin, windows, F.col("core") - begin, F.col("length") + beyond - half + 1)
    parts = rows.select("key", "sub", "m", F.explode(F.array_compact(F.array(left, right))).alias("p")).select("key", "sub", "m", "p.*")
    lengthened = F.substring("body", F.col("core") + 1, F.col("length"))
    return parts.withColumn("new_key", F.xxhash64("key", "side", lengthened)).withColumn("new_sub", F.xxhash64("body", "core"))


def split_hot(rows: DataFrame, window: int, gram: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Contexts (fp, ctx, m, body) in groups of at most ``most`` distinct ones.

    Gives the parts (fp, ctx, m, body, n_ctx; a part that cannot recur is left out) and
    which context holds them where (fp, ctx of the part; of_fp, of_ctx, shift).
    """
    todo = table(_with_cores(rows, gram).select(F.col("fp").alias("key"), F.col("ctx").alias("sub"), "m", "body", "core", F.lit(gram).alias("length")))
    members = todo.select("key", "sub", F.col("key").alias("of_fp"), F.col("sub").alias("of_ctx"), F.lit(0).alias("shift"))
    done, places = [], []
    while True:
        halves = table(_halves(todo, window))
        merged = table(halves.groupBy(F.col("new_key").alias("key"), F.col("new_sub").alias("sub")).agg(F.sum("m").alias("m"), *(F.first(c).alias(c) for c in ("body", "core", "length"))))
        size = merged.groupBy("key").agg(F.count(F.lit(1)).alias("n_ctx"), F.sum("m").alias("total")).where("total >= 2").drop("total")
        sized = table(merged.join(size, "key"))
        step = halves.select("key", "sub", "new_key", "new_sub", F.col("shift").alias("more"))
        members = table(members.join(step, ["key", "sub"]).select(F.col("new_key").alias("key"), F.col("new_sub").alias("sub"), "of_fp", "of_ctx", (F.col("shift") + F.col("more")).alias("shift")))
        done.append(sized.where(F.col("n_ctx") <= most))
        places.append(members)
        todo = sized.where(F.col("n_ctx") > most).drop("n_ctx")
        if todo.isEmpty():
            break
    parts = reduce(DataFrame.unionByName, done).select(F.col("key").alias("fp"), F.col("sub").alias("ctx"), "m", "body", "n_ctx")
    return parts, reduce(DataFrame.unionByName, places).withColumnsRenamed({"key": "fp", "sub": "ctx"})
