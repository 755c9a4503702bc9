"""Repeated passages by prefix-partitioned suffix trees: of every 20-word window, the first occurrence stays.

1. Anchors (see _anchors) find the windows that can recur at all, and equal contexts
   are collapsed to the earliest, so a copied passage is in the trees once.
2. A suffix is a window's start and the words from it on, as deep as the window.
   Suffixes are grouped by a prefix of their own words: the first 8, and 4 more
   wherever a prefix has over ``bound`` suffixes.  Groups are dealt to pools of a
   task's memory, however many there are.
3. In a pool the suffixes are sorted by their words; common prefixes of neighbours
   are the tree: an internal node is a span of neighbours that agree over its depth.
   The highest nodes at least a window deep are the repeats (_suffix_tree has all
   nodes, and the maximal repeats they spell), their leaves the places.
4. A prefix that is still over the bound at a whole window is one such node; its
   earliest leaf is a minimum, which Spark aggregates before the shuffle.

Order is by doc_id (null first), then by position in the text.  Words, contexts and
prefixes are compared by 64-bit hashes: two that differ are taken for equal with
probability 2^-64 a pair.

Edge cases: a null text has no words; texts shorter than the window keep all words;
rows that repeat a doc_id are one document, so neither is earlier than the other at
the same position; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loxodrome.llm import _textkit as tk
from loxodrome.llm._common import ship, table
from loxodrome.llm._repeats import Unit, _same_doc, distinct_contexts, keyed, removed_rows, repeated_anchors
from loxodrome.llm._suffix_tree import highest_nodes, sorted_suffixes

#: Suffixes in a pool, and rows of a batch on the way there.
POOL, ROWS = 1 << 15, 1 << 14
SHORTEST, LONGER = 8, 4


def suffixes(docs: DataFrame, contexts: DataFrame, unit: Unit) -> DataFrame:
    """doc_id, text_key, at, words (hashes as bytes) of every window of the contexts' first occurrences."""
    ship(docs.sparkSession)
    wanted = contexts.groupBy(F.col("first.doc_id").alias("doc_id"), F.col("first.text_key").alias("text_key")).agg(F.collect_list(F.struct(F.col("first.lo").alias("lo"), F.col("first.hi").alias("hi"))).alias("spans"))
    once = docs.join(wanted, _same_doc(docs, wanted)).select(docs["doc_id"], docs["text_key"], docs["text"], "spans")
    window, width = unit.window, 8 * unit.window

    def run(source):
        for batch in source:
            if not batch.num_rows:
                continue
            spans = batch.column(3)
            flat, begin = spans.flatten(), np.concatenate(([0], np.cumsum(np.asarray(spans.value_lengths()))))
            lo, hi = (flat.field(c).to_numpy().astype(np.int64) for c in ("lo", "hi"))
            for b in tk.text_blocks(batch.column(2)):
                e, first = unit.elements(b)
                s0, s1 = begin[b.row0], begin[b.row0 + b.rows]
                row = np.repeat(np.arange(b.rows), np.diff(begin[b.row0 : b.row0 + b.rows + 1]))
                count = hi[s0:s1] - lo[s0:s1] + 1
                row, at = np.repeat(row, count), np.repeat(lo[s0:s1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                if not len(at):
                    continue
                deep = np.lib.stride_tricks.sliding_window_view(e, window)
                for i in range(0, len(at), ROWS):
                    r, p = row[i : i + ROWS], at[i : i + ROWS]
                    body = np.ascontiguousarray(deep[first[r] + p])
                    words = pa.Array.from_buffers(pa.binary(), len(p), [None, pa.py_buffer((np.arange(len(p) + 1) * width).astype(np.int32)), pa.py_buffer(body)])
                    rows = pa.array(r + b.row0)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(p.astype(np.int32)), words], names=["doc_id", "text_key", "at", "words"])

    return once.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, text_key long, at int, words binary")


def prefix_groups(found: DataFrame, window: int, bound: int) -> tuple[DataFrame, DataFrame | None]:
    """Suffixes with the hash of a prefix that at most ``bound`` of them share; and those of which more share the whole window."""
    settled, rest = None, found
    lengths = [*range(min(SHORTEST, window), window, LONGER), window]
    for length in lengths:
        rest = rest.withColumn("prefix", F.xxhash64(F.lit(length), F.substring("words", 1, 8 * length)))
        over = table(rest.groupBy("prefix").count().where(F.col("count") > bound).select("prefix"))
        if over.isEmpty():
            return (rest if settled is None else settled.unionByName(rest)), None
        fits = rest.join(over, "prefix", "left_anti").select(*rest.columns)
        settled = fits if settled is None else settled.unionByName(fits)
        rest = table(rest.join(over, "prefix", "left_semi").select(*rest.columns))
    return settled, rest


def later_leaves(words: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which suffixes have an earlier one in their node; words: a row of word hashes each."""
    order, common = sorted_suffixes(words)
    first, last = highest_nodes(common, words.shape[1])
    leaf = np.concatenate([order[a : b + 1] for a, b in zip(first, last, strict=True)]) if len(first) else order[:0]
    node = np.repeat(np.arange(len(first)), last - first + 1)
    by_place = np.lexsort((at[leaf], doc[leaf], node))
    leaf, node = leaf[by_place], node[by_place]
    earliest = leaf[np.searchsorted(node, node)]
    return leaf[(doc[leaf] != doc[earliest]) | (at[leaf] != at[earliest])]


def later_spans(docs: DataFrame, window: int = 20, gram: int = 10, bound: int = 1 << 12) -> DataFrame:
    """doc_id, text_key, start, stop: word spans of windows that stand earlier elsewhere; docs as made by keyed()."""
    unit = Unit(True, window, gram)
    repeated = repeated_anchors(docs, unit)
    contexts = table(distinct_contexts(repeated))
    # the windows of one context differ in where its anchor lies in them; only another context of the anchor can repeat them
    found = table(suffixes(docs, contexts.where("n_ctx > 1"), unit))
    pools = max(1, -(-found.count() // POOL))
    grouped, whole = prefix_groups(found, window, bound)
    id_type = dict(docs.dtypes)["doc_id"]

    def tree(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        doc = pc.rank(t.column("doc_id"), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
        words = np.frombuffer(b"".join(t.column("words").to_pylist()), np.uint64).reshape(-1, window)
        return t.select(["doc_id", "text_key", "at"]).take(pa.array(later_leaves(words, doc, t.column("at").to_numpy())))

    later = grouped.select("doc_id", "text_key", "at", "words", F.pmod(F.xxhash64("prefix"), F.lit(pools)).alias("pool")).groupBy("pool").applyInArrow(tree, f"doc_id {id_type}, text_key long, at int")
    if whole is not None:
        least = table(whole.groupBy("prefix").agg(F.min(F.struct("doc_id", "at")).alias("least")))
        later = later.unionByName(whole.join(least, "prefix").where(F.struct("doc_id", "at") > F.col("least")).select("doc_id", "text_key", "at"))
    firsts = table(later).select("doc_id", "text_key", F.col("at").alias("start"), (F.col("at") + window).alias("stop"))
    first = contexts.select("fp", "ctx", F.struct("first.doc_id", "first.lo").alias("first"))
    copies = repeated.join(first, ["fp", "ctx"]).where(F.struct("doc_id", "lo") > F.col("first")).select("doc_id", "text_key", F.col("lo").alias("start"), (F.col("hi") + window).alias("stop"))
    return copies.unionByName(firsts)


def _digest(b: tk.Block, start: np.ndarray, stop: np.ndarray, doc: np.ndarray) -> list[pa.Array]:
    w = tk.find_words(b)
    gone = tk.covered(w.first[:-1][doc] + start, stop - start, len(w.start))
    n_gone = tk.per_row_sum(gone, w.first)
    sha = []
    for i in range(b.rows):
        words = b.data[b.off[i] : b.off[i + 1]].tobytes().split()
        sha.append(hashlib.sha256(b" ".join(compress(words, ~gone[w.first[i] : w.first[i + 1]]) if n_gone[i] else words)).hexdigest())
    return [pa.array(np.diff(w.first)), pa.array(n_gone), pa.array(sha)]


def remove_later_repeats(docs: DataFrame, window: int = 20, gram: int = 10, bound: int = 1 << 12) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    d = keyed(docs)
    return removed_rows(d, later_spans(d, window, gram, bound), _digest, "n_words long, n_removed long, kept_sha256 string")


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_later_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, s, md5(array_to_string(w[s:s + 19], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d)
), later AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS r FROM win) WHERE r > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS x FROM later
), agg AS (
  SELECT doc_id, list(x) AS xs FROM gone GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(xs), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN xs IS NULL THEN array_to_string(w, ' ')
    ELSE coalesce((SELECT string_agg(k.t, ' ' ORDER BY k.i) FROM (SELECT d2.w[i] AS t, i FROM (SELECT d.w AS w) d2, range(1, len(d.w) + 1) r(i) WHERE NOT list_contains(xs, i)) k), '') END) AS kept_sha256
FROM d LEFT JOIN agg USING (doc_id)
"""
