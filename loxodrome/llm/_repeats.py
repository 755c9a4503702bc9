"""The distributed frame of both substring operators: anchors, repeated contexts, and results per document.

    anchors      one row for each run of windows, no text: (document, lo, hi, hash of the anchor, hash of the context)
    repeated     anchors whose hash occurs twice or more, anywhere
    contexts     one row for each distinct context of those, with its count and first occurrence; then with its elements

Documents are matched by id and text hash, so repeated ids stay apart.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loxodrome.llm import _textkit as tk
from loxodrome.llm._anchors import Anchors, find_anchors
from loxodrome.llm._common import ship, table


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")


def _same_doc(a: DataFrame, b: DataFrame):
    return (a["text_key"] == b["text_key"]) & a["doc_id"].eqNullSafe(b["doc_id"])


class Unit:
    """How a text is cut: into bytes, or into words."""

    def __init__(self, words: bool, window: int, gram: int) -> None:
        self.words, self.window, self.gram = words, window, gram

    def elements(self, b: tk.Block) -> tuple[np.ndarray, np.ndarray]:
        """Elements of a block (bytes, or hashes of words) and where each text's begin."""
        if not self.words:
            return b.data, b.off
        w = tk.find_words(b)
        return tk.word_hashes(b, w), w.first

    def anchors(self, b: tk.Block) -> tuple[np.ndarray, Anchors, np.ndarray, np.ndarray, np.ndarray]:
        """Where texts begin, their anchors, and hashes of anchor grams and contexts."""
        if self.words:
            w = tk.find_words(b)
            roll = tk.Rolling(b.data)
            h = roll.spans(w.start, w.end)
            sums = np.concatenate(([np.uint64(0)], np.cumsum(h * tk._power_table("up", tk._BASE, len(h)))))
            down = tk._power_table("down", tk._BASE_INV, len(h) + 1)
            span = lambda lo, hi: tk.mix((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64))
            first, n, doc = w.first, len(h), w.doc
        else:
            span, first, n = tk.Rolling(b.data).spans, b.off, len(b.data)
            doc = np.repeat(np.arange(b.rows), np.diff(b.off))
        at = np.arange(max(0, n - self.gram + 1))
        grams = span(at, at + self.gram)
        a = find_anchors(grams, doc, self.window, self.gram)
        return first, a, grams[a.at] if len(a.at) else grams[:0], span(a.lo, a.hi + self.window), np.asarray(first)


def anchor_rows(docs: DataFrame, unit: Unit, columns: list[str]) -> DataFrame:
    """doc_id, text_key, lo, hi, fp, ctx of every anchor; ``columns`` names those wanted."""
    ship(docs.sparkSession)
    types = {"doc_id": dict(docs.dtypes)["doc_id"], "text_key": "long", "lo": "int", "hi": "int", "fp": "long", "ctx": "long"}

    def run(source):
        for batch in source:
            for b in tk.text_blocks(batch.column(2)):
                _, a, fp, ctx, first = unit.anchors(b)
                if not len(a.doc):
                    continue
                rows = pa.array(a.doc + b.row0)
                got = {
                    "doc_id": lambda: batch.column(0).take(rows), "text_key": lambda: batch.column(1).take(rows),
                    "lo": lambda: pa.array((a.lo - first[a.doc]).astype(np.int32)), "hi": lambda: pa.array((a.hi - first[a.doc]).astype(np.int32)),
                    "fp": lambda: pa.array(fp.view(np.int64)), "ctx": lambda: pa.array(ctx.view(np.int64)),
                }
                yield pa.RecordBatch.from_arrays([got[c]() for c in columns], names=columns)

    return docs.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in columns))


def repeated_anchors(docs: DataFrame, unit: Unit) -> DataFrame:
    """The anchors whose hash occurs at least twice. Text is read twice, so that single anchors are never stored."""
    # a table of its own, so that the join below has a plain shuffle on the side of the anchors, which Spark can split where a hash is hot
    often = table(anchor_rows(docs, unit, ["fp"]).groupBy("fp").count().where("count >= 2").select("fp"))
    return table(anchor_rows(docs, unit, ["doc_id", "text_key", "lo", "hi", "fp", "ctx"]).join(often, "fp", "left_semi"))


def distinct_contexts(repeated: DataFrame) -> DataFrame:
    """fp, ctx, m (occurrences), first (its earliest: doc_id, lo, hi, text_key) and n_ctx (contexts of that fp)."""
    g = repeated.groupBy("fp", "ctx").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("doc_id", "lo", "hi", "text_key")).alias("first"))
    g = table(g)
    return g.join(g.groupBy("fp").agg(F.count(F.lit(1)).alias("n_ctx")), "fp")


def with_elements(docs: DataFrame, contexts: DataFrame, unit: Unit) -> DataFrame:
    """contexts with ``body``: their elements as bytes (words: eight bytes each), taken from the first occurrence."""
    ship(docs.sparkSession)
    wanted = contexts.groupBy(F.col("first.doc_id").alias("doc_id"), F.col("first.text_key").alias("text_key")).agg(F.collect_list(F.struct(F.col("first.lo").alias("lo"), F.col("first.hi").alias("hi"), "fp", "ctx", "m", "n_ctx")).alias("spans"))
    once = docs.join(wanted, _same_doc(docs, wanted)).select(docs["doc_id"], docs["text"], "spans")
    id_type = dict(docs.dtypes)["doc_id"]
    window = unit.window

    def run(source):
        for batch in source:
            if not batch.num_rows:
                continue
            spans = batch.column(2)
            flat, counts = spans.flatten(), np.asarray(spans.value_lengths())
            begin = np.concatenate(([0], np.cumsum(counts)))
            lo, hi = flat.field("lo").to_numpy(), flat.field("hi").to_numpy()
            for b in tk.text_blocks(batch.column(1)):
                e, first = unit.elements(b)
                s0, s1 = begin[b.row0], begin[b.row0 + b.rows]
                base = np.repeat(first[:-1], counts[b.row0 : b.row0 + b.rows])
                bodies = [e[x : y + window].tobytes() for x, y in zip(base + lo[s0:s1], base + hi[s0:s1], strict=True)]
                rows = pa.array(np.repeat(np.arange(b.row0, b.row0 + b.rows), counts[b.row0 : b.row0 + b.rows]))
                part = flat.slice(s0, s1 - s0)
                yield pa.RecordBatch.from_arrays([*(part.field(c) for c in ("fp", "ctx", "m", "n_ctx", "lo")), batch.column(0).take(rows), pa.array(bodies, pa.binary())], names=["fp", "ctx", "m", "n_ctx", "lo", "doc_id", "body"])

    return once.mapInArrow(run, f"fp long, ctx long, m long, n_ctx long, lo int, doc_id {id_type}, body binary")


def spans_per_document(spans: DataFrame) -> DataFrame:
    """spans (doc_id, text_key, start, stop) gathered: as many as the text has at most."""
    return spans.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def removed_rows(docs: DataFrame, spans: DataFrame, digest: Callable, schema: str) -> DataFrame:
    """Every document with its removed spans: digest(block, starts, stops, text of each span) gives the result columns after doc_id."""
    ship(docs.sparkSession)
    per = spans_per_document(spans)
    joined = docs.join(per, _same_doc(docs, per), "left").select(docs["doc_id"], docs["text"], "spans")

    def run(source):
        for batch in source:
            if not batch.num_rows:
                continue
            col = batch.column(2)
            counts = np.asarray(col.value_lengths().fill_null(0)).astype(np.int64)
            flat = col.flatten()
            start, stop = flat.field("start").to_numpy().astype(np.int64), flat.field("stop").to_numpy().astype(np.int64)
            begin = np.concatenate(([0], np.cumsum(counts)))
            parts = []
            for b in tk.text_blocks(batch.column(1)):
                s0, s1 = begin[b.row0], begin[b.row0 + b.rows]
                parts.append(digest(b, start[s0:s1], stop[s0:s1], np.repeat(np.arange(b.rows), counts[b.row0 : b.row0 + b.rows])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.concat_arrays([p[i] for p in parts]) for i in range(len(parts[0])))], names=["doc_id", *(c.split()[0] for c in schema.split(", "))])

    return joined.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {schema}")
