"""Benchmark decontamination by winnowing. DataFrame operations only.

Of the hashes of all k-grams of words, each window of ``window - k + 1`` adjacent
ones keeps its minimum, on both sides.  Two texts that share ``window`` words share
that whole window of hashes, hence its minimum, at the same distance: joining kept
hashes finds every shared span.  A kept gram that the benchmark has as well is cut
out with the words around it, in which every window with that minimum lies; joined
with the items' cuts, whole windows are compared word by word.  Items of fewer words
are one window: their whole hash is sought among the documents' grams of that length.
A text is cut into words once to be marked, and once more only if it holds a mark.

Benchmark fingerprints grow with the benchmark alone; Spark broadcasts them only
under its size limit and joins by shuffle beyond, where skewed keys are split.

Edge cases: a null or empty text has no words; an item without words is ignored;
an item repeated under one id counts once; repeated documents each get their row;
rows are matched by id and text, so an id that comes with two texts is two
documents; empty tables give no hits; other columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loxodrome.llm._common import table

#: What separates words, on lower-cased text and on raw text.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Letters beyond ASCII that lower() would change though the contract leaves them.
OTHER_CAPITALS = "[\\p{javaUpperCase}\\p{javaTitleCase}&&[^\\x00-\\x7F]]"
POSITION_BITS = 28


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone; lower() does it faster wherever it changes nothing else."""
    return F.when(text.rlike(OTHER_CAPITALS), F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.lower(text))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS, -1), "")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _from(array: Column, gap: int) -> Column:
    return F.slice(array, gap + 1, F.greatest(F.size(array) - gap, F.lit(0)))


def _grams(hashes: Column, k: int, use: Callable[[Column], Column]) -> Column:
    """use(hashes of k adjacent words, by doubling); those at the end, without k words, mean nothing."""
    if k == 1:
        return use(hashes)
    pair = lambda one, other, gap: F.zip_with(one, _from(other, gap), lambda x, y: F.xxhash64(x, y))
    if k % 2:
        return _grams(hashes, k - 1, lambda g: _bound(pair(g, hashes, k - 1), use))
    return _grams(hashes, k // 2, lambda g: _bound(pair(g, g, k // 2), use))


def _marked(hashes: Column, k: int) -> Column:
    """For each k-gram: 36 bits of its hash, then its position. Needs k words at least."""
    mark = lambda g: F.transform(F.slice(g, 1, F.size(hashes) - (k - 1)), lambda x, i: F.shiftleft(x, POSITION_BITS).bitwiseOR(i.cast("long")))
    return _grams(hashes, k, lambda g: mark(g) if k > 1 else mark(F.transform(g, lambda x: F.xxhash64(x, F.lit(1)))))


def _least(marks: Column, width: int, use: Callable[[Column], Column]) -> Column:
    """use(least of every ``width`` adjacent marks), by doubling."""

    def grow(m: Column, size: int) -> Column:
        step = min(size, width - size)
        if not step:
            return use(F.slice(m, 1, F.size(marks) - (width - 1)))
        return _bound(F.zip_with(m, _from(m, step), lambda x, y: F.least(x, y)), lambda wider: grow(wider, size + step))

    return grow(marks, 1)


def winnow(hashes: Column, k: int, window: int) -> Column:
    """The kept k-grams; needs ``window`` words at least."""
    return _bound(_marked(hashes, k), lambda m: _least(m, window - k + 1, F.array_distinct))


def _kept(words: Column, k: int, window: int, lengths: list[int]) -> Column:
    """Marks of a text: its winnowed k-grams and, for each of ``lengths``, every gram of that length."""
    none = F.array().cast("array<long>")

    def of(hashes: Column) -> Column:
        parts = [F.when(F.size(hashes) >= window, winnow(hashes, k, window)).otherwise(none)]
        return F.concat(*parts, *(F.when(F.size(hashes) >= n, _marked(hashes, n)).otherwise(none) for n in lengths))

    return _bound(F.transform(words, lambda w: F.xxhash64(w)), of)


def _around(words: Column, at: Column, k: int, window: int) -> tuple[Column, Column]:
    """The words in which every window around the gram at ``at`` lies, and how many of them stand before the gram."""
    before = F.least(at, F.lit(window - k))
    return F.slice(words, at - before + 1, F.lit(window + window - k)), before


def _split_mark(df: DataFrame, pos: str) -> DataFrame:
    return df.withColumn("fp", F.shiftright("mark", POSITION_BITS)).withColumn(pos, F.col("mark").bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).cast("int")).drop("mark")


def marked_documents(docs: DataFrame, items: DataFrame, k: int, window: int) -> DataFrame:
    """doc_id, text_key, n_words and marks of every document: its text is cut into words here."""
    sizes = items.select(F.size("iw").alias("n")).where((F.col("n") < window) & (F.col("n") > 0)).distinct()
    lengths = sorted(r.n for r in sizes.collect())  # window - 1 numbers at most
    worded = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words_of(F.col("text")).alias("w"))
    both = worded.select("doc_id", "text_key", _bound(F.col("w"), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _kept(w, k, window, lengths).alias("marks"))).alias("of"))
    return table(both.select("doc_id", "text_key", "of.n_words", "of.marks"))


def item_words(items: DataFrame) -> DataFrame:
    return table(items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("iw")).where(F.size("iw") > 0).distinct())


def contamination_hits(docs: DataFrame, marked: DataFrame, it: DataFrame, k: int = 6, window: int = 13) -> DataFrame:
    """doc_id, text_key, item_id, start, length: every occurrence of an item's window in a document."""
    length = F.least(F.size("iw"), F.lit(window))
    marks = F.when(F.size("iw") >= window, _kept(F.col("iw"), k, window, []))
    for n in range(1, window):
        marks = marks.when(F.size("iw") == n, _kept(F.col("iw"), k, window, [n]))
    wanted = _split_mark(it.select("item_id", "iw", length.alias("length"), F.explode(marks).alias("mark")), "item_at")
    beside, before = _around(F.col("iw"), F.col("item_at"), k, window)
    wanted = table(wanted.select("fp", "item_id", "length", beside.alias("item_words"), F.when(F.col("length") < window, 0).otherwise(before).alias("item_before")).distinct())
    # the places of a document that hold a benchmark mark, then the words around them, then the items
    places = _split_mark(marked.select("doc_id", "text_key", F.explode("marks").alias("mark")), "at").join(wanted.select("fp").distinct(), "fp", "left_semi")
    places = places.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("at", "fp")).alias("places")).withColumnsRenamed({"doc_id": "id2", "text_key": "key2"})
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    found = texts.join(places, (F.col("text_key") == F.col("key2")) & F.col("doc_id").eqNullSafe(F.col("id2"))).dropDuplicates(["doc_id", "text_key"])
    beside, before = _around(F.col("w"), F.col("place.at"), k, window)
    found = found.select("doc_id", "text_key", words_of(F.col("text")).alias("w"), "places").select("doc_id", "text_key", "w", F.explode("places").alias("place"))
    found = found.select("doc_id", "text_key", "place.at", "place.fp", beside.alias("words"), before.alias("before"))
    # whole windows are compared, word by word, wherever they can lie around the gram
    same = lambda s: F.slice("words", F.col("before") + s + 1, F.col("length")) == F.slice("item_words", F.col("item_before") + s + 1, F.col("length"))
    whole = lambda s: (F.col("before") + s + F.col("length") <= F.size("words")) & (F.col("item_before") + s + F.col("length") <= F.size("item_words"))
    shifts = F.filter(F.sequence(-F.least("before", "item_before"), F.lit(0)), lambda s: whole(s) & same(s))
    return found.join(wanted, "fp").select("doc_id", "text_key", "item_id", "at", F.explode(shifts).alias("s"), "length").select("doc_id", "text_key", "item_id", (F.col("at") + F.col("s")).alias("start"), "length").distinct()


def contamination(docs: DataFrame, items: DataFrame, k: int = 6, window: int = 13) -> DataFrame:
    """doc_id, text_key, n_words, n_hit, items (sorted ids) and contaminated of every document."""
    it = item_words(items)
    marked = marked_documents(docs, it, k, window)
    hits = contamination_hits(docs, marked, it, k, window)
    spans = hits.groupBy("doc_id", "text_key", "start").agg(F.max(F.col("start") + F.col("length")).alias("end"), F.collect_set("item_id").alias("ids"))
    before = Window.partitionBy("doc_id", "text_key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.lit(0))))
    per = spans.withColumn("new", new).groupBy("doc_id", "text_key").agg(F.sum("new").cast("long").alias("n_hit"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("items"))
    per = per.withColumnsRenamed({"doc_id": "id2", "text_key": "key2"})
    out = marked.select("doc_id", "text_key", "n_words").join(per, (F.col("text_key") == F.col("key2")) & F.col("doc_id").eqNullSafe(F.col("id2")), "left")
    n_hit0 = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "text_key", "n_words", n_hit0.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n_hit0 > 0) & (20 * n_hit0 >= F.col("n_words"))).alias("contaminated"))


def op5_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    out = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s:s + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS s FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM win),
pos AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n
), hit AS (
  SELECT p.doc_id, p.s, p.n, win.item_id FROM (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM pos) p JOIN win ON win.n = p.n AND win.g = p.g
), cov AS (
  SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS x FROM hit) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS ids FROM hit GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN cov c USING (doc_id) LEFT JOIN its i USING (doc_id)
"""
