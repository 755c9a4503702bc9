"""Mixing sources to target weights by pivotal dependent rounding. DataFrame operations only.

A source's target is its weight's share of all words, at most ``max_repeat`` times
its own words; what a full source leaves is shared again by weight.  A document's
expected copies are target / source size: the whole part is certain, the rest is a
probability.  Pairs of fractional documents then pass words between them: a random
direction, by as much as makes one of the two whole, so the expected words of each
document and the total of the source stay as they are.  Groups of at most about
``fan_in`` documents are folded that way; each leaves one fractional document, and
those meet in the next level of a tree.  The last one of a source is drawn alone,
so a source is off its target by less than its largest document.

Hot sources are many groups, so no task sees more than a group.  All draws are
hashes of the ids: reruns agree.

Edge cases: a null or empty text has size 0 and takes 0 words; the null source is
a source, last in order; repeated rows are separate documents; an empty table
gives an empty result; other columns stay out of the result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loxodrome.llm._common import WORD, cut, unit

WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = 3) -> DataFrame:
    """source, n, source_size, target. One row for each source; water filling in closed form.

    In the order of max_repeat * size / weight, sources fill up first to last. At
    the k-th, those before it being full, the level is what is left over their
    weights; the first source that this level does not fill sets the level for all.
    """
    by = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = rows.withColumn("weight", weight.cast("double")).withColumn("cap", max_repeat * F.col("source_size").cast("double"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    of = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / of)
    level = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct((F.col("cap") / F.col("weight")).alias("r"), "level"))).over(everything)["level"]
    return rows.withColumn("at", level).select("source", "n", "source_size", F.least("cap", F.col("at") * F.col("weight")).alias("target"))


def _fold(items: Column) -> Column:
    """Folds documents (u, doc, s, p) to the decided ones and the one that is still fractional."""

    def step(state: Column, j: Column) -> Column:
        r = state["rest"]
        up_r, up_j = r["s"] * (1 - r["p"]), j["s"] * (1 - j["p"])
        down_r, down_j = r["s"] * r["p"], j["s"] * j["p"]
        to_r, to_j = F.least(up_r, down_j), F.least(down_r, up_j)
        raise_r = j["u"] * (to_r + to_j) < to_j
        r_whole = F.when(raise_r, up_r <= down_j).otherwise(down_r <= up_j)
        decided = F.when(r_whole, F.struct(r["doc"].alias("doc"), raise_r.cast("int").alias("extra"))).otherwise(F.struct(j["doc"].alias("doc"), (~raise_r).cast("int").alias("extra")))
        p_j = F.when(raise_r, j["p"] - up_r / j["s"]).otherwise(j["p"] + down_r / j["s"])
        p_r = F.when(raise_r, r["p"] + down_j / r["s"]).otherwise(r["p"] - up_j / r["s"])
        rest = F.when(r_whole, F.struct(j["u"].alias("u"), j["doc"].alias("doc"), j["s"].alias("s"), p_j.alias("p"))).otherwise(F.struct(r["u"].alias("u"), r["doc"].alias("doc"), r["s"].alias("s"), p_r.alias("p")))
        return F.struct(rest.alias("rest"), F.concat(state["done"], F.array(decided)).alias("done"))

    first = F.element_at(items, 1)
    nothing = F.slice(F.transform(items, lambda x: F.struct(x["doc"].alias("doc"), F.lit(0).alias("extra"))), 1, 0)
    return F.aggregate(F.slice(items, 2, F.size(items)), F.struct(first.alias("rest"), nothing.alias("done")), step)


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = 3, seed: int = 17, fan_in: int = 256, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every document, and the columns named in ``carry`` (small ones: they travel through the tree)."""
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *carry))
    targets = cut(source_targets(sized, weights, max_repeat))
    most = targets.agg(F.max("n")).first()[0] or 0
    t = targets.withColumnRenamed("source", "of_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = sized.join(t, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source").withColumn("rate", rate)
    rows = rows.withColumn("whole", F.floor("rate").cast("int")).withColumn("p", F.col("rate") - F.col("whole"))
    uneven = (F.col("p") > 0) & (F.col("size") > 0)
    outcome = [rows.where(~uneven).select("doc_id", "source", "size", "source_size", "target", *carry, F.col("whole").alias("copies"))]
    doc = F.struct("doc_id", "size", "source_size", "target", "whole", *carry)
    buckets = F.ceil(F.col("n") / fan_in)
    level = rows.where(uneven).select(
        "source",
        F.floor(unit(F.col("doc_id"), F.col("size"), F.lit(seed)) * buckets).alias("bucket"),
        F.struct(unit(F.col("doc_id"), F.col("size"), F.lit(seed + 1)).alias("u"), doc.alias("doc"), F.col("size").cast("double").alias("s"), "p").alias("item"),
    )
    for depth in range(1, 1 + max(1, math.ceil(math.log(max(most, 2)) / math.log(fan_in)) + 1)):
        folded = level.groupBy("source", "bucket").agg(F.sort_array(F.collect_list("item")).alias("items"))
        folded = cut(folded.select("source", "bucket", _fold(F.col("items")).alias("out")))
        outcome.append(folded.select("source", F.explode("out.done").alias("d")).select("d.doc.doc_id", "source", "d.doc.size", "d.doc.source_size", "d.doc.target", *(f"d.doc.{c}" for c in carry), (F.col("d.doc.whole") + F.col("d.extra")).alias("copies")))
        rest = F.col("out.rest")
        again = unit(rest["doc"]["doc_id"], rest["doc"]["size"], F.lit(seed + 1 + depth))
        level = folded.select("source", F.floor(F.col("bucket") / fan_in).alias("bucket"), F.struct(again.alias("u"), rest["doc"].alias("doc"), rest["s"].alias("s"), rest["p"].alias("p")).alias("item"))
    last = F.col("item")
    outcome.append(level.select(last["doc"]["doc_id"].alias("doc_id"), "source", last["doc"]["size"].alias("size"), last["doc"]["source_size"].alias("source_size"), last["doc"]["target"].alias("target"), *(last["doc"][c].alias(c) for c in carry), (last["doc"]["whole"] + (last["u"] < last["p"]).cast("int")).alias("copies")))
    out = outcome[0]
    for part in outcome[1:]:
        out = out.unionByName(part)
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def op3_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
