"""Near-duplicate documents: MinHash with tensored banding, links confirmed on whole shingle sets.

1. A text's set is its distinct 5-word shingles.  Equal sets are one vertex, named
   by their least doc_id, so exact copies cost one row.
2. Two small collections of half keys, each of two minhashes, are paired to table
   keys: 11 x 12 pairs need 46 minhashes where independent bands of four need 528.
   A pair of documents at similarity 0.75 shares a key unless it misses all of one
   collection: probability 1.6e-4, and 7e-6 at 0.8.  Half keys that one document
   alone has are left out before pairing: their keys could tie nothing.
3. Each member of a table cell is tied to the cell's least member; members whose
   signatures rule that out are tied to the least among themselves.  Tied documents
   are families.  A first round with eleven of the keys labels what they tie, and the
   round with all keys makes ties between different labels alone, so a large group
   costs rows, not pairs.
4. In a family every pair is decided on its full sets.  A family of one block is one
   task with an inverted index.  In a larger one, members are first compared with a
   pivot; those linked to it are one class, and only blocks of different classes, or
   of members no pivot won, meet two by two.  No pair that could join two classes is
   skipped, and no task holds more than two blocks, bounded in members and shingles.
5. Components of the links; every document takes the component of its set.

Edge cases: a null or empty text, or one of separators only, has an empty set and is
linked with nothing; fewer than five words are one shingle; repeated rows have equal
sets; a null doc_id joins the component of its set, and if no id reaches it, its
component is null and it is kept; rows that share an id share a component; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loxodrome.llm import _textkit as tk
from loxodrome.llm._common import ship, table
from loxodrome.llm._components import components

SHINGLE = 5
LEFT, RIGHT, HALF = 11, 12, 2
N_HASHES = (LEFT + RIGHT) * HALF
#: Of the minhashes, the least share of equal ones at which a pair stays a candidate; at similarity 0.75 fewer have probability 1e-9.
LEAST_AGREEMENT = 0.3
MULTIPLIERS = np.random.default_rng(75).integers(1, 1 << 63, N_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(b: tk.Block) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of a block, text after text, and each text's first."""
    w = tk.find_words(b)
    h = tk.word_hashes(b, w, lower=True)
    n = np.diff(w.first)
    ok = tk.grams_inside(w, SHINGLE)
    g = tk.gram_hashes(h, SHINGLE)[ok]
    count = np.maximum(n - SHINGLE + 1, 0)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if not len(short):
        return g, np.concatenate(([0], np.cumsum(count)))
    at = np.concatenate(([0], np.cumsum(count)))[short]
    whole = np.array([tk.gram_hashes(h[w.first[i] : w.first[i + 1]], int(n[i]))[0] + np.uint64(n[i]) for i in short], np.uint64)
    count[short] = 1
    return np.insert(g, at, whole), np.concatenate(([0], np.cumsum(count)))


def distinct_sets(g: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    return [np.unique(g[first[i] : first[i + 1]]) for i in range(len(first) - 1)]


def signatures(g: np.ndarray, first: np.ndarray) -> np.ndarray:
    """minhashes (texts x N_HASHES) as 32-bit integers; of empty texts they are 0."""
    out = np.zeros((len(first) - 1, N_HASHES), np.int32)
    some = np.flatnonzero(np.diff(first) > 0)
    if len(some):
        for k, a in enumerate(MULTIPLIERS):
            out[some, k] = (np.minimum.reduceat(g * a, first[some]) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def set_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, h1, h2 (hashes of the set), sig."""
    ship(docs.sparkSession)

    def run(source):
        for batch in source:
            if not batch.num_rows:
                continue
            n, h1, h2, sig = [], [], [], []
            for b in tk.text_blocks(batch.column(1)):
                g, first = shingles(b)
                sets = distinct_sets(g, first)
                n += [len(s) for s in sets]
                h1.append(np.array([np.add.reduce(s) for s in sets], np.uint64))
                h2.append(np.array([np.bitwise_xor.reduce(tk.mix(s)) for s in sets], np.uint64))
                sig.append(signatures(g, first))
            flat = pa.array(np.concatenate(sig).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * N_HASHES), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(n, np.int64)), pa.array(np.concatenate(h1).view(np.int64)), pa.array(np.concatenate(h2).view(np.int64)), lists], names=["doc_id", "n_shingles", "h1", "h2", "sig"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_shingles long, h1 long, h2 long, sig array<int>")


def shared_halves(vertices: DataFrame) -> DataFrame:
    """v, one, other: the half keys of either collection, as (i, h), that another vertex has as well; without any, no row.

    A table key repeats only where both its halves do, so pairing these alone loses no cell of two.
    """
    halves = F.transform(F.sequence(F.lit(0), F.lit(LEFT + RIGHT - 1)), lambda i: F.xxhash64(i, F.slice("sig", i * HALF + 1, HALF)))
    rows = vertices.select("v", F.posexplode(halves).alias("i", "h"))
    # written, so that hot halves can be split in the join: its side of rows is then a plain shuffle
    often = table(rows.groupBy("h").count().where("count >= 2").select("h"))
    both = rows.join(often, "h", "left_semi").groupBy("v").agg(F.collect_list(F.struct("i", "h")).alias("of"))
    return both.select("v", F.filter("of", lambda x: x["i"] < LEFT).alias("one"), F.filter("of", lambda x: x["i"] >= LEFT).alias("other"))


def table_keys(diagonal: bool = False) -> Column:
    """The keys of ``one`` and ``other``: every half key of one collection with every one of the other; or those of equal position alone."""
    mates = lambda x: F.filter("other", lambda y: y["i"] == x["i"] + LEFT) if diagonal else F.col("other")
    return F.flatten(F.transform("one", lambda x: F.transform(mates(x), lambda y: F.xxhash64(x["h"], y["h"]))))


def candidate_ties(vertices: DataFrame, halves: DataFrame, diagonal: bool = False, turns: int = 2) -> DataFrame:
    """(a, b): members of a table cell, each with the least of the cell, where their labels differ. vertices: v, sig; halves: v, label, one, other.

    Members whose signature rules the least one out make a cell of their own in the
    next turn; in the last one nothing is ruled out, so no pair of a cell is lost.
    """
    keys = halves.select("v", "label", F.explode(table_keys(diagonal)).alias("key"))
    found = None
    for turn in range(turns):
        # written, so that hot cells can be split in the join: its side of keys is then a plain shuffle
        # plain columns, no struct: the aggregate then hashes; with a struct it sorts, and spills
        least = [F.min("v").alias("a"), F.min_by("label", "v").alias("of"), F.min("label").alias("low"), F.max("label").alias("top")]
        cells = table(keys.groupBy("key").agg(*least).where("low < top").select("key", "a", "of"))
        members = table(keys.join(cells, "key").where("label <> of").select("key", "a", F.col("v").alias("b"), "label"))
        ties = members.select("a", "b").distinct()
        if turn + 1 < turns:
            sig_a, sig_b = vertices.select(F.col("v").alias("a"), F.col("sig").alias("sig_a")), vertices.select(F.col("v").alias("b"), F.col("sig").alias("sig_b"))
            equal = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda same: same))
            judged = table(ties.join(sig_b, "b").join(sig_a, "a").select("a", "b", (equal >= LEAST_AGREEMENT * N_HASHES).alias("alike")))
            ties, apart = judged.where("alike").select("a", "b"), judged.where("not alike").select("a", "b")
            keys = members.join(apart, ["a", "b"], "left_semi").select(F.col("b").alias("v"), "label", "key")
        found = ties if found is None else found.unionByName(ties)
    return found


def linked(sizes_sum: np.ndarray, common: np.ndarray) -> np.ndarray:
    """100 * intersection >= 75 * union, in whole numbers."""
    return 7 * common >= 3 * sizes_sum


def forest(sets: list[np.ndarray], known: np.ndarray, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect all linked sets, without those inside a class of ``known``; with ``side``, only pairs of different sides are looked at."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(n), size)
    values = np.unique(np.concatenate(sets), return_inverse=True)[1] if n else np.zeros(0, np.int64)
    by_value = np.argsort(values, kind="stable")
    posting = owner[by_value]
    begin = np.searchsorted(values[by_value], np.arange(values.max() + 2 if len(values) else 1))
    at = np.concatenate(([0], np.cumsum(size)))
    group = np.unique(known, return_inverse=True)[1] if n else np.zeros(0, np.int64)
    out = []
    for x in range(n):
        if side is not None and side[x]:
            continue
        v = values[at[x] : at[x + 1]]
        count = begin[v + 1] - begin[v]
        idx = np.repeat(begin[v] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        hit = linked(size + size[x], np.bincount(posting[idx], minlength=n)) & (group != group[x])
        if side is not None:
            hit &= side.astype(bool)
        for y in np.flatnonzero(hit):
            if group[y] != group[x]:
                group[group == group[y]] = group[x]
                out.append((x, int(y)))
    return out


def set_bodies(docs: DataFrame, members: DataFrame) -> DataFrame:
    """members (v and more columns) with ``body``, the set of each text under that id as bytes."""
    ship(docs.sparkSession)
    joined = docs.select("doc_id", "text").join(members, F.col("doc_id") == F.col("v")).select("text", *members.columns)
    names = [*members.columns, "body"]

    def run(source):
        for batch in source:
            if not batch.num_rows:
                continue
            bodies = []
            for b in tk.text_blocks(batch.column(0)):
                bodies += [s.tobytes() for s in distinct_sets(*shingles(b))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(bodies, pa.binary())], names=names)

    return joined.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in members.dtypes) + ", body binary")


def links_in_blocks(rows: DataFrame, id_type: str) -> DataFrame:
    """(a, b): for each task of one or two blocks a forest of the links that join classes. rows: pool, task, v, class, body, side (null: all pairs count)."""

    def link(t: pa.Table) -> pa.Table:
        v, bodies = t.column("v").to_pylist(), [np.frombuffer(x, np.uint64) for x in t.column("body").to_pylist()]
        task = np.unique(t.column("task").to_numpy(), return_inverse=True)[1]
        known = np.unique(np.array([str(x) for x in t.column("class").to_pylist()]), return_inverse=True)[1]
        side = np.array([-1 if x is None else x for x in t.column("side").to_pylist()])
        order = np.argsort(task, kind="stable")
        a, b = [], []
        for at in np.split(order, np.flatnonzero(np.diff(task[order])) + 1):
            for p, q in forest([bodies[i] for i in at], known[at], None if side[at[0]] < 0 else side[at]):
                a.append(v[at[p]])
                b.append(v[at[q]])
        return pa.table({"a": pa.array(a, t.schema.field("v").type), "b": pa.array(b, t.schema.field("v").type)})

    return rows.select("pool", "task", "v", "class", "body", "side").groupBy("pool").applyInArrow(link, f"a {id_type}, b {id_type}")


def links_to_pivots(members: DataFrame, id_type: str) -> DataFrame:
    """v, family, pivot, linked: every member against its family's pivot, the least one. members: v, family, body."""
    pivots = table(members.groupBy("family").agg(F.min("v").alias("v")))
    sets = table(members.join(pivots, ["family", "v"]).select("family", F.col("v").alias("pivot"), F.col("body").alias("of")).dropDuplicates(["family"]))

    def run(source):
        for batch in source:
            if not batch.num_rows:
                continue
            own, other = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            hit = []
            for x, y in zip(own, other, strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                hit.append(bool(linked(len(x) + len(y), len(np.intersect1d(x, y, assume_unique=True)))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(hit, pa.bool_())], names=["v", "family", "pivot", "linked"])

    return members.join(sets, "family").select("v", "family", "pivot", "body", "of").mapInArrow(run, f"v {id_type}, family {id_type}, pivot {id_type}, linked boolean")


def exact_links(docs: DataFrame, families: DataFrame, block: int = 256, block_shingles: int = 1 << 20) -> DataFrame:
    """(a, b): links that connect, in each family, all that is linked. families: v, family, n (size of the set).

    A family that fits a block is one task's, every pair of it.  In a larger one every
    member meets a pivot, and those linked to it are its class; with the rest this is
    repeated as long as a pivot wins a quarter of them.  Then blocks of different
    classes, and blocks of the rest with every block, meet two by two.  Copies of one
    text thus cost rows; only members that are alike but not linked cost pairs of blocks.
    """
    id_type = dict(docs.dtypes)["doc_id"]
    blocks_of = lambda members, weight: F.ceil(F.greatest(members / block, weight / block_shingles)).cast("int")
    sizes = families.groupBy("family").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("weight"))
    f = table(families.join(sizes, "family").withColumn("blocks", blocks_of(F.col("members"), F.col("weight"))))
    small = f.where("blocks <= 1")
    total = small.agg(F.count(F.lit(1)), F.sum("n")).first()
    n_pools = max(1, total[0] // 1000, (total[1] or 0) // (2 * block_shingles))
    rows = set_bodies(docs, small.select("v", "family")).select(F.pmod(F.xxhash64("family"), F.lit(n_pools)).alias("pool"), F.xxhash64("family").alias("task"), "v", F.col("v").alias("class"), "body", F.lit(None).cast("int").alias("side"))
    links = table(links_in_blocks(rows, id_type))
    large = f.where("blocks > 1").select("v", "family", "n")
    if large.isEmpty():
        return links
    members = table(set_bodies(docs, large))
    rest, classes, done = members.select("v", "family", "body"), None, None
    while not rest.isEmpty():
        met = table(links_to_pivots(rest, id_type))
        won = met.where("linked").select("v", "family", F.col("pivot").alias("class")).distinct()
        classes = won if classes is None else classes.unionByName(won)
        share = met.groupBy("family").agg(F.avg(F.col("linked").cast("int")).alias("share"))
        left = table(rest.join(won.select("v", "family"), ["v", "family"], "left_anti").join(share, "family"))
        over = left.where("share < 0.25").select("v", "family")
        done = over if done is None else done.unionByName(over)
        rest = left.where("share >= 0.25").select("v", "family", "body")
    classes = table(classes)
    # the rest, under class null, stand apart from each other as well
    named = table(classes.unionByName(done.distinct().withColumn("class", F.lit(None).cast(id_type))))
    groups = table(large.join(named, ["v", "family"]).groupBy("family", "class").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("weight")).select("family", "class", blocks_of(F.col("members"), F.col("weight")).alias("of")))
    one, other = groups.select("family", F.col("class").alias("c1"), F.col("of").alias("of1")), groups.select("family", F.col("class").alias("c2"), F.col("of").alias("of2"))
    both_rest, meet = F.col("c1").isNull() & F.col("c2").isNull(), F.col("c1").isNull() | (F.col("c1") < F.col("c2"))
    tasks = one.join(other, "family").where(meet).withColumn("k1", F.explode(F.sequence(F.lit(0), F.col("of1") - 1))).withColumn("k2", F.explode(F.sequence(F.when(both_rest, F.col("k1")).otherwise(0), F.col("of2") - 1)))
    block = lambda c, k: F.xxhash64("family", F.col(c).isNull(), c, k)
    tasks = tasks.select(block("c1", "k1").alias("b1"), block("c2", "k2").alias("b2")).withColumn("task", F.xxhash64("b1", "b2"))
    ends = F.when(F.col("b1") == F.col("b2"), F.array(F.struct(F.col("b1").alias("block"), F.lit(None).cast("int").alias("side")))).otherwise(F.array(F.struct(F.col("b1").alias("block"), F.lit(0).alias("side")), F.struct(F.col("b2").alias("block"), F.lit(1).alias("side"))))
    ends = table(tasks.select("task", F.explode(ends).alias("end")).select("task", "end.block", "end.side"))
    in_class = members.join(named, ["v", "family"]).join(groups.select("family", F.col("class").alias("of_class"), "of").withColumnRenamed("family", "of_family"), (F.col("family") == F.col("of_family")) & F.col("class").eqNullSafe(F.col("of_class")))
    dealt = table(in_class.withColumn("k", F.pmod(F.xxhash64("v"), F.col("of")).cast("int")).select("v", F.coalesce("class", "v").alias("class"), "body", block("class", "k").alias("block")))
    across = links_in_blocks(dealt.join(ends, "block").select(F.col("task").alias("pool"), "task", "v", "class", "body", "side"), id_type)
    return links.unionByName(classes.select(F.col("class").alias("a"), F.col("v").alias("b"))).unionByName(table(across))


def near_duplicates(docs: DataFrame, block: int = 256) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    sets = table(set_table(docs))
    vertices = table(sets.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("v"), F.first("sig").alias("sig"), F.max("n_shingles").alias("n")).where("v is not null"))
    halves = table(shared_halves(vertices))
    # a few of the keys bring most of a group together, so that the rest only has to join what is still apart
    first = table(candidate_ties(vertices, halves.withColumn("label", F.col("v")), diagonal=True))
    known = halves.join(components(first).withColumnRenamed("label", "known"), "v", "left").withColumn("label", F.coalesce("known", "v"))
    ties = table(candidate_ties(vertices, known).unionByName(first))
    families = components(ties).select("v", F.col("label").alias("family")).join(vertices.groupBy("v").agg(F.max("n").alias("n")), "v")
    links = table(exact_links(docs, families, block))
    label = components(links)
    named = vertices.join(label, "v", "left").select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.coalesce("label", "v").alias("component"))
    out = sets.join(named, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")) & (F.col("n_shingles") > 0), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op6_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
