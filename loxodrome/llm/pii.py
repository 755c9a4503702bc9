"""Personal data: fixed patterns, and information-theoretic sanitisation of terms that give them away. DataFrame operations only.

Base spans (email, ip, card, phone) follow fixed patterns.  The entities to protect
are the distinct values of those spans.  A term discloses an entity when knowing the
term tells most of what there is to know about it: with n(e) documents holding the
entity, n(t) holding the term and n(e,t) holding the term within ``reach`` words of
the entity,

    disclosure = pmi(e;t) / information(e) = log(N n(e,t) / (n(e) n(t))) / log(N / n(e)),

which is 1 when every document with the term has the entity beside it.  Terms over
the threshold, seen beside the entity in at least ``support`` different texts and as many different
surroundings, become spans (kind ``term``) wherever they stand in a document that
holds the entity.  Counts are over the distinct texts of the whole corpus, so copies
are one witness; near copies share their surroundings and are not many either.  Both
least numbers are fixed, so a term found beside a rare entity is found beside a
frequent one.

Spans are positions in code points, end exclusive.  sanitise() replaces base spans by
their kind and terms by ``[term]`` (generalised) or nothing (removed).

Patterns are written so that matching is linear: a run that can begin a match is
entered at its start only, and quantifiers do not give back.

Edge cases: a null or empty text has no spans; very long texts are matched whole;
repeated rows each get their spans; null ids keep their rows; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loxodrome.llm._common import table

_LOCAL = "[A-Za-z0-9._%+-]"
#: kind, pattern. Equal to the greedy leftmost match of the plain patterns in the contract.
PATTERNS = {
    "email": f"(?:\\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?:\\G|(?<![0-9]))[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "[0-9](?:[\\x20-]?[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)
#: Cheap tests a text must pass before a pattern is tried.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
TERM = "[\\p{L}\\p{M}][\\p{L}\\p{M}\\p{N}'_-]{2,}"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Digit sum check, from the right."""
    at = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, doubled(d)).otherwise(d)

    return F.aggregate(at, F.lit(0), add) % 10 == 0


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(s, "\\."), lambda p: F.length(F.ltrim(p, F.lit("0"))).between(0, 3) & (F.coalesce(F.substr(F.concat(F.lit("0"), F.ltrim(p, F.lit("0"))), F.lit(1), F.lit(4)).try_cast("int"), F.lit(999)) <= 255))
    if kind == "card":
        return F.length(_digits(s)).between(14, 19) & _luhn(_digits(s))
    if kind == "phone":
        return F.length(_digits(s)).between(10, 15)
    return F.lit(True)


def _matches(kind: str, text: Column) -> Column:
    """Valid matches of one kind: array of (start, end, kind number, value). Positions: lengths of the pieces between matches add up."""
    found, gaps = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), F.split(text, PATTERNS[kind], -1)
    Span = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("value"))

    def walk(state: Column, p: Column) -> Column:
        start = state["at"] + F.length(p["gap"])
        end = start + F.length(p["value"])
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(start.alias("start"), end.alias("end"), p["value"].alias("value")))).alias("out"))

    pieces = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    spans = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), F.slice(F.array(Span), 1, 0).alias("out")), walk)["out"]
    kept = F.filter(spans, lambda s: _valid(kind, s["value"]))
    return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(KINDS.index(kind)).alias("k"), s["value"].alias("value")))


SPAN_TYPE = "array<struct<start:int,end:int,k:int,value:string>>"


def base_spans(text: Column) -> Column:
    """All base spans of a text, by start, then kind."""
    text = F.coalesce(text, F.lit(""))
    none = F.array().cast(SPAN_TYPE)
    parts = []
    for kind in KINDS:
        maybe = text.contains(HINTS[kind]) if HINTS[kind] else F.lit(True)
        found = maybe & text.rlike("[0-9](?:[\\x20-]?[0-9]){13}" if kind == "card" else PATTERNS[kind])
        parts.append(F.when(found, _matches(kind, text)).otherwise(none).cast(SPAN_TYPE))
    return F.array_sort(F.concat(*parts))


def joined(spans: Column, names: list[str]) -> Column:
    kind = F.array(*map(F.lit, names))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kind, s["k"] + 1), s["start"], s["end"])), ",")


def terms_of(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda w: F.lower(w))


def _bound(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _contexts(text: Column, spans: Column, reach: int) -> Column:
    """(value, term, witness): the terms within ``reach`` words of each span, other entities blanked; witness: the least hash of the longer words beside the term, which near copies of a passage share."""
    blank = lambda s: F.regexp_replace(F.regexp_replace(s, PATTERNS["email"], " "), "[0-9@]\\S*", " ")
    # the words between spans, a list for each span (what lies before it) and one for the rest
    ends = F.aggregate(spans, F.array(F.lit(0)), lambda to, s: F.concat(to, F.array(F.greatest(F.element_at(to, -1), s["end"]))))
    starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text)))
    pieces = F.zip_with(starts, ends, lambda start, end: terms_of(blank(F.substr(text, end + 1, F.greatest(start - end, F.lit(0))))))

    def counted(pieces: Column) -> Column:
        before = F.aggregate(pieces, F.array(F.lit(0)), lambda n, p: F.concat(n, F.array(F.element_at(n, -1) + F.size(p))))
        return F.struct(F.flatten(pieces).alias("words"), F.slice(before, 2, F.size(before) - 2).alias("before"))

    def around(words: Column, value: Column, n: Column) -> Column:
        near = F.concat(F.slice(words, F.greatest(n - reach + 1, F.lit(1)), F.least(n, F.lit(reach))), F.slice(words, n + 1, F.lit(reach)))
        return _bound(near, lambda near: witnessed(near, value))

    def witnessed(near: Column, value: Column) -> Column:
        long_words = F.filter(near, lambda w: F.length(w) >= 5)
        witness = lambda t: F.coalesce(F.array_min(F.transform(F.filter(long_words, lambda w: w != t), lambda w: F.xxhash64(w))), F.lit(0).cast("long"))
        return F.transform(F.array_distinct(near), lambda t: F.struct(value.alias("value"), t.alias("term"), witness(t).alias("witness")))

    found = _bound(_bound(pieces, counted), lambda c: F.flatten(F.zip_with(spans, c["before"], lambda s, n: around(c["words"], s["value"], n))))
    return F.array_distinct(found)


def disclosing_terms(spanned: DataFrame, threshold: float = 0.85, support: int = 3, reach: int = 8) -> DataFrame:
    """value, term, disclosure. spanned: text, spans (base spans)."""
    texts = spanned.where(F.col("text").isNotNull())
    with_spans = table(texts.where(F.size("spans") > 0).dropDuplicates(["text"]).select(F.xxhash64("text").alias("id"), "text", "spans"))
    n_docs = F.lit(float(texts.agg(F.count_distinct(F.xxhash64("text"))).first()[0] or 1))
    entities = with_spans.select("id", F.explode(F.array_distinct(F.transform("spans", lambda s: s["value"]))).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n_e")).where(F.col("n_e") >= support)
    pairs = with_spans.select("id", F.explode(_contexts(F.col("text"), F.col("spans"), reach)).alias("p")).select("id", "p.value", "p.term", "p.witness")
    pairs = pairs.groupBy("value", "term").agg(F.count_distinct("id").alias("n_et"), F.count_distinct("witness").alias("n_w")).where((F.col("n_et") >= support) & (F.col("n_w") >= support))
    pairs = table(pairs.join(entities, "value"))
    wanted = pairs.select("term").distinct()
    # documents that hold a wanted term anywhere, over the whole corpus
    everywhere = texts.select(F.xxhash64("text").alias("id"), F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term")).join(wanted, "term", "left_semi").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    information = F.log(n_docs / F.col("n_e"))
    pmi = F.log(n_docs * F.col("n_et") / (F.col("n_e") * F.col("n_t")))
    disclosure = F.when(information > 0, pmi / F.when(information > 0, information)).otherwise(0.0)
    return table(pairs.join(everywhere, "term").withColumn("disclosure", disclosure).where(F.col("disclosure") >= threshold).select("value", "term", "disclosure"))


def term_spans(spanned: DataFrame, terms: DataFrame) -> DataFrame:
    """id (hash of the text), terms: spans of disclosing terms in texts that hold their entity."""
    hits = spanned.where(F.size("spans") > 0).select(F.xxhash64("text").alias("id"), "text", F.explode(F.array_distinct(F.transform("spans", lambda s: s["value"]))).alias("value")).join(terms, "value")
    hits = hits.select("id", "text", "term").distinct()
    # words and what lies between them, so that positions add up
    words, gaps = F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), F.split("text", TERM, -1)
    hits = hits.groupBy("id", "text").agg(F.collect_set("term").alias("wanted")).withColumn("words", words).withColumn("gaps", gaps)

    def walk(state: Column, p: Column) -> Column:
        start = state["at"] + F.length(p["gap"])
        end = start + F.length(p["word"])
        one = F.struct(start.alias("start"), end.alias("end"), F.lit(len(KINDS)).alias("k"), p["word"].alias("value"))
        return F.struct(end.alias("at"), F.when(F.array_contains(F.col("wanted"), F.lower(p["word"])), F.concat(state["out"], F.array(one))).otherwise(state["out"]).alias("out"))

    pieces = F.zip_with(F.slice("gaps", 1, F.size("words")), F.col("words"), lambda g, w: F.struct(g.alias("gap"), w.alias("word")))
    return hits.select("id", F.aggregate(pieces, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN_TYPE).alias("out")), walk)["out"].alias("terms"))


def personal_spans(docs: DataFrame, threshold: float = 0.85, support: int = 3, reach: int = 8) -> DataFrame:
    """docs with base (base spans) and spans (base and disclosing terms that overlap none), every other column kept."""
    own = [c for c in docs.columns if c not in ("base", "spans")]
    spanned = docs.select(*own, base_spans(F.col("text")).alias("spans"))
    terms = disclosing_terms(spanned.select("text", "spans"), threshold, support, reach)
    extra = term_spans(spanned.select("text", "spans"), terms).withColumnsRenamed({"id": "_of_text", "terms": "_terms"})
    out = spanned.withColumnRenamed("spans", "base").join(extra, F.xxhash64("text") == F.col("_of_text"), "left")
    free = F.filter(F.coalesce("_terms", F.array().cast(SPAN_TYPE)), lambda t: ~F.exists("base", lambda b: (t["start"] < b["end"]) & (b["start"] < t["end"])))
    return out.select(*own, "base", F.array_sort(F.concat("base", free)).alias("spans"))


def sanitise(docs: DataFrame, generalise: bool = True, **parameters) -> DataFrame:
    """docs with personal data replaced in text; every other column kept."""
    names = F.array(*map(F.lit, [*KINDS, "term"]))
    aside = {c: f"_own_{c}" for c in ("base", "spans") if c in docs.columns}
    marked = personal_spans(docs.withColumnsRenamed(aside), **parameters)

    def walk(state: Column, s: Column) -> Column:
        put = F.concat(F.lit("["), F.element_at(names, s["k"] + 1), F.lit("]"))
        if not generalise:
            put = F.when(s["k"] == len(KINDS), F.lit("")).otherwise(put)
        piece = F.when(s["start"] >= state["at"], F.concat(F.substr(F.col("text"), state["at"] + 1, s["start"] - state["at"]), put)).otherwise(F.lit(""))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["out"], F.array(piece)).alias("out"))

    folded = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), walk)
    rebuilt = F.element_at(F.transform(F.array(folded), lambda s: F.concat(F.array_join(s["out"], ""), F.substr(F.col("text"), s["at"] + 1, F.length("text")))), 1)
    return marked.withColumn("text", F.when(F.size("spans") > 0, rebuilt).otherwise(F.col("text"))).drop("base", "spans").withColumnsRenamed({v: k for k, v in aside.items()}).select(*docs.columns)


def op7_personal_data(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    count = lambda k: F.size(F.filter("base", lambda s: s["k"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return personal_spans(docs).select("doc_id", *map(count, KINDS), F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"), joined(F.col("spans"), [*KINDS, "term"]).alias("spans"))
