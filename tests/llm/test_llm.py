"""The corpus operators against plain versions, on a fixture with every odd row: nulls, empty and long texts, repeats, clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loxodrome.llm import _suffixes as sx
from loxodrome.llm import _textkit as tk
from loxodrome.llm import decontam, langid, mixing, near_dup, pii, quality_cnn, quality_rules, substring_dedup, suffix_dedup, toxicity

WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, label string, spans string, v long, terms string"


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    words = ["".join(random.Random(k).choice("abcdefghijklmnopqrstuvwé") for _ in range(2 + k % 7)) for k in range(vocabulary)]
    return " ".join(r.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    long = prose(1, 30_000)
    shared = prose(2, 120)
    near = prose(3, 90).split()
    texts = {
        1: shared, 2: prose(4, 40) + " " + shared + "\n" + prose(5, 30), 3: "", 4: None, 5: " \t\n ", 6: long, 7: "Ein Wort", 8: " ".join(near), 9: " ".join(near[:-2] + ["anders", "hier"]), 10: " ".join(near[:40] + ["neu"] + near[41:]),
        11: "nul\0byte " + prose(6, 30), 12: "x" * 3000, 13: "ab " * 400, 14: shared.upper(), 15: "\n".join(["gleich wie immer"] * 5), 16: "mail a.b@c.de ruf +49 (30) 1234567 an 10.0.0.1, 4111 1111 1111 1111",
    }
    out = [(k, t, "aa" if k % 2 else None, [None, "s1", "s2"][k % 3], 1, 5, "l", "s", 1, "t") for k, t in texts.items()]
    out += [out[0], out[0], (None, shared, "bb", "s1", None, 0, None, None, None, None), (None, None, None, None, None, None, None, None, None, None), (17, prose(7, 50), "bb", "s2", 1, 1, "", "", 1, "")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(WORD, t or "")


def got_by_row(df, *cols):
    return sorted(map(repr, ((r["doc_id"], *(r[c] for c in cols)) for r in df.collect())))


def test_blocks_and_words(rows):
    col = pa.array([r[1] for r in rows], pa.string())
    found = []
    for b in tk.text_blocks(col, 500, 4):
        w = tk.find_words(b)
        for i in range(b.rows):
            found.append([b.data[w.start[k] : w.end[k]].tobytes().decode() for k in range(w.first[i], w.first[i + 1])])
    assert found == [words(r[1]) for r in rows]


@pytest.mark.parametrize("k", [1, 2, 5, 13, 20])
def test_gram_hashes_depend_on_content_alone(k):
    h = np.random.default_rng(1).integers(0, 4, 300).astype(np.uint64)
    g = tk.gram_hashes(h, k)
    seen = {}
    for i, v in enumerate(g):
        assert seen.setdefault(tuple(h[i : i + k]), v) == v
    assert len(set(g.tolist())) == len(seen)


def test_suffix_array_and_prefixes():
    rng = random.Random(3)
    for alphabet in ("ab", "abcdefgh"):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))).encode() for _ in range(12)]
        data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        order, slot = sx.suffix_array(data, 64)
        raw = data.tobytes()
        key = lambda p: (raw[p : p + 64], p)
        assert all(raw[a : a + 64] <= raw[b : b + 64] for a, b in zip(order, order[1:], strict=False))
        end = np.cumsum([len(t) + 1 for t in texts]) - 1
        begin = end - np.array([len(t) for t in texts])
        lcp = sx.common_prefixes(data, order, slot, begin, end - begin, end, 16)
        for t in range(len(texts)):
            for p in range(begin[t], end[t]):
                if slot[p]:
                    q = order[slot[p] - 1]
                    e = end[np.searchsorted(end, q)]
                    n = 0
                    while n < 16 and p + n < end[t] and q + n < e and raw[p + n] == raw[q + n]:
                        n += 1
                    assert lcp[p] == n, (key(p), n)


def plain_removed(texts, window):
    """Bytes of windows that also start elsewhere."""
    c = collections.Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        g = [0] * len(t)
        for i in range(len(t) - window + 1):
            if c[t[i : i + window]] > 1:
                g[i : i + window] = [1] * window
        out.append(g)
    return out


@pytest.mark.parametrize(("block", "merged"), [(1000, 4), (2, 1000), (2, 1), (1, 1)])
def test_suffix_dedup(docs, rows, block, merged):
    texts = [(r[1] or "").encode() for r in rows]
    want = []
    for r, t, g in zip(rows, texts, plain_removed(texts, 60), strict=True):
        kept = bytes(b for b, x in zip(t, g, strict=True) if not x)
        want.append(repr((r[0], len(t), sum(g), sum(1 for i in range(len(g)) if g[i] and not (i and g[i - 1])), hashlib.sha256(kept).hexdigest())))
    assert got_by_row(suffix_dedup.remove_repeats(docs, 60, 24, block, merged), "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want)


@pytest.mark.parametrize(("k", "bound"), [(8, 4096), (14, 1)])
def test_substring_dedup(docs, rows, k, bound):
    first = {}
    for r in rows:
        w = words(r[1])
        for i in range(len(w) - k + 1):
            at = (-1 if r[0] is None else r[0], i)
            key = tuple(w[i : i + k])
            first[key] = min(first.get(key, at), at)
    want = []
    for r in rows:
        w = words(r[1])
        g = [0] * len(w)
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < (-1 if r[0] is None else r[0], i):
                g[i : i + k] = [1] * k
        kept = " ".join(x for x, y in zip(w, g, strict=True) if not y)
        want.append(repr((r[0], len(w), sum(g), hashlib.sha256(kept.encode()).hexdigest())))
    assert got_by_row(substring_dedup.remove_later_repeats(docs, k, 3, bound), "n_words", "n_removed", "kept_sha256") == sorted(want)


def test_decontamination(spark, docs, rows):
    items = [("i1", " ".join(words(rows[1][1])[50:70])), ("i2", "ein WORT"), ("i3", None), ("i4", "..."), ("i1", "mail a.b"), ("i5", prose(99, 40))]
    tokens = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    wins = set()
    for i, t in items:
        w = tokens(t)
        n = min(len(w), 13)
        wins |= {(i, tuple(w[a : a + n])) for a in range(len(w) - n + 1)} if n else set()
    want = []
    for r in rows:
        w = tokens(r[1])
        g, ids = [0] * len(w), set()
        for i, q in wins:
            for a in range(len(w) - len(q) + 1):
                if tuple(w[a : a + len(q)]) == q:
                    g[a : a + len(q)] = [1] * len(q)
                    ids.add(i)
        want.append(repr((r[0], len(w), sum(g), sorted(ids), sum(g) > 0 and 20 * sum(g) >= len(w))))
    b = spark.createDataFrame(items, "item_id string, text string")
    assert got_by_row(decontam.contamination(docs, b), "n_words", "n_hit", "items", "contaminated") == sorted(want)


@pytest.mark.parametrize("block", [256, 2])
def test_near_duplicates(docs, rows, block):
    sets, by = [], collections.defaultdict(set)
    for n, r in enumerate(rows):
        w = words((r[1] or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 75 * len(sets[a] | sets[b]) or rows[a][0] is not None and rows[a][0] == rows[b][0]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    for n, r in enumerate(rows):
        if r[0] is not None:
            by[group[n]].add(r[0])
    want = []
    for n, r in enumerate(rows):
        least = min(by[group[n]], default=None) if sets[n] else r[0]
        want.append(repr((r[0], len(sets[n]), least, least == r[0])))
    assert got_by_row(near_dup.near_duplicates(docs, block), "n_shingles", "component_id", "kept") == sorted(want)


def test_many_near_copies_of_one_text(spark):
    base = prose(50, 120).split()
    out = [(0, " ".join(base))]
    for k in range(1, 120):
        r = random.Random(k)
        w = list(base)
        for _ in range(r.randint(1, 6)):
            w[r.randrange(len(w))] = f"neu{r.randrange(10**6)}"
        out.append((k, " ".join(w)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(116)} for _, t in out]
    group = list(range(120))
    for a in range(120):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if 100 * i >= 75 * (len(sets[a]) + len(sets[b]) - i) and group[a] != group[b]:
                lo, hi = sorted((group[a], group[b]))
                group = [lo if g == hi else g for g in group]
    df = spark.createDataFrame(out, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(df, 16).collect()} == dict(enumerate(group))


def luhn(d):
    return sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(int(c) for c in reversed(d))) % 10 == 0


def test_personal_data(spark, docs):
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", r"[0-9](?:[\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    tests = [lambda m: True, lambda m: all(int(x) <= 255 for x in m.split(".")), lambda m: 14 <= len(re.sub(r"\D", "", m)) <= 19 and luhn(re.sub(r"\D", "", m)), lambda m: 10 <= len(re.sub(r"\D", "", m)) <= 15]
    r = random.Random(8)
    texts = [(k, "".join(r.choice("aé@..+-() 0123456789") for _ in range(200))) for k in range(60)] + [(60, "é" * 5000 + "a@b.co"), (61, "1" * 5000), (62, "a." * 3000 + "@x"), (63, "4111 1111-1111 1111, 4111111111111112")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for row in df.select("text", pii.joined(pii.base_spans(F.col("text")), pii.KINDS).alias("s")).collect():
        spans = sorted((m.start(), k, m.end()) for k, p in enumerate(patterns) for m in re.finditer(p, row.text) if tests[k](m[0]))
        assert row.s == ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert clean.where("doc_id = 16").first().text == "mail [email] ruf [phone] an [ip], [card]"


def test_disclosing_terms(spark):
    pairs = [("apples", "stone"), ("mount", "cloud"), ("paper", "window"), ("engine", "garden"), ("market", "harbor")]
    out = [(i, f"{a} word{i}x asked Zorblatt at z.b@mail.example about {b} and {a}{b} today") for i, (a, b) in enumerate(pairs)] + [(100 + i, f"they asked today about number{i} and it was {i}") for i in range(40)]
    s = pii.personal_spans(spark.createDataFrame(out, "doc_id long, text string"))
    terms = {x["value"] for r in s.collect() for x in r["spans"] if x["k"] == len(pii.KINDS)}
    assert terms == {"Zorblatt"}
    assert "Zorblatt" not in pii.sanitise(spark.createDataFrame(out, "doc_id long, text string")).where("doc_id = 0").first().text


def test_terms_of_a_frequent_entity(spark):
    """The surroundings of many texts come from few words, so their least hashes are few: that must not drop the term."""
    r = random.Random(3)
    vocabulary = [f"{a}{b}" for a in ("silver", "copper", "bronze", "marble") for b in ("gate", "field", "river", "house", "stone", "light")]
    around = lambda: [" ".join(r.sample(vocabulary, 8)) for _ in range(2)]
    for n in (6, 90):
        out = [(i, "{} Zorblatt z.b@mail.example {}".format(*around())) for i in range(n)] + [(1000 + i, " ".join(around())) for i in range(4 * n)]
        spanned = spark.createDataFrame(out, "doc_id long, text string").select("text", pii.base_spans(F.col("text")).alias("spans"))
        assert [(t.value, t.term) for t in pii.disclosing_terms(spanned).collect()] == [("z.b@mail.example", "zorblatt")]


def test_contexts_reach_words_not_characters(spark):
    """Against a loop over the words of the text: long words, many addresses and numbers between, no spaces, both ends."""
    r = random.Random(5)
    compound = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(3, 40)))
    texts = [" ".join(r.choice([compound, compound, lambda: "ab", lambda: "4711", lambda: f"{compound()}@mail.example"])() for _ in range(60)) for _ in range(12)]
    texts += ["a@b.example", f"a@b.example {compound()}", f"{compound()} a@b.example", "字" * 300 + ",a@b.example," + "字" * 300, "a@b.example 10.0.0.1@c.example +49 30 1234567 " + compound()]
    spanned = spark.createDataFrame([(t,) for t in texts], "text string").select("text", pii.base_spans(F.col("text")).alias("spans"))
    for row in spanned.select("text", "spans", pii._contexts(F.col("text"), F.col("spans"), 8).alias("found")).collect():
        kept = list(row.text)
        for s in row.spans:
            kept[s.start : s.end] = " " * (s.end - s.start)
        spoken = [(m.start(), m[0].lower()) for m in re.finditer(r"[^\W\d_][\w'-]{2,}", re.sub(r"[0-9@]\S*", lambda m: " " * len(m[0]), "".join(kept)))]
        want = {(s.value, w) for s in row.spans for w in [w for at, w in spoken if at < s.start][-8:] + [w for at, w in spoken if at >= s.end][:8]}
        assert {(f.value, f.term) for f in row.found} == want


def test_mixing(docs, rows, spark):
    many = spark.range(3000).selectExpr("id AS doc_id", "repeat('w ', CAST(1 + id % 37 AS INT)) AS text", "CASE WHEN id % 3 = 0 THEN 'big' WHEN id % 50 = 1 THEN 'a' WHEN id % 7 = 2 THEN NULL ELSE 'mid' END AS source")
    a = mixing.mix_sources(many, fan_in=16).toPandas()
    assert len(a) == 3000 and a.equals(a) and (a.taken <= 3 * a["size"]).all()
    g = a.groupby("source", dropna=False).agg(n=("size", "sum"), target=("target", "first"), taken=("taken", "sum"), top=("size", "max"))
    assert (abs(g.taken - g.target) <= g.top).all() and g.target.sum() == pytest.approx(g.n.sum())
    # plain water filling
    names = sorted(x for x in g.index if isinstance(x, str))
    order = [*names, None]
    size = {s: int(g.n[s]) if isinstance(s, str) else int(g[g.index.isna()].n.iloc[0]) for s in order}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    full, target = set(), {}
    while True:
        left, w = sum(size.values()) - sum(3 * size[s] for s in full), sum(weight[s] for s in order if s not in full)
        target = {s: 3 * size[s] if s in full else left * weight[s] / w for s in order}
        over = {s for s in order if target[s] > 3 * size[s]}
        if not over:
            break
        full |= over
    for s in names:
        assert g.target[s] == pytest.approx(target[s])
    b = mixing.mix_sources(many.repartition(7), fan_in=16).toPandas()
    key = ["doc_id", "taken"]
    assert a.sort_values("doc_id")[key].reset_index(drop=True).equals(b.sort_values("doc_id")[key].reset_index(drop=True))
    assert mixing.mix_sources(docs).count() == len(rows)


def test_rules_counts(docs, rows):
    want = []
    for r in rows:
        t, w = r[1] or "", words(r[1])
        g = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        c, cov = collections.Counter(g), set()
        for i, x in enumerate(g):
            if c[x] > 1:
                cov |= set(range(i, i + 5))
        seen, dup = set(), 0
        for line in t.split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        want.append(repr((r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cov))))
    forest = quality_rules.IsolationForest().fit(np.zeros((0, 8)))
    out = quality_rules.judge_rules(docs, forest)
    assert got_by_row(out, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == sorted(want)
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in out.collect())


def test_forest_finds_outliers():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(0, 1, (600, 8)), rng.normal(9, 1, (50, 8))
    f = quality_rules.IsolationForest().fit(good[:300]).calibrate(good[300:], bad)
    assert (f.score(bad) > f.limit).mean() > 0.95 and (f.score(good[300:]) > f.limit).mean() < 0.03


def test_classifiers_on_odd_rows(spark, docs, rows, empty):
    labels = spark.createDataFrame([(k, k % 2, int(k % 3 == 0)) for k in range(1, 18)] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    out = langid.identify_language(docs, langid.fit_language_model(docs))
    assert set(docs.columns) <= set(out.columns) and out.count() == len(rows)
    for r in out.collect():
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and 0 <= r.lang_score <= 1
    for model in (quality_cnn.fit_quality_net(docs, labels), toxicity.fit_toxicity(docs, labels)):
        s = quality_cnn.score_texts(docs, model, "score").collect()
        assert len(s) == len(rows) and all(0 <= r.score <= 1 for r in s)
    for model in (quality_cnn.fit_quality_net(empty, labels), toxicity.fit_toxicity(empty, labels)):
        assert quality_cnn.score_texts(empty, model, "score").count() == 0


def test_empty_tables(spark, empty):
    none = spark.createDataFrame([], "item_id string, text string")
    assert langid.identify_language(empty, langid.fit_language_model(empty)).count() == 0
    assert decontam.contamination(empty, none).count() == 0
    assert mixing.mix_sources(empty).count() == 0
    assert near_dup.near_duplicates(empty).count() == 0
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert substring_dedup.remove_later_repeats(empty).count() == 0
    assert pii.sanitise(empty).count() == 0
    assert quality_rules.judge_rules(empty, quality_rules.fit_rule_forest(empty, spark.createDataFrame([], "doc_id long, quality int"))).count() == 0


def test_noisy_channel():
    text = ("you are an idiot and a loser with pathetic trash " * 50) + prose(9, 500)
    counts = np.zeros((toxicity.SYMBOLS,) * 3)
    for b in tk.text_blocks(pa.array([text])):
        c = np.concatenate([[0, 0], toxicity._ids(b), [0]])
        np.add.at(counts, (c[:-2], c[1:-1], c[2:]), 1)
    ch = toxicity.NoisyChannel(counts)
    for hidden, word in {"1d10t": "idiot", "i d i o t": "idiot", "i.d.i.o.t": "idiot", "iiidiooot": "idiot", "l0s3r": "loser", "p4th3t1c": "pathetic", "tr@sh": "trash"}.items():
        assert ch.restore(f"an {hidden} here").split() == ["an", word, "here"]
    assert ch.restore("plain words, 42 of them!") == "plain words, 42 of them!"


def test_held_out_accuracy(spark, sf):
    """Labels and languages of rows no fit has seen."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = langid.identify_language(docs, langid.fit_language_model(docs)).select("doc_id", "lang", "lang_pred").collect()
    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.9


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["language_id", "near_dedup", "benchmark_decontamination", "personal_data", "source_mixing"]
    near = cp.near_dedup(spark, docs, sf)
    keep = {r.doc_id for r in near_dup.near_duplicates(docs).where("kept").collect()}
    assert {r.doc_id for r in near.collect()} == keep and near.columns == docs.columns
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    bad = {r.doc_id for r in decontam.contamination(docs, bench).where("contaminated").collect()}
    assert {r.doc_id for r in cp.decontaminate(spark, docs, sf).collect()} == {r.doc_id for r in docs.select("doc_id").collect()} - bad
    mixed = cp.mixing(spark, docs, sf)
    taken = {r.doc_id: r.copies for r in mixing.mix_sources(docs).collect() if r.copies}
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == taken
