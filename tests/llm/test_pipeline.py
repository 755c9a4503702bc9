"""The pipeline as a whole, on no document and on a few odd ones."""

import random

import corpus_pipeline as cp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string"


def written(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_no_documents(spark, tmp_path):
    out = cp.run(spark, written(spark, tmp_path, []))
    assert out.count() == 0 and out.columns == [*(c.split()[0] for c in SCHEMA.split(", ")), "copy"]


def test_stages_take_effect(spark, tmp_path):
    """Texts without letters, copies, a benchmark passage and personal data: each meets its stage."""
    r = random.Random(2)
    words = {"aa": ["morning", "garden", "window", "silver", "paper", "engine", "harbor"], "bb": ["straße", "größe", "übung", "mädchen", "höhe", "früh", "schön"]}
    prose = lambda lang: " ".join(r.choice(words[lang]) + r.choice(["", "s", "en"]) for _ in range(60))
    rows = [(k, prose(lang := "aa" if k % 2 else "bb"), lang, ["s1", "s2", None][k % 3], 1, "x") for k in range(80)]
    passage = "One, two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows += [(90, rows[3][1], "aa", "s1", 1, "x"), (91, passage, "aa", "s1", 1, "x"), (92, "", "aa", "s1", 1, "x"), (93, None, None, None, None, None), (94, "12 34 !", "bb", "s2", 1, "x"), (95, rows[5][1] + " mail z.b@mail.example now", "aa", "s2", 1, "x")]
    d = written(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    ids = lambda df: {x.doc_id for x in df.collect()}
    assert not ids(cp.language_id(spark, docs, d)) & {92, 93, 94}
    assert {90, 95} & ids(cp.near_dedup(spark, docs, d)) == set()
    assert ids(docs) - ids(cp.decontaminate(spark, docs, d)) == {91}
    clean = {x.doc_id: x.text for x in cp.personal_data(spark, docs, d).collect()}
    assert clean[95].endswith("mail [email] now") and all(clean[k] == t for k, t, *_ in rows if k != 95)
