"""Suffix arrays and trees against plain versions; the two queries at the lengths they fix."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from loxodrome.llm import _suffix_tree as st
from loxodrome.llm import suffix_dedup
from loxodrome.llm.substring_dedup import op9_substring_dedup
from loxodrome.llm.suffix_dedup import op1_suffix_array_dedup, remove_repeats


@pytest.mark.parametrize("seed", range(30))
def test_maximal_repeats(seed):
    rng = random.Random(seed)
    texts = [np.array([rng.randint(1, 3) for _ in range(rng.randint(0, 25))], np.uint64) for _ in range(5)]
    least, places = rng.randint(1, 4), collections.defaultdict(list)
    for t, x in enumerate(texts):
        for i in range(len(x)):
            for j in range(i + least, len(x) + 1):
                places[tuple(x[i:j].tolist())].append((t, i))
    want = {}
    for words, at in places.items():
        before = {int(texts[t][i - 1]) if i else (t,) for t, i in at}
        after = {int(texts[t][i + len(words)]) if i + len(words) < len(texts[t]) else (t,) for t, i in at}
        if len(before) > 1 and len(after) > 1:
            want[words] = sorted(at)
    assert st.maximal_repeats(texts, least) == want


def test_highest_nodes_hold_the_others():
    rng = np.random.default_rng(4)
    order, common = st.sorted_suffixes(rng.integers(0, 3, (200, 9)).astype(np.uint64))
    nodes = st.internal_nodes(common, 4)
    top = {(a, b) for a, b, _ in nodes if not any(c <= a and b <= d and (a, b) != (c, d) for c, d, _ in nodes)}
    assert set(zip(*map(np.ndarray.tolist, st.highest_nodes(common, 4)), strict=True)) == top


def letters(seed, n):
    return bytes(random.Random(seed).choice(b"abcdefgh") for _ in range(n))


def test_nul_bytes_beside_equal_windows():
    """A suffix that runs over the end of its text sorts between the two equal windows."""
    p, q = letters(1, 30), letters(2, 29)
    got = suffix_dedup.repeated_in_shard([p + b"\0" + q + b"x", letters(3, 40) + p, q + letters(4, 40), p + b"\0" + q + b"y"], np.ones(4, np.int64), 60)
    assert sorted(got[0].tolist()) == [0, 3]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Copies, shared passages at several places, passages that repeat in one text, odd rows, an extra column."""
    word = lambda r: "".join(r.choice("abcdefghij\u00e9") for _ in range(r.randint(1, 9)))
    prose = lambda seed, n: " ".join(word(r) for r in [random.Random(seed)] for _ in range(n))
    shared, other = prose(1, 130), prose(2, 90)
    texts = [prose(3, 60), shared, prose(4, 30) + " " + shared, shared + " " + prose(5, 25), other + "\n" + shared + "\t" + other, prose(6, 15) + " " + shared[40:] + " " + other[:450], other[30:] + " x", None, "", " \n", "x" * 1000, "a b " * 300, prose(7, 19), prose(8, 20), prose(8, 20), prose(3, 60)]
    rows = [(k * 3 % 17, t, "s", 1) for k, t in enumerate(texts)] + [(None, shared, "s", 2), (4, prose(9, 30), None, 3)]
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, fp string, at int").write.parquet(f"{d}/documents.parquet")
    return d, rows


def test_op1_removes_what_repeats_over_400_bytes(spark, corpus):
    d, rows = corpus
    texts = [(r[1] or "").encode() for r in rows]
    count = collections.Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    want = []
    for r, t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - 399):
            if count[t[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        spans = len(re.findall(b"\1+", bytes(gone)))
        want.append(str((r[0], len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, x in zip(t, gone, strict=True) if not x)).hexdigest())))
    got = op1_suffix_array_dedup(spark, d).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(want)


def test_op9_keeps_the_first_of_20_words(spark, corpus):
    d, rows = corpus
    words = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows]
    place = lambda r, i: (-1 if r[0] is None else r[0], i)
    first = {}
    for r, w in zip(rows, words, strict=True):
        for i in range(len(w) - 19):
            first[tuple(w[i : i + 20])] = min(first.get(tuple(w[i : i + 20]), place(r, i)), place(r, i))
    want = []
    for r, w in zip(rows, words, strict=True):
        gone = [0] * len(w)
        for i in range(len(w) - 19):
            if first[tuple(w[i : i + 20])] < place(r, i):
                gone[i : i + 20] = [1] * 20
        want.append(str((r[0], len(w), sum(gone), hashlib.sha256(" ".join(x for x, y in zip(w, gone, strict=True) if not y).encode()).hexdigest())))
    got = op9_substring_dedup(spark, d).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(want)


@pytest.mark.parametrize("most", [1, 3])
def test_split_of_hot_anchors_loses_no_link(spark, most):
    """A phrase between surroundings that few, many or all texts share, periodic ones among them: every window that recurs is found."""
    r = random.Random(most)
    phrase, ends = "the phrase that stands in all of them", ["ab" * 40, "b" * 70, *("".join(r.choice("abc") for _ in range(70)) for _ in range(4))]
    texts = [r.choice(ends)[-r.randint(0, 70) :] + phrase + r.choice(ends)[: r.randint(0, 70)] + str(k) for k in range(90)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    count = collections.Counter(t[i : i + 60] for t in texts for i in range(len(t) - 59))
    want = {}
    for k, t in enumerate(texts):
        gone = {j for i in range(len(t) - 59) if count[t[i : i + 60]] > 1 for j in range(i, i + 60)}
        want[k] = len(gone)
    got = {x.doc_id: x.n_removed for x in remove_repeats(docs, 60, 24, 1, most).collect()}
    assert got == want and sum(want.values()) > 1000
