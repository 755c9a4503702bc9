"""The fit of op8 on the driver: few dense features at a time, and the weights of a plain dense fit."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from loxodrome.llm import _textkit as tk
from loxodrome.llm import langid
from loxodrome.llm._linear import Ftrl, temperature


def sample(n):
    rng = np.random.default_rng(n)
    words = [["morning", "garden", "window", "silver", "paper"], ["straße", "größe", "übung", "mädchen", "höhe"], ["matin", "jardin", "fenêtre", "été", "papier"]]
    langs = [int(k) for k in rng.integers(0, 3, n)]
    texts = [" ".join(rng.choice(words[k], int(rng.integers(0, 40)))) for k in langs]
    return texts, [f"l{k}" for k in langs]


@pytest.mark.parametrize("n", [1, 19, 33, 150])
def test_fit_equals_dense_fit(n):
    texts, langs = sample(n)
    m = langid.LanguageModel(1 << 10).fit(texts, langs)
    y = np.array([m.langs.index(x) for x in langs])
    counts = np.vstack([langid.features(b, 1 << 10)[0].astype(np.float32) for b in tk.text_blocks(pa.array(texts, pa.string()))])
    idf = (np.log((1 + n) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    x = langid._tfidf(counts, idf)
    aside = np.random.default_rng(11).random(n) < 0.2
    if aside.all() or n < 20:
        aside[:] = False
    w = Ftrl(1 << 10, len(m.langs)).fit(x[~aside], y[~aside], 6, 16, 11).astype(np.float32)
    assert np.array_equal(m.idf, idf) and np.array_equal(m.w, w)
    assert m.t == temperature(x[aside] @ w[:-1] + w[-1], y[aside])


def test_fit_holds_few_dense_rows():
    texts, langs = sample(1500)
    tracemalloc.start()
    langid.LanguageModel().fit(texts, langs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1500 * (1 << 13) * 4  # of one dense copy
