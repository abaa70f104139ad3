import math
import re

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from tessera.llm import langid, queries

SCHEMA = "doc_id long, text string, lang string, score string, languages string"
ENGLISH = "the house and the garden were in the shade of that old tree when they came with bread"
GERMAN = "das Haus und der Garten lagen im Schatten des alten Baumes als sie mit dem Brot kamen"


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, f"{ENGLISH} {i}" if i % 2 else f"{GERMAN} {i}", "en" if i % 2 else "de", "", "") for i in range(60)]
    return langid.train(spark.createDataFrame(rows, SCHEMA))


def test_held_out_accuracy(spark):
    lang = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    out = queries.op10_language(spark, SMALL).join(lang, "doc_id").toPandas()
    held = out[out.held_out & out.lang.notna()]
    assert len(held) > 20 and (held.lang_pred == held.lang).mean() >= 0.95
    assert out.score.between(0, 1).all()


def test_fold(spark):
    import zlib

    got = {r.id: r.f for r in spark.range(50).select("id", langid.fold(F.col("id")).alias("f")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 for i in range(50)}


@pytest.mark.parametrize("text", [None, "", "12 34 !!", "\n\t"])
def test_nothing_to_go_by(model, text):
    assert langid.Identifier(model).predict(text)[:2] == ("und", 0.0)


def test_one_language_and_two(model):
    own = langid.Identifier(model)
    assert own.predict(ENGLISH)[0] == "en" and own.predict(GERMAN)[0] == "de" and own.predict("Das")[0] == "de"
    lead, score, shares = own.predict(f"{ENGLISH} " * 30 + f"{GERMAN} " * 20)
    assert lead == "en" and set(shares) == {"en", "de"} and 0.5 < score < 0.7
    assert set(own.predict(f"{ENGLISH} " * 30)[2]) == {"en"}


def test_blocks_do_not_change_a_prediction(model, monkeypatch):
    text = f"{ENGLISH} {GERMAN} " * 200
    whole = langid.Identifier(model).word_likelihoods(text)
    monkeypatch.setattr(langid, "BLOCK", 997)
    np.testing.assert_allclose(langid.Identifier(model).word_likelihoods(text), whole, rtol=1e-4)


def test_grams_by_hand():
    buckets, starts = langid.grams("ab c")
    # Row by order; positions: edge, a, b, blank, c.
    held = (buckets != langid.BUCKETS).tolist()
    assert held[0] == [False, True, True, False, True] and held[1] == [True, True, True, True, True]
    assert held[2] == [True, True, False, True, False] and held[3] == [True, False, False, False, False]
    assert starts.tolist() == [1, 4]


def test_edges(spark, model):
    rows = [(1, ENGLISH, None, "x", "y"), (1, ENGLISH, None, "x", "y"), (None, "x" * 200_000, None, "", ""), (3, None, "de", "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = langid.predictions(df, model)
    assert out.columns == ["id", "lang_pred", "score", "languages"] and out.count() == 4
    kept = df.filter(langid.accepted(model, F.col("text"))).collect()
    assert [r.doc_id for r in kept] == [1, 1]
    nothing = langid.train(spark.createDataFrame([], SCHEMA))
    assert nothing.languages == [] and {r.lang_pred for r in langid.predictions(df, nothing).collect()} == {"und"}
    assert langid.predictions(df.limit(0), model).count() == 0
    assert df.filter(langid.accepted(nothing, F.col("text"))).count() == 4


def test_a_filter_rejects_what_no_language_explains(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    own = langid.Identifier(langid.train(docs))
    foreign = ["Привет, как дела? Это русский текст.", "这是中文文本 你好 世界", "Γειά σου κόσμε", "12 !", "", None]
    assert not any(own.accepts(t) for t in foreign)
    assert all(own.accepts(r.text) for r in docs.collect() if r.text and any(c.isalpha() for c in r.text))


def plain_mixture(own, text):
    """The definition, word by word: languages in order of their shares, taken as long as the gain exceeds
    the penalty, shares by many rounds of expectation-maximisation."""
    logs = []
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        buckets, _ = langid.grams(word)
        logs.append(sum(own.weights[int(b)].astype(float) for b in buckets.ravel()))
    k = len(own.languages)

    def fit(of):
        share = [1 / len(of)] * len(of)
        for _ in range(3000):
            total = [0.0] * len(of)
            for row in logs:
                p = [s * math.exp(row[j] - max(row)) for s, j in zip(share, of)]
                total = [t + x / sum(p) for t, x in zip(total, p)]
            share = [t / len(logs) for t in total]
        return share, sum(math.log(sum(s * math.exp(row[j] - max(row)) for s, j in zip(share, of))) for row in logs)

    order = [j for _, j in sorted((-s, j) for j, s in enumerate(fit(range(k))[0]))]
    chosen = order[:1]
    for size in range(2, k + 1):
        if fit(order[:size])[1] - fit(chosen)[1] <= langid.PENALTY * 0.5 * math.log(1 + len(logs)):
            break
        chosen = order[:size]
    share = fit(chosen)[0]
    return own.languages[chosen[share.index(max(share))]], {own.languages[j] for j in chosen}


FRENCH = "la maison et le jardin etaient dans ombre du vieil arbre quand ils vinrent avec du pain"


@pytest.mark.parametrize("mix", [(1, 0, 0), (0, 1, 0), (3, 2, 0), (2, 0, 3), (2, 2, 2), (4, 0, 1)])
def test_mixture_equals_the_definition(spark, mix):
    every = {"en": ENGLISH, "de": GERMAN, "fr": FRENCH}
    rows = [(i, f"{text} {i}", lang, "", "") for i, (lang, text) in enumerate(list(every.items()) * 20)]
    own = langid.Identifier(langid.train(spark.createDataFrame(rows, SCHEMA)))
    text = " ".join(" ".join([t] * n) for t, n in zip(every.values(), mix) if n)
    lead, _, shares = own.predict(text)
    want = plain_mixture(own, text)
    assert set(shares) == want[1] and (lead == want[0] or len(set(mix)) == 1)
