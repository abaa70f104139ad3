"""Model calls: a model is loaded once a worker, batches hold like sizes, repeated pairs are scored once."""

import os
import re

from conftest import SMALL
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import hooks
from tessera.operators import index as I
from tessera.operators import retrieve as R
from tessera.plans import registry


def loader(folder, kind):
    """A loader that leaves a file for each load and each call."""

    def make():
        import os
        import uuid

        open(os.path.join(folder, f"load-{uuid.uuid4().hex}"), "w").close()

        def model(*columns):
            with open(os.path.join(folder, f"call-{uuid.uuid4().hex}"), "w") as file:
                file.write("\n".join(str(sum(map(len, row))) for row in zip(*columns, strict=True)))
            return [float(len(row[-1])) if kind == "score" else f"r{row[0]}" if kind == "text" else [float(len(row[0]))] * 2 for row in zip(*columns, strict=True)]

        return model

    make.__qualname__ = f"make-{folder}"
    return make


def told(folder):
    names = os.listdir(folder)
    calls = [[int(x) for x in open(os.path.join(folder, n)).read().split("\n")] for n in names if n.startswith("call")]
    return sum(n.startswith("load") for n in names), calls


def test_a_model_is_loaded_once_a_worker(spark, tmp_path):
    rows = spark.range(4000, numPartitions=60).select("id", F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")).alias("text"))
    made = hooks.generated(rows, "text", hooks.lazy(loader(str(tmp_path), "text")), "reply")
    assert made.filter("reply <> concat('r', text)").count() == 0
    loads, calls = told(tmp_path)
    assert 1 <= loads <= 2 * os.cpu_count() < 60 and sum(map(len, calls)) == 4000
    assert max(map(len, calls)) <= hooks.MODEL_BATCH and all(c == sorted(c) for c in calls)
    vectors = hooks.embedded(rows.limit(50), "text", hooks.lazy(loader(str(tmp_path), "vector")))
    assert vectors.schema["embedding"].dataType.simpleString() == "array<float>"


def test_repeated_pairs_are_scored_once(spark, tmp_path):
    rows = spark.range(300).select("id", F.lit("alpha beta").alias("query"), F.concat(F.lit("text with alpha "), (F.col("id") % 5).cast("string")).alias("content"), F.array(F.lit("alpha")).alias("words"))
    rows = rows.unionAll(spark.createDataFrame([(999, None, None, [])], "id long, query string, content string, words array<string>"))
    made = hooks.reranked(rows, "query", "content", "words", hooks.lazy(loader(str(tmp_path), "score")))
    assert made.count() == 301 and made.filter("id < 300 and logit <> length(content)").count() == 0
    assert sum(map(len, told(tmp_path)[1])) == 6  # each pair once; counting rows needs no score
    assert set(made.columns) == {"id", "query", "content", "words", "logit"}


def test_retrieval_asks_the_reranker_about_excerpts(spark):
    text = "filler " * 300 + "the needle word here " + "filler " * 300
    chunks = spark.createDataFrame([(1, "a", "p", "b", "note", text), (2, "b", "p", "b", "note", "needle " + "other " * 20)], "chunk_key long, pos string, project string, build string, document_type string, content string")
    asked = spark.createDataFrame([(1, "needle word", "p", "b")], "qid long, query string, project string, build string")
    products = spark.createDataFrame([("p", ["b"])], "product string, revisions array<string>")

    def model(queries, excerpts):
        assert all(len(e) <= 512 for e in excerpts)
        return [1.5 if "needle word" in e else -1.0 for e in excerpts]

    found = R.retrieve(asked, chunks, I.lexical(chunks, "chunk_key"), products, reranker=model).orderBy("rank").collect()
    assert [(r.chunk_key, r.score) for r in found] == [(1, 1.5), (2, -1.0)]


def plain_excerpt(content, terms, size=512):
    """What an excerpt is, window by window."""
    text = content.strip()
    upper, best, most = text.upper(), 0, 0
    if len(text) <= size:
        return text
    for term in terms:
        for match in re.finditer(re.escape(term), text, re.IGNORECASE):
            at = max(0, match.start() - size // 3)
            score = sum(t.upper() in upper[at : at + size] for t in terms)
            if score > most:
                most, best = score, at
    return text[best : best + size]


def test_the_excerpt_query_runs_each_time_it_is_built(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    want = {i: plain_excerpt(t, ["the", "interface", "andthe", "erth"]) for i, t in texts.items() if len(t.strip().upper()) == len(t.strip())}
    assert len(want) > 150
    for _ in range(4):
        got = {r.doc_id: r.excerpt for r in registry.queries()["R08_query_excerpt"](spark, SMALL).collect()}
        assert set(got) == set(texts) and {i: got[i] for i in want} == want


def test_words_of_a_question_reach_a_python_function(spark):
    path = "a" * 600 + " The LCD pin " + "b" * 600
    rows = spark.createDataFrame([(1, "the THE lcd", path), (2, None, path), (3, "pin", path), (4, "the", None)], "id long, query string, content string").repartition(2)
    for _ in range(4):
        words = X.boost_tokens(F.col("query"))
        found = {r.id: (r.words, r.excerpt) for r in rows.select("id", words.alias("words"), hooks.focused_excerpt(F.col("content"), words).alias("excerpt")).collect()}
        assert found == {1: (["the", "lcd"], path[601 - 170 :][:512]), 2: (None, path[:512]), 3: ([], path[:512]), 4: (["the"], "")}
