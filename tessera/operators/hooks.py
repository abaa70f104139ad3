"""Named places where a model or a binary decoder plugs in, with deterministic offline defaults.

A hook is a plain function over lists, run in Arrow batches; a deployment passes its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as X
from tessera.operators.durable import materialize

Embedder = Callable[[list[str]], list[list[float]]]
Reranker = Callable[[list[str], list[str]], list[float]]
Model = Callable[[list[str]], list[str]]

DIMENSIONS = 64


def hashing_embedder(texts: list[str]) -> list[list[float]]:
    """Signed feature hashing of lower-cased words."""
    out = np.zeros((len(texts), DIMENSIONS))
    seen: dict[str, tuple[int, float]] = {}
    for row, text in enumerate(texts):
        for word in re.findall(r"\w+", text.lower()):
            if word not in seen:
                digest = hashlib.md5(word.encode(), usedforsecurity=False).digest()
                seen[word] = (digest[0] % DIMENSIONS, 1.0 if digest[1] & 1 else -1.0)
            at, sign = seen[word]
            out[row, at] += sign
    return out.tolist()


def embedded(rows: DataFrame, text_col: str, embedder: Embedder = hashing_embedder, out: str = "embedding") -> DataFrame:
    """``rows`` with the vector of a text, texts in batches of like length."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            given = [t or "" for t in texts]
            yield pd.Series(by_length(embedder, [given], lambda i: len(given[i])))

    return rows.withColumn(out, run(text_col))


def excerpt_of(content: str, words: list[str], size: int = 512) -> str:
    """At most ``size`` characters of ``content`` around the occurrence that gathers most words; the
    first best wins, and without any the beginning does."""
    text = content.strip()
    if len(text) <= size or not len(words):
        return text[:size]
    upper = text.upper()
    if len(upper) != len(text):  # some letters grow in upper case; positions must agree
        upper = "".join(u if len(u := c.upper()) == 1 else c for c in text)
    terms = [w.upper() for w in words]
    starts = sorted({max(0, m.start() - size // 3) for t in terms for m in re.finditer(re.escape(t), upper)})
    if not starts:
        return text[:size]
    # Which terms a window holds follows from where each term next occurs.
    score = np.zeros(len(starts), int)
    at = np.array(starts)
    for term in set(terms):
        spots = np.array([m.start() for m in re.finditer(f"(?={re.escape(term)})", upper)] or [len(upper) * 2])
        following = np.append(spots, len(upper) * 2)[np.searchsorted(spots, at)]
        score += (following + len(term) <= at + size) * terms.count(term)
    by_term = {max(0, m.start() - size // 3): None for t in terms for m in re.finditer(re.escape(t), upper)}
    rank = {s: i for i, s in enumerate(by_term)}
    best = max(range(len(starts)), key=lambda i: (score[i], -rank[starts[i]]))
    return text[starts[best] : starts[best] + size]


def focused_excerpt(content: Column, words: Column, size: int = 512) -> Column:
    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series, terms: pd.Series) -> pd.Series:
        return pd.Series([excerpt_of(t or "", list(w) if w is not None else [], size) for t, w in zip(texts, terms, strict=True)])

    return run(content, words)


def lexical_reranker(queries: list[str], excerpts: list[str]) -> list[float]:
    """The share of a question's words that an excerpt holds, from -6 to 2."""
    out = []
    for query, excerpt in zip(queries, excerpts, strict=True):
        words = {w.lower() for w in re.findall(r"[\w&]+", query) if len(w) > 1 and w.lower() not in X.STOP_TOKENS}
        out.append(8.0 * sum(w in excerpt.lower() for w in words) / len(words) - 6.0 if words else -6.0)
    return out


#: Pairs that a model scores at a time, sorted by length so that a batch holds texts of like size.
MODEL_BATCH = 64


def loaded(make: Callable[[], Callable]) -> Callable:
    """The model that ``make`` loads, once a worker; later batches and tasks of the worker reuse it.  Models
    are told apart by the module and name of what loads them."""
    name = f"{make.__module__}.{make.__qualname__}"
    if name not in _LOADED:
        _LOADED[name] = make()
    return _LOADED[name]


_LOADED: dict[str, Callable] = {}


def lazy(make: Callable[[], Callable]) -> Callable:
    """A hook whose model is loaded by ``make``, a function of a module, where it first runs."""

    def run(*columns: list):
        return loaded(make)(*columns)

    return run


def by_length(model: Callable[..., list], columns: list[list], weigh: Callable[[int], int]) -> list:
    """``model`` over rows in batches of like length; results in the order of the rows."""
    order = sorted(range(len(columns[0])), key=weigh)
    out: list = [None] * len(order)
    for at in range(0, len(order), MODEL_BATCH):
        own = order[at : at + MODEL_BATCH]
        for i, value in zip(own, model(*([c[i] for i in own] for c in columns)), strict=True):
            out[i] = value
    return out


def reranked(rows: DataFrame, query_col: str, content_col: str, words_col: str, reranker: Reranker = lexical_reranker, size: int = 512) -> DataFrame:
    """``rows`` with ``logit``: the score of the question with the excerpt of the content that gathers most of
    its words.  Each pair of a question and an excerpt is scored once, however many rows repeat it."""
    with_excerpt = rows.withColumn("__excerpt", focused_excerpt(F.col(content_col), F.col(words_col), size))
    asked = F.coalesce(F.col(query_col), F.lit(""))
    with_excerpt = materialize(with_excerpt.withColumn("__pair", F.sha2(F.concat(F.length(asked).cast("string"), F.lit(":"), asked, F.col("__excerpt")).cast("binary"), 256)), "rerank-pairs")

    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for queries, excerpts in batches:
            asked, told = [q or "" for q in queries], [e or "" for e in excerpts]
            yield pd.Series(by_length(reranker, [asked, told], lambda i: len(asked[i]) + len(told[i])), dtype="float64")

    pairs = with_excerpt.groupBy("__pair").agg(F.first(query_col).alias("__asked"), F.first("__excerpt").alias("__told"))
    scored = pairs.withColumn("logit", run("__asked", "__told")).select("__pair", "logit")
    return with_excerpt.join(scored, "__pair").drop("__pair", "__excerpt")


def extractive_model(prompts: list[str]) -> list[str]:
    """Answers with the first sentence of the first context block and its marker; no context, no answer."""
    out = []
    for prompt in prompts:
        found = re.search(r"^\[1\][^\n]*\n([^\n.]*\.?)", prompt, re.MULTILINE)
        out.append(f"{found.group(1).strip()} [1]" if found and found.group(1).strip() else "")
    return out


def generated(rows: DataFrame, prompt_col: str, model: Model = extractive_model, out: str = "answer") -> DataFrame:
    """``rows`` with the model's reply to a prompt, in batches of like length."""

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            asked = [p or "" for p in prompts]
            yield pd.Series(by_length(model, [asked], lambda i: len(asked[i])), dtype="object")

    return rows.withColumn(out, run(prompt_col))


def rewritten(question: Column, reply: Column) -> Column:
    """A model's rewrite unless it is empty or more than five times as long."""
    clean = X.strip(reply)
    return F.when((clean != "") & (F.length(clean) <= 5 * F.length(question)), clean).otherwise(question)
