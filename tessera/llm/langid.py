"""Language identification by multilingual mixture inference.

A model holds, for each learned language, log-probabilities of character n-grams (one to four
letters of a word, with its edges), hashed into a fixed number of buckets.  A document is a mixture: every word comes from one
of the languages, with the probability its n-grams give it.  Expectation-maximisation estimates
the proportions; languages enter the document's set in order of proportion as long as the gain in
log-likelihood exceeds a penalty that grows with the logarithm of the words.  The prediction is
the language with the largest proportion in the chosen set, the score that proportion.

Training reads a bounded sample: about ``PER_LANGUAGE`` documents of each language, chosen by a
hash of the id, whole texts.  Prediction reads the text alone.

A text that is null or has no letter gets ``und`` with score 0, as do all texts if there is no
language to learn from.  Repeated rows are predicted alike.

``accepts`` is the decision of a filter: a text is rejected if it has no letter, or if no learned
language explains it.  For that, a model without a language, in which all n-grams are as likely,
competes with the chosen set: it wins if its log-likelihood is larger by the penalty and by
``MARGIN`` for each word, as for scripts and languages that were never learned.  If there is no
language to learn from, every text is accepted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import ship

UNKNOWN = "und"
FOLDS, HELD_OUT_FOLD = 4, 2
PER_LANGUAGE = 1500
BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
#: Characters that are read at once; longer texts are read in pieces.
BLOCK = 1 << 16
SMOOTHING = 0.5
ROUNDS = 12
#: Weight of the penalty for another language, in units of half the logarithm of the words.
PENALTY = 4.0
#: Log-likelihood a word by which the model without a language must win.
MARGIN = 2.0


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


@lru_cache(1)
def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def blocks_of(text: str) -> Iterator[str]:
    """``text`` in pieces of at most ``BLOCK`` characters, cut at blanks where there are any."""
    at = 0
    while at < len(text):
        end = at + BLOCK
        if end < len(text):
            end = text.rfind(" ", at + 1, end) + 1 or end
        yield text[at:end]
        at = end


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram buckets of the words of ``text`` (orders x positions) and where words start.

    A word is a run of letters between blanks; all else counts as blank.  An n-gram belongs to the
    position at which it starts, one that starts with the blank before a word to the word's first
    letter.  ``BUCKETS`` stands for no n-gram. """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    z = np.zeros(len(points) + len(ORDERS) + 1, np.uint32)
    z[1 : len(points) + 1] = np.where(letter_table()[points], points, 0)
    n = len(points) + 1
    letter = z != 0
    out = np.empty((len(ORDERS), n), np.int32)
    key, inner = z[:n].copy(), np.ones(n, bool)
    for row, order in enumerate(ORDERS):
        if order > 1:
            if order > 2:
                inner = inner & letter[order - 2 : n + order - 2]
            key = key * np.uint32(0x01000193) ^ z[order - 1 : n + order - 1]
        bucket = ((key * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int32)
        fit = letter[:n] if order == 1 else inner & (letter[:n] | letter[1 : n + 1])
        out[row] = np.where(fit, (bucket + 8191 * order) & (BUCKETS - 1), BUCKETS)
    return out, np.flatnonzero(letter[1 : n] & ~letter[: n - 1]) + 1


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # languages x buckets, log-probabilities


def count_rows(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(lang, bucket, n) of the n-grams of ``docs``."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per_lang: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total = per_lang.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                for part in blocks_of(text):
                    total += np.bincount(grams(part)[0].ravel(), minlength=BUCKETS + 1)
        for lang, total in per_lang.items():
            used = np.flatnonzero(total[:BUCKETS])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(total[used])], names=["lang", "bucket", "n"])

    return docs.select(lang_col, text_col).mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> Model:
    """A model from the labelled rows of ``docs``."""
    labelled = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang is not null and text is not null")
    sizes = {row["lang"]: row["count"] for row in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], np.zeros((0, BUCKETS), np.float32))
    # Rows whose hash falls below the share that their language may give.
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, per_language / n)))])
    drawn = labelled.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)
    counts = count_rows(drawn, "lang", "text").toPandas()  # at most languages x buckets rows
    languages = sorted(set(counts["lang"]))
    total = np.full((len(languages), BUCKETS), SMOOTHING)
    for k, lang in enumerate(languages):
        own = counts[counts["lang"] == lang]
        total[k, own["bucket"].to_numpy()] += own["n"].to_numpy()
    return Model(languages, np.log(total / total.sum(axis=1, keepdims=True)).astype(np.float32))


def proportions(likelihood: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
    """Maximum-likelihood shares of the languages and the log-likelihood, by
    expectation-maximisation.  ``likelihood``: words x languages, scaled to at most 1 a word."""
    share = start
    for _ in range(ROUNDS):
        mixed = likelihood * share
        moved = (1 / mixed.sum(axis=1)) @ mixed / len(likelihood)
        done = np.abs(moved - share).max() < 1e-3
        share = moved
        if done:
            break
    return share, float(np.log(likelihood @ share).sum())


class Identifier:
    """Predicts by a model."""

    def __init__(self, model: Model):
        self.languages = model.languages
        # Each order reads the whole word, so their mean is the scale of one reading of it.
        self.weights = np.zeros((BUCKETS + 1, len(model.languages)), np.float32)
        self.weights[:BUCKETS] = model.weights.T / len(ORDERS)
        self.plain = -np.log(BUCKETS) / len(ORDERS)  # of an n-gram without a language

    def word_likelihoods(self, text: str) -> np.ndarray:
        """Log-likelihood of every word of ``text`` in every language."""
        return self.read(text)[0]

    def read(self, text: str) -> tuple[np.ndarray, int]:
        """``word_likelihoods``, and how many n-grams were read."""
        found, count = [], 0
        for part in blocks_of(text):
            buckets, starts = grams(part)
            if not len(starts):
                continue
            count += int((buckets < BUCKETS).sum())
            total = self.weights[buckets[0]]
            for row in buckets[1:]:
                total += self.weights[row]
            blank = np.flatnonzero(buckets[0][:-1] == BUCKETS)
            total[blank + 1] += total[blank]
            total[blank] = 0
            found.append(np.add.reduceat(total, starts, axis=0))
        return (np.concatenate(found) if found else np.empty((0, len(self.languages)), np.float32)), count

    def predict(self, text: str | None) -> tuple[str, float, dict[str, float]]:
        """(language, score, shares of the chosen languages)."""
        if not text or not self.languages:
            return UNKNOWN, 0.0, {}
        logs = self.word_likelihoods(text)
        if not len(logs):
            return UNKNOWN, 0.0, {}
        return self.mixture(logs)[:3]

    def accepts(self, text: str | None) -> bool:
        """Whether a filter by language keeps the text."""
        if not self.languages:
            return True
        logs, count = self.read(text or "")
        if not len(logs):
            return False
        explained = self.mixture(logs)[3] + float(logs.max(axis=1).sum())
        return count * self.plain - explained <= PENALTY * 0.5 * np.log(1 + len(logs)) + MARGIN * len(logs)

    def mixture(self, logs: np.ndarray) -> tuple[str, float, dict[str, float], float]:
        """(language, score, shares of the chosen languages, their log-likelihood less that of each word's
        best language)."""
        likelihood = np.exp(np.maximum(logs - logs.max(axis=1, keepdims=True), -50.0)).astype(np.float64)
        words, k = likelihood.shape
        share, _ = proportions(likelihood, np.full(k, 1 / k))
        order = np.argsort(-share, kind="stable")
        chosen, best_share, best = order[:1], np.ones(1), float(np.log(likelihood[:, order[0]]).sum())
        penalty = PENALTY * 0.5 * np.log(1 + words)
        for size in range(2, k + 1):
            if share[order[size - 1]] < 0.01:
                break
            own = order[:size]
            found, gained = proportions(likelihood[:, own], share[own] / share[own].sum())
            if gained - best <= penalty:
                break
            chosen, best_share, best = own, found, gained
        lead = int(np.argmax(best_share))
        # The score is what the full mixture gives the winner: a lone language is not certain.
        score = float(min(1.0, max(0.0, share[chosen[lead]])))
        return self.languages[chosen[lead]], score, {self.languages[j]: float(s) for j, s in zip(chosen, best_share, strict=True)}, best


def predictions(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, languages) per row of ``df``, without carrying the text back."""
    ship(df.sparkSession)
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = T.StructType([source.schema["id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("languages", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Identifier(model)
        for batch in batches:
            made = [own.predict(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64()), pa.array([sorted(m[2]) for m in made], pa.list_(pa.string()))], names=out.names)

    return source.mapInArrow(run, out)


def accepted(model: Model, text: Column) -> Column:
    """Whether a filter by language keeps ``text``, as a column beside a row's other columns."""

    @F.pandas_udf(T.BooleanType())
    def decide(texts):
        import pandas as pd

        own = _identifier(model)
        return pd.Series([own.accepts(x) for x in texts], dtype=bool)

    return decide(text.cast("string"))


_KEPT: dict[int, Identifier] = {}


def _identifier(model: Model) -> Identifier:
    """One identifier per model and worker, so that its words carry over between batches."""
    key = hash((tuple(model.languages), model.weights.tobytes()))
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Identifier(model)
    return _KEPT[key]
