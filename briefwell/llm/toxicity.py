"""Toxicity by a classifier chain.

Categories are predicted one after another by logistic regressions; the model of a category reads, beside the text's
features, the probabilities of all categories before it. In training these come from models that did not see the row
(out-of-fold predictions), as they will for new rows; the model kept for a category is fitted on all rows.

Features are the presence of terms (words and word beginnings) that labelled toxic documents hold far more often than
others do, found by a log-likelihood ratio, and how many such terms and occurrences a text has.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, labelled_sample, materialize

WORD = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6)
#: Features beside the terms: log counts of distinct terms and of occurrences, and occurrences in 100 words (at most 10).
EXTRA = 3


#: Words of a worker that are kept with their terms, and the longest of them.
MAX_WORDS, LONGEST_KEPT = 300_000, 64


def terms_of(word: str) -> list[str]:
    """The word itself and its beginnings, which carry a ``*``."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


class _Lookup(dict):
    """For each word the places of its terms; bounded."""

    def __init__(self, terms: tuple[str, ...]):
        super().__init__()
        self.places = {t: i for i, t in enumerate(terms)}

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = tuple(self.places[t] for t in terms_of(word) if t in self.places)
        if len(word) <= LONGEST_KEPT:
            if len(self) >= MAX_WORDS:
                self.clear()
            self[word] = found
        return found


_lookups: dict[tuple, _Lookup] = {}


def present(text: str, terms: tuple[str, ...]) -> tuple[dict[int, int], int]:
    """How often each term (by place) that the text holds occurs, and the number of words."""
    lookup = _lookups.get(terms)
    if lookup is None:
        lookup = _lookups[terms] = _Lookup(terms)
    words = WORD.findall(text.lower())
    found: dict[int, int] = {}
    for w, n in Counter(words).items():
        for at in lookup[w]:
            found[at] = found.get(at, 0) + n
    return found, len(words)


def extras(found: dict[int, int], n_words: int) -> list[float]:
    """Log counts of distinct terms and of their occurrences, and occurrences in 100 words (at most 10)."""
    occurrences = sum(found.values())
    return [math.log1p(len(found)), math.log1p(occurrences), min(10.0, 100.0 * occurrences / max(20, n_words))]


@dataclass(frozen=True)
class ToxicityChain:
    """Terms, and for each category in chain order: name, weights over terms, extras and earlier probabilities, intercept."""

    terms: tuple[str, ...]
    links: tuple[tuple[str, tuple[float, ...], float], ...]

    def matrix(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Weights by (feature, link), intercepts, and each link's weights of earlier probabilities."""
        width = len(self.terms) + EXTRA
        weights = np.array([w[:width] for _, w, _ in self.links]).reshape(len(self.links), width).T
        return weights, np.array([b for _, _, b in self.links]), [np.array(w[width:]) for _, w, _ in self.links]

    def probabilities(self, texts: list[str]) -> list[list[float]]:
        """For each text one probability for each category, in chain order."""
        weights, intercepts, chained = self.matrix()
        out = []
        for text in texts:
            found, n_words = present(text, self.terms)
            totals = intercepts + weights[list(found)].sum(axis=0) + np.array(extras(found, n_words)) @ weights[len(self.terms) :]
            known: list[float] = []
            for total, earlier in zip(totals.tolist(), chained):
                total += sum(p * w for p, w in zip(known, earlier))
                known.append(1.0 / (1.0 + math.exp(-min(60.0, max(-60.0, total)))))
            out.append(known)
        return out


def telling_terms(sample: DataFrame, folds: int, max_terms: int, least_ratio: float = 30.0, least_docs: int = 4) -> list[list[str]]:
    """The terms of (_text, _label, fold) rows that label 1 favours most, by log-likelihood ratio: of all rows, then of all but each fold.

    Partial counts are formed in tasks; the bounded winners of each choice come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, bool], Counter] = {}
        for batch in batches:
            for text, label, fold in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                of = counts.setdefault((fold, label > 0), Counter())
                of.update({t for w in set(WORD.findall((text or "").lower())) for t in terms_of(w)})
        for (fold, label), of in counts.items():
            terms = list(of)
            for i in range(0, len(terms), 50_000):
                cut = terms[i : i + 50_000]
                n, zero = pa.array([of[t] for t in cut], pa.int64()), pa.array([0] * len(cut), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(cut, pa.string()), pa.array([fold] * len(cut), pa.int32()), n if label else zero, zero if label else n], ["term", "fold", "pos", "neg"])

    partial = sample.select("_text", "_label", "fold").mapInArrow(run, "term string, fold int, pos long, neg long")
    apart = lambda c, f: F.sum(F.when(F.col("fold") != f, F.col(c)).otherwise(0)).alias(f"{c}{f}")
    counted = materialize(partial.groupBy("term").agg(*[apart(c, f) for f in range(-1, folds) for c in ("pos", "neg")]).filter(F.col("pos-1") >= least_docs), "toxicity-terms")
    rows = sample.agg(*[F.sum(F.when(F.col("fold") != f, F.col("_label")).otherwise(0.0)) for f in range(-1, folds)], *[F.count(F.when(F.col("fold") != f, 1)) for f in range(-1, folds)]).first()
    chosen = []
    for k, f in enumerate(range(-1, folds)):
        n_pos, n_all = rows[k] or 0.0, rows[folds + 1 + k]
        if not 0 < n_pos < n_all:
            chosen.append([])
            continue
        share, pos, neg = float(n_pos) / n_all, F.col(f"pos{f}"), F.col(f"neg{f}")
        total = pos + neg
        ratio = 2 * (pos * F.log(pos / (total * F.lit(share))) + F.when(neg > 0, neg * F.log(neg / (total * F.lit(1 - share)))).otherwise(0.0))
        telling = counted.filter((pos >= least_docs) & (pos > total * F.lit(share))).withColumn("ratio", ratio).filter(F.col("ratio") >= least_ratio)
        chosen.append([r[0] for r in telling.orderBy(F.col("ratio").desc(), "term").limit(max_terms).select("term").collect()])
    discard(counted)
    return chosen


def fit_toxicity(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", keep: tuple[str, ...] = (), max_rows: int = 16_000, max_terms: int = 400, folds: int = 3, regularisation: float = 0.002) -> ToxicityChain:
    """Fit on the documents of at most ``max_rows`` labelled rows (those whose id hashes lowest).

    ``categories``: name to a boolean column over ``_label`` (1.0 or 0.0) and the columns of ``docs`` named in ``keep``,
    in chain order; nulls count as false. A category of which all rows or none are members gets a constant. Without rows:
    0 throughout. A row with several labels counts once for each.

    A fold's out-of-fold probabilities come from models whose terms, too, were chosen without the fold.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    fold = F.pmod(F.xxhash64(F.lit("fold"), "_id"), F.lit(folds)).cast("int").alias("fold")
    sample = labelled_sample(docs, labels, id_col, label_col, text_col, max_rows, keep)
    names = list(categories)
    targets = [F.coalesce(c, F.lit(False)).cast("double").alias(f"_y{k}") for k, c in enumerate(categories.values())]
    sample = materialize(sample.select("_id", "_text", "_label", fold, *targets), "toxicity-sample")
    n = sample.count()
    choices = telling_terms(sample, folds, max_terms)
    every = tuple(sorted({t for terms in choices for t in terms}))
    place = {t: i for i, t in enumerate(every)}
    #: Features of each choice: its terms, then its own extras, which follow all terms.
    columns = [[place[t] for t in terms] + [len(every) + EXTRA * k + i for i in range(EXTRA)] for k, terms in enumerate(choices)]
    width = len(every) + EXTRA * len(choices)
    own = [frozenset(c[:-EXTRA]) for c in columns]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                found, n_words = present(text or "", every)
                row = [0.0] * width
                for at in found:
                    row[at] = 1.0
                row[len(every) :] = [x for mine in own for x in extras({a: m for a, m in found.items() if a in mine}, n_words)]
                rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), *(batch.column(1 + k) for k in range(len(names) + 1))], ["x", "fold", *(f"_y{k}" for k in range(len(names)))])

    ys = ", ".join(f"_y{k} double" for k in range(len(names)))
    rows = materialize(sample.select("_text", "fold", *[f"_y{k}" for k in range(len(names))]).mapInArrow(features, f"x array<double>, fold int, {ys}"), "toxicity-features")
    frame, held = rows.coalesce(4).withColumn("x", array_to_vector("x")), []
    links, earlier = [], []
    for k, name in enumerate(names):
        frame = frame.cache()
        held.append(frame)
        ones = frame.agg(F.sum(f"_y{k}")).first()[0] or 0.0
        if not n or ones in (0.0, float(n)):
            links.append((name, (0.0,) * (len(columns[0]) + len(earlier)), 60.0 if n and ones else -60.0))
            frame = frame.withColumn(f"_p{k}", F.lit(1.0 if n and ones else 0.0))
        else:
            trainer = LogisticRegression(labelCol=f"_y{k}", regParam=regularisation, maxIter=30, standardization=False)

            def ready(rows: DataFrame, choice: int) -> DataFrame:
                chosen = VectorSlicer(inputCol="x", outputCol="_chosen", indices=columns[choice]).transform(rows)
                return VectorAssembler(inputCols=["_chosen", *earlier], outputCol="features").transform(chosen)  # noqa: B023

            fitted = trainer.fit(ready(frame, 0))
            links.append((name, tuple(map(float, fitted.coefficients)), float(fitted.intercept)))
            if k + 1 < len(names):
                parts = []
                for f in range(folds):
                    apart, asked = ready(frame.filter(F.col("fold") != f), f + 1), ready(frame.filter(F.col("fold") == f), f + 1)
                    seen = {r[0] for r in apart.select(f"_y{k}").distinct().collect()}
                    if len(seen) == 2:
                        told = trainer.fit(apart).transform(asked).withColumn(f"_p{k}", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
                    else:
                        told = asked.withColumn(f"_p{k}", F.lit(max(seen, default=0.0)))
                    parts.append(told.drop("_chosen", "features"))
                frame = reduce(DataFrame.unionByName, parts)
        earlier.append(f"_p{k}")
    for one in held:
        one.unpersist()
    for one in (sample, rows):
        discard(one)
    return ToxicityChain(tuple(choices[0]), tuple(links))


def toxicity_column(model: ToxicityChain, text: Column) -> Column:
    """An array of one probability for each category, in chain order; a null text counts as empty."""

    @F.arrow_udf("array<double>")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.probabilities([t or "" for t in texts.to_pylist()]), pa.list_(pa.float64()))

    return score(text)


def score_toxicity(docs: DataFrame, model: ToxicityChain, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per row: id, p_<category> for each, toxic (the last category's probability >= threshold). Whole texts, no shuffle.

    Null and empty texts have no words. Repeated rows repeat; other columns are not read; an empty table gives an empty one.
    """
    bounded_batches(docs.sparkSession)
    scored = docs.select(F.col(id_col).alias("_id"), toxicity_column(model, F.col(text_col)).alias("_p"))
    names = [name for name, _, _ in model.links]
    return scored.select(F.col("_id").alias(id_col), *[F.get("_p", F.lit(k)).alias(f"p_{name}") for k, name in enumerate(names)], (F.get("_p", F.lit(len(names) - 1)) >= threshold).alias("toxic"))


def drop_toxic(docs: DataFrame, model: ToxicityChain, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose last category has a probability under the threshold, with their own columns; nulls as in score_toxicity()."""
    bounded_batches(docs.sparkSession)
    return docs.filter(F.get(toxicity_column(model, F.col(text_col)), F.lit(len(model.links) - 1)) < threshold)
