"""Quality classifier: a sparse rule ensemble compiled into Spark column expressions.

Tree paths over text statistics become conjunctive rules; a lasso logistic regression keeps few of them; what is left
is one column expression, so scoring is a projection that Spark compiles, with no shuffle and no Python.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, labelled_sample, materialize

#: A condition of a rule: statistic, whether it must be above the threshold, threshold.
Condition = tuple[str, bool, float]
WHITE = "[ \t\n\x0b\f\r]+"


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text, every one finite for null, empty and blank texts too."""
    t = F.coalesce(text, F.lit(""))
    chars = F.length(t)
    words = F.filter(F.split(t, WHITE), lambda w: w != "")
    per = lambda x: x / F.greatest(chars, F.lit(1))
    drop = lambda pattern: chars - F.length(F.regexp_replace(t, pattern, ""))
    return {
        "log_chars": F.log1p(chars.cast("double")),
        "upper": per(drop("\\p{Lu}+")),
        "symbols": per(drop("[*#%$&|<>{}\\[\\]=+~^_@\\\\]+")),
        "bars": per(drop("[|]+")),
        "bangs": per(drop("[!?]+")),
        "digits": per(drop("[0-9]+")),
        "lines": per(drop("\n+")),
        "n_words": F.size(words).cast("double"),
        "word_chars": (chars - F.size(words)) / F.greatest(F.size(words), F.lit(1)),
        "distinct": F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1)),
    }


@dataclass(frozen=True)
class RuleEnsemble:
    """Weighted rules and an intercept; ``score`` is their logistic sum."""

    intercept: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]

    def score(self, columns: dict[str, Column]) -> Column:
        """The column expression of the score over statistics columns, from 0 to 1."""
        fires = lambda rule: reduce(lambda a, b: a & b, [columns[s] > v if above else columns[s] <= v for s, above, v in rule])
        total = reduce(lambda a, b: a + b, [F.when(fires(rule), F.lit(w)).otherwise(F.lit(0.0)) for rule, w in self.rules], F.lit(self.intercept))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def tree_paths(node, names: list[str], path: tuple[Condition, ...] = ()) -> list[tuple[Condition, ...]]:
    """Every path from a tree's root to a node below it, as conditions; a later bound on the same side replaces an earlier one."""
    found = [path] if path else []
    if node.subtreeDepth():
        split = node.split()
        name, at = names[split.featureIndex()], split.threshold()
        for above, child in ((False, node.leftChild()), (True, node.rightChild())):
            kept = tuple(c for c in path if (c[0], c[1]) != (name, above))
            found += tree_paths(child, names, tuple(sorted((*kept, (name, above, at)))))
    return found


def fit_quality(docs: DataFrame, labels: DataFrame, label_col: str = "label", id_col: str = "doc_id", text_col: str = "text", max_rows: int = 12_000, trees: int = 12, depth: int = 3, lasso: float = 0.0005, seed: int = 7) -> RuleEnsemble:
    """Fit on the documents of at most ``max_rows`` rows of ``labels`` (those whose id hashes lowest, so always the same).

    Rows with a null label are left out. Without rows, or with labels of one kind, the result is a constant score:
    the share of label 1, or 0.5.
    """
    names = list(statistics(F.col(text_col)))
    sample = labelled_sample(docs, labels, id_col, label_col, text_col, max_rows)
    train = materialize(sample.select("_label", *[c.alias(n) for n, c in statistics(F.col("_text")).items()]), "quality-train")
    n, ones = train.agg(F.count("*"), F.sum("_label")).first()
    if not n or ones in (0.0, float(n)):
        share = 0.5 if not n else min(max(ones / n, 1e-3), 1 - 1e-3)
        discard(train)
        return RuleEnsemble(math.log(share / (1 - share)), ())
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(train).coalesce(4).cache()
    forest = RandomForestClassifier(labelCol="_label", numTrees=trees, maxDepth=depth, seed=seed, maxBins=64, subsamplingRate=0.7, featureSubsetStrategy="0.7").fit(vectors)
    rules = sorted({p for t in forest.trees for p in tree_paths(t._call_java("rootNode"), names)})
    fires = [reduce(lambda a, b: a & b, [F.col(s) > v if above else F.col(s) <= v for s, above, v in r]).cast("double") for r in rules]
    names_of_rules = [f"_r{k}" for k in range(len(rules))]
    columns = train.coalesce(4).select("_label", *[f.alias(name) for f, name in zip(fires, names_of_rules)])
    matrix = VectorAssembler(inputCols=names_of_rules, outputCol="features").transform(columns).select("_label", "features").cache()
    fitted = LogisticRegression(labelCol="_label", elasticNetParam=1.0, regParam=lasso, maxIter=60, standardization=False).fit(matrix)
    kept = tuple((r, float(w)) for r, w in zip(rules, fitted.coefficients) if w)
    vectors.unpersist()
    matrix.unpersist()
    discard(train)
    return RuleEnsemble(float(fitted.intercept), kept)


def score_quality(docs: DataFrame, model: RuleEnsemble, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if score >= threshold); columns of these names are replaced, all others stay.

    Null and empty texts get the score of their (zero) statistics. Repeated rows repeat; an empty table gives an empty one.
    """
    stats = statistics(F.col(text_col))
    used = sorted({s for rule, _ in model.rules for s, _, _ in rule})
    own = docs.drop(*[c for c in docs.columns if c.lower() in ("score", "predicted")])
    packed = own.select(F.struct(*[F.col(f"`{c}`") for c in own.columns]).alias("row"), F.struct(F.lit(0).alias("none"), *[stats[s].cast("double").alias(s) for s in used]).alias("stats"))
    scored = packed.select("row", model.score({s: F.col("stats")[s] for s in used}).alias("score"))
    return scored.select("row.*", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: RuleEnsemble, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score at or over the threshold, with their own columns only."""
    return docs.filter(model.score({name: stat.cast("double") for name, stat in statistics(F.col(text_col)).items()}) >= threshold)
