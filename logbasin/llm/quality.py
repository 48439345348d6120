"""Quality classifier: a sparse ensemble of rules over text statistics.

A small forest is grown on the statistics of labelled texts. Every path from a root
to a node is a rule, a conjunction of conditions. A logistic regression with an L1
penalty weighs all rules and leaves most at zero. The rules that stay are compiled
into one Spark expression, so scoring is a projection: no model object, no Python.

Training takes at most ``max_rows`` labelled rows, drawn by a hash of doc_id; every
text is scored whole. Labels, lang, source and doc_id are no statistics.

Defined results: a null text is scored as an empty one; rows without a label, or with
one that is null, are not trained on; repeated rows and labels are used as they come;
with labels of one kind only the score is their share (0.5 without any); empty tables
give empty results; extra columns pass through ``filter_good``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logbasin.llm import forest
from logbasin.llm.common import SPACES, UPPER, fresh_name, stage

MAX_ROWS, TREES, DEPTH, PENALTY, THRESHOLD, SEED = 20_000, 20, 3, 0.002, 0.3, 5


def split_words(text: Column) -> Column:
    return F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES)), "[\\x20\\x09-\\x0D]+")


SYMBOLS, STOPS, DIGITS = "#$%&*@^~<>{}[]\\=+_", ".;:?", "0123456789"


def classed(text: Column) -> Column:
    """The text with one letter for each class of marks, so that a class is counted by removing that letter."""
    kinds = (SYMBOLS, STOPS, DIGITS, UPPER)
    return F.translate(F.coalesce(text, F.lit("")), "".join(k[1:] for k in kinds), "".join(k[0] * (len(k) - 1) for k in kinds))


def statistics(marks: Column, words: Column) -> dict[str, Column]:
    """Figures of a whole text, all 0 for an empty one, from columns of ``classed`` and ``split_words``, each made once."""
    chars = F.char_length(marks).cast("double")
    n = F.when(words[0] == "", 0).otherwise(F.size(words)).cast("double")
    part = lambda a, b: F.when(b > 0, a / b).otherwise(0.0).cast("double")
    number = lambda mark: chars - F.char_length(F.replace(marks, F.lit(mark), F.lit("")))
    return {
        "log_words": F.log1p(n),
        "word_length": part(chars, n),
        "symbols": part(number(SYMBOLS[0]), n),
        "bars": part(number("|"), n),
        "shouts": part(number("!"), n),
        "stops": part(number(STOPS[0]), n),
        "digits": part(number(DIGITS[0]), chars),
        "capitals": part(number(UPPER[0]), chars),
        "distinct": part(F.size(F.array_distinct(words)).cast("double"), n),
        "lines": part(number("\n"), n),
    }


STATISTICS = [
    "log_words", "word_length", "symbols", "bars", "shouts", "stops", "digits", "capitals", "distinct", "lines",
]


@dataclass(frozen=True)
class Rules:
    """Weighted rules; ``score`` is the compiled expression over columns named like the statistics."""

    intercept: float
    weights: tuple[tuple[tuple, float], ...] = ()
    constant: float | None = None

    def score(self) -> Column:
        if self.constant is not None:
            return F.lit(self.constant)
        features = [F.col(f"`{_name(c)}`") for c in STATISTICS]
        total = F.lit(self.intercept)
        for path, weight in self.weights:
            total = total + F.when(forest.rule(path, features), F.lit(weight)).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def _name(statistic: str) -> str:
    return f"__q_{statistic}"


def with_statistics(docs: DataFrame) -> DataFrame:
    words, marks = fresh_name(docs, "text_words"), fresh_name(docs, "text_marks")
    once = docs.withColumns({words: split_words(F.col("text")), marks: classed(F.col("text"))})
    return once.withColumns({_name(c): v for c, v in statistics(F.col(marks), F.col(words)).items()}).drop(words, marks)


def is_held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def fit(measured: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> Rules:
    """Rules from statistics (``with_statistics``) and labels (doc_id, quality) of rows that are not held out."""
    given = labels.where("quality is not null").select(F.col("doc_id").alias("_labelled"), F.col("quality").cast("double").alias("label"))
    rows = measured.where(~is_held_out(F.col("doc_id"))).join(given, F.col("doc_id") == F.col("_labelled"))
    rows = rows.select("doc_id", "label", *[F.col(_name(c)) for c in STATISTICS])
    drawn = rows.orderBy(F.xxhash64(F.lit(SEED), "doc_id")).limit(max_rows)
    drawn = stage(drawn.withColumn("features", array_to_vector(F.array(*[_name(c) for c in STATISTICS]))), "quality-sample")
    kinds = {r.label: r["count"] for r in drawn.groupBy("label").count().collect()}
    if len(kinds) < 2:
        return Rules(0.0, constant=float(next(iter(kinds), 0.5)))
    grown = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, subsamplingRate=0.7, featureSubsetStrategy="0.5").fit(drawn)
    rules = sorted(set().union(*map(forest.paths, forest.trees(grown))))
    features = [F.col(_name(c)) for c in STATISTICS]
    held = F.array(*[forest.rule(r, features).cast("double") for r in rules])
    by_rule = stage(drawn.select("label", array_to_vector(held).alias("features")), "quality-rules")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60, tol=1e-4).fit(by_rule)
    weights = tuple((r, float(w)) for r, w in zip(rules, lasso.coefficients, strict=True) if w)
    return Rules(float(lasso.intercept), weights)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row. Texts are read once; the rest works on their figures."""
    measured = stage(with_statistics(docs.select("doc_id", "text")).drop("text"), "quality-statistics")
    rules = fit(measured, labels)
    scored = measured.select("doc_id", F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), rules.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def filter_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score at least ``threshold``, with their columns. The filter is a projection over the texts."""
    measured = stage(with_statistics(docs.select("doc_id", "text")).drop("text"), "quality-statistics")
    rules = fit(measured, labels)
    score = fresh_name(docs, "quality_score")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # Behind a generator the filter sees only the score: else it would hold the statistics once for every rule.
    scored = with_statistics(docs).select(*columns, F.explode(F.array(rules.score())).alias(score))
    return scored.where(F.col(score) >= threshold).select(*columns)
