"""Secret scan: candidates, figures about them, and a random forest that removes false positives.

A candidate is a run of at least ``MIN_CHARS`` characters that keys and tokens are made
of. A finding is a candidate in a document. Each of its occurrences is scored by its own
neighbourhood; the finding has the highest score, the neighbourhood that goes with it (of
equals the first) and the number of occurrences. Its label is 1 if an occurrence's is and
0 if all are; occurrences without a label in a finding that isn't 0 are not trained on.
The forest is grown on labelled occurrences (at most
``max_rows`` of each kind, drawn by hash) from the candidate's length, character
transitions, coverage by the corpus's dictionary, the path it stands in and its
neighbouring words, and is compiled into one column expression. Only DataFrame
functions are used on the way of the texts.

The dictionary: words of letters that at least ``MIN_SEEN`` findings have beside them are
cut into trigrams; the ``DICTIONARY`` most frequent trigrams are the dictionary, a fixed
bound on what the driver sees and the expression holds.

Defined results: null and empty texts have no findings; a candidate that repeats in a
row is one finding; rows that repeat have findings each; candidates of any length are
kept whole; with labels of one kind only the score is their share (0.0 without any);
empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logbasin.llm import forest
from logbasin.llm.common import lower_ascii, stage

MIN_CHARS, AROUND, DICTIONARY, MIN_SEEN, MAX_ROWS, SEED = 16, 48, 2000, 3, 10_000, 3
CANDIDATE = f"[A-Za-z0-9+/_=-]{{{MIN_CHARS},}}+"
KEY_WORDS = "token|secret|password|passwd|pwd|apikey|api_key|access_key|private|auth|bearer|credential"


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, row, place, candidate, before, after): one row for each occurrence, the text left behind.

    ``row`` tells repeated documents apart. Candidates have sixteen characters at least and one between them, so three of
    them and what lies between are more than a neighbourhood; the text is read once, however many candidates it holds.
    """
    found, between = F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)), F.split("text", CANDIDATE, -1)
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), found.alias("found"), between.alias("between")).where(F.size("found") > 0)
    part = lambda name, i: F.coalesce(F.get(F.col(name), i), F.lit(""))

    def occurrence(c: Column, i: Column) -> Column:
        before = F.concat(*[x for k in (3, 2, 1) for x in (part("found", i - k), part("between", i - k + 1))])
        after = F.concat(*[x for k in (1, 2, 3) for x in (part("between", i + k), part("found", i + k))])
        return F.struct(i.alias("place"), c.alias("candidate"), F.right(before, F.lit(AROUND)).alias("before"), F.left(after, F.lit(AROUND)).alias("after"))

    return rows.select("doc_id", "row", F.inline(F.transform("found", occurrence)))


def dictionary(found: DataFrame, size: int = DICTIONARY) -> list[str]:
    """The most frequent trigrams of the words beside findings; at most ``size`` of them come to the driver."""
    beside = F.regexp_extract_all(lower_ascii(F.concat_ws(" ", "before", "after")), F.lit(r"(?<![a-z0-9])[a-z]{4,14}(?![a-z0-9])"), F.lit(0))
    words = found.select(F.explode(beside).alias("word")).groupBy("word").count().where(F.col("count") >= MIN_SEEN)
    trigrams = words.select("count", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("word") - 2), lambda i: F.substr("word", i, F.lit(3)))).alias("t"))
    best = trigrams.groupBy("t").agg(F.sum("count").alias("n")).orderBy(F.desc("n"), "t").limit(size)
    return sorted(r.t for r in best.collect())


FIGURES = [
    "length", "class_changes", "case_changes", "digits", "upper", "hex_only", "distinct_chars", "marks", "coverage",
    "in_path", "key_word_before", "assigned", "quoted", "digits_around", "words_around", "occurrences_log",
]


def figures(trigrams: list[str]) -> dict[str, Column]:
    """What the forest sees of a finding."""
    c, before, after = F.col("candidate"), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))
    n = F.char_length(c).cast("double")
    share = lambda marks: (n - F.char_length(F.translate(c, marks, ""))) / n
    places = F.sequence(F.lit(1), F.char_length(c) - 2)
    in_dictionary = F.filter(places, lambda i: F.lower(F.substr(c, i, F.lit(3))).isin(trigrams)) if trigrams else F.array()
    beside = lower_ascii(F.concat(before, F.lit(" "), after))
    number = lambda x: x.cast("double")
    return {
        "length": n,
        "class_changes": F.regexp_count(c, F.lit("(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")) / n,
        "case_changes": F.regexp_count(c, F.lit("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])")) / n,
        "digits": share("0123456789"),
        "upper": share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "hex_only": number(c.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "distinct_chars": F.size(F.array_distinct(F.split(c, ""))) / n,
        "marks": share("+/_=-"),
        "coverage": F.size(in_dictionary) / (n - 2),
        "in_path": number(before.rlike(r"[/\\.]$|://\S*$") | c.contains("/")),
        "key_word_before": number(lower_ascii(before).rlike(f"(?:{KEY_WORDS})\\W{{0,8}}$")),
        "assigned": number(before.rlike("[=:]\\s*[\"'`]?$")),
        "quoted": number(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
        "digits_around": F.regexp_count(beside, F.lit("[0-9]")).cast("double"),
        "words_around": F.regexp_count(beside, F.lit("(?<![a-z0-9])[a-z]{2,12}(?![a-z0-9])")).cast("double"),
        "occurrences_log": F.log1p("occurrences"),
    }


def measured(found: DataFrame, trigrams: list[str]) -> DataFrame:
    return found.select("*", *[v.cast("double").alias(f"f_{k}") for k, v in figures(trigrams).items()])


def fit(labelled: DataFrame, max_rows: int = MAX_ROWS, trees: int = 20, depth: int = 5) -> Column:
    """The score as an expression over the figures, from findings with a ``label`` of 0 or 1."""
    known = labelled.where("label is not null").select(F.col("label").cast("double").alias("label"), "doc_id", "candidate", "before", "after", *[f"f_{k}" for k in FIGURES])
    kinds = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    if len(kinds) < 2:
        return F.lit(float(next(iter(kinds), 0.0)))
    parts = [known.where(F.col("label") == k).orderBy(F.xxhash64(F.lit(SEED), "doc_id", "candidate"), "before", "after").limit(max_rows) for k in kinds]
    drawn = parts[0].unionByName(parts[1]).select("label", array_to_vector(F.array(*[f"f_{k}" for k in FIGURES])).alias("features"))
    drawn = stage(drawn, "secret-sample")
    grown = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED).fit(drawn)
    return forest.share_of_votes(forest.trees(grown), [F.col(f"f_{k}") for k in FIGURES])


def weak_labels(found: DataFrame) -> DataFrame:
    """Labels by a strict reading, for lack of people's: 32 or 40 hex digits in quotes, assigned to a key word, are secrets.

    A candidate that no key word, quote or assignment stands before is none. All others stay unlabelled.
    """
    before = lower_ascii(F.coalesce("before", F.lit("")))
    is_key = before.rlike(f"(?:{KEY_WORDS})\\s*[=:]\\s*[\"']$")
    shape = F.col("candidate").rlike("^(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40})$")
    nothing = ~before.rlike(f"{KEY_WORDS}|[=:\"'`]")
    return found.withColumn("label", F.when(is_key & shape, F.lit(1)).when(nothing, F.lit(0)))


def scan(docs: DataFrame, labelled_rows: Column | None = None, label=weak_labels, threshold: float = 0.5) -> DataFrame:
    """Every finding with score and verdict. ``labelled_rows`` marks the documents whose labelled findings are trained on."""
    each = stage(candidates(docs), "secret-occurrences")
    finding = Window.partitionBy("row", "candidate")
    found = stage(each.withColumn("occurrences", F.count(F.lit(1)).over(finding)), "secret-findings")
    trigrams = dictionary(found)
    rows = stage(measured(found, trigrams), "secret-figures")
    train = label(rows if labelled_rows is None else rows.where(labelled_rows))
    clean = F.min(F.coalesce((F.col("label") == 0).cast("int"), F.lit(0))).over(finding)
    score = fit(train.withColumn("label", F.when(F.col("label") == 1, F.lit(1)).when(clean == 1, F.lit(0))))
    highest = F.max(F.struct(score.alias("score"), (-F.col("place")).alias("place"), "before", "after")).alias("highest")
    scored = rows.groupBy("row", "doc_id", "candidate", "occurrences").agg(highest)
    return scored.select("doc_id", "candidate", "occurrences", "highest.before", "highest.after", "highest.score").withColumn("secret", F.col("score") >= threshold)
