"""Quality rules whose cutoffs are chosen with a guarantee on false rejection.

Each rule compares one measure of a text with a cutoff. Documents labelled good in the holdout tell how many good ones
the rules would reject. A vector of cutoffs, one a rule, is allowed where the exact binomial bound shows, at the wanted
confidence, that at most a stated share of the good documents of its stratum is rejected by any of its rules. Per stratum
one sequence of vectors, fixed beforehand, is tested from the mildest on and testing stops at the first that fails
(fixed-sequence testing), so neither steps nor rules need a correction; over strata the error rate is divided
(Bonferroni). With four strata 217 good documents of which none is rejected are enough. A stratum without enough gets
no cutoffs and loses nothing.

Everything is built-in functions: no shuffle touches a text, the shuffles hold counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fundtrace.llm.native import SPACE, let
from fundtrace.llm.store import documents, prepare, table

FALSE_REJECTION = 0.02  # share of good documents of a stratum all its rules together may reject
ERROR_RATE = 0.05  # probability that any stratum exceeds it
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"



def _rules() -> dict[str, tuple[Column, list[float]]]:
    chars, count = F.greatest(F.col("word_chars"), F.lit(1)), F.greatest(F.col("n_words"), F.lit(1))
    shares = [x / 100 for x in (60, 50, 40, 35, 30, 25, 20, 17, 15, 13, 11, 9, 7, 5, 4, 3, 2, 1)]
    return {
        "symbols": (F.col("n_symbols") / chars, shares),
        "duplicate_lines": (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), [0.9, 0.8, 0.7, *shares]),
        "repeated_words": (F.col("n_repeat_words") / count, [0.9, 0.8, 0.7, *shares]),
        "long_words": (F.col("word_chars") / count, [float(x) for x in (100, 50, 30, 25, 20, 18, 16, 14, 13, 12, 11, 10)]),
    }


def _repeat_words(w: Column) -> Column:
    """Words that lie in a 3-word window found twice or more."""

    def windows(ws: Column) -> Column:
        last = F.size(ws) - 2
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.get(ws, i - 1), F.get(ws, i), F.get(ws, i + 1)))

    def places(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))

        def repeated(s: Column) -> Column:
            twice = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
            return F.sort_array(F.transform(twice, lambda x: x["at"]))

        return let(ordered, lambda s: let(repeated(s), covered))

    def covered(at: Column) -> Column:
        # Each window adds the words up to the next one's start, three at most.
        steps = F.transform(at, lambda x, i: F.coalesce(F.least(F.get(at, i + 1) - x, F.lit(3)), F.lit(3)))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def count(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(places(hashes))

    return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(windows(w), count))


def measures(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``keep``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines of every row; null counts as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    body = F.trim(text, F.lit(_SPACES))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(_SPACES)) != "")
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *keep,
        F.length(F.translate(text, _SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("all"), F.size(F.array_distinct(x)).alias("own"))).alias("lines"),
        let(
            F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, SPACE)),
            lambda w: F.struct(F.size(w).alias("words"), _repeat_words(w).alias("repeated")),
        ).alias("counts"),
    )
    return base.select(
        "doc_id",
        *keep,
        F.col("counts.words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.col("lines.all") - F.col("lines.own")).cast("long").alias("n_dup_lines"),
        F.col("counts.repeated").cast("long").alias("n_repeat_words"),
        F.col("lines.all").cast("long").alias("n_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def most_rejections(n: Column, share: float, error: Column) -> Column:
    """The largest k for which k of n rejected show, with error at most ``error``, a rate of at most ``share``; -1 if none.

    That is: P(Bin(n, share) <= k) <= error, the exact bound of Clopper and Pearson. The probabilities come one from the
    other, as logarithms so that none underflows before the sum needs it; ``n * share`` steps suffice, as
    half of the distribution lies below its mean.
    """
    log_odds = F.log(F.lit(share / (1 - share)))
    begin = F.struct(
        (n * F.log(F.lit(1 - share))).alias("term"), F.lit(0.0).cast("double").alias("total"), F.lit(-1).cast("long").alias("k"), F.lit(False).alias("over")
    )

    def step(acc: Column, k: Column) -> Column:
        total = acc["total"] + F.exp(acc["term"])
        fits = ~acc["over"] & (total <= error)
        return F.struct(
            (acc["term"] + F.log((n - k) / (k + 1)) + log_odds).alias("term"), total.alias("total"),
            F.when(fits, k).otherwise(acc["k"]).alias("k"), (~fits).alias("over"),
        )

    steps = F.sequence(F.lit(0).cast("long"), F.floor(n * share).cast("long"))
    return F.when(n > 0, F.aggregate(steps, begin, step, lambda acc: acc["k"])).otherwise(F.lit(-1).cast("long"))


def sequence_of_cutoffs() -> list[dict[str, float]]:
    """The vectors in the order they are tested: each rule goes through all its cutoffs, mildest first, at an even pace."""
    rules = _rules()
    steps = max(len(cuts) for _, cuts in rules.values())
    return [{name: cuts[step * len(cuts) // steps] for name, (_, cuts) in rules.items()} for step in range(steps)]


def cutoffs(measured: DataFrame, labels: DataFrame, stratum: str, false_rejection: float = FALSE_REJECTION, error_rate: float = ERROR_RATE) -> DataFrame:
    """(stratum, n, cut_<rule>...): the strictest allowed vector of cutoffs, nulls where none is.

    ``measured`` holds the measures of all documents; those labelled 1 that pass the base rules are the ``n`` good ones.
    """
    rules, vectors = _rules(), sequence_of_cutoffs()
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    held = measured.join(good, "doc_id", "left_semi").filter(~F.col("base_failed"))

    def rejected(vector: dict[str, float]) -> Column:
        return reduce(lambda a, b: a | b, [rules[name][0] > cut for name, cut in vector.items()]).cast("long")

    counts = [F.count(F.lit(1)).alias("n"), F.array(*(F.sum(rejected(v)) for v in vectors)).alias("rejected")]
    strata = table(held.groupBy(F.col(stratum).alias("stratum")).agg(*counts))
    tests = strata.withColumn("error", F.lit(error_rate) / F.count(F.lit(1)).over(Window.partitionBy()))
    tests = tests.withColumn("most", most_rejections(F.col("n"), false_rejection, F.col("error")))
    fails = F.array_position(F.transform("rejected", lambda k: k > F.col("most")), True)
    last = F.when(fails == 0, len(vectors)).otherwise(fails - 1).cast("int")
    chosen = [F.get(F.array(*(F.lit(v[name]) for v in vectors)), last - 1).alias(f"cut_{name}") for name in rules]
    return tests.select("stratum", "n", *chosen)


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", false_rejection: float = FALSE_REJECTION, error_rate: float = ERROR_RATE) -> DataFrame:
    """doc_id, the measures, base_failed and kept, for every row of ``docs`` (doc_id, text, ``stratum``).

    Null and empty texts have no words and fail the base rules. A null stratum is a stratum. Repeated rows are
    judged each, labels given twice count once, null labels and ids are ignored, other columns are not read;
    an empty table gives no rows. Without labels nothing is rejected beyond the base rules.
    """
    prepare(docs.sparkSession)
    kept = docs.withColumn("stratum_", F.coalesce(F.col(stratum).cast("string"), F.lit("")))
    measured = table(measures(kept, ("stratum_",)).withColumn("base_failed", base_failed()))
    chosen = table(cutoffs(measured, labels, "stratum_", false_rejection, error_rate))
    passes = F.lit(True)
    for name, (measure, _) in _rules().items():
        passes = passes & F.coalesce(measure <= F.col(f"cut_{name}"), F.lit(True))
    # A row per stratum, from a table whose size Spark knows.
    judged = measured.join(chosen.drop("n"), F.col("stratum_") == F.col("stratum"), "left")
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & passes).alias("kept")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir, "doc_id", "text", "lang"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
