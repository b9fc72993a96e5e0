"""Quality rules: plain counts of a text, and a ratio of likelihoods of its hashed n-grams.

Two multinomials over hash buckets are estimated: one of trusted target documents, one of the whole raw corpus. A
document's score is the mean over its n-grams of the log of the ratio of both. Terms that trusted documents use as often
as the corpus add nothing; those of junk, which the corpus has and the target lacks, add large negative numbers.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litquarry.llm.common import Workspace

BLANK = r"[\x20\x09-\x0D]+"
#: Characters that n_symbols counts.
SYMBOLS = r"[#*$%&|<>]"
#: Runs of ASCII punctuation are n-gram terms of their own.
MARKS = r"([!-/:-@\[-`{-~]+)"
#: Weights are whole numbers of 2**-20, so that a document's sum is the same in any order of its terms.
UNIT = 1 << 20
NONE = "array<int>"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK), "")


def terms_of(text: Column) -> Column:
    """Runs of ASCII punctuation and runs of other characters, both without blanks; case is kept."""
    return words_of(F.regexp_replace(text, MARKS, " $1 "))


def _tail(values: Column) -> Column:
    return F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))


def with_base_counts(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of the column ``text`` (no nulls).

    Windows of three words are compared by 64-bit hashes within their text. A text whose windows all differ is done at
    once; else hashes are sorted with their places, so that equal ones are neighbours, and the words that repeated
    windows cover are summed over the places in order: three each, less what the next one covers as well.
    """
    lines = F.filter(F.split(F.col(text), "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    window = lambda i: F.xxhash64(F.col("_words")[i], F.col("_words")[i + 1], F.col("_words")[i + 2])
    at = F.when(F.size("_words") >= 3, F.sequence(F.lit(0), F.size("_words") - 3)).otherwise(F.array().cast(NONE))
    same = F.zip_with("_placed", _tail(F.col("_placed")), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast(NONE)))
    step = F.zip_with("_places", _tail(F.col("_places")), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    return (
        rows.withColumns({"_words": words_of(F.col(text)), "_lines": lines})
        .withColumn("_windows", F.transform(at, window))
        .withColumn("_placed", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
        .withColumn("_places", F.when(F.col("_placed").isNotNull(), F.sort_array(F.array_distinct(F.flatten(same)))))
        .withColumns(
            {
                "n_words": F.size("_words").cast("long"),
                "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
                "n_symbols": (F.size(F.split(F.col(text), SYMBOLS, -1)) - 1).cast("long"),
                "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
                "n_repeat_words": F.coalesce(F.aggregate(step, F.lit(0), lambda total, x: total + x), F.lit(0)).cast("long"),
            }
        )
        .drop("_words", "_lines", "_windows", "_placed", "_places")
    )


def ngrams(rows: DataFrame, text: str, keep: list[str], buckets: int) -> DataFrame:
    """A row for each term of ``text``, with the columns ``keep``: ``first`` (true for one row of each text), the buckets ``one`` and ``two``.

    ``one`` is the bucket of the term and ``two`` that of the term with the next one; both are null for a text without
    terms, and ``two`` for a last term.
    """
    zipped = F.arrays_zip(F.col("_terms").alias("a"), _tail(F.col("_terms")).alias("b"))
    placed = rows.select(*keep, terms_of(F.col(text)).alias("_terms")).select(*keep, F.posexplode_outer(zipped).alias("_at", "_pair"))
    a, b = F.col("_pair.a"), F.col("_pair.b")
    bucket = lambda *terms: F.pmod(F.xxhash64(*terms), F.lit(buckets)).cast("int")
    return placed.select(
        *keep, (F.coalesce("_at", F.lit(0)) == 0).alias("first"), F.when(a.isNotNull(), bucket(a)).alias("one"), F.when(b.isNotNull(), bucket(a, b) + buckets).alias("two")
    )


def trusted_ids(labels: DataFrame, *, most: int, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(id): at most ``most`` ids all of whose labels are 1, those of smallest hash."""
    agreed = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("low"), F.max(label_col).alias("high"))
    return agreed.where("low = 1 and high = 1").select("id").orderBy(F.xxhash64("id"), "id").limit(most)


def fit_ratio(docs: DataFrame, trusted: DataFrame, *, buckets: int = 1 << 15, prior: float = 20.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, weight): the log of target over raw frequency of each bucket of terms and of pairs of terms, in units of 2**-20.

    ``trusted`` is (id), a bounded number of ids, and broadcast. Raw counts are of all of ``docs``, scaled to the size
    of the target; both then get ``prior`` occurrences, so that buckets of few terms weigh next to nothing. The model
    has at most two times ``buckets`` rows, whatever the corpus holds.
    """
    flagged = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(trusted.withColumn("target", F.lit(1))), "id", "left")
    grams = ngrams(flagged, "text", ["target"], buckets).select("target", F.explode(F.array("one", "two")).alias("bucket")).where("bucket is not null")
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("target").alias("target"))
    half = (F.col("bucket") >= buckets).alias("half")
    sizes = counts.groupBy(half).agg(F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"))
    scaled = F.col("raw") * F.col("all_target") / F.col("all_raw")
    ratio = F.log((F.col("target") + prior) / (scaled + prior))
    return counts.withColumn("half", half).join(F.broadcast(sizes), "half").select("bucket", F.round(ratio * UNIT).cast("long").alias("weight"))


def quality_rules(
    docs: DataFrame, labels: DataFrame, *, least_words: int = 50, most_repeated: int = 50, threshold: float = -0.25,
    buckets: int = 1 << 15, prior: float = 20.0, most_trusted: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> DataFrame:
    """Per row of ``docs``: the id, five base counts, base_failed, n_grams, score (mean log ratio) and kept.

    A row fails the base rules with fewer than ``least_words`` words, or with more than ``most_repeated`` of a hundred
    words in repeated windows. Another one is kept if its score is at least ``threshold``: no draw is made, every
    document is decided. The target is fitted on at most ``most_trusted`` labelled rows (see ``trusted_ids``), the raw
    distribution on all documents. Without trusted rows all weights are those of an empty target, 0.

    Null and empty texts have no words and fail. Rows that repeat an id are answered each, by their own text; null ids
    stay null and are never trusted. A very long text is a row like any other. An empty table gives no rows. Other
    columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "quality")
    weights = work.written(fit_ratio(docs, trusted_ids(labels, most=most_trusted, id_col=id_col, label_col=label_col), buckets=buckets, prior=prior, id_col=id_col, text_col=text_col), "weights")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    counted = with_base_counts(rows, "text").withColumn("copy", F.xxhash64("text"))
    grams = ngrams(counted, "text", ["id", "copy", *base], buckets)
    weight = lambda which: F.broadcast(weights.select(F.col("bucket").alias(which), F.col("weight").alias(f"w_{which}")))
    weighed = grams.join(weight("one"), "one", "left").join(weight("two"), "two", "left")
    # the same text under the same id has the same sums: they are taken together, and answered as often as it came
    summed = weighed.groupBy("id", "copy", *base).agg(
        F.sum(F.coalesce("w_one", F.lit(0)) + F.coalesce("w_two", F.lit(0))).alias("weight"), (F.count("one") + F.count("two")).alias("grams"), F.count_if("first").alias("times")
    )
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    found = summed.select(
        F.col("id").alias(id_col), *base, failed.alias("base_failed"), (F.col("grams") / F.col("times")).cast("long").alias("n_grams"),
        F.when(F.col("grams") > 0, F.col("weight") / F.col("grams") / UNIT).alias("score"),
        (~failed & (F.col("weight") >= F.col("grams") * round(threshold * UNIT))).alias("kept"), F.explode(F.expr("sequence(1L, times)")).alias("_copy"),
    )
    return found.drop("_copy")
