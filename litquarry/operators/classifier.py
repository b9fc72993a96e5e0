"""Text classification: TF-IDF weights, a logistic regression with cross-validation, thresholds, rules and training labels."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litquarry.sources.files import parts_for, scratch, written


def grams(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term): words of two characters or more in lower case, and pairs of neighbours."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    pairs = F.zip_with("w", F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    both = F.concat("w", F.slice(pairs, 1, F.greatest(F.size("w") - 1, F.lit(0))))
    return rows.select(key, words.alias("w")).select(key, F.explode(both).alias("term"))


def dealt_by(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text) dealt by the key, in parts that follow the size of the files: terms are counted and rows added up where
    the text is, so that it is shuffled and its many terms are not."""
    return rows.select(key, text).repartition(parts_for(rows, mb=2), key)


def tf_idf(rows: DataFrame, key: str, text: str, *, least_docs: int = 3, most_share: float = 0.95, most_terms: int = 20_000) -> DataFrame:
    """(key, term, weight): ``1 + ln(tf)`` times ``ln((1 + n) / (1 + df)) + 1``, each row's weights of length one.

    Terms of fewer than ``least_docs`` rows or more than ``most_share`` of them are left out; of the rest the
    ``most_terms`` most frequent stay (ties by the alphabet).
    """
    counts = grams(dealt_by(rows, key, text), key, text).groupBy(key, "term").agg(F.count("*").alias("tf"))
    n = rows.select(F.count("*").alias("n"))
    terms = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("all")).join(n)
    kept = terms.where((F.col("df") >= least_docs) & (F.col("df") <= F.col("n") * most_share)).orderBy(F.desc("all"), "term").limit(most_terms)
    idf = kept.select("term", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    raw = counts.join(idf, "term").select(key, "term", ((F.log("tf") + 1) * F.col("idf")).alias("w"))
    return raw.join(raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")), key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


def vocabulary(rows: DataFrame, key: str, text: str, *, least_docs: int = 3, most_share: float = 0.95, most_terms: int = 20_000) -> DataFrame:
    """(term, i, idf) of the terms that ``tf_idf`` keeps, numbered by the alphabet; at most ``most_terms`` rows."""
    counts = grams(dealt_by(rows, key, text), key, text).groupBy(key, "term").agg(F.count("*").alias("tf"))
    n = rows.select(F.count("*").alias("n"))
    terms = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("all")).join(n)
    kept = terms.where((F.col("df") >= least_docs) & (F.col("df") <= F.col("n") * most_share)).orderBy(F.desc("all"), "term").limit(most_terms)
    # as many rows as the vocabulary may have: one window spans them
    number = (F.row_number().over(Window.orderBy("term")) - 1).alias("i")
    return kept.select("term", number, (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def weighed(rows: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """(key, i, weight) by the terms (term, i, idf) of a vocabulary, which is broadcast; each row's weights have length one."""
    counts = grams(dealt_by(rows, key, text), key, text).join(F.broadcast(terms), "term").groupBy(key, "i", "idf").agg(F.count("*").alias("tf"))
    raw = counts.select(key, "i", ((F.log("tf") + 1) * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.select(key, "i", (F.col("w") / norm).alias("weight"))


def feature_vectors(labelled: DataFrame, weights: DataFrame, key: str, size: int) -> DataFrame:
    """``labelled`` with ``features``, sparse vectors of (key, i, weight): a table in the shared store, made without Python.

    A vector's stored form is a struct, so that a table of such structs is read back as vectors. Rows without weights get
    the zero vector.
    """
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql.types import StructField, StructType

    pairs = F.sort_array(F.collect_list(F.struct("i", "weight")))
    gathered = labelled.join(weights.groupBy(key).agg(pairs.alias("_pairs")), key, "left")
    held = F.coalesce("_pairs", F.array().cast("array<struct<i:int,weight:double>>"))
    vector = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), held["i"].alias("indices"), held["weight"].alias("values"))
    spark, path = labelled.sparkSession, scratch(labelled.sparkSession, "features")
    gathered.select(*labelled.columns, vector.alias("features")).write.parquet(path)
    return spark.read.schema(StructType([*labelled.schema.fields, StructField("features", VectorUDT())])).parquet(path)


def stratified_folds(rows: DataFrame, key: str, label: str, *, folds: int = 5, seed: int = 42) -> DataFrame:
    """``rows`` with ``fold``: the rank of a row's hash within its label, modulo ``folds``, so that folds have equal shares of each label.

    Ranks are counted within ranges of the hash and added up over ranges, so no window spans a label.
    """
    order = [F.col(label), F.xxhash64(F.lit(seed), F.col(key)), F.col(key)]
    ranged = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    here = Window.partitionBy(label, "_part").orderBy(F.xxhash64(F.lit(seed), F.col(key)), F.col(key))
    before = Window.partitionBy(label).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(label, "_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    ranked = ranged.withColumn("_k", F.row_number().over(here) - 1).join(counts, [label, "_part"])
    return ranked.withColumn("fold", ((F.col("_before") + F.col("_k")) % folds).cast("int")).drop("_part", "_k", "_before")


def fit_logistic(labelled: DataFrame, label: str, counts: dict[int, int], *, c: float = 5.0, steps: int = 100):
    """A logistic regression of (features, label) with the inverse penalty ``c``; ``counts`` of the two labels make both weigh the same."""
    from pyspark.ml.classification import LogisticRegression

    n = sum(counts.values())
    weight = F.when(F.col(label) == 1, n / (2.0 * max(counts.get(1, 0), 1))).otherwise(n / (2.0 * max(counts.get(0, 0), 1)))
    model = LogisticRegression(featuresCol="features", labelCol=label, weightCol="_weight", regParam=1.0 / (c * max(n, 1)), standardization=False, maxIter=steps)
    return model.fit(labelled.withColumn("_weight", weight))


def cross_validated(labelled: DataFrame, key: str, label: str, *, folds: int = 5, c: float = 5.0) -> DataFrame:
    """(fold, key, label, probability): each row of (key, label, features, fold) scored by the model of the other folds."""
    from pyspark.ml.functions import vector_to_array

    sizes = {(r["fold"], r[label]): r["n"] for r in labelled.groupBy("fold", label).agg(F.count("*").alias("n")).collect()}
    scored = []
    for k in range(folds):
        counts = {y: sum(n for (fold, own), n in sizes.items() if fold != k and own == y) for y in (0, 1)}
        model = fit_logistic(labelled.where(F.col("fold") != k), label, counts, c=c)
        told = model.transform(labelled.where(F.col("fold") == k))
        scored.append(told.select("fold", key, label, vector_to_array("probability")[1].alias("probability")))
    return reduce(DataFrame.unionByName, scored)


@dataclass
class TextClassifier:
    """A fitted vocabulary and model: ``terms`` (term, i, idf, coefficient), of a bounded number, and ``head`` (intercept, threshold)."""

    terms: DataFrame
    head: DataFrame

    def scores(self, rows: DataFrame, key: str, text: str) -> DataFrame:
        """(key, probability) of every row, without vectors: a row's score is a sum over its terms. Rows without known terms get the intercept's."""
        counts = grams(dealt_by(rows, key, text), key, text).join(F.broadcast(self.terms), "term").groupBy(key, "term", "idf", "coefficient").agg(F.count("*").alias("tf"))
        weight = (F.log("tf") + 1) * F.col("idf")
        summed = counts.groupBy(key).agg((F.sum(weight * F.col("coefficient")) / F.sqrt(F.sum(weight * weight))).alias("_sum"))
        every = rows.select(key).join(summed, key, "left").join(F.broadcast(self.head))
        margin = F.coalesce("_sum", F.lit(0.0)) + F.col("intercept")
        return every.select(key, (1 / (1 + F.exp(-margin))).alias("probability"), "threshold")

    def save(self, path: str) -> None:
        self.terms.write.parquet(f"{path}/terms")
        self.head.write.parquet(f"{path}/head")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TextClassifier:
        return TextClassifier(spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/head"))


def fit_text_classifier(
    rows: DataFrame, key: str, text: str, label: str, *, path: str | None = None, folds: int = 5, c: float = 5.0, target: float = 0.95, most_terms: int = 20_000, least_docs: int = 3, seed: int = 42
) -> tuple[TextClassifier, DataFrame]:
    """A classifier of labelled ``rows`` (key, text, label 0 or 1), saved at ``path``, and its cross-validated scores.

    The threshold is the one that reaches ``target`` of the positives among the scores of rows that a fold's model has not
    seen. Rows with a null label or key are left out. One table of vectors serves all folds and the final model.
    """
    spark = rows.sparkSession
    path = path or scratch(spark, "classifier")
    known = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    terms = written(vocabulary(known, key, text, least_docs=least_docs, most_terms=most_terms), "vocabulary")
    size = max(terms.count(), 1)
    folded = stratified_folds(known.select(key, label), key, label, folds=folds, seed=seed)
    vectors = feature_vectors(folded, weighed(known, key, text, terms), key, size)
    scored = written(cross_validated(vectors, key, label, folds=folds, c=c), "cross-validated")
    counts = {r[label]: r["n"] for r in vectors.groupBy(label).agg(F.count("*").alias("n")).collect()}
    model = fit_logistic(vectors, label, counts, c=c)
    coefficients = spark.createDataFrame(list(enumerate(model.coefficients.toArray().tolist())), "i int, coefficient double")
    head = threshold_for_recall(scored, label, "probability", target).select(F.lit(float(model.intercept)).alias("intercept"), "threshold")
    TextClassifier(terms.join(coefficients, "i").select("term", "i", "idf", "coefficient"), head).save(path)
    return TextClassifier.load(spark, path), scored


def threshold_for_recall(scored: DataFrame, label: str, probability: str, target: float = 0.95) -> DataFrame:
    """One row (threshold): the highest score such that at least ``target`` of the positives score that or more, else 0.5.

    Positives are counted by score first, so that the running count spans distinct scores of positives only.
    """
    positives = scored.where(F.col(label) == 1).groupBy(F.col(probability).alias("p")).agg(F.count("*").alias("n"))
    total = positives.agg(F.sum("n").alias("all"))
    bucket = F.floor(F.col("p") * 1000)
    above = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    starts = positives.groupBy(bucket.alias("b")).agg(F.sum("n").alias("s")).withColumn("before", F.coalesce(F.sum("s").over(above), F.lit(0))).select("b", "before")
    within = Window.partitionBy("b").orderBy(F.desc("p"))
    run = positives.withColumn("b", bucket).join(starts, "b").withColumn("reached", F.col("before") + F.sum("n").over(within))
    return run.join(total).where(F.col("reached") >= target * F.col("all")).agg(F.coalesce(F.max("p"), F.lit(0.5)).alias("threshold"))


def labelled_by(probability: Column, threshold: Column | float, yes: str, no: str) -> tuple[Column, Column]:
    """The label at a threshold, and how sure it is by the distance from the middle."""
    confidence = F.when((probability >= 0.9) | (probability <= 0.1), "high").when((probability >= 0.7) | (probability <= 0.3), "medium").otherwise("low")
    return F.when(probability >= threshold, yes).otherwise(no), confidence


def rule_label(journal: Column, text: Column, *, out: list[str], into: list[str], primary: list[str], secondary: list[str], yes: str, no: str) -> Column:
    """(label, confidence, reason): a journal decides first, then primary words, then two secondary ones. Words in a reason are sorted."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = lambda words: F.array_sort(F.array_compact(F.array(*(F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in words))))
    first, second = hits(primary), hits(secondary)
    told = lambda label, sure, reason: F.struct(F.lit(label).alias("label"), (F.lit(sure) if isinstance(sure, str) else sure).alias("confidence"), reason.alias("reason"))
    listed = lambda head, words, most: F.concat(F.lit(head), F.array_join(F.slice(words, 1, most), ","))
    named = F.concat(F.lit("journal:"), journal)
    return (
        F.when(journal.isin(out), told(no, "high", named))
        .when(journal.isin(into), told(yes, "high", named))
        .when(F.size(first) > 0, told(yes, F.when(F.size(first) >= 2, "high").otherwise("medium"), listed("primary:", first, 3)))
        .when(F.size(second) >= 2, told(yes, "low", listed("secondary:", second, 3)))
        .when(F.size(second) > 0, told("uncertain", "low", listed("weak:", second, 100)))
        .otherwise(told(no, "medium", F.lit("no_keywords")))
    )


def training_label(text: Column, tags: Column, journal: Column, rule: Column, *, missions: list[str], into: list[str], out: list[str], no: str) -> Column:
    """1 for a mission's tag or a journal of the field, 0 for a journal outside or a text without any keyword, else null. Texts under 20 characters have none."""
    enough = F.length(F.trim(F.coalesce(text, F.lit("")))) >= 20
    label = (
        F.when(F.coalesce(F.arrays_overlap(tags, F.array(*map(F.lit, missions))), F.lit(False)), 1).when(journal.isin(into), 1).when(journal.isin(out), 0)
        .when((rule["label"] == no) & (rule["reason"] == "no_keywords"), 0)
    )
    return F.when(enough, label)
