"""The trained classifier on texts that can be told apart."""

from pyspark.sql import functions as F

from litquarry.operators import classifier as k


def texts_of(spark, n=60):
    words = [["solar", "wind", "flare"], ["soup", "bread", "salt"]]
    rows = [(i, " ".join(words[i % 2][(i // 2 + j) % 3] for j in range(4)), i % 2) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, label int")


def test_fitted_classifier_is_saved_and_tells_texts_apart(spark, tmp_path):
    from pyspark.ml.functions import vector_to_array

    texts = texts_of(spark)
    unknown = spark.createDataFrame([(1000, "nothing known here", 1), (1001, None, 0), (None, "solar", 1), (1002, "soup", None)], "doc_id long, text string, label int")
    made, scored = k.fit_text_classifier(texts.unionByName(unknown), "doc_id", "text", "label", path=str(tmp_path / "m"))
    rows = scored.where("doc_id < 1000").collect()
    assert len(rows) == 60 and all((r["probability"] > 0.5) == (r["label"] == 1) for r in rows)
    again = k.TextClassifier.load(spark, str(tmp_path / "m"))
    told = {r["doc_id"]: r["probability"] for r in again.scores(texts.unionByName(unknown), "doc_id", "text").collect()}
    assert all((told[i] > 0.5) == bool(i % 2) for i in range(60)) and told[1000] == told[1001]
    # sums over terms are what the model of vectors says
    terms = again.terms.select("term", "i", "idf")
    vectors = k.feature_vectors(texts.select("doc_id", "label"), k.weighed(texts, "doc_id", "text", terms), "doc_id", terms.count())
    model = k.fit_logistic(vectors, "label", {0: 30, 1: 30})
    by_vectors = {r[0]: r[1] for r in model.transform(vectors).select("doc_id", vector_to_array("probability")[1]).collect()}
    head = spark.createDataFrame([(float(model.intercept), 0.5)], "intercept double, threshold double")
    numbers = spark.createDataFrame(list(enumerate(model.coefficients.toArray().tolist())), "i int, coefficient double")
    by_sums = k.TextClassifier(terms.join(numbers, "i"), head).scores(texts, "doc_id", "text").collect()
    assert all(abs(by_vectors[r["doc_id"]] - r["probability"]) < 1e-9 for r in by_sums)


def test_weights_are_those_of_tf_idf(spark):
    texts = texts_of(spark, 20)
    terms = k.vocabulary(texts, "doc_id", "text").cache()
    named = k.weighed(texts, "doc_id", "text", terms).join(terms, "i").select("doc_id", "term", "weight")
    key = lambda rows: sorted((r[0], r[1], round(r[2], 9)) for r in rows.collect())
    assert key(named) == key(k.tf_idf(texts, "doc_id", "text")) and terms.count() > 5
    assert [r["i"] for r in terms.orderBy("term").collect()] == list(range(terms.count()))


def test_folds_are_stratified_and_stable(spark):
    rows = spark.range(103).select(F.col("id").alias("doc_id"), (F.col("id") % 4 == 0).cast("int").alias("label"))
    found = k.stratified_folds(rows.repartition(7), "doc_id", "label").collect()
    assert len(found) == 103
    for y, n in ((0, 77), (1, 26)):
        sizes = [sum(r["fold"] == f and r["label"] == y for r in found) for f in range(5)]
        assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    assert {(r["doc_id"], r["fold"]) for r in found} == {(r["doc_id"], r["fold"]) for r in k.stratified_folds(rows, "doc_id", "label").collect()}


def test_threshold_none_and_ties(spark):
    scored = spark.createDataFrame([(1, 0.9), (1, 0.4), (1, 0.4), (0, 0.95)], "y int, p double")
    assert k.threshold_for_recall(scored, "y", "p", 0.3).first()["threshold"] == 0.9
    assert k.threshold_for_recall(scored, "y", "p", 0.95).first()["threshold"] == 0.4
    assert k.threshold_for_recall(scored.where(F.col("y") == 0), "y", "p").first()["threshold"] == 0.5


def test_terms_are_not_shuffled_to_be_counted(spark, capsys):
    rows = spark.range(4).select("id", F.lit("one two three").alias("text"))
    terms = spark.createDataFrame([("one", 0, 1.5)], "term string, i int, idf double")
    k.weighed(rows, "id", "text", terms).explain()
    shuffles = [line for line in capsys.readouterr().out.splitlines() if "Exchange hashpartitioning" in line]
    assert len(shuffles) == 1 and "REPARTITION_BY_NUM" in shuffles[0]
