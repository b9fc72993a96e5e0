"""Classification of texts by rules and by a trained model."""

from __future__ import annotations

from pyspark.sql import functions as F

from litquarry.operators import classifier as k
from litquarry.plans.registry import query
from litquarry.sources.roles import calls

#: Words of the test tables' invented prose, in the parts of a field's words and journals.
PRIMARY, SECONDARY = ["thonka", "stal", "benchmark"], ["ing", "esen", "ol", "wid"]
INTO, OUT = ["web", "forum"], ["code"]


@query(
    """WITH w AS (SELECT conv_id * 1000 + turn AS id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]{2,}') AS w FROM conversations),
    g AS (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
    c AS (SELECT id, term, count(*) AS tf FROM g GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM conversations),
    t AS (SELECT term, count(*) AS df, sum(tf) AS every FROM c GROUP BY 1), kept AS (SELECT term, ln((n + 1) / (df + 1)::DOUBLE) + 1 AS idf FROM t, n WHERE df >= 3 AND df <= n * 0.95 ORDER BY every DESC, term LIMIT 20000),
    r AS (SELECT id, term, (ln(tf) + 1) * idf AS w FROM c JOIN kept USING (term)), l AS (SELECT id, sqrt(sum(w * w)) AS norm FROM r GROUP BY 1) SELECT id, term, round(w / norm, 6) AS weight FROM r JOIN l USING (id)""",
)
def x2_tf_idf(read):
    rows = read("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return k.tf_idf(rows, "id", "text").select("id", "term", F.round("weight", 6).alias("weight"))


def _labelled(read):
    labels = read("labels").where("quality IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("label"))
    return read("documents").join(labels, "doc_id").select("doc_id", "text", "label")


@query()
def x3_cross_validation(read):
    """Five stratified folds of a balanced logistic regression on TF-IDF weights of labelled documents: how many rows and positives, and how many are told right. A trained model is no SQL; tests hold it against separable texts."""
    _, scored = k.fit_text_classifier(_labelled(read), "doc_id", "text", "label")
    said = (F.col("probability") >= 0.5).cast("int")
    return scored.groupBy("fold").agg(F.count("*").alias("n"), F.sum("label").alias("positives"), F.avg((said == F.col("label")).cast("double")).alias("accuracy"))


@query()
def x3_classified_corpus(read):
    """Every document by the saved classifier: its probability, the label at the threshold that reaches 95 % of the positives, and the band."""
    made, _ = k.fit_text_classifier(_labelled(read), "doc_id", "text", "label")
    label, confidence = k.labelled_by(F.col("probability"), F.col("threshold"), "in", "out")
    return made.scores(read("documents"), "doc_id", "text").select("doc_id", F.round("probability", 6).alias("probability"), label.alias("label"), confidence.alias("confidence"))


@query(
    """, s AS (SELECT tokens / 100.0::DOUBLE AS p, call_type = 'purchase' AS y FROM calls), n AS (SELECT count(*) FILTER (y) AS every FROM s), r AS (SELECT p, sum(count(*)) OVER (ORDER BY p DESC) AS reached FROM s WHERE y GROUP BY p) SELECT coalesce(max(p), 0.5) AS threshold FROM r, n WHERE reached >= 0.95 * every""",
    "calls",
)
def x4_recall_threshold(read):
    scored = calls(read).select((F.col("tokens") / 100.0).alias("p"), (F.col("call_type") == "purchase").cast("int").alias("y"))
    return k.threshold_for_recall(scored, "y", "p", 0.95)


@query("SELECT call_id, CASE WHEN tokens / 100.0 >= 0.4 THEN 'in' ELSE 'out' END AS label, CASE WHEN tokens >= 90 OR tokens <= 10 THEN 'high' WHEN tokens >= 70 OR tokens <= 30 THEN 'medium' ELSE 'low' END AS confidence FROM calls", "calls")
def x5_labels_and_bands(read):
    label, confidence = k.labelled_by(F.col("tokens") / 100.0, 0.4, "in", "out")
    return calls(read).select("call_id", label.alias("label"), confidence.alias("confidence"))


RULE = """h AS (SELECT doc_id, source, length(trim(coalesce(text, ''))) AS n, lang, list_sort(list_filter(['thonka', 'stal', 'benchmark'], lambda w: contains(lower(coalesce(text, '')), w))) AS a, list_sort(list_filter(['ing', 'esen', 'ol', 'wid'], lambda w: contains(lower(coalesce(text, '')), w))) AS b FROM documents),
r AS (SELECT doc_id, source, n, lang, CASE WHEN source IN ('code') THEN 'out' WHEN source IN ('web', 'forum') OR len(a) > 0 OR len(b) >= 2 THEN 'in' WHEN len(b) > 0 THEN 'uncertain' ELSE 'out' END AS label,
  CASE WHEN source IN ('code', 'web', 'forum') OR len(a) >= 2 THEN 'high' WHEN len(a) > 0 THEN 'medium' WHEN len(b) > 0 THEN 'low' ELSE 'medium' END AS confidence,
  CASE WHEN source IN ('code', 'web', 'forum') THEN 'journal:' || source WHEN len(a) > 0 THEN 'primary:' || array_to_string(a[1:3], ',') WHEN len(b) >= 2 THEN 'secondary:' || array_to_string(b[1:3], ',') WHEN len(b) > 0 THEN 'weak:' || b[1] ELSE 'no_keywords' END AS reason FROM h)"""


def ruled(read):
    rule = k.rule_label(F.col("source"), F.col("text"), out=OUT, into=INTO, primary=PRIMARY, secondary=SECONDARY, yes="in", no="out")
    return read("documents").withColumn("rule", rule)


@query(f"WITH {RULE} SELECT doc_id, label, confidence, reason FROM r")
def x6_rule_classifier(read):
    return ruled(read).select("doc_id", "rule.label", "rule.confidence", "rule.reason")


@query(f"WITH {RULE} SELECT doc_id, CASE WHEN n < 20 THEN NULL WHEN lang IN ('fr') OR source IN ('web', 'forum') THEN 1 WHEN source IN ('code') OR (label = 'out' AND reason = 'no_keywords') THEN 0 END AS label FROM r")
def x9_training_labels(read):
    """A language stands for a mission's tag here."""
    label = k.training_label(F.col("text"), F.array("lang"), F.col("source"), F.col("rule"), missions=["fr"], into=INTO, out=OUT, no="out")
    return ruled(read).select("doc_id", label.alias("label"))
