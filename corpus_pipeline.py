"""Corpus pipeline: toxic documents go, repeated lines go, one document of each near-duplicate group stays, contaminated
documents go, and what is left is packed into sequences.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept, and calls one operator; its
result is written as Parquet and read back as the next one's documents. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litquarry.llm.common import written
from litquarry.llm.decontaminate import decontaminate
from litquarry.llm.line_dedup import line_dedup
from litquarry.llm.ngram_join import ngram_components
from litquarry.llm.packing import pack_documents
from litquarry.llm.queries import tokenizer_path
from litquarry.llm.toxicity import toxicity

#: Words in a row that a document must have in common with a benchmark item to be contaminated.
WINDOW = 10


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7; labels are learnt from the documents of this stage.

    Null and empty texts have the score of a text without words. Of rows that share an id all go if one is toxic, as ids
    name documents. A row with a null id cannot be named and stays. Very long texts are scored whole.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity(docs, labels, threshold=0.7)
    return docs.join(scored.where(F.col("predicted") == 1).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a smaller document has; one that has nothing but blanks left, and had more, goes.

    Null and empty texts have one empty line and stay as they are; n_chars follows a text that changed. Rows that repeat an
    id hold a line together, so neither loses it to the other; a row with a null id counts for no line and keeps all its
    own. Texts of any length are cut into all their lines.
    """
    kept = line_dedup(docs, carry=True)
    changed = F.col("n_dropped") > 0
    left = kept.where(~changed | (F.btrim("kept_text", F.lit(" \t\n\x0b\x0c\r")) != ""))
    new = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return left.select(*[F.when(changed, new[c]).otherwise(F.col("row")[c]).alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each component of near duplicates (five-word shingles, similarity 0.8 or more).

    Texts without words, null ones included, link with nothing and stay. Rows that repeat an id are one document and stay
    or go together; a row with a null id stays. Texts of any length are compared whole.
    """
    groups = ngram_components(docs, words=5, percent=80)
    others = groups.where(F.col("component_id") < F.col("doc_id")).select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no window of ten words of a benchmark item occurs in.

    Null and empty texts have no words and stay, and so does a row with a null id, which cannot be named. Of rows that
    share an id all go if one is hit. Texts of any length are searched whole.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = decontaminate(docs, benchmark, width=WINDOW).where("n_hit > 0").select("doc_id").distinct()
    return docs.join(hit, "doc_id", "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most 2048 tokens.

    Null and empty texts are one piece of the end's id alone. Repeated rows and rows with a null id are packed each. A
    text longer than a sequence is cut into as many pieces as it needs.
    """
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"), size=2048, end_id=0)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_group),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

#: No stage list with a learnt score and a tokenizer can be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
