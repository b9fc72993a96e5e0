"""Text queries on small fixtures: rows that are not ASCII, against Python."""

import re
import unicodedata

from litquarry.plans.catalogue import QUERIES

#: ASCII, accents, ligatures, curly quotes and dashes, invisible characters, odd blanks, empty, null.
TEXTS = ["plain  text\n", "d\u00e9j\u00e0 vu \u2014 \u201cna\u00efve\u201d", "\ufb01ne \ufb02ow of\ufb03ce", "l\u2019\u0153uvre \u2010 x\u2212y", "so\u00adft\u200b gap\ufeff", "a\u00a0b\u2003c \u2026", "x\u00b2 \u212b \u00bd \u2460", "Stra\u00dfe \u00c4rger", "", None]


def python_plain(text):
    if text is None:
        return None
    for found, new in (("\u2010\u2011\u2012\u2013\u2014\u2015\u2212", "-"), ("\u2018\u2019", "'"), ("\u201c\u201d", '"'), ("\u00ad\u200b\u200c\u200d\ufeff", "")):
        text = re.sub(f"[{found}]", new, unicodedata.normalize("NFKD", text))
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", text).strip(" ")


def test_normalize_covers_every_document(spark, tmp_path):
    rows = list(enumerate(TEXTS))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r["plain"] for r in QUERIES["f1_normalize_plain"](spark, str(tmp_path)).collect()}
    assert found == {k: python_plain(t) for k, t in rows}
