"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litquarry.llm.alignment import alignment
from litquarry.llm.common import sha256_hex
from litquarry.llm.decontaminate import decontaminate
from litquarry.llm.embedding_dedup import embedding_links
from litquarry.llm.line_dedup import line_dedup
from litquarry.llm.ngram_join import ngram_components
from litquarry.llm.merkle import folded, leaf_digest, merkle_manifest, siblings
from litquarry.llm.packing import pack_documents
from litquarry.llm.quality_rules import quality_rules
from litquarry.llm.substring_dedup import substring_dedup
from litquarry.llm.token_count import token_counts
from litquarry.llm.token_output import token_output
from litquarry.llm.toxicity import toxicity
from litquarry.llm.warc import warc_round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0, with_ids=False)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), size=2048, end_id=0)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(_table(spark, sf_dir, "documents"), width=13)
    return found.select("doc_id", "n_words", "n_removed", sha256_hex(F.col("kept_text")).alias("kept_sha256"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, pos, array_to_string(w[pos:pos + 12], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS pos FROM d)
), first AS (SELECT k, min(doc_id) AS keeper FROM win GROUP BY k HAVING count(DISTINCT doc_id) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 13)) AS pos FROM win JOIN first USING (k) WHERE doc_id > keeper
), words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d
), marked AS (
  SELECT words.doc_id, word, words.pos, gone.pos IS NOT NULL AS removed
  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.pos = words.pos
), per AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE removed) AS r,
         string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT removed) AS kept
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(r, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN per USING (doc_id)
"""


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return found.withColumn("over_limit", F.col("n_tokens") > 512)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.7)
    return found.select("doc_id", "held_out", "score", "predicted")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_links(_table(spark, sf_dir, "embeddings"), cosine=0.95)
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), width=10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        sha256_hex(F.array_join("items", ",")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[pos:pos + 9], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, least(len(w), 1) + 1))) AS pos FROM i)
), sizes AS (SELECT DISTINCT n FROM iw
), dw AS (
  SELECT doc_id, n, pos, array_to_string(w[pos:pos + n - 1], ' ') AS k
  FROM (SELECT doc_id, n, w, unnest(range(1, greatest(len(w) - n + 2, 1))) AS pos FROM d CROSS JOIN sizes)
), hits AS (SELECT doc_id, pos, dw.n AS n, item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.n = iw.n
), covered AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(pos, pos + n)) AS pos FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM hits GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc_round_trip(_table(spark, sf_dir, "pages"), with_payload=False, min_bytes=1000)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
last AS (SELECT body, max(page_id) AS target FROM p WHERE strlen(body) >= 1000 GROUP BY body)
SELECT page_id, strlen(p.body) AS payload_bytes, sha1(p.body) AS payload_digest,
       CASE WHEN page_id < target THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < target THEN target END AS refers_to
FROM p LEFT JOIN last ON p.body = last.body
"""


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", sha256_hex(F.col("kept_text")).alias("kept_sha256"))


OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), common AS (
  SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT keyed.doc_id, pos, line, common.first IS NOT NULL AND keyed.doc_id > common.first AS dropped
  FROM keyed LEFT JOIN common ON keyed.k = common.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(_table(spark, sf_dir, "documents"), words=5, percent=80)


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[pos:pos + 4], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) AS pos FROM d)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id
), links AS (
  SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 80 * (na.n + nb.n - common)
), reach AS (
  SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(d.doc_id, coalesce(min(reach.b), d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id
"""


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("n_grams")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    more = {"n_chars": F.expr("try_add(n_chars, 1)")}
    forged = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, leaf_digest(*[more.get(c, F.col(c)) for c in fields]))
    leaves = _table(spark, sf_dir, "documents").select("doc_id", "lang", leaf_digest(*map(F.col, fields)).alias("leaf"), forged.alias("forged"))
    made = merkle_manifest(leaves, group_col="lang", id_col="doc_id", leaf_col="leaf")
    root = F.lit(made.root).cast("string")
    proven = made.proofs.withColumn("folded_root", folded(F.coalesce("forged", "leaf"), F.col("proof")))
    return proven.select(
        "doc_id", "leaf", "subroot", root.alias("root"), F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified")
    )


OP13_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, n_chars,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS tail,
         coalesce(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
           lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))),
           4294967295) % 7 = 0, false) AS tampered
  FROM documents
), leaves AS (
  SELECT *, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
         sha256(head || coalesce(strlen(CAST(n_chars + tampered::INT AS VARCHAR)) || ':' || (n_chars + tampered::INT), '-') || tail) AS given FROM d
), placed AS (
  SELECT doc_id, lang, leaf, given, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
         count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM leaves
), nodes AS (
  SELECT g, 0 AS level, place AS i, leaf AS h, n FROM placed
  UNION ALL
  SELECT g, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM nodes WHERE n > 1 GROUP BY g, level, i // 2
), subroots AS (SELECT g, h AS subroot FROM nodes WHERE n = 1
), high AS (
  SELECT 0 AS level, g AS i, subroot AS h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM high WHERE n > 1 GROUP BY level, i // 2
), steps AS (
  SELECT p.g, place, x.level AS step, s.h AS sibling, (place >> x.level) % 2 = 1 AS on_left
  FROM placed p JOIN (SELECT DISTINCT g, level, n FROM nodes) x ON x.g = p.g AND x.n > 1
  LEFT JOIN nodes s ON s.g = p.g AND s.level = x.level AND s.i = xor(place >> x.level, 1)
  UNION ALL
  SELECT p.g, place, 1000 + x.level, s.h, (p.g >> x.level) % 2 = 1
  FROM placed p JOIN (SELECT DISTINCT level, n FROM high) x ON x.n > 1
  LEFT JOIN high s ON s.level = x.level AND s.i = xor(p.g >> x.level, 1)
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY g, place ORDER BY step) AS k FROM steps
), fold AS (
  SELECT g, place, given AS h, 0 AS k FROM placed
  UNION ALL
  SELECT fold.g, fold.place, sha256(CASE WHEN sibling IS NULL THEN h WHEN on_left THEN sibling || h ELSE h || sibling END), fold.k + 1
  FROM fold JOIN ordered o ON o.g = fold.g AND o.place = fold.place AND o.k = fold.k + 1
), ends AS (SELECT g, place, arg_max(h, k) AS folded_root FROM fold GROUP BY g, place
), proofs AS (SELECT g, place, coalesce(string_agg(sibling, '' ORDER BY k), '') AS siblings FROM ordered GROUP BY g, place
), root AS (SELECT h AS root FROM high WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed p JOIN subroots USING (g) CROSS JOIN root JOIN ends e ON e.g = p.g AND e.place = p.place LEFT JOIN proofs f ON f.g = p.g AND f.place = p.place
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_output": op1_token_output,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_token_counts": op4_token_counts,
        "op5_toxicity": op5_toxicity,
        "op6_embedding_dedup": op6_embedding_dedup,
        "op7_decontamination": op7_decontamination,
        "op8_warc": op8_warc,
        "op9_line_dedup": op9_line_dedup,
        "op10_ngram_join": op10_ngram_join,
        "op11_quality_rules": op11_quality_rules,
        "op12_alignment": op12_alignment,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_substring_dedup": OP3_SQL,
        "op7_decontamination": OP7_SQL,
        "op8_warc": OP8_SQL,
        "op9_line_dedup": OP9_SQL,
        "op10_ngram_join": OP10_SQL,
        "op13_merkle_manifest": OP13_SQL,
    }
