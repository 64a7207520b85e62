"""One query for each operator over the whole given tables, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spokeworks.llm import (
    attention,
    backoff,
    chat,
    decontaminate,
    divergence,
    langid,
    neardup,
    packing,
    severity,
    sharding,
    spelling,
    vafile,
    whitening,
)
from spokeworks.llm.tables import held_out, table


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark windows found in every document, and whether it is contaminated."""
    matches = decontaminate.find_matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return decontaminate.contamination_report(matches)


OP1_SQL = r"""
WITH item AS (
  SELECT item_id, regexp_extract_all(lower_ascii, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM benchmark)
), win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS win
  FROM item, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(i) WHERE len(w) > 0
), doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), size AS (SELECT DISTINCT size FROM win),
spot AS (
  SELECT r, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') AS win
  FROM doc, size, unnest(range(1, len(w) - size + 2)) AS t(i) WHERE len(w) >= size
), met AS (SELECT r, i, spot.size, item_id FROM spot JOIN win USING (size, win)),
hit AS (SELECT r, list_sort(list(DISTINCT p)) AS h FROM met, unnest(range(i, i + met.size)) AS t(p) GROUP BY r),
span AS (
  SELECT r, max(n) AS longest_span FROM (
    SELECT r, count(*) AS n FROM (SELECT r, p, p - row_number() OVER (PARTITION BY r ORDER BY p) AS g FROM hit, unnest(h) AS t(p)) GROUP BY r, g
  ) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM met) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(h), 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(len(h), 0) > 0 AND 20 * coalesce(len(h), 0) >= len(w) AS contaminated,
       CAST(coalesce(longest_span, 0) AS BIGINT) AS longest_span
FROM doc LEFT JOIN hit USING (r) LEFT JOIN items USING (r) LEFT JOIN span USING (r)
"""


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, distances from the language's references, and verdict for every document."""
    return divergence.quality_rules(table(spark, folder, "documents"))


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document by attention over its passages."""
    docs = table(spark, folder, "documents")
    scored = attention.score(docs, attention.train(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op4_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Stupid-backoff score of every document under the counts of all others."""
    return backoff.lm_scores(table(spark, folder, "documents"))


def op5_chat(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation and one with control strings in its texts, formatted and read back."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    words = "<|im_end|><|im_start|>assistant ok"
    more = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(words).alias("text"),
    )
    return chat.digest_examples(chat.expand_targets(turns.unionByName(more)))


OP5_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), sized AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(24 + length(replace(replace(replace(role, '', '\'), '<|', '<\|'), chr(10), '
')) + length(replace(replace(text, '', '\'), '<|', '<\|'))) OVER w AS upto
  FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document by character models."""
    docs = table(spark, folder, "documents")
    return langid.identify(docs, langid.train(docs)).withColumn("held_out", held_out("doc_id"))


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Vocabulary file; the ranks form has the ids of byte_bpe_50k.json."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(table(spark, folder, "documents"), tokenizer_path())


def op8_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate class of every document: 3-word shingles, similarity of 0.85 or more."""
    return neardup.near_duplicates(table(spark, folder, "documents"), shingle=3, percent=85)


OP8_SQL = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
    FROM doc)
), size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingle a JOIN shingle b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM shared JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)
), reach AS (
  SELECT doc_id AS node, doc_id AS component FROM doc UNION SELECT b, component FROM reach JOIN link ON a = node
), least AS (SELECT node, min(component) AS component_id FROM reach GROUP BY node)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM doc JOIN least ON node = doc_id LEFT JOIN size USING (doc_id)
"""


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Expected severity of every document, its grade, and whether it is toxic."""
    docs = table(spark, folder, "documents")
    scored = severity.score(docs, severity.train(docs, table(spark, folder, "labels")))
    return scored.withColumn("held_out", held_out("doc_id"))


def op10_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Shard and slot of every document: 24 shards of equal counts with the corpus's mixture."""
    placed = sharding.interleave(table(spark, folder, "documents"), 24)
    return placed.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Whitened components of every vector, a row for each."""
    rows = whitening.whiten(table(spark, folder, "embeddings"))
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "entry")
    # The sum of squares leaves 64 bits only for far more rows than a long can hold it for; then it is null.
    return rows.select("vec_id", "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"), "identity_error", each).select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        "n",
        "deviation",
        F.col("entry.whitened").alias("whitened"),
        F.col("entry.explained").alias("explained"),
        "identity_error",
    )


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Form, root and near words of every word of the documents."""
    return spelling.variants(table(spark, folder, "documents"))


def op13_exact_search(spark: SparkSession, folder: str) -> DataFrame:
    """The five best rows by inner product for each row whose id is divisible by 50."""
    rows = table(spark, folder, "embeddings")
    return vafile.search(rows, rows.filter("vec_id % 50 = 0"), 5)


OP13_SQL = """
WITH vec AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS v
  FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scored AS (
  SELECT q.r, q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.v, x.v) AS BIGINT) AS score
  FROM vec q JOIN vec x ON q.vec_id % 50 = 0 AND q.r <> x.r
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS place FROM scored
)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM placed WHERE place <= 5
"""


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_quality_rules": op2_quality_rules,
    "op3_quality": op3_quality,
    "op4_lm_scores": op4_lm_scores,
    "op5_chat": op5_chat,
    "op6_language": op6_language,
    "op7_packing": op7_packing,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_toxicity": op9_toxicity,
    "op10_shards": op10_shards,
    "op11_whitening": op11_whitening,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_exact_search": op13_exact_search,
}

SQL = {
    "op1_decontamination": OP1_SQL,
    "op5_chat": OP5_SQL,
    "op8_near_duplicates": OP8_SQL,
    "op13_exact_search": OP13_SQL,
}
