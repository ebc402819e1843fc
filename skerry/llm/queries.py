"""The opN queries over the tables of a folder, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm import exact_dedup, fingerprint, jaccard_join, language, mixing, packing, personal_data, quality, substring_dedup, token_counts
from skerry.llm.common import stored, table, text_key, word_count


def remainder(n: int) -> Column:
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"), n=4, percent=85)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array("source").alias("sources"), word_count(F.col("text")).alias("words"), text_key(F.col("text")).alias("sig"))
    mixed = mixing.mix(stored(docs, "sizes"), F.col("sources"), F.col("words"), tell_apart=["sig"])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    network = quality.train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"), learn=remainder(3) != 1)
    return quality.score(docs, network).select("doc_id", (remainder(3) == 1).alias("held_out"), "score", "predicted")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_copies(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.sums(token_counts.histogram(table(spark, sf_dir, "documents")))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = personal_data.described(F.col("base"))
    every = F.concat("base", "terms", "secrets")
    added = [F.size(c).cast("long").alias(n) for c, n in (("terms", "n_term"), ("secrets", "n_secret"))]
    return found.select(
        "doc_id", *[count(k) for k in personal_data.KINDS], F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        personal_data.described(every).alias("spans"), *added, F.size(every).cast("long").alias("n_spans"),
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs, learn=remainder(4) != 2)
    return language.identify(docs.select("doc_id", "text"), model).select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def queries() -> dict:
    return {f.__name__: f for f in (op1_substring_dedup, op2_jaccard_join, op3_fingerprints, op4_mixing, op5_quality, op6_exact_dedup, op7_token_counts, op8_personal_data, op9_packing, op10_language)}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1, "op2_jaccard_join": OP2, "op6_exact_dedup": OP6}


WORDS = "list_filter(string_split_regex({}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

OP1 = f"""
WITH d AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
p AS (
  SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d) t),
m AS (SELECT k, min(doc_id) AS low FROM p GROUP BY k),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM p JOIN m USING (k) WHERE low < doc_id),
g AS (SELECT doc_id, list(j) AS gone FROM c GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
       sha256(array_to_string(list_filter(w, lambda x, i: NOT coalesce(list_contains(gone, i), false)), ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""

OP2 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0) t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (
  SELECT x, y, o = nx.n AND o = ny.n AS same
  FROM o JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * o >= 85 * (nx.n + ny.n - o)),
r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS low FROM r GROUP BY x),
k AS (SELECT x, count(*) AS links, count(*) FILTER (WHERE same) AS same FROM l GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, c.low) AS component_id,
       coalesce(links, 0) AS n_links, coalesce(same, 0) + 1 AS copies
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.x = d.doc_id LEFT JOIN k ON k.x = d.doc_id
"""


OP6 = """
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS h
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY h) AS group_size
  FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM g
"""
