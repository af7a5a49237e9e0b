"""Business records and their truth, as views over the driver's tables, in Spark and in SQL.

Documents become records: source, name, address and country come from doc_id, text and lang; the name is a text's first 40
characters, the address all others. Records with an equal name are true matches, each record with the smallest S1.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators.blocking import PAIR, TfidfBlocker

S1, CAND = PAIR
K, MIN_DF, MAX_DF = 10, 2, 1.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    kind = (F.col("doc_id") % 3 + 1).cast("string")
    text = F.coalesce("text", F.lit(""))
    return d.select(F.concat(F.lit("S"), kind, F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"), F.substring(text, 1, 40).alias("business_name"), F.substring(text, 41, (1 << 31) - 1).alias("business_address"), F.col("lang").alias("country"))


def part_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with short fields, for the features that compare strings character by character: parts by name, with brand,
    size and price for an address and the type for a country."""
    p = table(spark, sf_dir, "part")
    address = F.concat_ws(" ", "p_brand", F.col("p_size").cast("string"), F.col("p_retailprice").cast("string"))
    kind = (F.col("p_partkey") % 3 + 1).cast("string")
    return p.select(F.concat(F.lit("S"), kind, F.lit("-"), F.col("p_partkey").cast("string")).alias("entity_id"), F.col("p_name").alias("business_name"), address.alias("business_address"), F.col("p_type").alias("country"))


def side(rec: DataFrame, *prefixes: str) -> DataFrame:
    return rec.where(F.substring("entity_id", 1, 3).isin(*prefixes))


def universe(rec: DataFrame) -> DataFrame:
    return side(rec, "S1-").select(F.col("entity_id").alias(S1))


def truth(rec: DataFrame) -> DataFrame:
    """Each pool record with the smallest S1 of the same name."""
    a = side(rec, "S1-").groupBy("business_name").agg(F.min("entity_id").alias(S1))
    b = side(rec, "S2-", "S3-").select("business_name", F.col("entity_id").alias(CAND))
    return a.join(b, "business_name").select(*PAIR)


def tokens():
    return T.word_tokens(F.concat_ws(" ", "business_name", "business_address"))


def blocker(**more) -> TfidfBlocker:
    return TfidfBlocker(tokens(), MIN_DF, MAX_DF, **more)


def candidates(rec: DataFrame, k: int = K) -> DataFrame:
    return blocker().candidates(side(rec, "S1-"), side(rec, "S2-", "S3-"), k)


def scored(rec: DataFrame) -> DataFrame:
    """Candidates with p, their score as a probability, and whether they are true."""
    t = truth(rec).withColumn("_t", F.lit(1))
    return candidates(rec).join(t, PAIR, "left").select(*PAIR, "score", "rank", F.least(F.col("score"), F.lit(1.0)).alias("p"), F.coalesce("_t", F.lit(0)).alias("label"))


#: The same views as SQL common table expressions.
REC = r"""rec AS (SELECT 'S' || (doc_id % 3 + 1)::VARCHAR || '-' || doc_id::VARCHAR AS entity_id, substr(coalesce(text, ''), 1, 40) AS business_name,
  substr(coalesce(text, ''), 41) AS business_address, lang AS country FROM documents),
s1 AS (SELECT * FROM rec WHERE entity_id LIKE 'S1-%'), pool AS (SELECT * FROM rec WHERE entity_id NOT LIKE 'S1-%'),
uni AS (SELECT entity_id AS source1_entity_id FROM s1),
truth AS (SELECT a.e AS source1_entity_id, b.entity_id AS candidate_entity_id FROM (SELECT business_name, min(entity_id) AS e FROM s1 GROUP BY 1) a JOIN pool b USING (business_name))"""


def postings_sql(name: str, source: str) -> str:
    return rf"""{name} AS (SELECT id, country, term, count(*) AS tf FROM (SELECT entity_id AS id, country, unnest(regexp_extract_all(lower(business_name || ' ' || business_address), '[\p{{L}}\p{{N}}\p{{M}}_]{{2,}}')) AS term FROM {source}) GROUP BY ALL)"""


def topk_sql(q: str = "s1", c: str = "pool", out: str = "cand", k: int = K, max_df: float = MAX_DF) -> str:
    """CTEs that end in `out` (source1_entity_id, candidate_entity_id, score, rank), with q asking and c the index."""
    return f"""{postings_sql(out + '_q', q)}, {postings_sql(out + '_c', c)},
{out}_idf AS (SELECT country, term, df, ln((1 + n)::DOUBLE / (1 + df)) + 1 AS idf FROM (SELECT country, term, count(*) AS df FROM {out}_c GROUP BY ALL) JOIN (SELECT country, count(DISTINCT id) AS n FROM {out}_c GROUP BY ALL) USING (country) WHERE df >= {MIN_DF} AND df <= {max_df}::DOUBLE * n),
{out}_wq AS (SELECT id, country, term, tf * idf / sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY id)) AS w FROM {out}_q JOIN {out}_idf USING (country, term)),
{out}_wc AS (SELECT id, country, term, tf * idf / sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY id)) AS w FROM {out}_c JOIN {out}_idf USING (country, term)),
{out}_p AS (SELECT a.id AS source1_entity_id, b.id AS candidate_entity_id, round(sum(a.w * b.w), 6) AS score FROM {out}_wq a JOIN {out}_wc b USING (country, term) GROUP BY 1, 2),
{out} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source1_entity_id ORDER BY score DESC, candidate_entity_id) AS rank FROM {out}_p WHERE score > 0) WHERE rank <= {k})"""


SCORED = """scored AS (SELECT c.*, least(score, 1.0::DOUBLE) AS p, (t.source1_entity_id IS NOT NULL)::INT AS label FROM cand c LEFT JOIN truth t USING (source1_entity_id, candidate_entity_id))"""


def sql(body: str, *ctes: str) -> str:
    """A query over the views; `cand` and `scored` are there if the body names them."""
    parts = [REC]
    said = set(re.findall(r"\w+", " ".join([body, *ctes])))
    if said & {"cand", "cand_idf", "scored"}:
        parts.append(topk_sql())
    if "scored" in said:
        parts.append(SCORED)
    return f"WITH {', '.join([*parts, *ctes])} {body}"
