"""Entity tables derived from the ``customer`` table, in SQL that Spark and
DuckDB read alike. Records with the same key are the same business."""

from pyspark.sql import DataFrame, SparkSession

# The fixture texts.
BASE = """
WITH b AS (
  SELECT c_custkey AS k,
    split_part('acme,globex,initech,umbrella,stark,wayne,hooli,vandelay,wonka,soylent,tyrell,café noir,gringotts', ',', CAST(c_custkey * 7 % 13 + 1 AS INT)) AS w1,
    split_part('trading,foods,systems,logistics,textiles,motors,chemicals,media,energy,retail,pharma', ',', CAST((c_custkey * 5 + CAST(floor(c_custkey / 13) AS BIGINT)) % 11 + 1 AS INT)) AS w2,
    chr(CAST(97 + c_custkey % 26 AS INT)) || chr(CAST(97 + CAST(floor(c_custkey / 26) AS BIGINT) % 26 AS INT)) || chr(CAST(97 + CAST(floor(c_custkey / 676) AS BIGINT) % 26 AS INT)) AS w3,
    split_part('Inc|Ltd|Pvt Ltd|LLC|Corp|& Co', '|', CAST(c_custkey % 6 + 1 AS INT)) AS sfx,
    CAST(c_custkey * 37 % 900 + 1 AS STRING) AS hn,
    split_part('Main St,Oak Ave,MG Road,Rue Cler,Hill Rd,Park Ln,Lake Dr', ',', CAST(c_custkey * 3 % 7 + 1 AS INT)) AS st,
    CAST(10000 + c_custkey * 91 % 80000 AS STRING) AS pc,
    split_part('US,India,France', ',', CAST(c_custkey % 3 + 1 AS INT)) AS country
  FROM customer)
"""

S1 = """
SELECT 'S1-' || CAST(k AS STRING) AS entity_id,
  CASE WHEN k % 200 = 13 THEN NULL WHEN k % 200 = 113 THEN '***' ELSE w1 || ' ' || w3 || ' ' || w2 || ' ' || sfx END AS business_name,
  CASE WHEN k % 10 = 9 THEN NULL WHEN k % 50 = 7 THEN st ELSE hn || ' ' || st || ', ' || pc END AS business_address,
  country
FROM b
"""

S2 = """
SELECT 'S2-' || CAST(k AS STRING) AS entity_id,
  CASE WHEN k % 4 = 0 THEN upper(w1) || ' ' || w3 || ' ' || w2 || ' ' || sfx
       WHEN k % 4 = 1 THEN w2 || ' ' || w1 || ' ' || w3
       WHEN k % 4 = 2 THEN w1 || ' ' || w3 || ' ' || substr(w2, 1, length(w2) - 1)
       ELSE w1 || ' ' || w3 || ' ' || w2 END AS business_name,
  CASE WHEN k % 5 = 0 THEN NULL WHEN k % 5 = 1 THEN st || ' ' || hn ELSE hn || ' ' || st || ', ' || pc END AS business_address,
  country
FROM b WHERE k % 3 <> 0
"""

S3 = """
SELECT 'S3-' || CAST(k AS STRING) AS entity_id,
  CASE WHEN k % 2 = 0 THEN w1 || ' ' || w3 ELSE w1 || '-' || w3 || ' ' || w2 || ' ' || sfx END AS business_name,
  CASE WHEN k % 4 = 3 THEN 'PO Box ' || pc ELSE hn || ' ' || upper(st) END AS business_address,
  CASE WHEN k % 97 = 0 THEN NULL ELSE country END AS country
FROM b WHERE k % 4 <> 1
"""

GROUND_TRUTH = """
SELECT 'S1-' || CAST(c_custkey AS STRING) AS source1_entity_id,
  CASE WHEN c_custkey % 3 <> 0 THEN 'S2-' || CAST(c_custkey AS STRING) ELSE '' END
  || CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 4 <> 1 THEN ',' ELSE '' END
  || CASE WHEN c_custkey % 4 <> 1 THEN 'S3-' || CAST(c_custkey AS STRING) ELSE '' END AS matched_entity_ids
FROM customer
"""

ENTITY_SQL = {"s1": BASE + S1, "s2": BASE + S2, "s3": BASE + S3}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entities(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """Source ``s1``, ``s2`` or ``s3``."""
    return spark.sql(
        ENTITY_SQL[source].replace("FROM customer", "FROM {customer}"),
        customer=table(spark, sf_dir, "customer"),
    )


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        GROUND_TRUTH.replace("FROM customer", "FROM {customer}"),
        customer=table(spark, sf_dir, "customer"),
    )
