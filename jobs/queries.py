"""The jobs as registered queries over the driver's tables, with their DuckDB texts.

Each runs its job twice into one new folder below the shared one and returns the whole output as it stands after that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import cohort_intake, instruction_set
from tessera.functions import chat, nets
from tessera.plans.registry import DEMO_NETS, PERSON_SQL, sql_first, sql_net
from tessera.session import shared_path

#: The built-in nets name diseases, which invented prose does not: these come before them.
INTAKE = cohort_intake.DEFAULTS | {"nets": DEMO_NETS, "subtyped": "alpha", "subtypes": {"one": ("ndst",), "two": ("ered",)}, "files_per_batch": 5}
CHAT = instruction_set.DEFAULTS | {"max_words": 400, "max_turns": 12, "shares": {"train": 0.8, "valid": 0.1, "test": 0.1}}


def job1_cohort_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` as samples that have landed."""
    out = shared_path(spark, "cohort_intake")
    for _ in range(2):
        labels = cohort_intake.run(spark, f"{sf_dir}/documents.parquet", f"{out}/cohort", f"{out}/checkpoint", INTAKE)
    return labels.select("doc_id", "series", "measure", "n_matched", F.array_join("matched", ",").alias("matched"), "subtype", "person", "resolved", "category")


def job2_instruction_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``conversations``."""
    out = shared_path(spark, "instruction_set")
    for _ in range(2):
        every = instruction_set.run(spark, f"{sf_dir}/conversations.parquet", out, CHAT)
    return every


_ALL = cohort_intake.categories(INTAKE)
_CATEGORY = sql_first("text", _ALL, nets.UNLABELED)
_MATCHED = " || ".join(f"CASE WHEN {sql_net('text', w)} THEN ['{n}'] ELSE [] END" for n, w in _ALL.items())

JOB1_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS series, n_chars, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL)
, m AS (SELECT doc_id, series, CAST(n_chars AS BIGINT) AS measure, {_MATCHED} AS every, {_CATEGORY} AS category, {PERSON_SQL.format(text="text")} AS raw, {sql_first("text", INTAKE["subtypes"], nets.UNRESOLVED)} AS subtype FROM d)
, p AS (SELECT *, CASE WHEN raw <> '' AND raw NOT IN ('na','n/a','none','unknown','-','?','not available') AND series <> '' THEN raw END AS pid FROM m)
SELECT doc_id, series, measure, CAST(len(every) AS INTEGER) AS n_matched, array_to_string(every, ',') AS matched, CASE WHEN category = 'alpha' THEN subtype END AS subtype,
  coalesce(series || '::' || pid, '__unresolved__::' || CAST(doc_id AS VARCHAR)) AS person, pid IS NOT NULL AS resolved, category
FROM p
"""

_PLACE = "CAST('0x' || substr(md5(r[1].question), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE"

JOB2_SQL = f"""
WITH c AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
, s AS (
  SELECT conv_id, count(*) AS n_turns, CAST(sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))) AS BIGINT) AS n_words, list({{'role': role, 'text': text}} ORDER BY turn, role, text) AS a
  FROM c GROUP BY conv_id
), b AS (SELECT *, n_words <= 400 AND n_turns <= 12 AS fits, CASE WHEN a[1].role = 'user' THEN a ELSE a[2:] END AS b FROM s)
, r AS (SELECT conv_id, n_words, fits, CASE WHEN fits AND len(b) % 2 = 0 THEN [{{'question': b[2*i+1].text, 'answer': b[2*i+2].text}} FOR i IN range(len(b) // 2)] END AS r FROM b)
, p AS (SELECT *, CASE WHEN len(r) > 0 THEN '{chat.SYSTEM.replace(chr(39), chr(39) * 2)} ' || array_to_string([('USER: ' || q.question || ' ASSISTANT: ' || q.answer || '</s>') FOR q IN r], '') END AS prompt FROM r)
, f AS (SELECT *, min(conv_id) OVER (PARTITION BY prompt) AS first FROM p)
, x AS (SELECT *, CASE WHEN NOT fits THEN 'too_long' WHEN r IS NULL THEN 'unpaired' WHEN len(r) = 0 THEN 'empty' WHEN first < conv_id THEN 'copy' END AS reason FROM f)
SELECT conv_id, CAST(len(r) AS INTEGER) AS n_rounds, n_words, CASE WHEN reason IS NULL THEN prompt END AS prompt,
  CASE WHEN reason IS NOT NULL THEN NULL WHEN {_PLACE} < 0.8::DOUBLE THEN 'train' WHEN {_PLACE} < 0.9::DOUBLE THEN 'valid' ELSE 'test' END AS split,
  CASE WHEN reason IS NULL THEN CAST(CASE WHEN n_words <= 1 THEN 0 ELSE length(bin(n_words - 1)) END AS INTEGER) END AS bucket, reason
FROM x
"""

QUERIES = {"job1_cohort_intake": job1_cohort_intake, "job2_instruction_set": job2_instruction_set}
ORACLES = {"job1_cohort_intake": JOB1_SQL, "job2_instruction_set": JOB2_SQL}
