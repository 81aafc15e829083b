"""The jobs as queries: each runs twice into one new folder of the shared place and is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from isobar.plans import sql as S
from isobar.plans.catalogue import _scratch, rounded
from jobs import common, text_statistics, verify_baselines


def job1_verify_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _scratch(spark, "job1")
    for _ in range(2):
        out = verify_baselines.run(spark, f"{sf_dir}/embeddings.parquet", root, common.settings("verify_baselines"))
    return rounded(out)


def job2_text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _scratch(spark, "job2")
    for _ in range(2):
        out = text_statistics.run(spark, f"{sf_dir}/documents.parquet", root, common.settings("text_statistics"))
    return rounded(out)


QUERIES = {f.__name__: f for f in (job1_verify_baselines, job2_text_statistics)}

ORACLES = {
    "job1_verify_baselines": f"""WITH {S.WHOLE_FULL} SELECT model, CAST(lead AS INTEGER) AS lead, lead_hours, channel_idx, round(physical_rmse, 6) AS physical_rmse,
  round(normalized_acc, 6) AS normalized_acc, acc_valid_initializations, round(physical_bias, 6) AS physical_bias, round(spatial_variance_ratio, 6) AS spatial_variance_ratio FROM chan""",
    "job2_text_statistics": r"""WITH m AS (
  SELECT lang, source, unnest(['characters', 'bytes', 'words', 'lines', 'upper_case', 'digits', 'line_repeats']) AS measure,
    unnest([length(text), strlen(text), len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), len(string_split(text, chr(10))),
      length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')), length(text) - length(translate(text, '0123456789', '')),
      len(string_split(text, chr(10))) - len(list_distinct(string_split(text, chr(10))))]) AS value
  FROM documents WHERE text <> '')
SELECT lang, source, measure, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std,
  CAST(min(value) AS DOUBLE) AS least, CAST(max(value) AS DOUBLE) AS most FROM m GROUP BY 1, 2, 3""",
}
