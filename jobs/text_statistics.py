"""Running statistics of a growing text archive, per language, source and measure.

The text counterpart of a state archive's training statistics: each text is measured
(words, lines, ...), the measures are channels, and their moments are kept up to date
as files arrive, so that a filter or a normaliser can be set from them at any time.
Texts that cannot be measured are kept apart, with the reason.

Input: Parquet files with doc_id, text and the columns named by ``by``.  The file
stream's checkpoint is the high-water mark: a run takes the files that no run before it
has taken and ends when there is none left.  Output, all Parquet:

- ``parts/batch=``: count, mean, centred squares and extremes of what each batch brought;
- ``rejected/batch=``: doc_id and reason of the rows it could not measure;
- ``statistics/measure=``: everything merged, rewritten by each run.

A batch that is run again after a crash replaces its own partition, so a rerun ends
with the same tables.  Moments are merged from parts, a row per batch and group; no
document's row is read twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.operators.stats import mean_std, merge_moments
from isobar.sources.state import flatten_variables
from isobar.streaming.ingest import stream_table
from jobs.common import command_line, log

_SPACE = r"[\x20\x09-\x0D]"


def _lines() -> Column:
    return F.split("text", "\n", -1)


#: Measures of a text that is not null.  Words are runs of characters other than ASCII space.
MEASURES = {
    "characters": lambda: F.char_length("text"),
    "bytes": lambda: F.octet_length("text"),
    "words": lambda: F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")),
    "lines": lambda: F.size(_lines()),
    "upper_case": lambda: F.char_length("text") - F.char_length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")),
    "digits": lambda: F.char_length("text") - F.char_length(F.translate("text", "0123456789", "")),
    "line_repeats": lambda: F.size(_lines()) - F.size(F.array_distinct(_lines())),
}


def measured(docs: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """doc_id, by, reason, and a column per measure: a row per document; the text itself stays behind.

    A null or empty text has a reason and no values.
    """
    reason = F.when(F.col("text").isNull(), "null text").when(F.col("text") == "", "empty text")
    value = lambda m: F.when(F.col("text") != "", MEASURES[m]().cast("double")).alias(m)
    return docs.select("doc_id", *by, reason.alias("reason"), *map(value, measures))


def parts_of(told: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """by, measure, w, mean, m2, least, most of ``measured`` rows, combined map-side."""
    rows = flatten_variables(told.where("reason IS NULL").select(*by, *measures), by, measures).withColumnRenamed("channel", "measure")
    own = rows.groupBy(*by, "measure").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("v"), F.min("value").alias("least"), F.max("value").alias("most"))
    return own.select(*by, "measure", F.col("n").cast("double").alias("w"), "mean", (F.col("n") * F.col("v")).alias("m2"), "least", "most")


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """by, n, mean, std, least, most per measure: the parts of all batches."""
    keys = [*by, "measure"]
    # Groups of missing values must meet too: nulls get a stand-in beside a flag.
    stood = parts.select(*(F.struct(F.col(c).isNull().alias("gone"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("is")).alias(c) for c in by), "measure", "w", "mean", "m2", "least", "most")
    moments = merge_moments(stood, keys)
    ends = stood.groupBy(*keys).agg(F.min("least").alias("least"), F.max("most").alias("most"))
    out = mean_std(moments, [*keys, "w"]).join(ends, keys)
    back = [F.when(~F.col(f"`{c}`.gone"), F.col(f"`{c}`.is")).alias(c) for c in by]
    return out.select(*back, "measure", F.col("w").cast("long").alias("n"), "mean", "std", "least", "most")


def pattern(path: str) -> str:
    """A path as a pattern that matches it alone: a file stream takes a single file only so."""
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, source: str, output: str, config: dict) -> DataFrame:
    """Bring the statistics of a growing text archive up to date with the files that are new."""
    by, measures = list(config["by"]), list(config["measures"])
    if unknown := set(measures) - set(MEASURES):
        raise ValueError(f"unknown measures: {', '.join(sorted(unknown))}")
    taken = {"batches": 0}

    def put(batch: DataFrame, epoch: int) -> None:
        docs = batch.select("doc_id", F.col("text").cast("string").alias("text"), *by)
        told = measured(docs, by, measures).persist()  # some numbers a document; texts are read once
        try:
            parts_of(told, by, measures).write.mode("overwrite").parquet(f"{output}/parts/batch={epoch}")
            told.where("reason IS NOT NULL").select("doc_id", *by, "reason").write.mode("overwrite").parquet(f"{output}/rejected/batch={epoch}")
        finally:
            told.unpersist()
        taken["batches"] += 1
        log.info("wrote %s/parts and %s/rejected, batch %d", output, output, epoch)

    stream = stream_table(spark, pattern(source), config["files_per_batch"])
    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{output}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read %s: %d batches, %d rows that were new", source, taken["batches"], sum(p["numInputRows"] for p in query.recentProgress))

    parts = spark.read.parquet(f"{output}/parts").drop("batch")
    if set(parts.columns) != {*by, "measure", "w", "mean", "m2", "least", "most"}:
        raise ValueError(f"{output} was begun with other columns in 'by': take a new output folder")
    told = merged(parts, by)
    told.write.mode("overwrite").partitionBy("measure").parquet(f"{output}/statistics")
    out = spark.read.schema(told.schema).parquet(f"{output}/statistics").select(told.columns)
    log.info("wrote %s/statistics: %d rows", output, out.count())
    return out


if __name__ == "__main__":
    command_line("text_statistics", run)
