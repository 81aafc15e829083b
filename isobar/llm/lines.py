"""Line deduplication with a levelled index of line hashes.

The index is a set of sorted runs, a written table each: (h1, h2) is a 128-bit
hash of the line key, ``docs`` in how many documents so far the key occurs, ``top``
the largest doc_id among them.  Every batch of documents is merge-joined with the
runs so far: keys that no run holds (the anti-join, ``fresh``) start their count,
known ones go on from theirs, and the batch's keys with their counts so far are its
run at level 0.  A key's row in a later run replaces earlier ones, so what has become
frequent is read off the runs without summing them.  When a batch fills a level, its
merge also takes in the run it was merged with (compaction), so a key lies in
O(log batches) runs.

Counts add over batches because a document lies in one batch only; a key
repeated inside a document counts once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import cut, new_path

#: Parameters of the production query.
MIN_CHARS, MIN_DOCS, BATCHES, FANOUT = 20, 3, 3, 2
#: A key in more than one document-line pair of this many is hot; hence at most so
#: many keys are hot, and a table of them may be broadcast whatever the input.
HOT = 10_000

_SPACES = " \t\n\u000b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    """A text's lines; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_SPACES)), _UPPER, _LOWER)


def _hashes(key: Column) -> Column:
    """128-bit hash of a key: two independently seeded 64-bit ones."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2"))


def _long_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, pos, h1, h2) of all lines whose key has min_chars code points."""
    return (
        docs.select("doc_id", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
        .select("doc_id", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("doc_id", "pos", _hashes(F.col("key")).alias("h"))
        .select("doc_id", "pos", "h.h1", "h.h2")
    )


def sightings(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, h1, h2): a row per document and distinct key of min_chars code points."""
    return (
        docs.select("doc_id", F.explode(F.array_distinct(F.transform(lines_of(F.col("text")), lambda x: line_key(x)))).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("doc_id", _hashes(F.col("key")).alias("h"))
        .select("doc_id", "h.h1", "h.h2")
    )


@dataclass
class LineIndex:
    """The runs, by level, of an index that lives in the shared folder."""

    spark: SparkSession
    min_chars: int = MIN_CHARS
    fanout: int = FANOUT
    levels: list[list[str]] = field(default_factory=list)

    _SCHEMA = "h1 long, h2 long, docs long, top long, fresh boolean"

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self._SCHEMA).parquet(*paths)

    def runs(self) -> list[str]:
        return [p for level in self.levels for p in level]

    def _latest(self, paths: list[str]) -> DataFrame:
        """h1, h2, docs, top: a row per key, its last one (counts and ids only grow)."""
        rows = self._read(paths).select("h1", "h2", "docs", "top")
        return rows if len(paths) == 1 else self._latest_of(rows)

    def _full_levels(self) -> int:
        """How many levels the next batch fills, from 0 up."""
        n = 0
        while n < len(self.levels) and len(self.levels[n]) + 1 >= self.fanout:
            n += 1
        return n

    def add(self, docs: DataFrame) -> DataFrame:
        """Merge a batch ``docs(doc_id, text)`` in; the run it wrote."""
        return self.merge(sightings(docs, self.min_chars))

    def merge(self, seen: DataFrame) -> DataFrame:
        """Merge a batch of ``sightings`` in; the run it wrote.

        ``fresh`` marks keys that no earlier run holds.  A run that fills its level
        also holds the keys of the runs it replaces, which are not fresh.
        """
        batch = seen.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("doc_id").alias("top")).withColumn("fresh", F.lit(True))
        full = self._full_levels()
        paths = self.runs()
        if paths:
            # Only what is replaced comes along whole; other runs are looked up.
            absorbed = [p for level in self.levels[:full] for p in level]
            known = self._latest(paths).select("h1", "h2", F.col("docs").alias("docs0"), F.col("top").alias("top0"))
            how = "left"
            if absorbed:
                how = "full"
                if len(absorbed) < len(paths):
                    mine = self._read(absorbed).select("h1", "h2", F.lit(True).alias("mine")).distinct()
                    known = known.join(mine.hint("merge"), ["h1", "h2"], "left")
            joined = batch.join(known.hint("merge"), ["h1", "h2"], how)
            if "mine" in joined.columns:
                joined = joined.where("docs IS NOT NULL OR mine")
            zero = F.lit(0)
            batch = joined.select(
                "h1", "h2", (F.coalesce("docs", zero) + F.coalesce("docs0", zero)).alias("docs"), F.greatest("top", "top0").alias("top"), F.col("docs0").isNull().alias("fresh")
            )
        path = new_path(self.spark, f"run{full}")
        batch.sortWithinPartitions("h1", "h2").write.parquet(path)
        for level in range(full):
            self.levels[level] = []
        if full == len(self.levels):
            self.levels.append([])
        self.levels[full].append(path)
        return self._read([path])

    def frequent(self, min_docs: int) -> DataFrame:
        """(h1, h2, docs, top) of keys found in at least min_docs documents."""
        return self._latest_of(self._read(self.runs()).where(F.col("docs") >= min_docs))

    @staticmethod
    def _latest_of(rows: DataFrame) -> DataFrame:
        return rows.groupBy("h1", "h2").agg(F.max("docs").alias("docs"), F.max("top").alias("top"))


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, drop) of the documents that lose lines; drop: sorted positions from 0.

    Lines of hot keys meet a broadcast table and are then dealt by document, so no
    task gets all lines of one key.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    index = LineIndex(docs.sparkSession, min_chars, fanout)
    seen = cut(sightings(docs, min_chars).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")), "sightings", by="batch")
    for k in range(batches):  # every document is in one batch
        index.merge(seen.where(F.col("batch") == k))
    frequent = cut(index.frequent(min_docs), "frequent")
    is_hot = F.col("docs") * HOT > seen.count()
    hot = frequent.where(is_hot).select("h1", "h2", F.col("top").alias("hot_top"))  # fewer than HOT rows
    met = _long_keys(docs, min_chars).join(F.broadcast(hot), ["h1", "h2"], "left").where("hot_top IS NULL OR doc_id <> hot_top")
    dealt = met.withColumn("h1", F.when(F.col("hot_top").isNotNull(), F.xxhash64("doc_id", "pos")).otherwise(F.col("h1")))
    lost = dealt.join(frequent.where(~is_hot).select("h1", "h2", "top"), ["h1", "h2"], "left").where("hot_top IS NOT NULL OR doc_id <> top")
    return lost.groupBy("doc_id").agg(F.array_sort(F.collect_set("pos")).alias("drop"))


def dedup_lines(docs: DataFrame, **parameters: int) -> DataFrame:
    """``docs`` with ``text`` cleaned, and n_lines, n_dropped (long).

    A line's key is the line without spaces and U+0009..U+000D at both ends, A-Z
    lower-cased.  Keys of at least ``min_chars`` code points found in at least
    ``min_docs`` documents lose all their lines except in the largest doc_id
    holding it.  Other lines stay, in order, joined by a newline.  A null or
    empty text is one empty line (text becomes empty); if all lines go the text
    is empty.  doc_id is expected to be unique; rows of one doc_id count as one
    document and lose the same positions.  A row with a null doc_id keeps all
    lines and is not counted.  Other columns pass through; clashing names
    (n_lines, n_dropped) are replaced.
    """
    drop = dropped_lines(docs, **parameters).select(F.col("doc_id").alias("_doc_id"), F.col("drop").alias("_drop"))
    made = ("doc_id", "text", "n_lines", "n_dropped")
    others = [c for c in docs.columns if c not in made]  # they travel as one struct: no name can clash
    packed = docs.select("doc_id", "text", *([F.struct(*(docs[c] for c in others)).alias("_row")] if others else []))
    out = packed.join(drop, F.col("doc_id").cast("long") == F.col("_doc_id"), "left")
    out = out.withColumn("_lines", lines_of(F.col("text").cast("string")))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_drop")
    new = {
        "doc_id": F.col("doc_id"),
        "text": F.when(F.col("_drop").isNull(), F.coalesce(F.col("text").cast("string"), F.lit(""))).otherwise(
            F.array_join(F.transform(kept, lambda i: F.get("_lines", i)), "\n")
        ),
        "n_lines": F.size("_lines").cast("long"),
        "n_dropped": F.coalesce(F.size("_drop"), F.lit(0)).cast("long"),
    }
    names = list(dict.fromkeys([*docs.columns, *made]))
    return out.select(*(new[c].alias(c) if c in made else F.col("_row").getField(c).alias(c) for c in names))
