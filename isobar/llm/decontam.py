"""Benchmark decontamination with template canonicalisation.

A text becomes a sequence of words in which numbers, names and units are typed
placeholders.  Windows of ``WINDOW`` template words are hashed and hash-joined
with those of the benchmark, so a question asked again with other numbers,
names or units meets the original.  Where a match holds placeholders their
values must map consistently: equal values of the item stand for equal values
of the document.

A window needs at least ``LITERALS`` words that are no placeholder, and a
document is reported for an item from ``MATCHED`` matching windows in one
alignment (all of them where an item has fewer).  With ``partial``, as the query
and the pipeline call it, windows that hold the item's own values are judged on
their own, so a verbatim part is found whatever stands elsewhere.

Items without such a window (short ones, or ones dense in placeholders) are found
by their whole sequence of words, with its values, and only as a verbatim copy.
An item's first word is compared without case, as it may read as a name elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ids import drop_ids, maybe
from .storage import cut

#: Parameters of the production query.
WINDOW, LITERALS, MATCHED = 8, 5, 4
#: Benchmark windows up to which they are broadcast (about 24 bytes each); beyond
#: it the windows are joined by a shuffle.
BROADCAST_WINDOWS = 1_000_000

# Unit words (lower case).
UNITS = (
    "mm", "cm", "km", "mg", "kg", "ml", "cl", "kb", "mb", "gb", "hz", "khz", "mhz", "kw", "mph", "kmh",
    "metre", "metres", "meter", "meters", "kilometre", "kilometres", "kilometer", "kilometers", "mile", "miles",
    "gram", "grams", "kilogram", "kilograms", "litre", "litres", "liter", "liters", "pound", "pounds", "ounce", "ounces",
    "dollar", "dollars", "euro", "euros", "cent", "cents", "percent", "degree", "degrees",
    "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
)

_NUMBER, _NAME, _UNIT = 1, 2, 3  # placeholders in place of a word's hash


def words(text: Column) -> Column:
    """Words of a text: ``_`` joins the parts of a number and leads a name.

    A name is a capitalised word inside a sentence (after a lower-case letter,
    comma or semicolon and one space).
    """
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "([0-9])[.,:](?=[0-9])", "$1_")
    t = F.regexp_replace(t, "(?=\\p{Lu})(?<=[\\p{Ll},;] )(\\p{Lu}\\p{Ll}+)", "_$1")
    return F.filter(F.split(t, "[^\\p{L}\\p{N}_]+"), lambda w: w != "")


def template(word_array: Column) -> Column:
    """A 64-bit hash per word; 1, 2, 3 for a number, name or unit."""

    def one(w: Column) -> Column:
        low = F.lower(w)
        return (
            F.when(w.between("0", "9~"), F.lit(_NUMBER).cast("long"))
            .when(w.startswith("_"), F.lit(_NAME).cast("long"))
            .when(low.isin(*UNITS), F.lit(_UNIT).cast("long"))
            .otherwise(F.xxhash64(low))
        )

    return F.transform(word_array, one)


def values(word_array: Column) -> Column:
    """A 64-bit hash per word, numbers, names and units included."""
    return F.transform(word_array, lambda w: F.xxhash64(F.ltrim(F.lower(w), F.lit("_"))))


def _starts(size: int = WINDOW) -> Column:
    """Where windows of ``h`` start; none where it is too short (filters may run later)."""
    return F.when(F.size("h") >= size, F.sequence(F.lit(0), F.size("h") - size)).otherwise(F.array().cast("array<int>"))


def _windows(rows: DataFrame, key: str) -> DataFrame:
    """(key, pos, w): every window of rows(key, v, h).

    One that starts with a name comes once more with the name as a word, as an
    item's capitalised first word reads as a name inside a sentence.
    """
    one = lambda i, first: F.struct(i.alias("pos"), F.xxhash64(first, *(F.get("h", i + j) for j in range(1, WINDOW))).alias("w"))
    many = F.transform(_starts(), lambda i: one(i, F.get("h", i)))
    named = F.filter(_starts(), lambda i: F.get("h", i) == _NAME)
    again = F.transform(named, lambda i: one(i, F.xxhash64(F.ltrim(F.lower(F.get("v", i)), F.lit("_")))))
    return rows.where(F.size("h") >= WINDOW).select(key, F.explode(F.concat(many, again)).alias("x")).select(key, "x.pos", "x.w")


def _whole(docs: DataFrame, items: DataFrame, windows: DataFrame) -> DataFrame:
    """``contaminated`` for the items without windows; docs: doc_id, v.

    An item is one window of its own length, or of more than WINDOW words several
    of WINDOW words that hold all of it and must meet in one alignment.
    """
    rest = items.where(F.size("words") > 0).join(windows.select("item_id", F.col("text_hash")).distinct(), ["item_id", "text_hash"], "left_anti")
    size = F.least(F.size("h"), F.lit(WINDOW))
    rest = rest.select("item_id", "text_hash", values(F.col("words")).alias("h")).withColumn("size", size)
    steps = F.array_distinct(F.concat(F.sequence(F.lit(0), F.size("h") - F.col("size"), F.col("size")), F.array(F.size("h") - F.col("size"))))
    parts = cut(rest.withColumn("steps", steps).select("item_id", "text_hash", "size", F.size("steps").alias("needed"), F.explode("steps").alias("at"), "h").withColumn("w", F.xxhash64(F.slice("h", F.col("at") + 1, F.col("size")))).drop("h"), "whole")
    sizes = sorted(r[0] for r in parts.select("size").distinct().collect())  # at most WINDOW
    hashed = docs.select("doc_id", values(F.col("v")).alias("h"))

    def parts_of(n: int) -> Column:
        return F.transform(_starts(n), lambda i: F.struct(F.lit(n).alias("size"), i.alias("pos"), F.xxhash64(F.slice("h", i + 1, n)).alias("w")))

    if not sizes:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, shift int, matched long, windows long, kind string")
    mine = hashed.select("doc_id", F.explode(F.concat(*map(parts_of, sizes))).alias("x")).select("doc_id", "x.*")
    small = parts.count() <= BROADCAST_WINDOWS
    met = mine.join(F.broadcast(parts) if small else parts, ["size", "w"])
    shift = F.when(F.col("needed") == 1, 0).otherwise(F.col("pos") - F.col("at"))
    aligned = met.groupBy("doc_id", "item_id", "text_hash", "needed", shift.alias("shift")).agg(F.count_distinct("at").alias("n"))
    one = F.lit(1).cast("long")
    return aligned.where("n = needed").select("doc_id", "item_id", "shift", one.alias("matched"), one.alias("windows"), F.lit("exact").alias("kind"))


def benchmark_windows(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, windows) of ``benchmark(item_id, text)``: item_id, words, h, text_hash; w, item_id, at, text_hash."""
    items = cut(
        benchmark.where("item_id IS NOT NULL")
        .select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text").cast("string")).alias("words"))
        .distinct()
        .withColumn("h", template(F.col("words")))
        .withColumn("text_hash", F.xxhash64("words")),
        "items",
    )
    literal = lambda i: F.size(F.filter(F.slice("h", i + 1, WINDOW), lambda x: ~x.between(_NUMBER, _UNIT)))
    good = F.filter(_starts(), lambda i: literal(i) >= LITERALS)
    usable = items.where(F.size("h") >= WINDOW).select("item_id", "text_hash", "h", good.alias("good"))
    windows = usable.select("item_id", "text_hash", F.explode("good").alias("at"), "h").select(
        "item_id", "text_hash", "at", F.size("h").alias("length"), F.xxhash64(*(F.get("h", F.col("at") + j) for j in range(WINDOW))).alias("w")
    )
    return items, cut(windows, "windows")


def contaminated(docs: DataFrame, benchmark: DataFrame, partial: bool = False) -> DataFrame:
    """``doc_id, item_id, matched, windows, kind``: a row per document and item it repeats.

    matched: windows of the item found in the document, of ``windows`` usable
    ones; kind: ``exact`` where all placeholders hold the item's own values, else
    ``reparameterised``.  Values must map consistently from the first to the last
    window.  With ``partial`` only over the windows that hold other values; where
    those do not, they do not count, and the windows that hold the item's own
    values are reported as ``exact`` if they suffice by themselves.  Null and empty texts and null ids match nothing.  An
    item without usable windows counts as one window, its whole text.  Repeated items
    or documents of one id count once.  Other columns are ignored.
    """
    items, windows = benchmark_windows(benchmark)
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    split = texts.select("doc_id", words(F.col("text")).alias("v"))
    mine = _windows(split.select("doc_id", "v", template(F.col("v")).alias("h")), "doc_id")
    small = windows.count() <= BROADCAST_WINDOWS
    met = mine.join(F.broadcast(windows) if small else windows, "w")
    aligned = met.select("doc_id", "item_id", (F.col("pos") - F.col("at")).alias("shift"), "at").groupBy("doc_id", "item_id", "shift").agg(F.count_distinct("at").alias("matched"), F.array_sort(F.collect_set("at")).alias("ats"))
    total = windows.groupBy("item_id").agg(F.count_distinct("at", "w").alias("windows"))
    found = cut(aligned.join(total, "item_id").where(F.col("matched") >= F.least(F.lit(MATCHED), F.col("windows"))), "found")
    slotted = items.where(F.exists("h", lambda x: x.between(_NUMBER, _UNIT))).select("item_id", F.col("words").alias("iw"), F.col("h").alias("ih"))
    asked = found.join(slotted, "item_id")
    plain = found.join(slotted.select("item_id"), "item_id", "left_anti").withColumn("kind", F.lit("exact"))
    if not asked.isEmpty():
        wanted = maybe(texts, "doc_id", asked.select("doc_id")).join(asked.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
        both = asked.join(wanted.select("doc_id", words(F.col("text")).alias("dw")), "doc_id")
        pair = lambda p: F.struct(F.lower(F.get("iw", p)).alias("i"), F.lower(F.get("dw", p + F.col("shift"))).alias("d"))
        slots = lambda a, b: F.filter(F.sequence(a, b), lambda p: F.get("ih", p).between(_NUMBER, _UNIT))
        own = lambda p: pair(p)["i"].eqNullSafe(pair(p)["d"])
        checked = both.withColumn("own", F.filter("ats", lambda a: F.forall(slots(a, a + WINDOW - 1), own)))
        if partial:
            covered = F.array_distinct(F.flatten(F.transform(F.array_except("ats", "own"), lambda a: slots(a, a + WINDOW - 1))))
        else:
            covered = slots(F.element_at("ats", 1), F.element_at("ats", -1) + WINDOW - 1)
        checked = checked.withColumn("pairs", F.array_distinct(F.transform(covered, pair)))
        consistent = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda x: x["i"])))
        same = F.forall("pairs", lambda x: x["i"].eqNullSafe(x["d"]))
        judged = checked.withColumn("kind", F.when(same, "exact").otherwise("reparameterised")).withColumn("consistent", consistent)
        kept = judged.where("consistent")
        if partial:
            verbatim = judged.where(~F.col("consistent") & (F.size("own") >= F.least(F.lit(MATCHED), F.col("windows"))))
            kept = kept.unionByName(verbatim.withColumn("matched", F.size("own").cast("long")).withColumn("kind", F.lit("exact")))
        plain = plain.unionByName(kept.select(*found.columns, "kind"))
    plain = plain.select("doc_id", "item_id", "shift", "matched", "windows", "kind").unionByName(_whole(split, items, windows))
    best = Window.partitionBy("doc_id", "item_id").orderBy(F.desc("matched"), "kind", "shift")
    return plain.withColumn("r", F.row_number().over(best)).where("r = 1").select("doc_id", "item_id", F.col("matched").cast("long").alias("matched"), F.col("windows").cast("long").alias("windows"), "kind")


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, partial: bool = False) -> DataFrame:
    """``docs`` without the documents that repeat a benchmark item; same columns.

    Null and empty texts, and rows with a null id, are kept; rows that repeat a doc_id
    go or stay together.  An empty table or benchmark changes nothing.  Only
    rows that may go are shuffled.
    """
    bad = cut(contaminated(docs, benchmark, partial).select("doc_id").distinct().withColumn("goes", F.lit(True)), "bad")
    return drop_ids(docs, "doc_id", bad)
