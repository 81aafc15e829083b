"""Temperature mixing of sources to target weights.

Token shares p of the sources are raised to an exponent and normalised; the
exponent is bisected until the weights meet a target entropy, or until no source
is repeated more often than a limit.  The weights times the token budget are the
sources' quotas.  A quota is realised as whole epochs (permutations of the
source) and a last, partial one that stops at the quota; every epoch is dealt
over the blocks of the mix in its own order, so each block holds the sources in
their weights.

Running token sums use levels (a source's hash range is cut into ``RANGES``, the
range in which its quota ends into ``RANGES`` again; only the rows of that last cell
are counted one by one), so a source of a third of all rows is summed in many
tasks and no task holds more of it than a millionth where the quota ends.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut

#: Parameters of the production query.
MAX_REPETITION, BLOCKS, SEED = 2.0, 64, 17
RANGES = 1024
#: Sources are a catalogue: more than this is an error, so the plan fits the driver.
MAX_SOURCES = 100_000


@dataclass(frozen=True)
class Mix:
    """exponent, token budget; per source its weight, quota and repetition."""

    exponent: float
    budget: float
    weight: dict
    quota: dict
    repetition: dict


def _weights(tokens: dict, exponent: float) -> dict:
    total = sum(tokens.values())
    raw = {s: (t / total) ** exponent for s, t in tokens.items()}
    norm = sum(raw.values())
    return {s: x / norm for s, x in raw.items()}


def entropy(weight: dict) -> float:
    return -sum(w * math.log(w) for w in weight.values() if w > 0)


def plan_mix(tokens: dict, max_repetition: float | None = MAX_REPETITION, target_entropy: float | None = None, budget: float | None = None) -> Mix:
    """Bisect the exponent in [0, 1]: 1 keeps the natural shares, 0 makes them equal.

    With ``target_entropy`` the weights reach it as nearly as the range allows;
    else the least exponent under which no source is repeated more than
    ``max_repetition`` times.  Without a budget it is the least that uses every
    source whole (no document is lost).  Sources without tokens get no weight and,
    where every source is used whole, one epoch.
    """
    live = {s: t for s, t in tokens.items() if t > 0}
    if not live:
        return Mix(1.0, 0.0, {}, {}, {s: 1.0 for s in tokens})

    def spread(x: float) -> tuple[dict, float, dict]:
        w = _weights(live, x)
        b = budget if budget is not None else max(live[s] / w[s] for s in live)
        return w, b, {s: w[s] * b / live[s] for s in live}

    def too_even(x: float) -> bool:
        w, _, r = spread(x)
        return entropy(w) > target_entropy if target_entropy is not None else max(r.values()) > max_repetition

    low, high = 0.0, 1.0
    if not too_even(0.0):
        high = 0.0
    else:
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if too_even(mid) else (low, mid)
    w, b, r = spread(high)
    return Mix(high, b, w, {s: w[s] * b for s in live}, {s: r.get(s, 1.0 if budget is None else 0.0) for s in tokens})


def token_count(text: Column) -> Column:
    """Words: maximal runs without space and U+0009..U+000D."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def _range_of(h: Column, level: int = 0) -> Column:
    """Which of the RANGES of level 0, or of a cell of the level before, holds the hash."""
    bits = RANGES.bit_length() - 1
    return F.shiftrightunsigned(F.shiftleft(h, bits * level), 64 - bits).cast("int")


def _tagged(docs: DataFrame, seed: int) -> DataFrame:
    tagged = docs.withColumns(
        {
            "_source": F.coalesce(F.col("source").cast("string"), F.lit("")),
            "_h": F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.col("text").cast("string")),
        }
    )
    return tagged.withColumns({"_range": _range_of(F.col("_h")), "_cell": _range_of(F.col("_h"), 1)})


def _counted(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, _tokens and the helper columns, without texts: words are counted once."""
    tokens = token_count(F.col("text").cast("string")).alias("_tokens")
    return cut(_tagged(docs.select("doc_id", "text", "source"), seed).select("doc_id", "_source", "_h", "_range", "_cell", tokens), "counted")


def _passing(sums: DataFrame, room: DataFrame, step: str) -> DataFrame:
    """_source, _at, _left: the first ``step`` of sums(_source, step, t) at which a source's
    running sum passes its ``_room``, and what of the room is left before it."""
    so_far = Window.partitionBy("_source").orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    run = sums.join(F.broadcast(room.select("_source", "_room")), "_source").withColumn("_run", F.sum("t").over(so_far)).where("_run > _room")
    return run.groupBy("_source").agg(F.min(step).alias("_at"), F.min_by(F.col("_room") - F.col("_run") + F.col("t"), step).alias("_left"))


def _plan(counted: DataFrame, **target) -> tuple[Mix, DataFrame]:
    """The mix and, per source, whole epochs and where the partial one ends: range,
    cell of it, and how many of its tokens still fit in that cell.

    The driver gets a row per source; running sums (RANGES rows a source) stay on the
    executors.  Tables that are broadcast here hold a row per source.
    """
    spark = counted.sparkSession
    sums = cut(counted.groupBy("_source", "_range").agg(F.sum("_tokens").alias("t")), "sums")
    held = sums.groupBy("_source").agg(F.sum("t").alias("t")).limit(MAX_SOURCES + 1).collect()
    if len(held) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    mix = plan_mix({r["_source"]: r["t"] for r in held}, **target)
    rows = []
    for r in held:
        times = mix.repetition[r["_source"]]
        whole = int(times + 1e-9)
        part = times - whole > 1e-9
        rows.append((r["_source"], whole, part, int(round((times - whole) * r["t"])) if part else 0))
    quota = spark.createDataFrame(rows, "_source string, _whole int, _part boolean, _room long")
    ends = quota.where("_part").join(_passing(sums, quota.where("_part"), "_range"), "_source", "left")
    ends = cut(ends.select("_source", F.coalesce("_at", F.lit(RANGES)).alias("_border"), F.coalesce("_left", F.lit(0)).alias("_room")), "ends")
    open_ = ends.where("_room > 0")
    edge = counted.join(F.broadcast(open_.select("_source", F.col("_border").alias("_range"))), ["_source", "_range"])
    cells = _passing(edge.groupBy("_source", "_cell").agg(F.sum("_tokens").alias("t")), open_, "_cell")
    plan = quota.select("_source", "_whole").join(ends.select("_source", "_border"), "_source", "left").join(cells, "_source", "left")
    zero = F.lit(0)
    return mix, cut(plan.select("_source", "_whole", F.coalesce("_border", zero).alias("_border"), F.coalesce("_at", zero).alias("_last"), F.coalesce("_left", zero).alias("_room")), "plan")


def _dealt(tagged: DataFrame, plan: DataFrame, tokens: Column) -> DataFrame:
    """The rows of ``tagged`` once per epoch they appear in (``_epoch``), with the helper columns."""
    placed = tagged.join(F.broadcast(plan), "_source")  # a row a source: at most MAX_SOURCES
    inside = (F.col("_range") < F.col("_border")) | ((F.col("_range") == F.col("_border")) & (F.col("_cell") < F.col("_last")))
    sure = placed.withColumn("_times", F.col("_whole") + inside.cast("int"))
    running = Window.partitionBy("_source").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    last = placed.where("_range = _border AND _cell = _last AND _room > 0").withColumn("_run", F.sum(tokens).over(running))
    last = last.where("_run <= _room").withColumn("_times", F.lit(-1)).drop("_run")
    whole = sure.where("_times > 0").withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)))
    return whole.unionByName(last.withColumn("_epoch", F.col("_whole")))


def mix_documents(docs: DataFrame, seed: int = SEED, **target) -> DataFrame:
    """``docs`` with every row as often as the mix draws it; same columns.

    Without a budget no document is lost: the scarcest weight sets the budget.  Null
    sources, null and empty texts, repeated rows and empty tables are taken as by
    :func:`mixture`.  Rows travel as one struct, so no column can clash with a
    helper's name.
    """
    _, plan = _plan(_counted(docs, seed), **target)
    packed = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("_row"))
    return _dealt(_tagged(packed, seed), plan, token_count(F.col("text").cast("string"))).select("_row.*")


def mixture(docs: DataFrame, blocks: int = BLOCKS, seed: int = SEED, **target) -> DataFrame:
    """``docs(doc_id, text, source, ...)`` -> doc_id, source, tokens, epoch, block, place.

    A row per draw of a document.  epoch: from 0, each a permutation of the
    source, the last one stopped at the quota (a document that would pass it is
    left out and ends it).  block: 0 to blocks - 1, by the draw's position in the
    token stream of its source.  place: order inside the block.  A null source is
    the source named by the empty string; null and empty texts have no tokens and
    are drawn in whole epochs.  Repeated rows are drawn as separate documents.  An
    empty table gives an empty result.
    """
    counted = _counted(docs, seed)
    mix, plan = _plan(counted, **target)
    rows = _dealt(counted, plan, F.col("_tokens"))
    spark = docs.sparkSession
    quota = spark.createDataFrame([(s, float(q)) for s, q in mix.quota.items()], "_source string, _quota double")
    drawn = rows.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "_source",
        F.col("_tokens").alias("tokens"),
        F.col("_epoch").alias("epoch"),
        F.xxhash64(F.lit(seed), "_epoch", "_h").alias("place"),
    ).withColumn("_range", _range_of(F.col("place")))
    keys = ["_source", "epoch", "_range"]
    ahead = Window.partitionBy("_source").orderBy("epoch", "_range").rowsBetween(Window.unboundedPreceding, -1)
    base = drawn.groupBy(*keys).agg(F.sum("tokens").alias("t")).select(*keys, F.coalesce(F.sum("t").over(ahead), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys).orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("_base") + F.coalesce(F.col("_in"), F.lit(0))
    return (
        drawn.withColumn("_in", F.sum("tokens").over(inside))
        .join(base, keys)
        .join(F.broadcast(quota), "_source", "left")  # a row a source
        .select(
            "doc_id",
            F.col("_source").alias("source"),
            "tokens",
            F.col("epoch").cast("int").alias("epoch"),
            F.least(F.lit(blocks - 1), F.coalesce(F.floor(at * blocks / F.col("_quota")), F.lit(0))).cast("int").alias("block"),
            "place",
        )
    )
