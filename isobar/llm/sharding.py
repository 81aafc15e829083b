"""Sharding by minimax contiguous partition.

Documents are ordered by the digest of their text, so equal texts are
neighbours, an atomic group that never parts.  The smallest capacity for which a
greedy sweep over the ordered groups needs no more than the wanted number of shards
is found by binary search; then the groups are cut there, each cut as near to an
even share as the capacity still allows.

The driver does not see the groups, only sums over ranges of the digest space:
``2**RANGE_BITS`` ranges at first.  A capacity is certainly enough if the sweep
succeeds with whole ranges, and certainly too small if it fails although ranges of
several groups could be cut anywhere.  Where both leave a capacity open, the ranges
around the sweep's cuts are split into ``2**SPLIT_BITS`` parts and the sweep is
repeated, so the capacity found is the smallest for the groups themselves.

Slots are prefix sums over (shard, range, lane) counts plus a row number inside a
lane of about ``LANE`` rows, so a group of copies of a third of all rows is numbered
in many tasks.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut

#: Parameters of the production query.
SHARDS = 16
LANE = 2048
#: Bits of a group's place, of the first ranges and of each split.
PLACE_BITS, RANGE_BITS, SPLIT_BITS = 60, 14, 8
#: Ranges between two open cuts that are split at once; of more, those at both ends.
_NEAR = 64


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """Least c such that ``sizes``, in order, fill at most ``shards`` bins of c."""
    total = list(accumulate(sizes, initial=0))

    def feasible(c: int) -> bool:
        at = 0
        for _ in range(shards):
            at = bisect_right(total, total[at] + c) - 1
            if at == len(sizes):
                return True
        return False

    low, high = max(sizes, default=0), total[-1]
    while low < high:
        mid = (low + high) // 2
        if feasible(mid):
            high = mid
        else:
            low = mid + 1
    return low


def cut_points(sizes: list[int], shards: int) -> list[int]:
    """Start of each shard but the first, as indexes into ``sizes``.

    No shard exceeds the smallest capacity; within it each cut is the feasible
    one nearest to an even share.  Shards may be empty only when there are fewer
    atoms with rows than shards.
    """
    total = list(accumulate(sizes, initial=0))
    n, c = len(sizes), smallest_capacity(sizes, shards)
    # earliest[k]: the least start from which the last k shards can hold the rest
    earliest, at = [n], n
    for _ in range(shards):
        low, high = 0, at
        while low < high:
            mid = (low + high) // 2
            if total[at] - total[mid] <= c:
                high = mid
            else:
                low = mid + 1
        at = low
        earliest.append(at)
    cuts, at = [], 0
    for k in range(1, shards):
        low = max(at, earliest[shards - k])
        high = bisect_right(total, total[at] + c) - 1
        want = total[at] + (total[n] - total[at]) / (shards - k + 1)
        best = min(range(max(low, bisect_right(total, want) - 2), min(high, bisect_right(total, want)) + 1), key=lambda i: abs(total[i] - want), default=None)
        at = best if best is not None else (low if total[low] > want else high)
        cuts.append(at)
    return cuts


class Ranges:
    """Sums of ``groups(place, bytes)`` over ordered ranges of places, split on demand."""

    def __init__(self, groups: DataFrame):
        self.groups = groups
        width = PLACE_BITS - RANGE_BITS
        self.rows = self._sums(self.groups, width)  # (start, width, bytes, groups), in order

    def _sums(self, groups: DataFrame, width: int) -> list[tuple[int, int, int, int]]:
        """At most a row for each range of ``width`` bits asked for."""
        sums = groups.groupBy(F.shiftright("place", width).alias("r")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).collect()
        return sorted((r["r"] << width, width, r["b"], r["n"]) for r in sums)

    def split(self, which: set[int]) -> None:
        keep = [r for i, r in enumerate(self.rows) if i not in which]
        asked: dict[int, list[int]] = {}
        for i in which:
            start, width = self.rows[i][:2]
            asked.setdefault(width, []).append(start >> width)
        for width, starts in asked.items():
            keep += self._sums(self.groups.where(F.shiftright("place", width).isin(starts)), max(0, width - SPLIT_BITS))
        self.rows = sorted(keep)

    def sizes(self) -> list[int]:
        return [r[2] for r in self.rows]

    def sweep(self, c: int, shards: int, loose: bool) -> tuple[bool, list[int]]:
        """(do ``shards`` of capacity c suffice?, range of each cut); loose: ranges of several groups can be cut anywhere."""
        total = list(accumulate(self.sizes(), initial=0))
        at, cuts = 0, []
        for _ in range(shards):
            i = bisect_right(total, at + c) - 1
            if i == len(self.rows):
                return True, cuts
            cuts.append(i)
            at = at + c if loose and self.rows[i][3] > 1 else total[i]
        return False, cuts

    def capacity(self, shards: int) -> int:
        """The smallest capacity for the groups themselves; afterwards whole ranges reach it."""
        if not self.rows:
            return 0
        low = max(self.groups.agg(F.max("bytes")).first()[0], -(-sum(self.sizes()) // shards))
        high = smallest_capacity(self.sizes(), shards)
        while low < high:
            mid = (low + high) // 2
            enough, cuts = self.sweep(mid, shards, False)
            if enough:
                high = mid
                continue
            may, ends = self.sweep(mid, shards, True)
            open_ = {i for a, b in zip(cuts, ends, strict=False) for i in (range(a, b + 1) if b - a < _NEAR else (a, b)) if self.rows[i][3] > 1}
            if not may:
                low = mid + 1
            else:
                self.split(open_)
        return high


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> doc_id, size, text_crc32, law, shard, slot, grown_shard.

    One row per input row.  size: UTF-8 bytes of the text (null: none) plus 1.
    The law is ``bytes``: shard sizes are near equal, the largest as small as the
    order of groups (equal texts) allows.  slot numbers the rows of a shard
    without gaps from 0; ties (repeated rows of a group) are numbered in any
    order.  grown_shard is null (it belongs to another law).  A null text groups
    with the empty one.  An empty table gives an empty result.  Other columns are
    ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.conv(F.substring(F.md5(text.cast("binary")), 1, PLACE_BITS // 4), 16, 10).cast("long").alias("place"),
        F.monotonically_increasing_id().alias("row"),  # fixed once written
    )
    rows = cut(rows, "rows")
    groups = cut(rows.groupBy("place").agg(F.sum("size").alias("bytes")), "groups")
    ranges = Ranges(groups)
    ranges.capacity(shards)
    starts = [r[0] for r in ranges.rows] + [1 << PLACE_BITS]
    cuts = F.lit([starts[i] for i in cut_points(ranges.sizes(), shards)]).cast("array<bigint>")
    placed = rows.withColumns({"shard": F.size(F.filter(cuts, lambda c: c <= F.col("place"))), "range": F.shiftright("place", PLACE_BITS - RANGE_BITS).cast("int")})
    keys = ["shard", "range"]
    earlier = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(*keys).agg(F.count("*").alias("n"))
    base = counts.select(*keys, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"), F.ceil(F.col("n") / LANE).alias("lanes"))
    dealt = placed.join(F.broadcast(base), keys)  # at most 2**RANGE_BITS + shards rows
    dealt = dealt.withColumn("lane", F.pmod(F.xxhash64("row"), F.col("lanes")).cast("int"))
    before = Window.partitionBy(*keys).orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    lanes = dealt.groupBy(*keys, "lane").agg(F.count("*").alias("n")).select(*keys, "lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    numbered = dealt.withColumn("r", F.row_number().over(Window.partitionBy(*keys, "lane").orderBy("place", "doc_id", "row")))
    return numbered.join(lanes, [*keys, "lane"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("base") + F.col("ahead") + F.col("r") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
