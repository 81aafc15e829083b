"""N-gram Jaccard join by parity sketches.

Tokens are the distinct five-word shingles of a text (64-bit hashes).  A set of
size ``a`` belongs to the size band ``m = floor(log2 a)``; a band cuts the hash
space into ``2**m`` equal cells and XORs the hashes that fall in a cell into
one 64-bit word.  Each token changes one cell only, so the number of differing
cells (and, for the 1024-bit parity sketch, the Hamming distance) never exceeds
the symmetric difference of the two sets.

Jaccard >= 3/4 means ``7 * symmetric_difference <= a + b``.  With at most
``d`` differing cells two sketches agree on all but ``d`` cells, hence under any
total order of (cell, word) tokens they share one of their first ``d + 1``
(pigeonhole): only these are indexed.  A set also enters the band below when a
partner there can be similar enough, so bands never need comparing.

The order puts first the cells with most rare shingles.  Two sets that share a
token hold the same shingles in that cell, so this is one order for all sets.
Shingles that several sets of one stretch of the input hold are frequent; a bitmap
of fixed size says which (a false positive only moves a cell back, in all sets
alike).  So passages that many texts share are hardly ever indexed, and a bucket
of over ``BUCKET`` sets is, in practice, a group of near copies of one text.

Such a bucket emits no pairs.  It elects a leader ``l``, the set that is in most
crowded buckets, and every other set x of it is compared with l exactly.  Of two
sets that both link with l nothing more is asked.  What x adds to l and lacks of l,
``A = x xor l``, stands for x then: ``A_x xor A_y = x xor y``, so the common text
cancels.  If y does not link with l, a similar x must share so many elements of its
A with A_y that the first ones (added and rare elements before lacking ones)
meet; these are the tokens of the next level, where only true relatives share
buckets.  Buckets that are still crowded there elect leaders again.  Components of
the links found so far drop what needs no comparing.  After ``LEVELS`` levels
what is left is compared in full by its sketches, so no link between different
components is lost, and no bucket is capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import components
from .ids import drop_ids, maybe
from .storage import cut, release, small_batches
from .text import mix, shingle_sets

#: Sets in a bucket up to which all pairs are taken.
BUCKET = 16
#: Bits of the frequent-shingle and wanted-document bitmaps (1 MiB each, whatever the input).
BITMAP_BITS = 1 << 23
#: Levels of leaders in crowded buckets; sets that are sent one copy of a leader.
LEVELS, SQUAD = 5, 64
#: Bands of how far a set is from linking with its leader: 7 a - s - l exceeds these.
EXCESS = (0, 28, 84, 196)
_BAND_KEYS = tuple(int(x) for x in np.random.Generator(np.random.PCG64(9)).integers(-(2**63), 2**63 - 1, len(EXCESS)))
#: A shingle is frequent when this many different sets hold it in one stretch of
#: the input of about STRETCH shingles.
FREQUENT, STRETCH = 3, 1 << 20
#: Shingles of the sets a task remembers while it counts what pairs share.
HELD = 1 << 20
SKETCH_BITS = 1024
_TEXTS = 128

_META = "doc_id long, n long, node long, sketch array<long>, often array<long>"
_TOKENS = "key long, node long"
_MET = "a long, b long, crowded boolean"
_COMMON = "a long, b long, common long"
_LEVEL = "key long, node long, c long, left int, mass int"
_FRAMES = "leader long, node long, linked boolean, n_index array<int>, band int, size int, mass int, tokens array<long>"


def _node(h: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sketch(h: np.ndarray) -> np.ndarray:
    bits = np.bincount((h & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(bits.astype(bool)).view(np.int64)


def _bands(a: int) -> list[tuple[int, int]]:
    """(band, most differing cells) of every band that a set of size a enters."""
    m = a.bit_length() - 1
    out = [(m, (a + 4 * a // 3) // 7)]
    top = (1 << m) - 1  # largest set of the band below
    if m and 3 * a <= 4 * top:
        out.append((m - 1, (a + top) // 7))
    return out


def _cells(h: np.ndarray, m: int, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token keys of the non-empty cells, their rare shingles, and which cells they are."""
    cell = h >> np.uint64(64 - m) if m else np.zeros(len(h), dtype=np.uint64)
    at = np.flatnonzero(np.diff(cell, prepend=~cell[:1]))
    word = np.bitwise_xor.reduceat(h, at)
    used = cell[at]
    tag = mix(used + np.uint64((m + 1) << 40))
    return mix(word ^ tag), np.add.reduceat(rare, at), used


def _empty_keys(m: int, used: np.ndarray, need: int) -> np.ndarray:
    free = np.setdiff1d(np.arange(1 << m, dtype=np.uint64), used)
    return np.sort(mix(~mix(free + np.uint64((m + 1) << 40))))[:need]


def _in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = (keys >> np.uint64(64 - (BITMAP_BITS.bit_length() - 1))).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _prefix(h: np.ndarray, m: int, d: int, rare: np.ndarray) -> np.ndarray:
    """The first d + 1 tokens: most rare shingles first, empty cells last."""
    keys, weight, used = _cells(h, m, rare)
    order = keys[np.lexsort((keys, -weight))[: d + 1]]
    if len(order) <= d:
        order = np.concatenate([order, _empty_keys(m, used, d + 1 - len(order))])
    return order


def _slices(batch: pa.RecordBatch, columns: list[str]) -> Iterator[list[list]]:
    for at in range(0, batch.num_rows, _TEXTS):
        part = batch.slice(at, _TEXTS)
        yield [part.column(c).to_pylist() for c in columns]


def _frequent(sets: list[np.ndarray]) -> np.ndarray:
    if not sets:
        return np.zeros(0, np.int64)
    every = np.sort(np.concatenate(sets))
    return np.unique(every[: 1 - FREQUENT][every[FREQUENT - 1 :] == every[: 1 - FREQUENT]]).view(np.int64)


def _meta(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document; at the end of a stretch its frequent shingles ride on one row."""
    held: dict[int, np.ndarray] = {}
    size = 0
    last: list[pa.Array] = []  # rows not sent yet: the partition's last ones end its last stretch

    def sent() -> pa.RecordBatch:
        nonlocal held, size
        often: list = [None] * len(last[0])
        if size >= STRETCH or done:
            often[0] = _frequent(list(held.values()))
            held, size = {}, 0
        return pa.RecordBatch.from_arrays([*last, pa.array(often, pa.list_(pa.int64()))], ["doc_id", "n", "node", "sketch", "often"])

    done = False
    for batch in batches:
        for ids, texts in _slices(batch, ["doc_id", "text"]):
            if last:
                yield sent()
            sets = list(shingle_sets(texts))
            nodes = [_node(h) for h in sets]
            for node, h in zip(nodes, sets, strict=True):
                if node not in held:
                    held[node] = h
                    size += len(h)
            last = [
                pa.array(ids, pa.int64()),
                pa.array([len(h) for h in sets], pa.int64()),
                pa.array(nodes, pa.int64()),
                pa.array([_sketch(h) for h in sets], pa.list_(pa.int64())),
            ]
    done = True
    if last:
        yield sent()


def _emit(keys: list[np.ndarray], nodes: list[int]) -> pa.RecordBatch:
    key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    node = np.repeat(np.array(nodes, dtype=np.int64), [len(k) for k in keys])
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node)], ["key", "node"])


def _tokens(frequent: bytes):
    """Prefix tokens of every distinct set of a task (copies add a row per task, not each)."""
    bits = np.frombuffer(frequent, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for (texts,) in _slices(batch, ["text"]):
                keys, owner = [], []
                for h in shingle_sets(texts):
                    if not len(h) or (node := _node(h)) in seen:
                        continue
                    seen.add(node)
                    rare = (~_in_bitmap(bits, h)).astype(np.int64)
                    for m, d in _bands(len(h)):
                        keys.append(_prefix(h, m, d, rare))
                        owner.append(node)
                yield _emit(keys, owner)

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens sorted by (key, node) -> pairs of small buckets (a, b), rows of crowded ones (key, node).

    A bucket of any size streams: once it is known to be crowded its rows leave at once.
    """

    def out(a: np.ndarray, b: np.ndarray, crowded: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(crowded)], ["a", "b", "crowded"])

    def flush(key: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node = key[new], node[new]
        at = np.flatnonzero(np.diff(key, prepend=~key[:1]))
        size = np.diff(np.append(at, len(key)))
        crowd = np.repeat(size > BUCKET, size)
        left, right, hot = [key[crowd]], [node[crowd]], [np.ones(int(crowd.sum()), bool)]
        for step in range(1, min(BUCKET, int(size.max(initial=1)))):
            same = np.flatnonzero((key[step:] == key[:-step]) & ~crowd[step:])
            left.append(node[same])
            right.append(node[same + step])
            hot.append(np.zeros(len(same), bool))
        a, b, c = map(np.concatenate, (left, right, hot))
        if len(a):
            yield out(a, b, c)

    key = node = np.zeros(0, np.int64)
    open_key = None
    for batch in batches:
        k = np.concatenate([key, batch.column("key").to_numpy(zero_copy_only=False)])
        v = np.concatenate([node, batch.column("node").to_numpy(zero_copy_only=False)])
        if (k[1:] < k[:-1]).any():
            raise ValueError("tokens must arrive sorted by key")
        if open_key is not None:
            more = int(np.searchsorted(k, open_key, "right"))
            if more:
                yield out(np.full(more, open_key), v[:more], np.ones(more, bool))
            k, v = k[more:], v[more:]
            if len(k):
                open_key = None
        if not len(k):
            key, node = k, v
            continue
        last = int(np.searchsorted(k, k[-1], "left"))
        if last:
            yield from flush(k[:last], v[:last])
        key, node = k[last:], v[last:]
        if len(node) > 1:  # of copies that several tasks sent one stays
            node = np.unique(node)
            key = key[: len(node)]
        if len(node) > BUCKET:
            yield from flush(key, node)
            open_key = int(key[0])
            key, node = key[:0], node[:0]
    if len(key):
        yield from flush(key, node)


def _bitmap(spark: SparkSession, ids: DataFrame, position) -> bytes:
    """Bitmap of BITMAP_BITS bits set at the positions of the rows of ids (aggregated
    on the executors; the driver gets at most 1 MiB)."""
    rows = (
        ids.select(position.alias("p"))
        .groupBy(F.bitmap_bucket_number("p").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
        .collect()
    )
    out = np.zeros(BITMAP_BITS // 8, dtype=np.uint8)
    for r in rows:  # at most BITMAP_BITS / 32768 rows of 4 KiB
        at = (r["bucket"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(r["bits"], np.uint8)
    return out.tobytes()


def _key_position(column: str):
    # bitmap_bucket_number counts from 1 and bit positions from value - 1 within a bucket
    return F.shiftrightunsigned(F.col(column), 64 - (BITMAP_BITS.bit_length() - 1)) + 1


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    size = 0
    for batch in batches:
        for a, b, ta, tb in _slices(batch, ["a", "b", "text_a", "text_b"]):
            fresh = {k: t for k, t in zip(a + b, ta + tb, strict=True) if k not in held}
            if size > HELD:
                held, size = {}, 0
                fresh = dict(zip(a + b, ta + tb, strict=True))
            for k, h in zip(fresh, shingle_sets(list(fresh.values())), strict=True):
                held[k] = h
                size += len(h)
            n = [len(np.intersect1d(held[x], held[y], assume_unique=True)) for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "common"])


def _differences(frequent: bytes):
    """For (leader, node) with their texts: do they link, and the first elements of node xor leader.

    With sizes s and l of set and leader and a of their difference, let m = 7 a - s.
    Two similar sets x and y share at least (m_x + m_y) / 14 elements of their
    differences.  A set y that does not link with the leader has m_y > l + EXCESS[band];
    so n_index[band] first elements of x must hold one of y's, and y's own ``tokens``
    are those that must hold one of any x of a size that y allows.
    """
    bits = np.frombuffer(frequent, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leads: dict[int, np.ndarray] = {}
        for batch in batches:
            for leaders, nodes, tl, tx in _slices(batch, ["leader", "node", "text_l", "text_x"]):
                linked, n_index, band, size, mass, tokens = [], [], [], [], [], []
                for leader, text, h in zip(leaders, tl, shingle_sets(tx), strict=True):
                    if leader not in leads:
                        if sum(map(len, leads.values())) > HELD:
                            leads.clear()
                        leads[leader] = next(shingle_sets([text]))
                    lead = leads[leader]
                    diff = np.setxor1d(h, lead, assume_unique=True)
                    s, big, a = len(h), len(lead), len(diff)
                    near = 7 * a <= s + big  # Jaccard >= 3/4
                    index = [max(0, a - (7 * a - s + big + e) // 14) for e in EXCESS]
                    probe = index[0] if near else max(index[0], min(a, (s + 4 * s // 3) // 7 + 1))
                    lacking = np.isin(diff, lead, assume_unique=True)
                    rank = np.where(lacking, 2, _in_bitmap(bits, diff).astype(np.int64))
                    first = diff[np.lexsort((diff, rank))[:probe]]
                    linked.append(near)
                    n_index.append(index)
                    band.append(sum(7 * a - s - big > e for e in EXCESS) - 1)
                    size.append(a)
                    mass.append(7 * a - s)
                    tokens.append(mix(first ^ mix(np.array([leader], np.int64).view(np.uint64))).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(leaders, pa.int64()),
                        pa.array(nodes, pa.int64()),
                        pa.array(linked, pa.bool_()),
                        pa.array(n_index, pa.list_(pa.int32())),
                        *(pa.array(x, pa.int32()) for x in (band, size, mass)),
                        pa.array(tokens, pa.list_(pa.int64())),
                    ],
                    ["leader", "node", "linked", "n_index", "band", "size", "mass", "tokens"],
                )

    return run


def _hamming(x: str, y: str):
    words = [F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(SKETCH_BITS // 64)]
    return reduce(lambda a, b: a + b, words)


def _plausible():
    """May the sets a and b (columns n_a, sketch_a, ...) link, by their sizes and sketches?"""
    sizes = 4 * F.least("n_a", "n_b") >= 3 * F.greatest("n_a", "n_b")
    return sizes & (7 * _hamming("sketch_a", "sketch_b") <= F.col("n_a") + F.col("n_b"))


def _screened(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of pairs(a, b) those that may link, with the sizes of both sets."""
    side = lambda s: nodes.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(_plausible()).select("a", "b", "n_a", "n_b")


def _squads(rows: DataFrame, head: str, member: str) -> tuple[DataFrame, DataFrame]:
    """rows with ``part``, and (head, part): about SQUAD members of a head share a part."""
    parts = rows.groupBy(head).agg(F.ceil(F.count("*") / SQUAD).cast("int").alias("parts"))
    dealt = rows.join(parts, head).withColumn("part", F.pmod(F.xxhash64(member), F.col("parts")).cast("int")).drop("parts")
    return dealt, parts.select(head, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))


def _verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of pairs(a, b, n_a, n_b), those with Jaccard >= 3/4, counted exactly on the texts."""
    dealt, heads = _squads(pairs, "a", "b")
    counted = (
        dealt.select("a", "part", "b")
        .join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        .join(heads.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a"), ["a", "part"])
        .select("a", "b", "text_a", "text_b")
        .mapInArrow(_common, _COMMON)
    )
    return pairs.join(counted, ["a", "b"]).where("100 * common >= 75 * (n_a + n_b - common)").select("a", "b")


def _frames(texts: DataFrame, rows: DataFrame, frequent: bytes) -> DataFrame:
    """Crowded buckets rows(key, node, c) -> every set with the leader of each of its buckets.

    The leader is of the bucket's largest component, and in most buckets.
    """
    busy = rows.groupBy("node").agg(F.count("*").alias("buckets"))
    heads = rows.join(busy, "node").groupBy("key", "c").agg(F.max_by("node", F.struct("buckets", "node")).alias("leader"), F.max("buckets").alias("buckets"), F.count("*").alias("n"))
    first = heads.groupBy("key").agg(F.max_by(F.struct("leader", "c"), F.struct("n", "buckets", "leader")).alias("x")).select("key", "x.*")
    # A leader that sits in a bucket of one who leads more gives way to it: few leaders a set.
    led = first.groupBy("leader").agg(F.count("*").alias("led"))
    meets = rows.join(led.select(F.col("leader").alias("node")), "node").join(first.join(led, "leader"), ["key", "c"])
    above = meets.groupBy("node").agg(F.max_by("leader", F.struct("led", "leader")).alias("above"))
    leads = first.join(above.withColumnRenamed("node", "leader"), "leader").select("key", F.col("above").alias("leader"))
    asked = cut(rows.join(leads, "key").where("node <> leader").select("leader", "node").distinct(), "asked", narrow=True)
    dealt, heads = _squads(asked, "leader", "node")
    out = cut(
        dealt.join(texts.select("node", F.col("text").alias("text_x")), "node")
        .join(heads.join(texts.select(F.col("node").alias("leader"), F.col("text").alias("text_l")), "leader"), ["leader", "part"])
        .select("leader", "node", "text_l", "text_x")
        .mapInArrow(_differences(frequent), _FRAMES),
        "frames",
    )
    release(asked)
    return out


def _component(comp: DataFrame, node: str, name: str) -> DataFrame:
    return comp.select(F.col("node").alias(node), F.col("component").alias(name))


def _answering(bits: bytes):
    """Index tokens of frames for the bands asked for, where a probe may hold the same."""
    asked = np.frombuffer(bits, np.uint8)
    band_keys = np.array(_BAND_KEYS, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 1024) for at in range(0, batch.num_rows, 1024)):
                key, row, at = [], [], []
                for i, (tokens, n, bands) in enumerate(zip(part.column("tokens"), part.column("n_index").to_pylist(), part.column("bands").to_pylist(), strict=True)):
                    held = tokens.values.to_numpy(zero_copy_only=False)
                    for band in bands:
                        keys = held[: n[band]] ^ band_keys[band]
                        hit = np.flatnonzero(_in_bitmap(asked, keys.view(np.uint64)))
                        key.append(keys[hit])
                        at.append(hit)
                        row.append(np.full(len(hit), i))
                if not key:
                    continue
                row = pa.array(np.concatenate(row))
                left = part.column("size").take(row).to_numpy() - np.concatenate(at).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(key)), part.column("node").take(row), part.column("c").take(row), pa.array(left, pa.int32()), part.column("mass").take(row)], ["key", "node", "c", "left", "mass"]
                )

    return run


def _next_level(frames: DataFrame, comp: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(index, probe) tokens(key, node, c, left, mass) of frames whose sets lie in several components.

    Only sets in another component than their leader (``few``) probe: a pair that
    matters holds one.  Index tokens that no probe can meet stay out, by a bitmap of
    fixed size.  left: elements from the token on, at most so many are shared.
    """
    placed = frames.join(_component(comp, "node", "c"), "node", "left").join(_component(comp, "leader", "of"), "leader", "left")
    placed = placed.withColumn("c", F.coalesce("c", "node")).withColumn("few", F.col("c") != F.coalesce("of", "leader"))
    band_key = F.get(F.array(*map(F.lit, _BAND_KEYS)), F.col("band"))
    spread = placed.where("few").select("node", "c", "size", "mass", band_key.alias("band_key"), F.posexplode("tokens").alias("at", "token"))
    probe = cut(spread.select(F.col("token").bitwiseXOR(F.col("band_key")).alias("key"), "node", "c", (F.col("size") - F.col("at")).alias("left"), "mass"), "probe")
    bits = _bitmap(frames.sparkSession, probe, _key_position("key"))
    bands = placed.where("few").groupBy("leader").agg(F.collect_set("band").alias("bands"))
    index = placed.join(bands, "leader").select("node", "c", "size", "mass", "n_index", "bands", "tokens").mapInArrow(_answering(bits), _LEVEL)
    return cut(index, "index"), probe


def _deal(index: DataFrame, probe: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tokens of a level -> (pairs(a, b) of small buckets, rows(key, node, c) of crowded ones, the table both come from).

    A bucket with at most BUCKET rows of either kind emits at most so many pairs a row.
    """
    rows = index.withColumn("probe", F.lit(False)).unionByName(probe.withColumn("probe", F.lit(True)))
    size = rows.groupBy("key").agg(F.count_if(~F.col("probe")).alias("n_index"), F.count_if("probe").alias("n_probe"), F.min("c").alias("low"), F.max("c").alias("high"))
    size = size.where("low <> high AND n_index > 0 AND n_probe > 0")
    dealt = cut(rows.join(size.select("key", (F.least("n_index", "n_probe") > BUCKET).alias("crowded")), "key"), "dealt")
    side = lambda s, which: dealt.where(~F.col("crowded") & which).select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "c", "left", "mass")))
    met = side("x", ~F.col("probe")).join(side("y", F.col("probe")), "key").where("c_x <> c_y AND 14 * least(left_x, left_y) >= mass_x + mass_y")
    met = met.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()
    return met, dealt.where("crowded").select("key", "node", "c").distinct(), dealt


def _in_full(rows: DataFrame, comp: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs(a, b) of the sets of a bucket that lie in different components and may link."""
    placed = rows.drop("c").join(comp, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c")).join(nodes.select("node", "n", "sketch"), "node")
    side = lambda s: placed.select("key", F.col("node").alias(s), F.col("c").alias(f"c_{s}"), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}"))
    return side("a").join(side("b"), "key").where("a < b AND c_a <> c_b").where(_plausible()).select("a", "b").distinct()


def _pairs_in(rows: DataFrame) -> int:
    """Pairs of the crowded buckets rows(key, node, ...)."""
    size = rows.groupBy("key").agg(F.count("*").alias("n"))
    return size.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0


def _linked_components(links: DataFrame) -> DataFrame:
    found = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    out = cut(found, "comp", narrow=True)
    release(found)
    return out


def similar_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, nodes, links) of a similarity join of ``docs(doc_id, text)``.

    members(doc_id, n, node): a row per input row; rows with equal shingle
    sets share ``node``.  nodes(node, n, sketch, doc): one row per distinct
    set, doc its least doc_id.  links(a, b): verified links between nodes, enough
    of them that their components are those of all links.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    meta = cut(docs.mapInArrow(_meta, _META), "meta")
    nodes = cut(
        meta.where("n > 0 AND doc_id IS NOT NULL").groupBy("node").agg(F.max("n").alias("n"), F.any_value("sketch").alias("sketch"), F.min("doc_id").alias("doc")),
        "nodes",
    )
    frequent = _bitmap(spark, meta.select(F.explode("often").alias("h")), _key_position("h"))
    tokens = docs.where("doc_id IS NOT NULL").select("text").mapInArrow(_tokens(frequent), _TOKENS)
    met = cut(tokens.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_meet, _MET), "met")
    pairs = [cut(_screened(nodes, met.where("NOT crowded").select("a", "b").distinct()), "pairs", narrow=True)]
    rows = cut(met.where("crowded").select(F.col("a").alias("key"), F.col("b").alias("node"), F.lit(0).cast("long").alias("c")), "crowded", narrow=True)
    release(met)
    # Texts of the sets that meet any other, read once.
    asked = pairs[0].select(F.explode(F.array("a", "b")).alias("node")).unionByName(rows.select("node")).distinct().join(nodes.select("node", "doc"), "node")
    asked = cut(asked, "asked", narrow=True)
    texts = maybe(docs, "doc_id", asked.select("doc")).join(asked.withColumnRenamed("doc", "doc_id"), "doc_id").dropDuplicates(["doc_id"])
    texts = cut(texts.select("node", "text"), "texts")
    release(asked)
    # One edge a set first: of a small group of copies this leaves one component.
    tried = cut(pairs[0].groupBy("b").agg(F.min_by(F.struct("a", "n_a", "n_b"), "a").alias("x")).select("x.a", "b", "x.n_a", "x.n_b"), "ask", narrow=True)
    links = [cut(_verified(texts, tried), "links")]
    comp, n = None, nodes.count()
    for _ in range(LEVELS):
        if _pairs_in(rows) <= BUCKET * n:  # no more than small buckets may give: these are compared in full
            break
        frames = _frames(texts, rows, frequent)
        links.append(cut(frames.where("linked").select(F.col("leader").alias("a"), F.col("node").alias("b")), "links", narrow=True))
        comp, spent = _linked_components(_all(links)), [comp, frames, rows]
        index, probe = _next_level(frames, comp)
        more, crowded, dealt = _deal(index, probe)
        pairs.append(cut(_screened(nodes, more), "pairs", narrow=True))
        rows = cut(crowded, "crowded", narrow=True)
        release(index, probe, dealt, *(t for t in spent if t is not None))
    if comp is None:
        comp = _linked_components(_all(links))
    if not rows.isEmpty():
        pairs.append(cut(_screened(nodes, _in_full(rows, comp, nodes)), "pairs", narrow=True))
    apart = _all(pairs).join(_component(comp, "a", "ca"), "a", "left").join(_component(comp, "b", "cb"), "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)")
    rest = cut(apart.select("a", "b", "n_a", "n_b").distinct().join(tried, ["a", "b"], "left_anti"), "rest", narrow=True)
    links.append(cut(_verified(texts, rest), "links"))
    release(texts, tried, rest, comp, rows, *pairs)
    return meta.select("doc_id", "n", "node"), nodes, _all(links)


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``doc_id, n_shingles, component_id``, a row per input row.

    Documents link when 100 * intersection >= 75 * union of their sets of
    five-word shingles; component_id is the least doc_id reachable by links, itself
    included.  Null, empty and word-less texts have n_shingles 0 and are linked
    with nothing (component_id = doc_id), each for itself.  A null doc_id is no
    node: its row has a null component_id.  Rows that repeat a doc_id should
    repeat its text; each gets its row.  Other columns are ignored.
    """
    members, nodes, links = similar_sets(docs)
    comp = _linked_components(links)
    placed = nodes.select("node", "doc").join(comp, "node", "left").select("node", "doc", F.coalesce("component", "node").alias("c"))
    least = placed.groupBy("c").agg(F.min("doc").alias("component_id"))
    of_node = placed.join(least, "c").select("node", "component_id")
    return members.join(of_node, "node", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).alias("component_id"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without near duplicates: of each group the row of its least doc_id.

    All columns stay as they are.  Rows that repeat a kept doc_id are reduced to
    one; documents without words, and rows with a null doc_id, are kept.  Only rows
    that may go, or that repeat an id, are shuffled.
    """
    found = cut(near_duplicates(docs).where("doc_id IS NOT NULL"), "classes")
    touched = found.groupBy("doc_id").agg(F.bool_or(F.col("doc_id") != F.col("component_id")).alias("goes"), F.count("*").alias("times")).where("goes OR times > 1")
    return drop_ids(docs, "doc_id", touched.select("doc_id", "goes"))
