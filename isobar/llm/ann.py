"""Largest-inner-product search by multiprobe p-stable hashing.

Inner product is turned into distance: a vector x of norm at most M gets one
more coordinate sqrt(M^2 - |x|^2), a query a zero, so the nearest vector has the
largest product.  A table hashes with k Gaussian (2-stable) projections, each cut
into cells of width w: a bucket is a vector of cells.  A query visits the
perturbed buckets around its own in the order of their estimated success (the
probability that a neighbour at the expected product falls there) until the
estimates sum to ``SUCCESS``; the tables' candidates are merged and ranked by
their exact product in double precision.

What product to expect is estimated for every query on a sample of ``SAMPLE``
vectors of its length: the place there that its last neighbour should take.  A
table has as many projections as fill a bucket with about ``FILL`` vectors, so their
number grows with the logarithm of the input.  M and projections are chosen per
band of norms: the vectors of a length are cut at halves of their largest norm, so a
few long vectors do not flatten the rest.  A query leaves out the bands whose M cannot
reach the product it expects.  A length or a band of at most ``FEW`` distinct vectors is
compared in full, and so is a query for which the tables hold fewer candidates than
asked for.

Buckets that share their leading cells form a group of about ``PART`` vectors
(fewer, if long).  A query goes to a group once, with the list of the buckets that it visits
there, and takes its best vectors from the group, not from every bucket.

Equal vectors are one candidate; a group's vectors and the queries that come to it
are dealt in blocks of about that size, so neither copies nor crowded buckets nor
popular ones gather in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut

#: Parameters of the production query: neighbours, tables, cell width in units of
#: M, and success estimate at which a table's probing ends.
NEIGHBOURS, TABLES, WIDTH, SUCCESS = 20, 2, 1.4, 0.82
#: Vectors, and queries, that a task compares: so many, and of long ones so many numbers in all.
PART, BLOCK = 16384, 2**20
#: Distinct vectors of a length up to which all are compared.
FEW = 4096
#: Vectors of a length that products are estimated on, and vectors a bucket holds on average.
SAMPLE, FILL = 4096, 512
#: Halvings of the largest norm that are told apart; grain of the hash that draws the sample.
_HALVINGS, _SHARES = 60, 1 << 40
_CELL_BITS = 1.56  # entropy of a projection's cell at this width
_REACH = 3.5  # cells beyond this many M hold next to nothing; outer cells are open


class Band(NamedTuple):
    """Vectors of a range of norms up to ``bound``: projections (0: compared in full), those that make a group."""

    k: int
    lead: int
    bound: float


class Lengths(NamedTuple):
    """What is known of the vectors of a length."""

    top: float
    of: np.ndarray
    bands: list[Band]
    place: int
    sample: np.ndarray

    def band_of(self, norm: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            halved = np.clip(np.floor(np.log2(self.top / norm)), 0, len(self.of) - 1)
        return self.of[halved.astype(np.int64)]


def _projections(table: int, dim: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64([table, dim, k, 41]))
    return rng.standard_normal((dim + 1, k)), rng.random(k)


def _cell_range() -> tuple[int, int]:
    edge = math.ceil(_REACH / WIDTH)
    return -edge, edge


def _cells(points: np.ndarray, table: int, dim: int, k: int, bound: float) -> np.ndarray:
    a, b = _projections(table, dim, k)
    low, high = _cell_range()
    return np.clip(np.floor(points @ a / (WIDTH * bound) + b), low, high).astype(np.int64)


def _code(cells: np.ndarray) -> np.ndarray:
    low, high = _cell_range()
    out = np.zeros(cells.shape[:-1], dtype=np.int64)
    for i in range(cells.shape[-1]):
        out = out * (high - low + 1) + (cells[..., i] - low)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = b"".join(column.to_pylist())
    return np.frombuffer(flat, dtype=np.float64).reshape(len(column), -1)


def _by_length(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    size = batch.column("dim").to_numpy(zero_copy_only=False)
    for d in np.unique(size).tolist():
        yield batch.filter(pa.array(size == d))


def _group(codes: np.ndarray, k: int, lead: int) -> np.ndarray:
    low, high = _cell_range()
    return codes // (high - low + 1) ** (k - lead)


def _rows(names: list[str], batch: pa.RecordBatch, t: int, group: np.ndarray, buckets) -> pa.RecordBatch:
    n = batch.num_rows
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), batch.column("dim"), pa.array(group), pa.array(buckets), batch.column("rep"), batch.column("v")], names)


def _table(band: int, t: int) -> int:
    """Number of a band's table t; t = TABLES is its one bucket of vectors that are not hashed."""
    return band * (TABLES + 1) + t


def _index(plan: dict[int, Lengths]):
    names = ["t", "dim", "grp", "bucket", "rep", "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for length in _by_length(whole):
                told = plan.get(length.column("dim")[0].as_py())
                if told is None:
                    none = np.zeros(length.num_rows, np.int64)
                    yield _rows(names, length, TABLES, none, none)
                    continue
                every = _matrix(length.column("v"))
                band = told.band_of(np.sqrt((every**2).sum(axis=1)))
                for b in np.unique(band).tolist():
                    at = np.flatnonzero(band == b)
                    batch, x = length.take(pa.array(at)), every[at]
                    if told.bands[b].k == 0:
                        none = np.zeros(len(x), np.int64)
                        yield _rows(names, batch, _table(b, TABLES), none, none)
                        continue
                    k, lead, bound = told.bands[b].k, told.bands[b].lead, told.bands[b].bound
                    rest = np.sqrt(np.maximum(bound**2 - (x**2).sum(axis=1, keepdims=True), 0))
                    for t in range(TABLES):
                        bucket = _code(_cells(np.hstack([x, rest]), t, x.shape[1], k, bound))
                        yield _rows(names, batch, _table(b, t), _group(bucket, k, lead), bucket)

    return run


def _normal_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.vectorize(math.erf, otypes=[float])(x / math.sqrt(2)))


def _visits(chance: np.ndarray) -> np.ndarray:
    """Codes of the likeliest cells of (projections x cells) chances, best first, until SUCCESS.

    Projections join one by one; of each step the least likely cells go, so few that
    all steps together cannot touch the success asked for.
    """
    slack = (1 - SUCCESS) / (2 * len(chance))
    p, code = np.ones(1), np.zeros(1, dtype=np.int64)
    for c in chance:
        joint = (p[:, None] * c).ravel()
        code = (code[:, None] * len(c) + np.arange(len(c))).ravel()
        order = np.argsort(-joint, kind="stable")
        mass = np.cumsum(joint[order])
        order = order[: int(np.searchsorted(mass, mass[-1] - slack)) + 1]
        p, code = joint[order], code[order]
    return code[: int(np.searchsorted(np.cumsum(p), SUCCESS)) + 1]


def _probe(plan: dict[int, Lengths]):
    names = ["t", "dim", "grp", "buckets", "query", "v"]
    low, high = _cell_range()
    span = np.arange(low, high + 1)

    def hashed(part: pa.RecordBatch, q: np.ndarray, norm: np.ndarray, last: np.ndarray, b: int, band: Band) -> Iterator[pa.RecordBatch]:
        k, bound = band.k, band.bound
        expected = np.clip(last / (norm * bound), 0, 0.999)[:, None]
        for t in range(TABLES):
            a, shift = _projections(t, q.shape[1], k)
            # where a neighbour's projection is expected, in units of M
            mean = expected * (q @ a[:-1]) / norm[:, None]
            sd = np.sqrt(1 - expected**2)[:, :, None]
            edge = (span[None, None, :] - shift[None, :, None]) * WIDTH
            below = _normal_cdf((edge - mean[:, :, None]) / sd)
            below[:, :, 0] = 0.0
            chance = np.diff(np.concatenate([below, np.ones_like(below[:, :, :1])], axis=2), axis=2)
            who, groups, lists = [], [], []
            for i, c in enumerate(chance):
                codes = np.sort(_visits(c))  # a group's codes follow each other
                there, first = np.unique(_group(codes, k, band.lead), return_index=True)
                who += [i] * len(there)
                groups.append(there)
                lists += [x.tobytes() for x in np.split(codes, first[1:])]
            yield _rows(names, part.take(pa.array(who)), _table(b, t), np.concatenate(groups), lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _by_length(whole):
                told = plan.get(batch.column("dim")[0].as_py())
                if told is None:
                    yield _rows(names, batch, TABLES, np.zeros(batch.num_rows, np.int64), [bytes(8)] * batch.num_rows)
                    continue
                every = _matrix(batch.column("v"))
                for at in range(0, len(every), 256):
                    part, q = batch.slice(at, 256), every[at : at + 256]
                    norm = np.sqrt((q**2).sum(axis=1))
                    ranked = -np.sort(-(q @ told.sample.T), axis=1)
                    last, least = ranked[:, told.place], ranked[:, min(2 * told.place + 1, ranked.shape[1] - 1)]
                    for b, band in enumerate(told.bands):
                        near = np.flatnonzero(norm * band.bound >= least)  # least: what the last neighbour has at any rate
                        if not len(near):
                            continue
                        mine = part.take(pa.array(near))
                        if band.k == 0:
                            yield _rows(names, mine, _table(b, TABLES), np.zeros(len(near), np.int64), [bytes(8)] * len(near))
                        else:
                            yield from hashed(mine, q[near], norm[near], last[near], b, band)

    return run


_TOP = pa.schema([("query", pa.int64()), ("rep", pa.int64()), ("score", pa.float64())])


def _first(found: list[tuple[np.ndarray, ...]], top: int) -> tuple[np.ndarray, ...]:
    """The best ``top`` of (query, rep, score) for each query, ties to the smaller rep."""
    a, rep, score = (np.concatenate(v) for v in zip(*found, strict=True))
    order = np.lexsort((rep, -score, a))
    a, rep, score = a[order], rep[order], score[order]
    good = np.arange(len(a)) - np.searchsorted(a, a) < top
    return a[good], rep[good], score[good]


def _compared(q: np.ndarray, who: np.ndarray, x: np.ndarray, rep: np.ndarray, top: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The best ``top`` vectors of a bucket for each query ``who`` of q that visits it."""
    keep = min(top, len(x))
    far = np.sqrt((x**2).sum(axis=1).max())
    step = max(1, 2**21 // len(x))
    for at in range(0, len(who), step):
        mine = q[who[at : at + step]]
        rough = mine @ x.T
        least = -np.partition(-rough, keep - 1, axis=1)[:, keep - 1] - 1e-12 * far * np.sqrt((mine**2).sum(axis=1))
        a, b = np.nonzero(~(rough < least[:, None]))
        # summed in one fixed order, so a pair has one score wherever it is met
        score = np.concatenate([(mine[a[i : i + 8192]] * x[b[i : i + 8192]]).sum(axis=1) for i in range(0, len(a), 8192)])
        yield _first([(who[at + a], rep[b], score)], keep)


def _rank(top: int):
    """The best ``top`` vectors of a block for each query of a block, in the buckets that it visits."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _TOP.empty_table()
        bucket = left.column("bucket").to_numpy()
        order = np.argsort(bucket, kind="stable")
        x = _matrix(left.column("v").combine_chunks())[order]
        rep = left.column("rep").to_numpy()[order]
        codes, start = np.unique(bucket[order], return_index=True)
        stop = np.append(start[1:], len(x))
        out = []
        for at in range(0, right.num_rows, 1024):
            part = right.slice(at, 1024)
            q = _matrix(part.column("v").combine_chunks())
            lists = part.column("buckets").to_pylist()
            visited = np.frombuffer(b"".join(lists), dtype=np.int64)
            who = np.repeat(np.arange(len(q)), [len(v) // 8 for v in lists])
            place = np.minimum(np.searchsorted(codes, visited), len(codes) - 1)
            hit = np.flatnonzero(codes[place] == visited)
            hit = hit[np.argsort(place[hit], kind="stable")]
            edge = np.searchsorted(place[hit], np.arange(len(codes) + 1))
            found = [f for i in range(len(codes)) if edge[i] < edge[i + 1] for f in _compared(q, who[hit[edge[i] : edge[i + 1]]], x[start[i] : stop[i]], rep[start[i] : stop[i]], top)]
            if found:
                a, b, c = _first(found, top)
                out.append((part.column("query").to_numpy()[a], b, c))
        if not out:
            return _TOP.empty_table()
        a, b, c = (np.concatenate(v) for v in zip(*out, strict=True))
        return pa.Table.from_arrays([pa.array(a), pa.array(b), pa.array(c)], schema=_TOP)

    return run


def _bands(counts: dict[int, tuple[int, float]], dim: int) -> tuple[np.ndarray, list[Band]]:
    """(band of each halving, bands) of ``counts``: (vectors, their largest norm) by how often the largest of all norms can be halved to theirs.

    Halvings of few vectors are put together as long as they stay few.
    """
    groups: list[list[int]] = []
    held = 0
    for e in sorted(counts):
        if groups and held + counts[e][0] <= FEW:
            groups[-1].append(e)
            held += counts[e][0]
        else:
            groups.append([e])
            held = counts[e][0]
    of, out = np.zeros(max(counts) + 1, np.int64), []
    for b, group in enumerate(groups):
        of[group[0] :] = b  # halvings that nobody has go with the ones above
        n = sum(counts[e][0] for e in group)
        k = max(1, round(math.log2(max(n / FILL, 1)) / _CELL_BITS)) if n > FEW else 0
        lead = min(k, int(math.log2(max(n / min(PART, max(BLOCK // dim, 1)), 1)) / _CELL_BITS))
        out.append(Band(k, lead, max(counts[e][1] for e in group) * (1 + 1e-9)))
    return of, out


def _plans(reps: DataFrame, neighbours: int) -> dict[int, Lengths]:
    """Per hashed length its bands of norms, place in the sample of the last neighbour, and the sample.

    The driver gets SAMPLE vectors of each such length and some numbers per band.  The
    sample is drawn by a bound on the ids' hashes, so only about twice as many vectors
    are put in order.  A length whose norms are not finite is not hashed.
    """
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x))
    rows = reps.select(F.size("e").alias("dim"), "vec_id", "e", norm.alias("norm"))
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm").alias("top")).where((F.col("n") > FEW) & (F.col("top") < 1e150))
    sizes = {r["dim"]: r for r in sizes.collect()}
    if not sizes:
        return {}
    told = reps.sparkSession.createDataFrame([(d, r["top"], min(1.0, 2 * SAMPLE / r["n"])) for d, r in sizes.items()], "dim int, top double, share double")
    known = rows.join(F.broadcast(told), "dim")  # a row per hashed length: at most one for FEW vectors
    halved = F.coalesce(F.least(F.floor(F.log2(F.try_divide("top", "norm"))), F.lit(_HALVINGS)), F.lit(_HALVINGS)).cast("int")
    counts: dict[int, dict[int, tuple[int, float]]] = {d: {} for d in sizes}
    for r in known.groupBy("dim", F.greatest(halved, F.lit(0)).alias("e")).agg(F.count("*").alias("n"), F.max("norm").alias("top")).collect():
        counts[r["dim"]][r["e"]] = (r["n"], r["top"])
    hashed = F.xxhash64("vec_id")
    few = known.where(F.pmod(hashed, F.lit(_SHARES)) < F.col("share") * _SHARES).withColumn("r", F.row_number().over(Window.partitionBy("dim").orderBy(hashed, "vec_id")))
    sample: dict[int, list] = {d: [] for d in sizes}
    for r in few.where(F.col("r") <= SAMPLE).select("dim", "vec_id", "e").collect():
        sample[r["dim"]].append((r["vec_id"], r["e"]))
    out = {}
    for d, r in sizes.items():
        of, bands = _bands(counts[d], d)
        place = math.ceil(neighbours * len(sample[d]) / r["n"])  # from 0, as the query itself may be there
        out[d] = Lengths(r["top"], of, bands, min(place, len(sample[d]) - 1), np.array([e for _, e in sorted(sample[d])]))
    return out


def nearest(vectors: DataFrame, is_query, neighbours: int = NEIGHBOURS) -> DataFrame:
    """``vectors(vec_id, embedding, ...)`` -> query_id, rank, vec_id, score.

    ``is_query``: condition on vec_id.  Every usable row is indexed.  Candidates of a
    query are all other usable rows of its length; ranks count from 1, largest
    product first, ties to the smaller vec_id; fewer rows only where there are fewer candidates.
    Vectors that are null, empty, zero or hold a null or non-finite component, and
    null ids, take no part.  Rows that repeat a vec_id and its vector count once.
    Other columns are ignored.
    """
    e = F.col("embedding").cast("array<double>")
    usable = (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e"))
        .where("vec_id IS NOT NULL AND e IS NOT NULL AND size(e) > 0")
        .where(~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
        .where(F.exists("e", lambda x: x != 0))
        .select("vec_id", "e", F.xxhash64("e").alias("h1"), F.xxhash64(F.lit("e"), "e").alias("h2"))
    )
    # The least ids of each distinct vector suffice: equal vectors tie.
    same = Window.partitionBy("h1", "h2").orderBy("vec_id")
    firsts = cut(usable.withColumn("r", F.dense_rank().over(same)).where(F.col("r") <= neighbours + 1).dropDuplicates(["h1", "h2", "vec_id"]), "firsts")
    one = firsts.where("r = 1")
    plan = _plans(one, neighbours)
    flat = one.select("vec_id", "e", "h1", "h2").mapInArrow(_pack, "rep long, dim int, v binary, h1 long, h2 long")
    reps = cut(flat, "reps")
    index = reps.select("rep", "dim", "v").mapInArrow(_index(plan), "t int, dim int, grp long, bucket long, rep long, v binary")
    wanted = usable.where(is_query).select(F.col("vec_id").alias("query_id"), "h1", "h2").distinct()
    asked = cut(wanted.join(reps.select("h1", "h2", "rep"), ["h1", "h2"]).select("query_id", F.col("rep").alias("query")), "asked")
    probes = reps.join(asked.select(F.col("query").alias("rep")).distinct(), "rep", "left_semi").select("rep", "dim", "v").mapInArrow(_probe(plan), "t int, dim int, grp long, buckets binary, query long, v binary")
    members = firsts.join(one.select("h1", "h2", F.col("vec_id").alias("rep")), ["h1", "h2"]).select("rep", "vec_id")
    ranked = _ranked(_best(index, probes, neighbours), members, asked, neighbours)
    if not plan:
        return ranked
    ranked = cut(ranked, "ranked")
    full = ranked.groupBy("query_id").count().where(F.col("count") >= neighbours).select("query_id")
    short = cut(asked.join(full, "query_id", "left_anti").join(reps.where(F.col("dim").isin(*plan)).select(F.col("rep").alias("query"), "dim", "v"), "query"), "short")
    if short.isEmpty():
        return ranked
    # All vectors of the lengths in question, once for every block of such queries.
    none = F.lit(0).cast("long")
    every = reps.join(F.broadcast(short.select("dim").distinct()), "dim", "left_semi").select(F.lit(TABLES).alias("t"), "dim", none.alias("grp"), none.alias("bucket"), "rep", "v")
    left = short.dropDuplicates(["query"]).select(F.lit(TABLES).alias("t"), "dim", none.alias("grp"), F.lit(bytes(8)).alias("buckets"), "query", "v")
    again = _ranked(_best(every, left, neighbours), members, short.select("query_id", "query"), neighbours)
    return ranked.join(short.select("query_id").distinct(), "query_id", "left_anti").unionByName(again)


def _best(index: DataFrame, probes: DataFrame, neighbours: int) -> DataFrame:
    """(query, rep, score): the best vectors of index(t, dim, grp, bucket, rep, v) in the buckets of probes(t, dim, grp, buckets, query, v)."""
    keys = ["t", "dim", "grp"]
    block = ["part", "squad"]
    count = lambda df, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / F.least(F.lit(PART), F.greatest(F.floor(F.lit(BLOCK) / F.col("dim")), F.lit(1)))).cast("int").alias(name))
    both = count(index, "parts").join(count(probes, "squads"), keys)
    mine = lambda id_, n: F.pmod(F.xxhash64(id_), F.col(n)).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = index.join(both, keys).withColumn("part", mine("rep", "parts")).withColumn("squad", all_("squads")).select(*keys, *block, "bucket", "rep", "v")
    sent = probes.join(both, keys).withColumn("squad", mine("query", "squads")).withColumn("part", all_("parts")).select(*keys, *block, "buckets", "query", "v")
    found = dealt.groupBy(*keys, *block).cogroup(sent.groupBy(*keys, *block)).applyInArrow(_rank(neighbours + 1), "query long, rep long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    return found.withColumn("r", F.dense_rank().over(order)).where(F.col("r") <= neighbours + 1).dropDuplicates(["query", "rep"]).select("query", "rep", "score")


def _ranked(best: DataFrame, members: DataFrame, asked: DataFrame, neighbours: int) -> DataFrame:
    spread = best.join(members, "rep").select("query", "vec_id", "score")
    close = spread.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= neighbours + 1).drop("r")
    mine = close.join(asked, "query").where("query_id <> vec_id")
    ranked = mine.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= neighbours).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.column("e")
        at = rows.offsets.to_numpy(zero_copy_only=False)
        raw = rows.values.to_numpy(zero_copy_only=False).astype("<f8").tobytes()
        v = [raw[8 * a : 8 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), pa.array(np.diff(at).astype(np.int32)), pa.array(v, pa.binary()), batch.column("h1"), batch.column("h2")], ["rep", "dim", "v", "h1", "h2"]
        )
