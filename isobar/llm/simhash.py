"""SimHash near-duplicates by anchor-point covering.

A text's fingerprint has bit k set when over half of the 64-bit hashes of its
four-word shingles (repeats included) have it set.  Fingerprints link at 4 or fewer
differing bits.

Anchors are the words of the perfect Hamming code of length 31: every 31-bit word
lies within 1 (the covering radius) of an anchor.  A fingerprint has two halves of 32
bits, 31 of which are covered, and of two linked fingerprints one half differs in at
most 2 bits (the threshold of a half).  The anchor of the word half way between the
two is within 1 + 1 of both, so each fingerprint is replicated to every anchor within
the covering radius plus its half of the threshold: no link is lost, and 16 rows a
half do instead of the 156 that one-sided replication needs.  A word's syndrome names
these anchors: the code word itself, or its one nearest and the 15 at distance 2.

Fingerprints are compared per anchor.  Only distinct ones are, copies ride along.
Within an anchor's bucket a search by breadth emits a spanning forest of its links, at
most a row per fingerprint.  A bucket of over ``BUCKET`` fingerprints is dealt again by
the anchors of its other half, now within 1 + 2 of them (of 4 differing bits half is 2);
what such a smaller bucket holds lies within 12 bits of each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .storage import cut, small_batches

SHINGLE, SEED, LINKED = 4, 42, 4
#: Fingerprints of an anchor that are compared by one search.
BUCKET = 1 << 13
#: Words of a half that are covered by anchors: its lower 31 bits.
COVERED = (1 << 31) - 1
_TEXTS = 128
#: Bytes of hashes whose bits are counted at once.
_HASHES = 1 << 15


def _patterns(distance: int) -> list[np.ndarray]:
    """By syndrome, the words of weight ``distance`` or less whose addition gives an anchor."""
    found: list[list[int]] = [[] for _ in range(32)]
    for weight in range(distance + 1):
        for at in combinations(range(1, 32), weight):
            syndrome = word = 0
            for i in at:
                syndrome ^= i
                word |= 1 << (i - 1)
            found[syndrome].append(word)
    return [np.array(x, np.uint64) for x in found]


#: Position i of a word (from 1) has the column i in the code's parity check.
_PARITY = [np.uint64(sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1)) for k in range(5)]
_NEAR, _FAR = _patterns(2), _patterns(3)


def _syndromes(words: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words), np.int64)
    for k, mask in enumerate(_PARITY):
        out |= (np.bitwise_count(words & mask).astype(np.int64) & 1) << k
    return out


def _anchors(words: np.ndarray, patterns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, anchors): the anchors that each word is replicated to."""
    syndrome = _syndromes(words)
    rows, anchors = [], []
    for s in np.unique(syndrome).tolist():
        at = np.flatnonzero(syndrome == s)
        rows.append(np.repeat(at, len(patterns[s])))
        anchors.append((words[at, None] ^ patterns[s]).ravel())
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(anchors)


def fingerprint(text: bytes | None) -> int:
    """The 64-bit fingerprint of a UTF-8 text."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()  # bytes: A-Z only, and the six ASCII spaces
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxh64_intdigest(joined, SEED)
    end = np.cumsum([len(w) + 1 for w in words])
    first, last = [0, *end[:-SHINGLE].tolist()], (end[SHINGLE - 1 :] - 1).tolist()
    counts, n = np.zeros(64, np.int64), len(last)
    for k in range(0, n, _HASHES):
        h = np.array([xxh64_intdigest(joined[i:j], SEED) for i, j in zip(first[k : k + _HASHES], last[k : k + _HASHES], strict=True)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(at, _TEXTS) for at in range(0, batch.num_rows, _TEXTS)):
            prints = np.array([fingerprint(t) for t in part.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "print"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``doc_id, print`` (the 64 bits as a long), a row per row.

    A null, empty or word-less text has fingerprint 0; a text of fewer than four words
    that of its whole word sequence.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(_fingerprints, "doc_id long, print long")


def _halves(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return prints & np.uint64(COVERED), (prints >> np.uint64(32)) & np.uint64(COVERED)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per fingerprint, half and anchor; key holds half and anchor."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            prints = batch.column("print").slice(at, 4096).to_numpy(zero_copy_only=False).view(np.uint64)
            for half, words in enumerate(_halves(prints)):
                rows, anchors = _anchors(words, _NEAR)
                yield pa.RecordBatch.from_arrays([pa.array((anchors | np.uint64(half << 32)).view(np.int64)), pa.array(prints[rows].view(np.int64))], ["key", "print"])


def _replicate_other(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of crowded anchors, to the anchors of the half that the key does not name."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            key, prints = part.column("key").to_numpy(zero_copy_only=False), part.column("print").to_numpy(zero_copy_only=False).view(np.uint64)
            low, high = _halves(prints)
            rows, anchors = _anchors(np.where(key >> 32 == 0, high, low), _FAR)
            yield pa.RecordBatch.from_arrays([pa.array(key[rows]), pa.array(anchors.view(np.int64)), pa.array(prints[rows].view(np.int64))], ["key", "other", "print"])


def _forest(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (u, v) that join the linked ones of distinct fingerprints as their links do."""
    left, u, v = prints, [prints[:0]], [prints[:0]]
    while len(left):
        queue, left = [left[:1]], left[1:]
        while queue and len(left):  # what is found leaves at once, so a dense bucket shrinks fast
            front = queue.pop()
            step = max(1, (1 << 20) // len(left))
            if len(front) > step:
                queue.append(front[step:])
            near = np.bitwise_count(left[:, None] ^ front[None, :step]) <= LINKED
            new = near.any(axis=1)
            if new.any():
                u.append(front[near[new].argmax(axis=1)])
                v.append(left[new])
                queue.append(left[new])
                left = left[~new]
    return np.concatenate(u), np.concatenate(v)


def _pairs(key: np.ndarray, prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All links of many small buckets, of at most ``size`` rows, sorted by key."""
    u, v = [], []
    for step in range(1, size):
        same = np.flatnonzero(key[step:] == key[:-step])
        if not len(same):
            break
        near = same[np.bitwise_count(prints[same] ^ prints[same + step]) <= LINKED]
        u.append(prints[near])
        v.append(prints[near + step])
    none = np.zeros(0, np.uint64)
    return (np.concatenate(u), np.concatenate(v)) if u else (none, none)


def _compare(keys: tuple[str, ...], bucket: int | None):
    """Rows sorted by keys and print -> edges (u, v, null), and the rows (print, key, key) of buckets over ``bucket``.

    Without a bound every bucket is compared whole; its fingerprints, 8 bytes each, are
    held by one task.
    """
    small = 32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64)), pa.nulls(len(u), pa.int64())], ["u", "v", "key"])

        def crowd(k: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(p.view(np.int64)), pa.nulls(len(p), pa.int64()), pa.array(k[0])], ["u", "v", "key"])

        def flush(k: tuple[np.ndarray, ...], p: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Whole buckets."""
            new = np.ones(len(p), bool)
            new[1:] = np.any([x[1:] != x[:-1] for x in k], axis=0)
            at = np.flatnonzero(new)
            size = np.diff(np.append(at, len(p)))
            number = np.repeat(np.arange(len(at)), size)
            few = np.repeat(size <= small, size)
            u, v = _pairs(number[few], p[few], small)
            if len(u):
                yield edges(u, v)
            for i in np.flatnonzero(size > small).tolist():
                rows = slice(at[i], at[i] + size[i])
                if bucket is not None and size[i] > bucket:
                    yield crowd(tuple(x[rows] for x in k), p[rows])
                elif len((got := _forest(p[rows]))[0]):
                    yield edges(*got)

        held: list[tuple] = []  # rows of the last, still open bucket
        count, open_key, crowded = 0, None, False
        for batch in batches:
            k = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in keys)
            p = batch.column("print").to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(p):
                continue
            change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in k], axis=0)) + 1
            first, before = tuple(x[0] for x in k), open_key
            if crowded and first == before:  # goes on: its rows leave at once
                more = int(change[0]) if len(change) else len(p)
                yield crowd(tuple(x[:more] for x in k), p[:more])
                k, p = tuple(x[more:] for x in k), p[more:]
                if not len(p):
                    continue
                change = change[1:] - more
                first = tuple(x[0] for x in k)
            crowded = False
            last = int(change[-1]) if len(change) else 0
            open_key = tuple(x[-1] for x in k)
            if last or (held and first != before):
                held.append((tuple(x[:last] for x in k), p[:last]))
                ks, ps = zip(*held, strict=True)
                yield from flush(tuple(map(np.concatenate, zip(*ks, strict=True))), np.concatenate(ps))
                held, count = [], 0
            held.append((tuple(x[last:] for x in k), p[last:]))
            count += len(p) - last
            if bucket is not None and count > bucket:
                for k, p in held:
                    if len(p):
                        yield crowd(k, p)
                held, count, crowded = [], 0, True
        if held:
            ks, ps = zip(*held, strict=True)
            yield from flush(tuple(map(np.concatenate, zip(*ks, strict=True))), np.concatenate(ps))

    return run


def linked_prints(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Distinct ``print`` -> edges(u, v) between fingerprints at 4 or fewer bits, with the components of all such links."""
    dealt = prints.mapInArrow(_replicate, "key long, print long").repartition("key").sortWithinPartitions("key", "print")
    met = cut(dealt.mapInArrow(_compare(("key",), bucket), "u long, v long, key long"), "met")
    edges, crowded = met.where("key IS NULL").select("u", "v"), met.where("key IS NOT NULL").select("key", F.col("u").alias("print"))
    if crowded.isEmpty():
        return edges
    again = crowded.mapInArrow(_replicate_other, "key long, other long, print long").repartition("key", "other").sortWithinPartitions("key", "other", "print")
    return edges.unionByName(again.mapInArrow(_compare(("key", "other"), None), "u long, v long, key long").select("u", "v"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``doc_id, fingerprint, component_id``, a row per row.

    fingerprint: 16 lowercase hex digits; component_id: the least doc_id reachable over
    fingerprints at 4 or fewer differing bits, itself included.  Texts without words have
    fingerprint 0 and are linked like others.  A null doc_id is no node: its row has a
    null component_id.  Rows that repeat a doc_id link each by its own text.
    A long text is hashed in one task, in pieces; other columns are ignored.  An empty
    table gives an empty result.
    """
    found = cut(fingerprints(docs), "prints")
    nodes = cut(found.where("doc_id IS NOT NULL").groupBy("print").agg(F.min("doc_id").alias("doc")), "nodes")
    comp = components(linked_prints(nodes.select("print")))
    placed = nodes.select("print", "doc").join(comp.withColumnRenamed("node", "print"), "print", "left").select("print", "doc", F.coalesce("component", "print").alias("c"))
    least = placed.groupBy("c").agg(F.min("doc").alias("component_id"))
    of_print = placed.join(least, "c").select("print", "component_id")
    return found.join(of_print, "print", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )
