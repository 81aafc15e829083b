"""Toxicity by cumulative-link ordinal regression.

``P(grade <= k | x) = sigmoid(theta[k] - w.x)`` with one weight vector for all
ordered thresholds.  x are sparse text features: whole words (written ``word$``)
and beginnings of words, so that other endings of a stem count too.  Evidence are
those that occur in toxic labelled documents far more often than in clean ones;
their value is log2(1 + occurrences).

Grades are the values of the labels' ``toxic``: 0 is clean, larger is worse.  There
is one threshold fewer than there are grades (one where labels are 0 and 1).
The output is the expected severity: the grades' steps times ``P(grade > k)``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut, small_batches

#: Labelled documents the model is fitted on, at most (those first by a hash of
#: the id), and how far an evidence feature must stand out; all that do are kept.
TRAIN_ROWS, Z_SCORE, MIN_DOCS = 8_000, 3.0, 3
#: How many times as often evidence occurs in toxic documents as in clean ones.
RATIO = 5
#: Weight of the squared weights in the fit.
L2 = 1.0
#: Lengths of the beginnings of words that are features.
STEMS = range(4, 9)
#: A document is toxic from this probability of any grade above 0.
THRESHOLD = 0.5

_WORD, _GAP = re.compile(r"[^\W_]+"), re.compile(r"[\W_]")
_PIECE = 1 << 16


def _features(word: str) -> list[str]:
    return [word + "$", *(word[:k] for k in STEMS if k <= len(word))]


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces of about _PIECE characters that cut no word."""
    at = 0
    while len(text) - at > _PIECE:
        gap = _GAP.search(text, at + _PIECE)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def _counted(text: str | None) -> Counter:
    """Occurrences of the words of a text; only its distinct words are held."""
    out: Counter = Counter()
    for piece in _pieces((text or "").lower()):
        out.update(_WORD.findall(piece))
    return out


def _words(text: str | None) -> Counter:
    out: Counter = Counter()
    for word, n in _counted(text).items():
        for f in _features(word):
            out[f] += n
    return out


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:  # summed over the batch before anything is shuffled
        every: Counter = Counter()
        toxic: Counter = Counter()
        for text, grade in zip(batch.column("text"), batch.column("grade").to_pylist(), strict=True):
            found = _words(text.as_py()).keys()
            every.update(found)
            if grade:
                toxic.update(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(every), pa.string()), pa.array([toxic.get(f, 0) for f in every], pa.int64()), pa.array(list(every.values()), pa.int64())], ["word", "toxic", "docs"]
        )


def _grid(vocabulary: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text"):
                found = _words(text.as_py())
                out.append([{"f": vocabulary[w], "n": n} for w, n in found.items() if w in vocabulary] if len(found) < len(vocabulary) else [{"f": f, "n": found[w]} for w, f in vocabulary.items() if w in found])
            kind = pa.list_(pa.struct([("f", pa.int32()), ("n", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array(out, kind)], ["grade", "x"])

    return run


def fit_cumulative_link(row: np.ndarray, col: np.ndarray, val: np.ndarray, grade: np.ndarray, features: int, l2: float = L2, steps: int = 1500) -> tuple[np.ndarray, np.ndarray]:
    """(w, theta) of the cumulative logit model by projected Adam; theta ascends, w is not negative.

    Features are evidence, so the likelihood is maximised over w >= 0.
    """
    top = int(grade.max(initial=0))
    n = len(grade)
    share = np.clip([(grade <= k).mean() if n else 0.5 for k in range(top)], 1e-3, 1 - 1e-3)
    theta0 = np.log(share / (1 - share))
    p = np.concatenate([np.zeros(features), theta0[:1], np.log(np.maximum(np.diff(theta0), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))

    def unpack(p):
        return p[:features], p[features] + np.concatenate([[0.0], np.cumsum(np.exp(p[features + 1 :]))]) if top else np.zeros(0)

    for t in range(1, steps + 1 if top and n else 1):
        w, theta = unpack(p)
        s = np.bincount(row, weights=w[col] * val, minlength=n)
        edge = np.concatenate([[-np.inf], theta, [np.inf]])
        hi, lo = sig(edge[grade + 1] - s), sig(edge[grade] - s)
        hi = np.where(grade == top, 1.0, hi)
        lo = np.where(grade == 0, 0.0, lo)
        pr = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / pr, lo * (1 - lo) / pr
        ds = dhi - dlo  # of the negative log-likelihood by s
        g_theta = np.array([-(dhi[grade == k].sum()) + dlo[grade == k + 1].sum() for k in range(top)])
        gw = np.bincount(col, weights=ds[row] * val, minlength=features) + l2 * w
        gaps = np.exp(p[features + 1 :])
        g = np.concatenate([gw, [g_theta.sum()], np.array([g_theta[k + 1 :].sum() for k in range(top - 1)]) * gaps]) / n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        p[:features] = np.maximum(p[:features], 0)
    return unpack(p)


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> dict:
    """Model from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``; toxic: a grade, 0 or less for clean.

    Fitted on a bounded sample: the ``train_rows`` labelled rows first by a hash
    of the id.  Where documents repeat an id its least text is taken.  Rows with a null id or null ``toxic`` are left out.  Without toxic rows nothing is learned and nothing flagged.
    """
    graded = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.greatest(F.col("toxic").cast("int"), F.lit(0)).alias("grade"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "grade")
        .limit(train_rows)
    )
    wanted = cut(graded, "graded")  # at most train_rows rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(F.broadcast(wanted.select("doc_id").distinct()), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    sample = cut(texts.join(F.broadcast(wanted), "doc_id").select("text", "grade"), "sample")
    counts = sample.groupBy().agg(F.count("*").alias("n"), F.count_if(F.col("grade") > 0).alias("t")).first()
    n, t = counts["n"], counts["t"]
    empty = {"words": {}, "w": np.zeros(0), "theta": np.array([40.0]), "levels": np.array([0, 1])}
    if not t or t == n:
        return empty
    word = sample.mapInArrow(_seen, "word string, toxic long, docs long").groupBy("word").agg(F.sum("toxic").alias("a"), F.sum("docs").alias("s"))
    word = word.where(F.col("a") >= MIN_DOCS).withColumn("share", F.col("s") / n)
    z = (F.col("a") / t - (F.col("s") - F.col("a")) / (n - t)) / F.sqrt(F.col("share") * (1 - F.col("share")) * (1 / t + 1 / (n - t)) + 1e-12)
    kept = word.withColumn("z", z).where(F.col("z") >= Z_SCORE).where(F.col("a") / t >= RATIO * (F.col("s") - F.col("a")) / (n - t))
    best = kept.orderBy(F.desc("z"), "word").collect()  # bounded by the sample
    vocabulary = {r["word"]: i for i, r in enumerate(best)}
    if not vocabulary:
        return empty
    rows = sample.mapInArrow(_grid(vocabulary), "grade int, x array<struct<f:int,n:long>>").collect()  # at most train_rows
    levels, grade = np.unique([0, *(r["grade"] for r in rows)], return_inverse=True)
    grade = grade[1:]
    where = [(i, x["f"], x["n"]) for i, r in enumerate(rows) for x in r["x"]]
    i, c, k = (np.array(x, dtype=np.int64) for x in zip(*where, strict=True)) if where else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((k, c, i))
    w, theta = fit_cumulative_link(i[order], c[order], np.log2(1.0 + k[order]), grade, len(vocabulary))
    return {"words": vocabulary, "w": w, "theta": theta, "levels": levels}


def _score(model: dict):
    weight = {word: float(model["w"][f]) for word, f in model["words"].items()}
    theta, levels = model["theta"], model["levels"]
    known: dict[str, tuple[str, ...]] = {}  # evidence features of the words met so far

    def evidence(text: str | None) -> float:
        hits: dict[str, int] = {}
        for word, n in _counted(text).items():
            found = known.get(word)
            if found is None:
                if len(known) > 50_000:
                    known.clear()
                found = known[word] = tuple(f for f in _features(word) if f in weight)
            for f in found:
                hits[f] = hits.get(f, 0) + n
        return sum(weight[f] * np.log2(1.0 + n) for f, n in sorted(hits.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.array([evidence(text.as_py()) for text in batch.column("text")], dtype=float)
            above = 1 / (1 + np.exp(np.clip(theta[None, :] - s[:, None], -40, 40)))
            level = levels[(above >= 0.5).sum(axis=1)].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(above @ np.diff(levels).astype(float)), pa.array(above[:, 0]), pa.array(level)], ["doc_id", "severity", "p_toxic", "grade"])

    return run


_OUT = "doc_id long, severity double, p_toxic double, grade int"


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> doc_id, severity, p_toxic, grade, toxic; a row per input row.

    severity: expected grade; grade: the median grade; toxic: p_toxic >=
    THRESHOLD.  Null and empty texts score as texts without evidence.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_score(model), _OUT).withColumn("toxic", F.col("p_toxic") >= THRESHOLD)


def keep_clean(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` without its toxic rows; all columns stay as they are, clean rows in place.

    Null and empty texts stay, as do rows with a null id.  An empty table gives an
    empty result.

    The score rides along in the same pass, so nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    names, schema = docs.columns, docs.schema
    run = _score(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            view = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch.column("text").cast(pa.string())], ["doc_id", "text"])
            for scored in run([view]):
                yield batch.filter(pa.array(scored.column("p_toxic").to_numpy() < THRESHOLD))

    return docs.select(*names).mapInArrow(keep, schema)
