"""Language identification with error-correcting output codes.

Each language has a binary codeword; one binary n-gram classifier per code bit
separates the languages with that bit from the rest (log-odds of hashed letter
n-grams, a naive Bayes classifier on counts over the whole training part).
A second pass over the training part counts how often each bit is right there;
decoding weighs a bit's logistic loss by the log-odds of that and takes the codeword
of least loss.  A small gap to the next marks the row as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hashed n-gram features, code bits at least, and the gap that counts as ambiguous.
FEATURES, MIN_BITS, AMBIGUOUS = 1 << 13, 15, 0.2
#: Languages that may be learned; beyond it the labels are no languages.
MAX_LANGUAGES = 4096
#: Characters whose counts are held at once.
_BLOCK_CHARS = 1 << 19

_letters: list[np.ndarray] = []


def _alpha() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    at, block, size = 0, [], 0
    for i, t in enumerate(texts):
        t = t or ""
        if block and (size + len(t) > _BLOCK_CHARS or len(block) >= 256):
            yield at, block
            at, block, size = i, [], 0
        block.append(t)
        size += len(t)
    if block:
        yield at, block


def _counts(block: list[str], features: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents x features) counts of letter 1- to 3-grams, and letters per document.

    Other characters count as one space; runs of them as one.
    """
    lowered = [t.lower() for t in block]
    code = np.frombuffer((" ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    doc = np.repeat(np.arange(len(block), dtype=np.int64), [len(t) + 1 for t in lowered])
    letter = _alpha()[code]
    letters = np.bincount(doc[letter], minlength=len(block))
    keep = letter | np.append(True, letter[:-1])
    c = np.where(letter, code, 32)[keep].astype(np.uint64)
    doc = doc[keep]
    mult = np.uint64(0x9E3779B97F4A7C15)
    shift = np.uint64(64 - (features.bit_length() - 1))
    out = np.zeros(len(block) * features, dtype=np.int64)
    gram = np.zeros(len(c), dtype=np.uint64)
    for n in range(1, 4):
        gram = gram[: len(c) - n + 1] * np.uint64(0x110001) + c[n - 1 :] + np.uint64(1)
        where = doc[: len(gram)]
        ok = where == doc[n - 1 :]
        at = where * features + ((gram * mult) >> shift).astype(np.int64)
        out += np.bincount(at[ok], minlength=len(out))
    return out.reshape(len(block), features), letters


def _totals(features: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for at, block in _blocks(batch.column("text").to_pylist()):
                counts, _ = _counts(block, features)
                rate = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
                for lang in sorted(set(langs[at : at + len(block)])):
                    rows = [i for i, x in enumerate(langs[at : at + len(block)]) if x == lang]
                    held[lang] = held.get(lang, 0) + rate[rows].sum(axis=0)
        for lang, v in held.items():
            f = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(f), pa.string()), pa.array(f.astype(np.int32)), pa.array(v[f])], ["lang", "f", "v"])

    return run


def codewords(languages: int, min_bits: int = MIN_BITS) -> np.ndarray:
    """(languages x bits) of +1/-1, far apart: every split once for few languages, else the best of seeded random draws."""
    if languages > 1 and (1 << (languages - 1)) - 1 <= min_bits:  # all splits there are
        splits = np.arange(1, 1 << (languages - 1))
        return np.where(splits >> np.arange(languages)[:, None] & 1, 1, -1)
    rng = np.random.Generator(np.random.PCG64(7))
    bits = max(min_bits, 4 * max(1, languages - 1).bit_length())
    best, score = None, -1
    for _ in range(200 if languages <= 64 else 5):
        code = rng.choice(np.array([-1, 1]), size=(languages, bits))
        if languages > 1:  # a bit that all share separates nothing
            same = np.abs(code.sum(axis=0)) == languages
            code[0, same] *= -1
        gap = bits - np.triu(code @ code.T, 1).max() if languages > 1 else bits
        if gap > score:
            best, score = code, gap
    return best


def train(labelled: DataFrame, features: int = FEATURES) -> dict:
    """Model from ``labelled(text, lang)``; rows with a null lang are left out.

    Counts run over all rows, on the executors; the driver gets languages x
    features sums, a size that does not depend on the number of rows.
    """
    rows = labelled.where("lang IS NOT NULL").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sums = rows.mapInArrow(_totals(features), "lang string, f int, v double").groupBy("lang", "f").agg(F.sum("v").alias("v"))
    langs = sorted(r[0] for r in rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels: these are no languages")
    at = {lang: i for i, lang in enumerate(langs)}
    total = np.zeros((len(langs), features))
    for r in sums.toLocalIterator():
        total[at[r["lang"]], r["f"]] += round(r["v"], 9)
    if not langs:
        return {"langs": [], "code": np.zeros((0, 1)), "weight": np.zeros((features, 1)), "bias": np.zeros(1), "trust": np.ones(1)}
    profile = (total + 1e-4) / (total + 1e-4).sum(axis=1, keepdims=True)
    code = codewords(len(langs))
    plus = np.stack([profile[code[:, b] > 0].mean(axis=0) if (code[:, b] > 0).any() else np.full(features, 1 / features) for b in range(code.shape[1])], axis=1)
    minus = np.stack([profile[code[:, b] < 0].mean(axis=0) if (code[:, b] < 0).any() else np.full(features, 1 / features) for b in range(code.shape[1])], axis=1)
    weight = np.log(plus) - np.log(minus)
    margins = profile @ weight
    # Centre each bit between the profiles it must part and scale the gap to 2.
    bias, scale = np.zeros(code.shape[1]), np.ones(code.shape[1])
    for b in range(code.shape[1]):
        up, down = margins[code[:, b] > 0, b], margins[code[:, b] < 0, b]
        if len(up) and len(down):
            bias[b], scale[b] = (up.min() + down.max()) / 2, 2 / max(up.min() - down.max(), 1e-6)
    model = {"langs": langs, "code": code, "weight": weight * scale, "bias": bias * scale, "trust": np.ones(code.shape[1])}
    right = rows.mapInArrow(_right(model, features), "bit int, right long, n long").groupBy("bit").agg(F.sum("right").alias("right"), F.sum("n").alias("n")).collect()  # a row per bit
    model["trust"] = bit_trust({r["bit"]: (r["right"], r["n"]) for r in right}, code.shape[1])
    return model


def bit_trust(right: dict[int, tuple[int, int]], bits: int) -> np.ndarray:
    """Weights that sum to 1: log-odds that a bit is right on training rows; at or below a coin's, none."""
    share = np.array([(right.get(b, (0, 0))[0] + 1) / (right.get(b, (0, 0))[1] + 2) for b in range(bits)])
    odds = np.maximum(np.log(share / (1 - share)), 0)
    return odds / odds.sum() if odds.sum() else np.full(bits, 1 / bits)


def _margins(model: dict, counts: np.ndarray) -> np.ndarray:
    return counts @ model["weight"] / np.maximum(counts.sum(axis=1, keepdims=True), 1) - model["bias"]


def _right(model: dict, features: int):
    """(bit, right, n): on how many rows each bit has the sign of its language's codeword."""
    at = {lang: i for i, lang in enumerate(model["langs"])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right, n = np.zeros(model["code"].shape[1], dtype=np.int64), 0
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for first, block in _blocks(batch.column("text").to_pylist()):
                counts, letters = _counts(block, features)
                code = model["code"][[at[x] for x in langs[first : first + len(block)]]]
                has = letters > 0
                right += ((_margins(model, counts) * code > 0) & has[:, None]).sum(axis=0)
                n += int(has.sum())
        yield pa.RecordBatch.from_arrays([pa.array(range(len(right)), pa.int32()), pa.array(right), pa.array([n] * len(right), pa.int64())], ["bit", "right", "n"])

    return run


def _predict(model: dict, features: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, code, trust = (model[k] for k in ("langs", "code", "trust"))
        for batch in batches:
            lang, score, unsure = [], [], []
            for _, block in _blocks(batch.column("text").to_pylist()):
                counts, letters = _counts(block, features)
                margin = np.clip(_margins(model, counts), -8, 8)
                loss = np.stack([(np.log1p(np.exp(-2 * margin * c)) * trust).sum(axis=1) for c in code], axis=1) if langs else np.zeros((len(block), 0))
                for n, row in zip(letters.tolist(), loss, strict=True):
                    if not n or not langs:
                        lang.append("und"), score.append(0.0), unsure.append(True)
                        continue
                    best = int(row.argmin())
                    p = np.exp(-4 * (row - row[best]))
                    others = np.delete(row, best)
                    lang.append(langs[best])
                    score.append(float(1 / p.sum()))
                    unsure.append(bool(len(others) and others.min() - row[best] < AMBIGUOUS))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())], ["doc_id", "lang_pred", "score", "ambiguous"]
            )

    return run


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> doc_id, lang_pred, score (0 to 1), ambiguous.

    One row per input row, from the whole text alone.  ``und`` with score 0 when
    the text is null or has no letter, or no language was learned.  Ties go to
    the language first in alphabetical order.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _predict(model, len(model["weight"])), "doc_id long, lang_pred string, score double, ambiguous boolean"
    )


def held_out():
    """True for the third of the documents (by crc32 of the id) kept from training."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
