"""Personal data: patterns propose spans, checksums confirm, context adjusts.

Regular expressions propose e-mail addresses, IPv4 addresses, payment cards,
phone numbers and IBANs; range checks, Luhn and mod-97 confirm them; words
near a span move its score.  The four base kinds follow a fixed definition and
are always reported; IBANs are reported from a score of ``IBAN_SCORE``.

Every pattern is linear in the text: digit runs are tried once (possessive,
from their first digit), and an e-mail is grown from its ``@``.  An IBAN ends at
the length its country fixes, so what follows it (a BIC, an amount) is left out;
for other codes every shorter end at a space is tried.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban")
#: Characters on each side of a span in which context words count.
CONTEXT = 40
IBAN_SCORE = 0.5

# Starting scores and context words (lower case) with what they add.
_START = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8}
_WORDS = {
    "email": {"mail": 0.1, "e-mail": 0.1, "email": 0.1, "contact": 0.1, "correo": 0.1, "courriel": 0.1},
    "ip": {"ip": 0.3, "host": 0.2, "server": 0.2, "address": 0.2, "version": -0.4, "release": -0.3},
    "card": {"card": 0.2, "visa": 0.2, "credit": 0.2, "karte": 0.2, "carte": 0.2, "tarjeta": 0.2, "isbn": -0.5, "order": -0.2},
    "phone": {"phone": 0.3, "tel": 0.3, "call": 0.2, "mobile": 0.3, "fax": 0.2, "telefon": 0.3, "invoice": -0.3},
    "iban": {"iban": 0.2, "bank": 0.2, "account": 0.1, "konto": 0.1, "compte": 0.1, "cuenta": 0.1, "serial": -0.4},
}

#: Characters of an IBAN by country (SWIFT registry).
_IBAN_LENGTH = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}

_ANY = re.compile(r"[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W_]+(?:-[^\W_]+)?")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    flat = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while m := _IBAN.search(text, at):
        start, last = m.span()
        ends = [e for e in range(last, start + 14, -1) if e == last or text[e] == " "]
        if length := _IBAN_LENGTH.get(text[start : start + 2]):
            ends = [e for e in ends if e - start - text.count(" ", start, e) == length] + [last]
        at = start + 1
        for end in ends:
            if len(text[start:end].replace(" ", "")) >= 15 and mod97(text[start:end]):
                yield start, end
                at = end
                break


def _spans(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans, kind by kind and left to right."""
    if not _ANY.search(text):
        return
    for s, e in _emails(text):
        yield "email", s, e
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        if all(len(g.lstrip("0")) <= 3 and int(g[-9:]) <= 255 for g in m.groups()):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield "card", *m.span()
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            yield "phone", *m.span()
    for s, e in _ibans(text):
        yield "iban", s, e


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT]
    words = {w.lower() for w in _WORD.findall(near)}
    return round(min(1.0, max(0.0, _START[kind] + sum(v for w, v in _WORDS[kind].items() if w in words))), 3)


_ROWS = "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    for batch in batches:
        out = []
        for text in batch.column("text"):
            text = text.as_py() or ""
            found = [(k, s, e, _score(text, k, s, e)) for k, s, e in _spans(text)]
            out.append([{"kind": k, "start": s, "end": e, "score": p} for k, s, e, p in found if k != "iban" or p >= IBAN_SCORE])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind)], ["doc_id", "spans"])


def personal_data(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``doc_id, spans``, a row per input row.

    spans: array of (kind, start, end, score) by kind (email, ip, card, phone,
    iban), then start; offsets are code points, end exclusive.  A null or empty
    text has an empty array.  Spans of different kinds may overlap; those of one
    kind do not.  One text is one unit of work: whole texts, no windows.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_find, _ROWS)


def redact(text: str | None) -> str | None:
    """The text with every span replaced by ``[kind]`` (the longer of two overlapping).

    A null text stays null, an empty one empty.
    """
    if text is None:
        return None
    out, done = [], 0
    for k, s, e in sorted(_spans(text), key=lambda x: (x[1], -x[2])):
        if s >= done:
            out += [text[done:s], f"[{k}]"]
            done = e
    return "".join([*out, text[done:]])


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of the result of :func:`personal_data`."""
    told = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"].isin(*KINDS[:4]))

    def count(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *(count(k) for k in KINDS[:4]),
        F.sha2(told(base).cast("binary"), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda x: x["score"])), F.lit(0.0)).alias("top_score"),
    )
