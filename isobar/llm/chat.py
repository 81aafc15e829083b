"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as a whole::

    ### <Role>: <text> </turn>\\n

Inside roles and texts a backslash is put before every backslash, ``#``, ``<``,
newline of a role and colon of a role, so no text can spell a control string and
the rendering reads back exactly.  The rendering is encoded once, with character
offsets; tokens and assistant spans are both sorted, and the tokens of a span
are found by binary search and clipped to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import VOCABULARY_A, vocabulary_path

# Fixed values of the template.
OPEN, AFTER_ROLE, CLOSE = "### ", ": ", " </turn>\n"
TRAINED_ROLE = "assistant"

_TEXT = str.maketrans({c: "\\" + c for c in "\\#<"})
_ROLE = str.maketrans({c: "\\" + c for c in "\\#<:\n"})


def default_tokenizer(spark: SparkSession | None = None) -> str:
    """Path of the byte-level vocabulary: in the folder that the session names, or where the machine offers it."""
    spark = spark or SparkSession.getActiveSession()
    return vocabulary_path(spark, VOCABULARY_A)


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    out, at = [], 0
    while (k := text.find("\\", at)) >= 0:
        out += [text[at:k], text[k + 1 : k + 2]]
        at = k + 2
    return "".join([*out, text[at:]])


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and its trained spans."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = OPEN + role.translate(_ROLE) + AFTER_ROLE
        body = text.translate(_TEXT)
        if role == TRAINED_ROLE and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation: the inverse of :func:`render`."""
    turns, at = [], 0
    while at < len(formatted):
        at += len(OPEN)
        end = at
        while formatted[end] != ":":
            end += 1 + (formatted[end] == "\\")
        role = unescape(formatted[at:end])
        at = end + len(AFTER_ROLE)
        end = formatted.index(CLOSE, at)  # an escaped text has no bare "<"
        turns.append((role, unescape(formatted[at:end])))
        at = end + len(CLOSE)
    return turns


def token_offsets(encode, formatted: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, starts and ends of the tokens of the whole rendering, encoded once.

    Some vocabularies trim spaces off their offsets: what lies between two tokens
    belongs to the later one, so the tokens cover all of the text.
    """
    e = encode(formatted)
    o = np.array(e.offsets, dtype=np.int64).reshape(-1, 2)
    high = np.maximum.accumulate(o[:, 1])
    high[-1:] = len(formatted)
    return np.array(e.ids, dtype=np.int64), np.minimum(o[:, 0], np.append(0, high[:-1])[: len(o)]), high


def mask_spans(low: np.ndarray, high: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which tokens meet a trained span, and the character spans they cover in it.

    Both lists are sorted, so the tokens of a span are one range of positions.
    A token that straddles a border is masked in and clipped to the span; tokens
    that share a character (parts of its bytes) cover it once.
    """
    mask = np.zeros(len(low), dtype=bool)
    covered = []
    for s, e in spans:
        i = int(np.searchsorted(high, s, "right"))
        j = int(np.searchsorted(low, e, "left"))
        mask[i:j] = True
        done = s
        for a, b in zip(np.maximum(low[i:j], s).tolist(), np.minimum(high[i:j], e).tolist(), strict=True):
            a = max(a, done)
            if a < b:
                if covered and covered[-1][1] == a and a > s:
                    covered[-1] = (covered[-1][0], b)
                else:
                    covered.append((a, b))
                done = b
    return mask, covered


_OUT = "conv_id long, formatted string, token_ids array<int>, loss_mask binary, loss_spans array<struct<start:long,end:long>>"
_ARROW = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("formatted", pa.string()),
        ("token_ids", pa.list_(pa.int32())),
        ("loss_mask", pa.binary()),
        ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ]
)


def _formatter(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_buffer(vocabulary.value)
        t.encode_special_tokens = True
        encode = lambda s: t.encode(s, add_special_tokens=False)

        def finish(conv, turns) -> dict:
            text, spans = render(turns)
            ids, low, high = token_offsets(encode, text)
            mask, covered = mask_spans(low, high, spans)
            return {"conv_id": conv, "formatted": text, "token_ids": ids, "loss_mask": np.packbits(mask).tobytes(), "loss_spans": [{"start": a, "end": b} for a, b in covered]}

        out, size, current, turns = [], 0, None, []
        for batch in batches:  # sorted by conv_id and turn; a conversation may span batches
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if turns and conv != current:
                    out.append(finish(current, turns))
                    size += len(out[-1]["formatted"])
                    turns = []
                    if len(out) >= 256 or size >= 1 << 20:
                        yield pa.RecordBatch.from_pylist(out, _ARROW)
                        out, size = [], 0
                current = conv
                turns.append((role or "", text or ""))
        if turns:
            out.append(finish(current, turns))
        if out:
            yield pa.RecordBatch.from_pylist(out, _ARROW)

    return run


def format_conversations(turns: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` -> one row per conversation.

    formatted: the rendering; token_ids; loss_mask: one bit per token, packed
    high bit first; loss_spans: code-point spans of ``formatted`` under the mask.
    Rows of a conversation are ordered by turn, then role, then text (nulls first),
    so repeated turns have a defined order and stay.  Null roles and texts are
    empty.  Rows with a null conv_id form one conversation of that id.  Other
    columns are ignored.  A conversation is one unit of work, as it is rendered whole
    and encoded once: a task holds the longest one, its tokens and their offsets.
    ``tokenizer``: path, on the driver, of a vocabulary file (else that of the session's
    setting ``isobar.tokenizers``); its bytes are sent to the executors.
    """
    with open(tokenizer or default_tokenizer(turns.sparkSession), "rb") as f:
        vocabulary = turns.sparkSession.sparkContext.broadcast(f.read())
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(_formatter(vocabulary), _OUT)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        tokens = pc.list_value_length(batch.column("token_ids")).to_pylist()
        for conv, text, spans, n_tokens in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_spans")), tokens, strict=True):
            turns = parse(text)
            told = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass"))
            loss = unescape("".join(text[s["start"] : s["end"]] for s in spans))
            out.append(
                {
                    "conv_id": conv,
                    "n_turns": len(turns),
                    "turns_sha256": told.hexdigest(),
                    "loss_chars": len(loss),
                    "loss_sha256": hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(),
                    "formatted_chars": len(text),
                    "n_tokens": n_tokens,
                }
            )
        yield pa.RecordBatch.from_pylist(out, _DIGEST)


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_tokens", pa.int64())])


def digest(formatted: DataFrame) -> DataFrame:
    """Turn and loss digests read back from the formatted output.

    A row per row of ``formatted``; no turns, or no text under the mask, give counts
    of 0 and the digest of the empty string.  An empty table gives an empty result.
    """
    return formatted.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long")


def with_probe(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """The table plus conversation -7, whose texts imitate the template."""
    text = "\\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe)
