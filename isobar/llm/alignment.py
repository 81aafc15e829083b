"""Cross-tokenizer alignment: which tokens of two tokenizers stand over the same bytes.

Python only tokenises: it sends token ids and the byte offsets at which tokens end,
for both tokenizers.  Groups and links are found by Spark's array functions:

- ``array_intersect`` of the two end arrays gives the offsets that cut both into groups;
- all ends together cut the text into pieces, each under one token of either side, so
  pieces and links (overlapping occurrences) are the same thing;
- how many ends lie before an offset comes from sorting both together: an offset's
  place less its own number.  That is a sort of two sorted runs, so a document costs
  time in proportion to its length.

No token and so no group or link crosses the places at which texts are cut into parts
(see ``_Units``).  The parts that occur most often, at most ``COMMON``, go through these
functions once, in a table of their own; a task puts their groups and links in their
places and sends only the tokens of a document's other parts.  Which parts are common
changes no result.

A pair of ids counts once per document.  Pairs held by over ``1 / FEW`` of all
(document, pair) rows are at most FEW and are broadcast; what they do not answer is
joined by a shuffle, in which no key is hot any more.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import cut, new_path, release, small_batches

#: Pairs that are broadcast, at most (16 bytes each).
FEW = 1 << 20
#: Parts that are aligned once for all documents, at most, and the characters of each.
COMMON, LONGEST = 1 << 18, 64
#: Characters of text whose tokens a task sends at once.
_CHUNK = 1 << 19
#: Characters of parts whose tokens a Python worker keeps.
_HELD = 1 << 24
_CUT, _SPACES = re.compile(r"(?<=\S) "), re.compile(r"\s ")
#: A character that some versions of Unicode call a space.
_ODD_SPACE = re.compile("\u180e")
#: Session setting that names the folder of the vocabulary files.
FOLDER_KEY = "isobar.tokenizers"
# The two vocabularies of the registered query.
VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"

_COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "known", "known_links", "a_ids", "a_ends", "b_ids", "b_ends"]
#: Stands in a text of groups where those of a part that is not common go.
_LATER = "\n"


def vocabulary_path(spark: SparkSession | None, name: str) -> str:
    """A vocabulary file's path: in the folder that the session names, or where the machine offers it."""
    folder = spark and spark.conf.get(FOLDER_KEY, None)
    if folder:
        return os.path.join(folder, name)
    try:
        import public_tokenizers
    except ImportError as e:
        raise ValueError(f"no vocabulary on this machine: set {FOLDER_KEY} to the folder of {name}") from e
    return str(public_tokenizers.path(name))


def byte_alphabet() -> dict[str, int]:
    """The byte that a character of a byte-level vocabulary stands for.

    Printable Latin-1 characters but the soft hyphen stand for themselves; the other
    bytes, in order, are the characters from U+0100 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def piece_bytes(piece: str) -> bytes:
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


class _Units:
    """Token ids and their byte lengths for parts of a text, each encoded once; kept by a Python worker.

    A part is cut at a space after a character that is no space.  No token of either
    side crosses such a place: the byte-level side splits words there before it merges,
    and no piece of the other has its space mark after another character.  Where a
    vocabulary is not like that, a text is one part.
    """

    def __init__(self, a: bytes, b: bytes):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
        self.first, self.second = Tokenizer.from_buffer(a), SentencePieceProcessor(model_proto=b)
        self.first.encode_special_tokens = True
        alphabet = byte_alphabet()
        of_a = [b""] * self.first.get_vocab_size()
        for token, i in self.first.get_vocab().items():
            of_a[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        self.of = of_a, [piece_bytes(p) for p in pieces]
        self.size_of = [np.array([len(x) for x in of], np.int32) for of in self.of]
        told = json.loads(a)
        level = told.get("pre_tokenizer") or {}
        words = level.get("type") == "ByteLevel" and level.get("use_regex", True) and told.get("normalizer") is None
        self.cut = words and not any("▁" in p.lstrip("▁") for p in pieces)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.held = 0
        self.count = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.ids, self.sizes = ([np.zeros(0, np.int32), np.zeros(0, np.int32)] for _ in range(2))
        self.whole = np.zeros(0, bool)

    def parts(self, text: str) -> list[str]:
        """What follows the leading space of every part of " " + text."""
        if not self.cut or _ODD_SPACE.search(text):
            return [text]
        return _CUT.split(text) if text[:1] == " " or _SPACES.search(text) else text.split(" ")

    def learn(self, parts: list[str]) -> None:
        new = [p for p in dict.fromkeys(parts) if p not in self.number]
        if not new:
            return
        self.number |= {p: len(self.number) + k for k, p in enumerate(new)}
        self.held += sum(map(len, new)) + 100 * len(new)
        coded = [e.ids for e in self.first.encode_batch_fast([" " + p for p in new], add_special_tokens=False)], self.second.encode(new, num_threads=1)
        if "" in new:  # a space at the end of a text; the piece side puts none before nothing
            coded[1][new.index("")] = [self.second.piece_to_id("▁")]
        want = [b" " + p.encode() for p in new]
        length, text = np.fromiter(map(len, want), np.int64, len(want)), b"".join(want)
        whole = np.ones(len(new), bool)
        for side, (rows, of) in enumerate(zip(coded, self.of, strict=True)):
            count = np.fromiter(map(len, rows), np.int64, len(rows))
            flat = list(chain.from_iterable(rows))
            ids = np.array(flat, np.int32)
            sizes = self.size_of[side][ids]
            border = np.append(0, np.cumsum(count))
            spelt = np.append(0, np.cumsum(sizes, dtype=np.int64))[border]
            if not ((np.diff(spelt) == length).all() and b"".join(map(of.__getitem__, flat)) == text):  # then each by itself
                whole &= [b"".join(map(of.__getitem__, r)) == w for r, w in zip(rows, want, strict=True)]
            self.count[side] = np.append(self.count[side], count)
            self.ids[side] = np.append(self.ids[side], ids)
            self.sizes[side] = np.append(self.sizes[side], sizes)
        self.whole = np.append(self.whole, whole)

    def numbers(self, parts: list[str]) -> np.ndarray:
        if self.held > _HELD:
            self.clear()
        self.learn(parts)
        return np.fromiter(map(self.number.__getitem__, parts), np.int64, len(parts))

    def lost(self, part: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Whether a text, whose parts lie between two edges, does not come back in bytes."""
        return np.diff(np.append(0, np.cumsum(~self.whole[part]))[edge]) > 0

    def arrays(self, part: np.ndarray, edge: np.ndarray, marked: bool) -> list[pa.Array]:
        """a_ids, a_ends, b_ids, b_ends of each text; marked: twice the ends, and one more where a part ends."""
        out = []
        for count, ids, sizes in zip(self.count, self.ids, self.sizes, strict=True):
            after, at = _places(np.cumsum(count) - count, count, part)
            total = np.append(0, np.cumsum(sizes[at], dtype=np.int64))
            border = after[edge]
            ends = total[1:] - np.repeat(total[border[:-1]], np.diff(border))
            if marked:
                ends *= 2
                ends[after[1:] - 1] += 1
            out += [_lists(border, pa.array(ids[at])), _lists(border, pa.array(ends).cast(pa.int32()))]
        return out

    def tokens(self, texts: list[str]) -> list[pa.Array]:
        """a_ids, a_ends, b_ids, b_ends of each text."""
        split = [self.parts(t) if t else [] for t in texts]
        part, edge = self.numbers([p for parts in split for p in parts]), _edges(split)
        return self.arrays(*_without(part, edge, self.lost(part, edge)), marked=False)

    def pieces(self, texts: list[str], common: _Common) -> list[pa.Array]:
        """The columns after doc_id of ``tokenise``."""
        split = [self.parts(t) if t else [] for t in texts]
        every, edge = [p for parts in split for p in parts], _edges(split)
        known = np.fromiter(map(common.number.get, every, repeat(-1)), np.int64, len(every))
        others = np.flatnonzero(known < 0)
        part, inner = self.numbers([every[k] for k in others.tolist()]), np.searchsorted(others, edge)
        gone = self.lost(part, inner)
        if gone.any():  # texts that do not come back in bytes have no tokens
            known, edge = _without(known, edge, gone)
            part, inner = _without(part, inner, gone)
        sums = [np.diff(np.append(0, np.cumsum(n[known]))[edge]) for n in common.sums]
        for k, count in enumerate(self.count):
            sums[k] += np.diff(np.append(0, np.cumsum(count[part]))[inner])
        each = known.tolist()
        groups = pa.array([";".join(map(common.groups.__getitem__, each[x:y])) for x, y in pairwise(edge.tolist())], pa.string())
        after, at = _places(common.first, common.count, known)
        return [*map(pa.array, sums), groups, _lists(after[edge], pa.array(common.links[at])), *self.arrays(part, inner, marked=True)]


def _edges(split: list[list[str]]) -> np.ndarray:
    return np.cumsum([0] + [len(parts) for parts in split])


def _without(part: np.ndarray, edge: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(edge)
    return part[~np.repeat(gone, n)], np.append(0, np.cumsum(np.where(gone, 0, n)))


def _places(first: np.ndarray, count: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the items of each part begin and end among those of all, and the place of each in the parts' own array."""
    mine = count[part]
    after = np.append(0, np.cumsum(mine))
    return after, np.repeat(first[part] - after[:-1], mine) + np.arange(after[-1])


def _lists(border: np.ndarray, items: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(border.astype(np.int32)), items)


class _Common:
    """Groups and links of common parts, as ``align`` found them; number -1 is any other part."""

    def __init__(self, rows: pa.Table | None, code: str):
        kind = np.int32 if code == "int" else np.int64
        self.number: dict[str, int] = {}
        self.groups, self.sums = [_LATER], [np.zeros(1, np.int64) for _ in range(3)]
        self.count, self.first, self.links = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, kind)
        if rows is not None and rows.num_rows:
            self.number = {p: k for k, p in enumerate(rows["doc_id"].to_pylist())}
            self.groups = [*rows["groups"].to_pylist(), _LATER]
            self.sums = [np.append(rows[c].to_numpy(), 0) for c in ("n_a", "n_b", "n_groups")]
            links = rows["links"].combine_chunks()
            self.count = np.append(links.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), 0)
            self.first, self.links = np.cumsum(self.count) - self.count, links.flatten().to_numpy().astype(kind)


@lru_cache(maxsize=1)
def _units(a: bytes, b: bytes) -> _Units:
    return _Units(a, b)


def _tokenise(vocabularies, common):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _units(*vocabularies.value)
        for batch in batches:
            texts, from_, size = [], 0, 0
            for k, text in enumerate(batch.column("text").to_pylist()):
                texts.append(text or "")
                size += len(texts[-1])
                if size >= _CHUNK or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(from_, len(texts)), *units.pieces(texts, common.value)], _COLUMNS)
                    texts, from_, size = [], k + 1, 0

    return run


def tokenise(docs: DataFrame, vocabularies: tuple[bytes, bytes], common: _Common, code: str) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> a row per row of what its " " + text is made of.

    vocabularies: a byte-level one, and a piece model that puts the space before the text
    itself.  n_a, n_b: numbers of tokens; n_groups, known_links: groups and links of the
    common parts; known: texts of these groups, a newline where another part's go.  Of
    the other parts both sides' ids and byte ends follow: twice the ends, and one more
    where a part ends.  A null or empty text, and one that either side does not give back
    byte by byte, has zeros and empty arrays.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    shared = [spark.sparkContext.broadcast(x) for x in (vocabularies, common)]
    kinds = [rows.schema["doc_id"].dataType.simpleString(), *["long"] * 3, "string", f"array<{code}>", *["array<int>"] * 4]
    return rows.mapInArrow(_tokenise(*shared), ", ".join(map(" ".join, zip(_COLUMNS, kinds, strict=True))))


_NUMBER, _SIDE = 1 << 32, 1 << 31


def _codes() -> Column:
    """Both sides' ends in ascending order, a before b at the same place: end, side and number of the token in one long."""
    a = F.transform("a_ends", lambda x, i: x.cast("long") * _NUMBER + i)
    b = F.transform("b_ends", lambda x, i: x.cast("long") * _NUMBER + (i + _SIDE))
    return F.sort_array(F.concat(a, b))


def _links(width: int) -> Column:
    """A link for every end in ``_codes``, but one where both sides end.

    The token of the other side over the piece that ends there is the one after all its
    ends before: an end's place less its own number counts them.
    """

    def link(x: Column, j: Column) -> Column:
        own = x.bitwiseAND(_SIDE - 1).cast("int")
        other = (j - own).cast("int")
        twice = F.shiftright(F.get("_codes", j - 1), 32) == F.shiftright(x, 32)
        b = F.when(twice, F.lit(None)).otherwise(F.get("a_ids", other).cast("long") * width + F.get("b_ids", own))
        return F.when(x.bitwiseAND(_SIDE) == 0, F.get("a_ids", own).cast("long") * width + F.get("b_ids", other)).otherwise(b)

    return F.array_compact(F.transform("_codes", link))


def _borders() -> Column:
    """By group, the numbers of its last a and b token: ends that follow each other in ``_codes`` at one place."""

    def border(x: Column, j: Column) -> Column:
        before = F.get("_codes", j - 1)
        return F.when((x.bitwiseAND(_SIDE) != 0) & (F.shiftright(before, 32) == F.shiftright(x, 32)), before.bitwiseAND(_SIDE - 1) * _NUMBER + x.bitwiseAND(_SIDE - 1))

    return F.array_compact(F.transform("_codes", border))


def align(tokens: DataFrame, width: int, code: str) -> DataFrame:
    """``tokens`` (see ``tokenise``) -> doc_id, n_a, n_b, n_groups, groups, links.

    groups: per group the text ``a1,a2|b1`` of its ids, joined by ``;``; links: per
    overlapping occurrence a_id * width + b_id, width being the number of b ids.
    """
    cut = tokens.withColumns({"_common": F.array_intersect("a_ends", "b_ends"), "_codes": _codes()})
    cut = cut.withColumns({"_borders": _borders(), "_links": _links(width)})

    of_a, of_b = lambda x: F.shiftright(x, 32).cast("int"), lambda x: x.bitwiseAND(_SIDE - 1).cast("int")

    def part(ids: str, last, g: Column) -> Column:  # tokens after the last group's end, up to this one's
        end = last(F.get("_borders", g))
        n = F.when(g == 0, end + 1).otherwise(end - last(F.get("_borders", g - 1)))
        many = F.transform(F.sequence(end - n + 1, end), lambda k: F.get(ids, k).cast("string"))  # slice() would copy the whole array first
        return F.when(n == 1, F.get(ids, end).cast("string")).otherwise(F.array_join(many, ","))

    def text(end: Column, g: Column) -> Column:  # a marked end is the part's last
        return F.concat(part("a_ids", of_a, g), F.lit("|"), part("b_ids", of_b, g), F.when(end.bitwiseAND(1) == 1, _LATER).otherwise(";"))

    cut = cut.withColumn("_groups", F.transform("_common", text))
    between, others = F.split("known", _LATER), F.split(F.array_join("_groups", ""), _LATER)  # of equal length
    return cut.select(
        "doc_id",
        "n_a",
        "n_b",
        (F.col("n_groups") + F.size("_groups")).alias("n_groups"),
        F.array_join(F.zip_with(between, others, lambda x, y: F.concat(x, y)), "").alias("groups"),
        F.concat("known_links", F.col("_links").cast(f"array<{code}>")).alias("links"),
    )


def _common_parts(docs: DataFrame, vocabularies: tuple[bytes, bytes], width: int, code: str) -> _Common:
    """The parts that occur most often, aligned; at most ``COMMON``, of those that occur more than once."""
    none = _Common(None, code)
    if not _units(*vocabularies).cut:
        return none
    words = docs.select(F.explode(F.split(F.col("text").cast("string"), " ")).alias("text")).where(F.length("text") <= LONGEST)
    counted = cut(words.groupBy("text").agg(F.count("*").alias("n")).where("n > 1"), "parts")
    kept, least = 0, None
    for n, count in sorted(map(tuple, counted.groupBy("n").count().collect()), reverse=True):
        if (kept := kept + count) > COMMON:
            break
        least = n
    if least is None:
        return none
    some = counted.where(F.col("n") >= least).select(F.col("text").alias("doc_id"), "text")
    found = align(tokenise(some, vocabularies, none, code), width, code).where("n_a > 0")
    common = _Common(found.toArrow(), code)
    release(counted)
    return common


def _times(links: DataFrame) -> DataFrame:
    """(link, n, best): documents that hold a pair linked, and the most of its a id's pairs."""
    held = links.select(F.explode(F.array_distinct("links")).alias("link"), "width")
    counted = held.groupBy("link", "width").agg(F.count("*").alias("n"))
    best = counted.withColumn("a", F.expr("link div width"))
    most = best.groupBy("a").agg(F.max("n").alias("best"))
    return best.join(most, "a").select("link", "n", (F.col("n") == F.col("best")).alias("is_best"))


def alignment(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> a row per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best: links whose pair is held by as many documents as any pair of its a id;
    count_sum: over links, the documents that hold the pair.  Rows count as documents,
    copies and repeated or null doc_ids too.  Null and empty texts, and texts whose
    tokens do not spell " " + text in bytes on both sides, have zeros and ''.  A text of
    any length is one row's arrays: about 30 bytes of memory a byte of text.  Other
    columns are ignored.  An empty table gives an empty result.  a, b: paths of the
    vocabularies on the driver.
    """
    spark = docs.sparkSession
    a, b = a or vocabulary_path(spark, VOCABULARY_A), b or vocabulary_path(spark, VOCABULARY_B)
    with open(a, "rb") as f, open(b, "rb") as g:
        vocabularies = f.read(), g.read()
    heights = [len(of) for of in _units(*vocabularies).of]
    width = heights[1]
    code = "int" if heights[0] * width < 1 << 31 else "long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    common = _common_parts(rows, vocabularies, width, code)
    found = align(tokenise(rows, vocabularies, common, code), width, code).select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        F.size("links").cast("long").alias("n_links"),
        F.when(F.col("n_groups") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("").alias("groups_sha256"),
        "links",
    )
    path = new_path(spark, "aligned")
    found.write.option("compression", "zstd").parquet(path)  # written once: the tokens are read twice
    found = spark.read.schema(found.schema).parquet(path)
    path = new_path(spark, "pairs")
    _times(found.select("links", F.lit(width).alias("width"))).write.parquet(path)
    pairs = spark.read.parquet(path)
    total = pairs.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * FEW >= total  # at most FEW rows, as the counts sum to total
    links = found.where("n_links > 0").select("row", F.explode("links").alias("link"))
    met = links.join(F.broadcast(pairs.where(often)), "link", "left")
    sums = [F.count_if("is_best").alias("n_best"), F.sum("n").alias("count_sum")]
    told = met.groupBy("row").agg(*sums)
    if not pairs.where(~often).isEmpty():
        rest = met.where("n IS NULL").select("row", "link").join(pairs.where(~often), "link")
        told = told.unionByName(rest.groupBy("row").agg(*sums)).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return found.drop("links").join(told, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
