"""Cross-tokenizer alignment and SimHash against plain recomputation."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from isobar.llm import alignment, simhash

from test_llm import ODD, docs, words_of

TEXTS = [
    *ODD,
    "The quick brown fox jumps over the lazy dog.",
    "The quick brown fox jumps over the lazy dog.",
    "naïve café – 東京 🎈 Straße <s> </s> <|endoftext|> <unk> <0x41>",
    "tabs\tand\nlines\r\n  double  spaces ",
    "a piece mark ▁ inside",
    "Übermäßig lange Wörter: Donaudampfschifffahrtsgesellschaftskapitän 1234567890",
    "x" * 3000,
    "word " * 2000,
]


def plain_alignment(spark, texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.vocabulary_path(spark, alignment.VOCABULARY_A))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=alignment.vocabulary_path(spark, alignment.VOCABULARY_B))
    alphabet, rows = alignment.byte_alphabet(), []
    for text in texts:
        sides = [], []
        if text:
            enc = a.encode(" " + text, add_special_tokens=False)
            sides = [(i, bytes(alphabet[c] for c in t)) for i, t in zip(enc.ids, enc.tokens)], [(i, alignment.piece_bytes(b.id_to_piece(i))) for i in b.encode(text)]
            if any(b"".join(x for _, x in side) != (" " + text).encode() for side in sides):
                sides = [], []
        spans = []
        for side in sides:
            at, out = 0, []
            for i, x in side:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        links = [(i, j) for i, s, e in spans[0] for j, u, v in spans[1] if s < v and u < e] if len(spans[0]) < 4000 else []
        ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, from_ = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for i, s, e in side if from_ <= s and e <= end) for side in spans))
            from_ = end
        rows.append((spans, links, groups))
    held = Counter(p for _, links, _ in rows for p in set(links))
    best = defaultdict(int)
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    out = []
    for spans, links, groups in rows:
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((len(spans[0]), len(spans[1]), len(groups), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), sha))
    return out


@pytest.mark.parametrize("few", [alignment.FEW, 8, 1])
def test_op11_by_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(alignment, "FEW", few)  # few pairs are broadcast, the rest is joined
    rows = alignment.alignment(docs(spark, TEXTS).withColumn("links", F.lit("clash")).withColumn("row", F.lit(1))).collect()
    got = {r.doc_id: tuple(r)[1:] for r in rows}
    assert [got[i] for i in range(len(TEXTS))] == plain_alignment(spark, TEXTS)
    assert got[0][0] >= 0 and len(rows) == len(TEXTS)


def test_op11_whole_tables(spark):
    where = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{where}/documents.parquet").where("length(text) < 6000")
    texts = {r.doc_id: r.text for r in table.select("doc_id", "text").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in alignment.alignment(table).collect()}
    assert [got[i] for i in texts] == plain_alignment(spark, list(texts.values()))
    assert sum(x[0] > 0 for x in got.values()) > 0.9 * len(got)


def test_op11_empty_null_and_repeated(spark):
    schema = "doc_id long, text string"
    assert alignment.alignment(spark.createDataFrame([], schema)).collect() == []
    rows = alignment.alignment(spark.createDataFrame([(None, None), (None, "one word"), (3, "one word"), (3, "one word"), (4, "")], schema)).collect()
    assert len(rows) == 5 and {tuple(r)[1:] for r in rows if r.n_a == 0} == {(0, 0, 0, 0, 0, 0, "")}
    full = [r for r in rows if r.n_a]
    assert len(full) == 3 and all(r.count_sum == 3 * r.n_links and r.n_best == r.n_links for r in full)


def test_op11_vocabulary_folder_is_a_setting(spark, tmp_path):
    spark.conf.set(alignment.FOLDER_KEY, str(tmp_path))
    try:
        assert alignment.vocabulary_path(spark, "x.json") == str(tmp_path / "x.json")
    finally:
        spark.conf.unset(alignment.FOLDER_KEY)


def plain_print(text):
    w = words_of(text)
    if not w:
        return 0
    parts = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)]
    h = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def plain_classes(ids, prints):
    """Least id reachable over all pairs."""
    lead = list(range(len(prints)))

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                lead[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(ids))]


def test_op12_by_brute_force(spark):
    r = random.Random(3)
    base = [r.choice(["river", "stone", "cloud", "lamp", "bread"]) + str(r.randrange(40)) for _ in range(400)]
    texts = list(ODD)
    for _ in range(150):
        w = list(base[: r.choice([60, 400])])
        for _ in range(r.randrange(0, 6)):
            w[r.randrange(len(w))] = "new" + str(r.randrange(99))
        texts.append(" ".join(w))
    texts += ["Three Words\tONLY", "three words only", "four words are one", "", None, "a" * 200000, "w " * 50000]
    rows = simhash.near_duplicates(docs(spark, texts).withColumn("print", F.lit(1)).withColumn("key", F.lit("x"))).collect()
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in rows}
    prints = [plain_print(t) for t in texts]
    classes = plain_classes(range(len(texts)), prints)
    assert [got[i] for i in range(len(texts))] == [(f"{p:016x}", c) for p, c in zip(prints, classes)]
    assert 1 < len(set(classes)) < len(texts)


def clustered(r, n):
    """Fingerprints around a few centres, with chains of up to 9 bits and lonely ones."""
    centres = [r.getrandbits(64) for _ in range(4)]
    out = []
    for _ in range(n):
        x = r.choice(centres)
        for _ in range(r.randrange(0, 9)):
            x ^= 1 << r.randrange(64)
        out.append(x)
    return sorted({*out, *(r.getrandbits(64) for _ in range(n // 4)), 0, 2**64 - 1})


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 40, 3])
def test_op12_buckets_lose_no_link(spark, bucket):
    prints = clustered(random.Random(bucket), 900)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    table = spark.createDataFrame([(x,) for x in signed], "print long").repartition(5)
    edges = [(x.u % 2**64, x.v % 2**64) for x in simhash.linked_prints(table, bucket).collect()]
    assert all((u ^ v).bit_count() <= 4 for u, v in edges)
    lead = {p: p for p in prints}

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        lead[b] = a
    assert [find(p) for p in prints] == plain_classes(prints, prints)
    if bucket == simhash.BUCKET:  # at most a row for each fingerprint and anchor, not all pairs
        assert len(edges) < 32 * len(prints)


def test_op12_anchors_cover():
    r = np.random.Generator(np.random.PCG64(1))
    words = r.integers(0, 2**31, 4000, dtype=np.uint64)
    for distance, patterns in ((1, simhash._patterns(1)), (2, simhash._NEAR), (3, simhash._FAR)):
        rows, anchors = simhash._anchors(words, patterns)
        assert (simhash._syndromes(anchors) == 0).all() and (np.bitwise_count(anchors ^ words[rows]) <= distance).all()
        assert len(np.unique(rows)) == len(words)  # the covering radius is 1
    assert {len(p) for p in simhash._NEAR[1:]} == {16} and len(simhash._NEAR[0]) == 1
    assert {len(p) for p in simhash._FAR[1:]} == {156}


def test_op12_empty_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    rows = simhash.near_duplicates(spark.createDataFrame([(None, "a b"), (7, "a b"), (5, "a  B"), (5, "a b"), (9, None), (8, " \n")], schema)).collect()
    assert sorted((x.doc_id, x.component_id) for x in rows if x.doc_id) == [(5, 5), (5, 5), (7, 5), (8, 8), (9, 8)]
    assert [x.component_id for x in rows if x.doc_id is None] == [None]


def test_op11_parts_give_what_whole_texts_give(spark):
    paths = [alignment.vocabulary_path(spark, v) for v in (alignment.VOCABULARY_A, alignment.VOCABULARY_B)]
    held = [open(p, "rb").read() for p in paths]
    cut, whole = alignment._Units(*held), alignment._Units(*held)
    assert cut.cut
    whole.cut = False
    r = random.Random(4)
    bits = [" ", "  ", "\n", "\t", "\r\n", "\n ", " \n", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "᠎", "​", "a", "don't", "I'll", "x1", "12", ".", "...", "ß", "É", "漢字", "🎈", "é", "<s>", "<|endoftext|>", "▁", "'s", "_", "the", "-"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(1, 25))) for _ in range(4000)] + [t for t in TEXTS if t]
    texts += [f"{a}{chr(c)}{b}" for c in [*range(1, 0x300), *range(0x1680, 0x1690), *range(0x2000, 0x2070)] for a, b in (("a ", " b"), ("a", "b"), ("1 ", "2"), (" ", " x"))]
    for k in range(0, len(texts), 500):
        some = texts[k : k + 500]
        for x, y in zip(cut.tokens(some), whole.tokens(some), strict=True):
            assert x.equals(y)
    cut.held = alignment._HELD + 1  # what is kept is let go
    assert all(x.equals(y) for x, y in zip(cut.tokens(texts[:50]), whole.tokens(texts[:50]), strict=True)) and len(cut.number) < 500


def test_op11_repeated_parts_are_aligned_once(spark, monkeypatch):
    """The array functions see a part of a text once, not once for every document that holds it."""
    aligned, align = [], alignment.align

    def watched(tokens, *settings):
        aligned.append(tokens.agg(F.sum(F.size("a_ids"))).first()[0] or 0)
        return align(tokens, *settings)

    monkeypatch.setattr(alignment, "align", watched)
    r = random.Random(11)
    words = ["".join(r.choice("abdeiklmnorstu") for _ in range(r.randrange(2, 12))) for _ in range(60)]
    texts = [" ".join(r.choice(words) for _ in range(50)) + f" {k}end" for k in range(100)]
    rows = alignment.alignment(docs(spark, texts)).collect()
    got = {x.doc_id: tuple(x)[1:] for x in rows}
    assert [got[i] for i in range(len(texts))] == plain_alignment(spark, texts)
    assert sum(aligned) < sum(x.n_a for x in rows) / 10


@pytest.mark.parametrize("common, longest", [(0, 64), (4, 64), (40, 3), (1 << 17, 64)])
def test_op11_common_parts_change_nothing(spark, monkeypatch, common, longest):
    monkeypatch.setattr(alignment, "COMMON", common)
    monkeypatch.setattr(alignment, "LONGEST", longest)
    texts = [t for t in TEXTS if not t or len(t) < 500] * 2
    texts += ["of ▁mark of", "▁mark ▁mark", "of  the  ", " of the", "of the x7", "x8 x9 of the", "of x10 the x11 x12", "the of ᠎ the of", "of\nthe\nof of", "ﬁ of ﬁ"]
    got = {x.doc_id: tuple(x)[1:] for x in alignment.alignment(docs(spark, texts)).collect()}
    want = plain_alignment(spark, texts)
    assert [got[i] for i in range(len(texts))] == want
    assert any(t and not x[0] for t, x in zip(texts, want, strict=True))  # some do not come back in bytes
