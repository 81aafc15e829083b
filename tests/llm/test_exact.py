"""Operators against plain recomputation, at both sides of their block and bucket bounds."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from isobar.llm import ann, chat, graph, ids, langid, mixing, near_dup, sharding, toxicity

from test_llm import ODD, brute_components, docs, words_of


def near_copies(r, n, base_len=90):
    """Copies of two texts with from none to many changed words, some of them changed alike."""
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    out = []
    for base in ([word() for _ in range(base_len)] for _ in range(2)):
        family = list(base)
        for _ in range(n):
            w = list(r.choice([base, family]))
            for _ in range(r.randrange(0, 12)):
                w[r.randrange(len(w))] = word()
            if r.random() < 0.2:
                family = list(w)
            out.append(" ".join(w[r.randrange(0, 9) :]))
    return out


@pytest.mark.parametrize(("bucket", "levels"), [(2, 4), (2, 1)])
def test_op1_levels_and_leftovers(spark, monkeypatch, bucket, levels):
    monkeypatch.setattr(near_dup, "BUCKET", bucket)
    monkeypatch.setattr(near_dup, "LEVELS", levels)  # 1: what stays crowded is compared in full
    texts = near_copies(random.Random(8), 60) + ODD
    want, _ = brute_components(texts)
    got = {x.doc_id: x.component_id for x in near_dup.near_duplicates(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_components_of_chains_and_stars(spark, monkeypatch):
    monkeypatch.setattr(graph, "HELD", 8)  # tasks contract a few edges at a time
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (201, 200)]
    r.shuffle(edges)
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_rows_by_ids(spark):
    rows = [(i % 40, f"t{i}", i) for i in range(60)] + [(None, "n", 1)]
    d = spark.createDataFrame(rows, "doc_id long, _row string, goes int")
    touched = spark.createDataFrame([(i, i < 10) for i in range(15)], "doc_id long, goes boolean")
    kept = ids.drop_ids(d, "doc_id", touched)
    assert kept.columns == d.columns
    times = {i: 0 if i < 10 else 1 if i < 15 else sum(x[0] == i for x in rows) for i in range(40)} | {None: 1}
    got = [x.doc_id for x in kept.collect()]
    assert {i: got.count(i) for i in times} == times
    assert {x.doc_id for x in ids.maybe(d, "doc_id", touched.select("doc_id")).collect()} >= set(range(15))


def test_op2_blocks_by_brute_force(spark):
    r = random.Random(6)
    texts = [" ".join(["w"] * r.randrange(0, 9)) for _ in range(300)] + [None]
    d = docs(spark, texts)
    blocks = 8
    rows = mixing.mixture(d, blocks=blocks).collect()
    tokens = {f"s{k}": sum(len(words_of(t)) for i, t in enumerate(texts) if i % 3 == k) for k in range(3)}
    quota = mixing.plan_mix(tokens).quota
    for s in tokens:
        drawn = sorted((x for x in rows if x.source == s), key=lambda x: (x.epoch, x.place % 2**64, x.doc_id))
        at = 0
        for x in drawn:
            assert x.block == min(blocks - 1, int(at * blocks / quota[s])) and x.tokens == len(words_of(texts[x.doc_id]))
            at += x.tokens


def test_op3_scores_and_grades_by_brute_force(spark):
    r = random.Random(4)
    calm = "the people of this town like to walk along a quiet river in the morning".split()
    rude, vile = ["vileword", "nastyword"], ["hatefulword", "brutalword"]
    rows = []
    for i in range(300):
        grade = r.choice([0, 0, 1, 3])
        text = r.choices(calm, k=20) + (r.choices(rude, k=2) if grade else []) + (r.choices(vile, k=3) if grade == 3 else [])
        rows.append((i, " ".join(r.sample(text, len(text))), grade))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(table.unionByName(table), table.select("doc_id", "toxic"))  # repeated documents
    assert model["levels"].tolist() == [0, 1, 3] and len(model["theta"]) == 2 and model["theta"][0] < model["theta"][1]
    assert (model["w"] >= 0).all()
    out = {x.doc_id: x for x in toxicity.score(table, model).collect()}
    for i, text, grade in rows:
        hits = {}
        for w in re.findall(r"[^\W_]+", text.lower()):
            for f in [w + "$", *(w[:k] for k in toxicity.STEMS if k <= len(w))]:
                hits[f] = hits.get(f, 0) + 1
        s = sum(model["w"][model["words"][f]] * math.log2(1 + n) for f, n in hits.items() if f in model["words"])
        above = [1 / (1 + math.exp(t - s)) for t in model["theta"]]
        assert out[i].severity == pytest.approx(above[0] + 2 * above[1]) and out[i].p_toxic == pytest.approx(above[0])
        assert out[i].grade == [0, 1, 3][sum(p >= 0.5 for p in above)]
    assert sum(out[i].grade == grade for i, _, grade in rows) > 0.95 * len(rows)


def test_op3_pieces_cut_no_word(monkeypatch):
    monkeypatch.setattr(toxicity, "_PIECE", 5)
    for text in ("", "abc", "one two-three_four " * 9, "x" * 50, "été où " * 6):
        assert toxicity._counted(text) == {w: re.findall(r"[^\W_]+", text).count(w) for w in re.findall(r"[^\W_]+", text)}


def test_op4_mask_by_brute_force():
    r = random.Random(2)
    for _ in range(200):
        edges = sorted(r.sample(range(1, 60), r.randrange(1, 20)))
        low, high = np.array([0, *edges]), np.array([*edges, 60])
        if r.random() < 0.5:  # tokens that share a character
            high = np.minimum(high + 1, 60)
        marks = sorted(r.sample(range(61), 4))
        spans = [(marks[0], marks[1]), (marks[2], marks[3])]
        mask, covered = chat.mask_spans(low, high, spans)
        assert mask.tolist() == [any(a < e and b > s for s, e in spans) for a, b in zip(low, high)]
        inside = {i for s, e in spans for i in range(s, e)}
        told = [i for a, b in covered for i in range(a, b)]
        assert sorted(set(told)) == sorted(inside) and len(told) == len(inside)


def test_op4_long_conversations_are_encoded_once(spark):
    from tokenizers import Tokenizer

    text = "a turn of words, 漢字 and \U0001f600 signs <#\\> " * 200
    rows = [(1, i, "assistant" if i % 2 else "user", f"{i} {text}") for i in range(40)]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()[0]
    assert len(out.formatted) > 1 << 18
    t = Tokenizer.from_file(chat.default_tokenizer())
    t.encode_special_tokens = True
    assert out.token_ids == t.encode(out.formatted, add_special_tokens=False).ids
    loss = chat.unescape("".join(out.formatted[s.start : s.end] for s in out.loss_spans))
    assert loss == "".join(x[3] for x in rows if x[2] == "assistant")


@pytest.mark.parametrize("kind", ["one hot group", "few", "even", "empty"])
def test_op5_capacity_of_the_groups_themselves(spark, monkeypatch, kind):
    import hashlib

    monkeypatch.setattr(sharding, "RANGE_BITS", 5)  # ranges of many groups
    monkeypatch.setattr(sharding, "LANE", 16)
    r = random.Random(len(kind))
    texts = {"one hot group": ["hot " * 40] * 150 + [f"t{i}" * r.randrange(1, 30) for i in range(300)], "few": ["a", "bb", None], "even": [f"text {i}" * r.randrange(1, 20) for i in range(900)], "empty": []}[kind]
    out = sharding.shard_documents(docs(spark, texts)).toPandas()
    sizes = {}
    for t in texts:
        b = (t or "").encode()
        place = hashlib.md5(b).hexdigest()[:15]
        sizes[place] = sizes.get(place, 0) + len(b) + 1
    best = sharding.smallest_capacity([sizes[p] for p in sorted(sizes)], sharding.SHARDS)
    assert len(out) == len(texts) and (out.groupby("shard")["size"].sum().max() if texts else 0) == best
    for _, rows in out.groupby("shard"):
        assert sorted(rows.slot) == list(range(len(rows)))


@pytest.mark.parametrize("n", [15, 1000, 10_000])
def test_op8_ties_and_recall_at_all_sizes(spark, n):
    r = np.random.default_rng(n)
    x = r.integers(-2, 3, size=(n, 12)).astype(float)  # products are whole numbers: many exact ties
    x[:, 0] += 3
    out = ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).toPandas()
    hit = total = 0
    for q in range(0, n, 50):
        s = x @ x[q]
        best = [i for i in np.lexsort((np.arange(n), -s)).tolist() if i != q][:20]
        mine = out[out.query_id == q].sort_values("rank")
        found = mine.vec_id.tolist()
        assert len(found) == min(20, n - 1) and mine.score.tolist() == s[found].tolist()
        assert found == sorted(found, key=lambda i: (-s[i], i))
        if n <= ann.FEW:
            assert found == best
        hit, total = hit + len(set(best) & set(found)), total + len(best)
    assert hit >= 0.9 * total


def test_op8_blocks(spark, monkeypatch):
    r = np.random.default_rng(5)
    x = r.normal(size=(300, 8))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    whole = ann.nearest(table, F.col("vec_id") % 2 == 0).collect()
    monkeypatch.setattr(ann, "PART", 40)  # vectors and queries are dealt in several blocks
    assert sorted(ann.nearest(table, F.col("vec_id") % 2 == 0).collect()) == sorted(whole)


def test_op8_visits_are_the_likeliest_cells():
    r = np.random.default_rng(3)
    chance = r.random((3, 4)) ** 3
    chance /= chance.sum(axis=1, keepdims=True)
    joint = (chance[0][:, None, None] * chance[1][None, :, None] * chance[2]).ravel()
    order = np.argsort(-joint, kind="stable")
    n = int(np.searchsorted(np.cumsum(joint[order]), ann.SUCCESS)) + 1
    assert ann._visits(chance).tolist() == order[:n].tolist()


def test_op9_codewords_and_decoding(spark):
    for languages in (1, 2, 3, 4, 5, 9):
        code = langid.codewords(languages)
        assert len({tuple(c) for c in code}) == languages
        if 1 < languages <= 5:  # every split once
            assert len({tuple(b * b[0]) for b in code.T}) == code.shape[1] == 2 ** (languages - 1) - 1
    assert langid.bit_trust({0: (50, 100), 1: (99, 100)}, 2).tolist() == [0.0, 1.0]
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the house of the man", "en"), ("das haus und der mann", "de"), ("la maison et les hommes", "fr")] * 30)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(d)
    out = {x.doc_id: x for x in langid.identify(d, model).collect()}
    for i, text, lang in rows[:6]:
        counts, _ = langid._counts([text], langid.FEATURES)
        margin = np.clip(counts[0] @ model["weight"] / counts.sum() - model["bias"], -8, 8)
        loss = [sum(w * math.log1p(math.exp(-2 * m * c)) for m, c, w in zip(margin, code, model["trust"])) for code in model["code"]]
        best = int(np.argmin(loss))
        assert out[i].lang_pred == model["langs"][best] == lang
        assert out[i].score == pytest.approx(1 / sum(math.exp(-4 * (x - loss[best])) for x in loss))


def test_pipeline_stages_by_brute_force(spark):
    import corpus_pipeline as p

    where = "/root/testdata/sf0.01"
    d = spark.read.parquet(f"{where}/documents.parquet")
    model = toxicity.train(d, spark.read.parquet(f"{where}/labels.parquet"))
    clean = {x.doc_id for x in toxicity.score(d, model).collect() if not x.toxic}
    assert {x.doc_id for x in p.drop_toxic(spark, d, where).collect()} == clean
    mixed = p.mix_sources(spark, d, where)
    plan = mixing.plan_mix({x.source: x.t for x in d.groupBy("source").agg(F.sum(mixing.token_count(F.col("text"))).alias("t")).collect()})
    times = {x.doc_id: x["count"] for x in mixed.groupBy("doc_id").count().collect()}
    for x in d.select("doc_id", "source").collect():
        assert math.floor(plan.repetition[x.source] + 1e-9) <= times[x.doc_id] <= math.ceil(plan.repetition[x.source] - 1e-9)
    placed = p.assign_shards(spark, mixed, where).toPandas()
    assert sorted(placed.doc_id) == sorted(i for i, n in times.items() for _ in range(n)) and placed["shard"].nunique() == sharding.SHARDS
