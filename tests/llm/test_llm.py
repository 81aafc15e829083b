"""The ten operators against brute force, round trips and held-out accuracy."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from isobar.llm import ann, chat, decontam, langid, lines, mixing, near_dup, pii, sharding, toxicity
from isobar.llm.text import shingle_sets

DIR = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t ", "one two", "A a A a A a", "x" * 30_000, "äß 漢字 \U0001f600 " * 50]


@pytest.fixture(scope="module", autouse=True)
def _sweep(spark):
    yield
    from isobar.llm.storage import sweep

    sweep(spark)


def docs(spark, texts, first=0):
    rows = [(first + i, t, "en", f"s{i % 3}", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_lines int")


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0d]+", low)


def shingles(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(texts):
    sets = [shingles(t) for t in texts]
    at = list(range(len(texts)))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                at[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def test_shingle_sets():
    for text, h in zip(ODD, shingle_sets(ODD), strict=True):
        assert len(h) == len(shingles(text))


def test_op1_chains_copies_and_shared_passages(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    base, passage = [word() for _ in range(120)], " ".join(word() for _ in range(60))
    texts = list(ODD) + [" ".join(base)] * 30
    for _ in range(60):  # near copies of several degrees, chains included
        w = list(base)
        for _ in range(r.randrange(1, 7)):
            w[r.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts += [passage + " " + " ".join(word() for _ in range(50)) for _ in range(40)]
    r.shuffle(texts)
    want, sizes = brute_components(texts)
    got = {x.doc_id: x for x in near_dup.near_duplicates(docs(spark, texts).repartition(3)).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    kept = near_dup.keep_one(docs(spark, texts))
    assert sorted(x.doc_id for x in kept.collect()) == sorted({c for c in want})
    assert near_dup.near_duplicates(docs(spark, [])).count() == 0


def test_op2_plan_and_budget(spark):
    tokens = {"a": 1000, "b": 100, "c": 10, "empty": 0}
    m = mixing.plan_mix(tokens, max_repetition=2.0)
    assert max(m.repetition.values()) <= 2 + 1e-9 and min(m.repetition[s] for s in "abc") == pytest.approx(1)
    e = mixing.plan_mix(tokens, target_entropy=0.8, budget=500)
    assert mixing.entropy(e.weight) == pytest.approx(0.8, abs=1e-6) and sum(e.quota.values()) == pytest.approx(500)
    d = spark.read.parquet(f"{DIR}/documents.parquet").unionByName(docs(spark, ODD, 10_000).select("doc_id", "text", "lang", "source", F.lit(0).cast("long").alias("n_chars")))
    out = mixing.mixture(d).toPandas()
    count = {r.doc_id: len(words_of(r.text)) for r in d.collect()}
    src = {r.doc_id: r.source for r in d.collect()}
    assert set(out.doc_id) == set(count)  # nothing is lost
    plan = mixing.plan_mix({s: sum(n for i, n in count.items() if src[i] == s) for s in set(src.values())})
    for s, rows in out.groupby("source"):
        quota = plan.quota[s]
        assert quota - max(count[i] for i in rows.doc_id) <= rows.tokens.sum() <= quota + 1
        assert not rows.duplicated(["doc_id", "epoch"]).any()
    mixed = mixing.mix_documents(d)
    assert mixed.columns == d.columns and mixed.count() == len(out)
    assert mixing.mixture(docs(spark, [])).count() == 0


def test_op2_partial_epochs_in_token_order(spark):
    texts = [" ".join(["w"] * (1 + i % 7)) for i in range(3000)] + [None, ""]
    d = docs(spark, texts).withColumn("source", F.when(F.col("doc_id") % 50 == 0, "rare").otherwise("big"))
    tokens = {s: sum(len(words_of(t)) for i, t in enumerate(texts) if (i % 50 == 0) == (s == "rare")) for s in ("rare", "big")}
    plan = mixing.plan_mix(tokens, target_entropy=0.4, budget=7777)
    order = d.select("doc_id", "source", "text", F.xxhash64(F.lit(mixing.SEED), "doc_id", "text").alias("h")).collect()
    want = []
    for s in tokens:
        rows = sorted((r for r in order if r.source == s), key=lambda r: r.h % 2**64)
        whole, room = int(plan.repetition[s]), round(plan.repetition[s] % 1 * tokens[s])
        for r in rows:
            room -= len(words_of(r.text))
            want += [r.doc_id] * (whole + (room >= 0))
    got = [r.doc_id for r in mixing.mix_documents(d, target_entropy=0.4, budget=7777).collect()]
    assert sorted(got) == sorted(want)


def test_stages_keep_columns_of_clashing_names(spark):
    d = docs(spark, [f"some words of text number {i} and {i * i} more" for i in range(20)])
    names = ["_source", "_h", "_range", "_times", "_bad", "_kept", "component_id", "t", "n", "_doc_id", "_drop", "_lines", "_row", "h1"]
    d = d.select("*", *(F.concat(F.lit(name), F.col("doc_id").cast("string")).alias(name) for name in names))
    bench = spark.createDataFrame([(1, "a question that is in none of these texts at all")], "item_id long, text string")
    deduped = lines.dedup_lines(d)
    assert deduped.columns == [*d.columns, "n_dropped"]  # n_lines is one of the table's
    model = toxicity.train(d, spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int"))
    for out in (mixing.mix_documents(d), decontam.keep_uncontaminated(d, bench), near_dup.keep_one(d), toxicity.keep_clean(d, model), deduped.drop("n_dropped")):
        assert out.columns == d.columns
        rows = out.collect()
        assert {r.doc_id for r in rows} == set(range(20)) and all(r[name] == f"{name}{r.doc_id}" for r in rows for name in names)


def test_operators_take_nulls_repeats_and_empty_tables(spark):
    texts = ["one two three four five six", "one two three four five six", None, "", "a\nb", "hello world this is a line\n" * 3]
    rows = [(i, t, ("en", None)[i % 2], ("a", "b", None)[i % 3]) for i, t in enumerate(texts)] + [(None, "text of a null id", "en", "a"), (None, None, None, None), (0, texts[0], "en", "a")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(0, 0, 1), (0, 0, 1), (1, 1, 0), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(None, "x"), (2, None)], "item_id long, text string")
    for t, n in ((d, 9), (d.where("false"), 0)):
        per_row = (
            near_dup.near_duplicates(t),
            toxicity.score(t, toxicity.train(t, labels)),
            toxicity.keep_clean(t, toxicity.train(t, labels.where("false"))),
            sharding.shard_documents(t),
            lines.dedup_lines(t),
            decontam.keep_uncontaminated(t, bench),
            langid.identify(t, langid.train(t)),
            pii.digest(pii.personal_data(t)),
        )
        assert [out.count() for out in per_row] == [n] * len(per_row)
        assert near_dup.keep_one(t).count() == (7 if n else 0)  # 0 once, not 1; null ids stay
        drawn = mixing.mixture(t).select("doc_id").distinct().count()
        assert drawn == (7 if n else 0) and mixing.mix_documents(t).count() >= n
        assert decontam.contaminated(t, bench).count() == 0
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", None), (None, 0, "user", "x"), (2, None, None, None), (1, 0, "user", "hi")], "conv_id long, turn long, role string, text string")
    assert {r.conv_id: r.n_turns for r in chat.digest(chat.format_conversations(turns)).collect()} == {1: 3, None: 1, 2: 1}
    assert [r.conv_id for r in chat.digest(chat.format_conversations(chat.with_probe(spark, turns.where("false")))).collect()] == [-7]
    vectors = spark.createDataFrame([(0, [1.0, 2.0]), (0, [1.0, 2.0]), (20, [None, 1.0]), (40, []), (None, [1.0, 1.0]), (1, [0.5, 0.5]), (60, [1.0, 2.0, 3.0]), (3, None)], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in ann.nearest(vectors, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 1.5)]
    assert ann.nearest(vectors.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_op3_held_out(spark):
    d, l = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    test = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(4)) == 0
    model = toxicity.train(d, l.where(~test))
    flagged = toxicity.score(d, model).select("doc_id", F.col("toxic").alias("flag")).join(l.where(test), "doc_id").toPandas()
    clean = flagged[flagged.toxic == 0]
    assert clean.flag.mean() < 0.02  # labels of this table hold some noise
    assert flagged[flagged.toxic == 1].flag.mean() > 0.5
    odd = docs(spark, ODD)
    assert toxicity.score(odd, model).count() == len(ODD)
    kept = toxicity.keep_clean(odd, model)
    assert kept.columns == odd.columns and kept.count() == len(ODD)
    none = toxicity.train(odd, l.where("false"))
    assert not toxicity.score(odd, none).where("toxic").count()


def test_op3_keeps_all_evidence(spark):
    word = lambda i: "xyz"[i // 676] + chr(97 + i // 26 % 26) + chr(97 + i % 26)
    rude = [word(i) for i in range(700)]  # too short for stems: one feature each
    d = docs(spark, [" ".join(rude)] * 3 + [f"calm words of text {i}" for i in range(60)] + [w for w in rude])
    labels = spark.createDataFrame([(i, 1, int(i < 3)) for i in range(63)], "doc_id long, quality int, toxic int")
    assert set(toxicity.train(d, labels)["words"]) == {w + "$" for w in rude}


def test_op3_cumulative_link_recovers_an_order():
    r = np.random.default_rng(0)
    x = r.integers(0, 5, 600)
    grade = np.clip((x + r.normal(0, 0.5, 600)) // 2, 0, 2).astype(np.int64)
    w, theta = toxicity.fit_cumulative_link(np.arange(600), np.zeros(600, np.int64), x.astype(float), grade, 1)
    assert w[0] > 0.5 and theta[0] < theta[1]


def test_op4_round_trip(spark):
    nasty = ["\\### Assistant: </turn> ok", "### User: hi </turn>\n", "\\\\<#", "", None, "a\n\nb  ", "漢字 \U0001f600é"]
    rows = [(c, t, role, text) for c in range(4) for t, (role, text) in enumerate((r.choice(["user", "assistant", None, "a:b\n#"]), r.choice(nasty)) for r in [random.Random(c)] for _ in range(9))]
    rows += rows[:2]  # repeated rows
    df = chat.with_probe(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = {r.conv_id: r for r in chat.digest(chat.format_conversations(df)).collect()}
    by = {}
    for r in df.collect():
        by.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    assert out.keys() == by.keys()
    for c, turns in by.items():
        turns.sort()
        told = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        assert (out[c].n_turns, out[c].turns_sha256) == (len(turns), hashlib.sha256(told.encode()).hexdigest())
        assert (out[c].loss_chars, out[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def brute_capacity(sizes, shards):
    c = max(sizes, default=0)
    while True:
        n, run = 1, 0
        for s in sizes:
            if run + s > c:
                n, run = n + 1, 0
            run += s
        if n <= shards:
            return c
        c += 1


def test_op5_minimax_and_slots(spark):
    r = random.Random(2)
    for _ in range(60):
        sizes = [r.randrange(0, 12) for _ in range(r.randrange(1, 30))]
        shards = r.randrange(1, 6)
        c = sharding.smallest_capacity(sizes, shards)
        assert c == brute_capacity(sizes, shards)
        cuts = [0, *sharding.cut_points(sizes, shards), len(sizes)]
        assert cuts == sorted(cuts) and all(sum(sizes[a:b]) <= c for a, b in zip(cuts, cuts[1:]))
    d = docs(spark, ODD + ["copy"] * 40 + [f"text {i}" for i in range(200)])
    out = sharding.shard_documents(d).toPandas()
    assert len(out) == d.count() and set(out["shard"]) <= set(range(16))
    for _, rows in out.groupby("shard"):
        assert sorted(rows.slot) == list(range(len(rows)))
    text = {x.doc_id: x.text or "" for x in d.collect()}
    assert all(text[i] is not None and len(text[i].encode()) + 1 == s and zlib.crc32(text[i].encode()) == c for i, s, c in zip(out.doc_id, out["size"], out.text_crc32))
    assert out[out.doc_id.map(text) == "copy"]["shard"].nunique() == 1
    assert sharding.shard_documents(docs(spark, [])).count() == 0


def test_op6_brute_force(spark):
    long, other = "this line is long enough to count", "another line that is long enough"
    texts = [f"a\n{long}\nb", f" {long.upper()}\t\n{long}", f"{other}\n{other}\n{long}", other, "short\nshort", None, "", "\n\n", f"{long}\r", "x" * 50_000]
    out = {r.doc_id: r for r in lines.dedup_lines(docs(spark, texts), batches=3).collect()}
    key = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\f\r"))
    where = {}
    for i, t in enumerate(texts):
        for s in (t or "").split("\n"):
            where.setdefault(key(s), set()).add(i)
    for i, t in enumerate(texts):
        all_lines = (t or "").split("\n")
        kept = [s for s in all_lines if not (len(key(s)) >= 20 and len(where[key(s)]) >= 3 and i != max(where[key(s)]))]
        assert (out[i].n_lines, out[i].n_dropped, out[i].text) == (len(all_lines), len(all_lines) - len(kept), "\n".join(kept))
    index = lines.LineIndex(spark)
    for i, t in enumerate(texts[:3]):
        fresh = index.add(docs(spark, [t], i).select("doc_id", "text")).where("fresh").count()
        assert fresh == (1, 0, 1)[i]
    assert [len(x) for x in index.levels] == [1, 1]
    assert lines.dedup_lines(docs(spark, [])).count() == 0


def test_op7_copies_and_new_parameters(spark):
    ask = "if the farmer Bella sells 12 baskets for 3.50 euros each and then Bella buys 4 more crates how much money remains"
    bench = spark.createDataFrame([(1, ask), (2, "too short"), (3, None), (1, ask)], "item_id long, text string")
    again = ask.replace("Bella", "Ivan").replace("12", "99").replace("3.50", "8")
    broken = ask.replace("farmer Bella", "farmer Ivan").replace("12", "99")
    texts = [f"before. {ask} after", f"x {again} y", broken, "nothing to see here at all my friend of mine", None, "", "1 2 3 4 5 6 7 8 9 10 11 12"]
    got = {(r.doc_id, r.item_id): r.kind for r in decontam.contaminated(docs(spark, texts), bench).collect()}
    assert got == {(0, 1): "exact", (1, 1): "reparameterised"}
    assert {r.doc_id for r in decontam.keep_uncontaminated(docs(spark, texts), bench).collect()} == {2, 3, 4, 5, 6}
    assert decontam.contaminated(docs(spark, []), bench).count() == 0


def test_op7_verbatim_part_beside_changed_values(spark, tmp_path):
    import corpus_pipeline
    from isobar.llm import queries

    ask = "if the farmer Bella sells 12 baskets for 3.50 euros each and then Bella buys 4 more crates how much money remains"
    part = ask.replace("farmer Bella", "farmer Ivan").replace("12", "99")  # 16 verbatim words at the end
    mixed = part.replace("sells 99 baskets for 3.50", "sells 99 baskets for 99").replace("12", "99")
    twice = "now the farmer Bella sees Bella near the old mill and then they both walk home in silence"
    bad = twice.replace("farmer Bella sees Bella", "farmer Ivan sees Otto")
    spark.createDataFrame([(1, ask), (2, twice)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs(spark, [part, f"x {mixed} y", bad, "now the farmer Ivan sees Otto near the old barn", ask]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.item_id): (r.kind, r.matched) for r in queries.op7_decontamination(spark, str(tmp_path)).collect()}
    assert {k: v[0] for k, v in got.items()} == {(0, 1): "reparameterised", (1, 1): "exact", (2, 2): "exact", (4, 1): "exact"}
    assert all(n >= decontam.MATCHED for _, n in got.values())
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [r.doc_id for r in corpus_pipeline.drop_contaminated(spark, d, str(tmp_path)).collect()] == [3]


def test_op7_short_dense_and_embedded_items(spark):
    items = {
        1: "What is the capital of France?",
        2: "Add 12 and 13.5, then 7 and Anna, Bob and 3 km, 4 kg and 15",  # no window of 5 literals
        3: "Which old river runs through the green valley",  # one window; its first word is capitalised
        4: "Why",
        5: "Which two rivers run through the same wide valley of that land",
        6: "the price is 12 euros",
    }
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    assert {r.item_id for r in decontam.benchmark_windows(bench)[1].collect()} == {3, 5}
    found = {
        0: (f"He asked: {items[1]} Nobody knew.", {1}),
        1: ("they ask what is the capital of france today", {1}),
        2: ("they ask What is the capital of Spain", set()),
        3: (f"now {items[2]} or more", {2}),
        4: (f"now {items[2].replace('3 km', '5 km')}", set()),
        5: (f"they ask {items[3]} here", {3}),
        6: ("they ask Where old river runs through the green valley", set()),
        7: (f"they ask, {items[5]}", {5}),
        8: ("and why not", {4}),
        9: ("the price is 13 euros", set()),
        10: ("so the Price is 12 euros", {6}),
        11: (items[1], {1}),
    }
    got = decontam.contaminated(docs(spark, [t for t, _ in found.values()]), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == sorted((d, i) for d, (_, want) in found.items() for i in want)
    assert {r.kind for r in got} == {"exact"} and all(r.matched == r.windows for r in got)


def test_op8_recall_and_ties(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(600, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[100:160] = x[100]  # a hot vector
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(1000, None, 0), (1020, [0.0] * 24, 0), (1040, [float("nan")] * 24, 0), (1060, [None] * 24, 0)]
    out = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int"), F.col("vec_id") % 20 == 0).toPandas()
    hit = 0
    for q in range(0, 600, 20):
        s = x @ x[q]
        s[q] = -np.inf
        best = set(np.lexsort((np.arange(600), -np.round(s, 12)))[:20].tolist())
        mine = out[out.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and mine.score.is_monotonic_decreasing
        hit += len(best & set(mine.vec_id))
    assert hit / 600 >= 0.9 and set(out.query_id) == set(range(0, 600, 20))
    assert out[out.query_id == 100].vec_id.tolist()[:20] == list(range(101, 121))


@pytest.mark.parametrize("few", [ann.FEW, 0])
def test_op8_all_candidates_where_they_are_few(spark, monkeypatch, few):
    monkeypatch.setattr(ann, "FEW", few)  # 0: hashed first, short results filled up
    r = np.random.default_rng(3)
    unit = lambda n, d: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(r.normal(size=(n, d)))
    groups = {64: unit(20, 64), 24: unit(15, 24), 8: unit(300, 8)}  # the last is the ordinary length
    rows, at = [], {}
    for d, x in groups.items():
        at[d] = len(rows)
        rows += [(at[d] + i, v.tolist()) for i, v in enumerate(x)]
    out = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") < 40).toPandas()
    for d, x in groups.items():
        for q in range(at[d], min(at[d] + len(x), 40)):
            s = x @ x[q - at[d]]
            s[q - at[d]] = -np.inf
            mine = out[out.query_id == q].sort_values("rank")
            assert len(mine) == min(20, len(x) - 1)
            if d != 8:
                assert mine.vec_id.tolist() == (np.argsort(-s)[: len(x) - 1] + at[d]).tolist()


def test_op9_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(d.where(~langid.held_out()))
    out = langid.identify(d, model).join(d.where(langid.held_out()).select("doc_id", "lang"), "doc_id").toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.97 and out.score.between(0, 1).all()
    odd = [r.lang_pred for r in langid.identify(docs(spark, [None, "", "123 !?"]), model).collect()]
    assert odd == ["und"] * 3
    assert langid.identify(docs(spark, ODD), langid.train(d.where("false"))).where("lang_pred = 'und'").count() == len(ODD)


def test_op10_brute_force(spark):
    luhn = "4111 1111 1111 1111"
    texts = ["mail a.b@c.de@f.gh x@y", f"card {luhn} or 4111111111111112", "1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.1", "+49 (0) 171 1234567. +1 2", "IBAN GB82 WEST 1234 5698 7654 32!", "9" * 50_000, "a" * 50_000 + "@", *ODD]
    out = {r.doc_id: r for r in pii.digest(pii.personal_data(docs(spark, texts))).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        o = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)] if len(t) < 10_000 else []
        o += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(v) <= 255 for v in m[0].split("."))] if len(t) < 10_000 else []
        o += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(z := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(z)]
        o += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in o)
        assert out[i].base_sha256 == hashlib.sha256(told.encode()).hexdigest() and out[i].spans.startswith(told)
    assert "iban" in out[4].spans
    assert pii.redact("to a@b.co now") == "to [email] now"


def test_op10_iban_before_other_text(spark):
    de, gb, other = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "ZZ59 1234 5678 9012 3456"
    assert pii.mod97(other)
    texts = {
        f"IBAN {de} BIC COBADEFFXXX": [de],
        "DE89370400440532013000 10 euros": ["DE89370400440532013000"],
        f"{gb} A": [gb],
        f"{de} {gb} 12": [de, gb],
        f"AB12 {de} X": [de],
        f"{other} EUR 10": [other],
        f"{de[:-1]}1 BIC": [],
        f"{de}1": [],
    }
    out = {r.doc_id: r.spans for r in pii.personal_data(docs(spark, list(texts))).collect()}
    for i, (text, want) in enumerate(texts.items()):
        assert [text[x.start : x.end] for x in out[i] if x.kind == "iban"] == want
    assert pii.redact(f"to {de} BIC COBADEFFXXX") == "to [iban] BIC COBADEFFXXX"


def test_pipeline_small(spark):
    import corpus_pipeline

    d = spark.read.parquet(f"{DIR}/documents.parquet")
    text = {r.doc_id: r.text for r in d.collect()}
    ids = sorted(text)
    want, _ = brute_components([text[i] for i in ids])
    out = corpus_pipeline.run(spark, DIR).toPandas()
    comp = dict(zip(ids, (ids[c] for c in want)))
    kept = set(out.doc_id)
    assert kept and len({comp[i] for i in kept}) == len(kept)  # one of each group
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    bench = decontam.contaminated(d, spark.read.parquet(f"{DIR}/benchmark.parquet"))
    assert not kept & {r.doc_id for r in bench.collect()}
