"""Decontamination against a plain recomputation of windows, alignments and slots."""

import random

import pytest
import regex

from isobar.llm import decontam

from test_llm import ODD

W, LITERALS, MATCHED = decontam.WINDOW, decontam.LITERALS, decontam.MATCHED


def words(text):
    t = regex.sub(r"([0-9])[.,:](?=[0-9])", r"\1_", text or "")
    t = regex.sub(r"(?=\p{Lu})(?<=[\p{Ll},;] )(\p{Lu}\p{Ll}+)", r"_\1", t)
    return [w for w in regex.split(r"[^\p{L}\p{N}_]+", t) if w]


def template(ws):
    return ["#" if "0" <= w <= "9~" else "@" if w.startswith("_") else "%" if w.lower() in decontam.UNITS else "w" + w.lower() for w in ws]


def value(w):
    return w.lower().lstrip("_")


def plain(docs, items):
    """{(doc, item): (matched, windows, kind)} of {doc: text} and {item: text}."""
    out = {}
    told = {i: (words(t), template(words(t))) for i, t in items.items()}
    good = {i: {a: tuple(h[a : a + W]) for a in range(len(h) - W + 1) if sum(x[0] == "w" for x in h[a : a + W]) >= LITERALS} for i, (_, h) in told.items()}
    for d, text in docs.items():
        dw = words(text)
        dh = template(dw)
        mine = {}
        for p in range(len(dh) - W + 1):
            mine.setdefault(tuple(dh[p : p + W]), set()).add(p)
            if dh[p] == "@":
                mine.setdefault(("w" + value(dw[p]), *dh[p + 1 : p + W]), set()).add(p)
        for i, (iw, ih) in told.items():
            found = []
            if not good[i] and iw:
                have, want = [value(w) for w in dw], [value(w) for w in iw]
                found = [(-1, "exact", 0, 1)] if any(have[p : p + len(want)] == want for p in range(len(have) - len(want) + 1)) else []
            shifts = {}
            for a, w in good[i].items():
                for p in mine.get(w, ()):
                    shifts.setdefault(p - a, set()).add(a)
            least = min(MATCHED, len(good[i]))
            for shift, ats in shifts.items():
                if len(ats) < least:
                    continue
                pair = lambda p: (iw[p].lower(), dw[p + shift].lower())  # noqa: E731, B023
                slots = lambda a: [p for p in range(a, a + W) if ih[p][0] != "w"]  # noqa: E731, B023
                own = {a for a in ats if all(len(set(pair(p))) == 1 for p in slots(a))}
                pairs = {pair(p) for a in ats - own for p in slots(a)}
                if len(pairs) == len({x for x, _ in pairs}):
                    kind = "exact" if all(x == y for x, y in pairs) else "reparameterised"
                    found.append((-len(ats), kind, shift, len(good[i])))
                elif len(own) >= least:
                    found.append((-len(own), "exact", shift, len(good[i])))
            if found:
                matched, kind, _, n = min(found)
                out[d, i] = (-matched, n, kind)
    return out


def told(spark, docs, items):
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    return {(r.doc_id, r.item_id): (r.matched, r.windows, r.kind) for r in decontam.contaminated(d, b, partial=True).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_op7_by_brute_force_on_few_words(spark, seed):
    r = random.Random(seed)
    bits = ["the", "a", "old", "farmer", "sells", "buys", "and", "then", "for", "Bella", "Otto", "Ivan", "12", "3.50", "99", "km", "euros", ",", ".", "how", "many"]
    say = lambda n: " ".join(r.choice(bits) for _ in range(n))
    items = {k: say(r.choice([0, 1, 3, 7, 8, 9, 14, 30])) for k in range(40)} | {90: None, 91: "", 92: "Which old farmer sells the old barn and then buys a mill"}
    items[93] = "if the farmer Bella sells 12 baskets for 3.50 euros each and then Bella buys 4 more crates how much money remains"
    docs = dict(enumerate(ODD))
    for k in range(300, 330):  # other values, some of them not one for one
        names, numbers = r.choices(["Bella", "Ivan", "Otto"], k=2), r.choices(["12", "99", "7"], k=3)
        told_again = items[93].replace("farmer Bella", f"farmer {names[0]}").replace("then Bella", f"then {names[1]}")
        docs[k] = say(3) + " " + told_again.replace("12", numbers[0]).replace("3.50", numbers[1]).replace(" 4 ", f" {numbers[2]} ")
    for k in range(10, 130):
        parts = []
        for _ in range(r.randrange(1, 4)):
            own = (items[r.choice(list(items))] or "").split()
            for i in range(len(own)):
                if r.random() < 0.1:
                    own[i] = r.choice(bits)
            parts += [say(r.randrange(0, 9)), " ".join(own)]
        docs[k] = " ".join(parts)
    docs[200] = "the farmer sells " * 60_000 + (items[92] or "")  # above a megabyte
    want = plain(docs, items)
    assert told(spark, docs, items) == want
    assert {v[2] for v in want.values()} == {"exact", "reparameterised"} and len(want) > 60


def test_op7_by_brute_force_on_given_tables(spark):
    where = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "text").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{where}/benchmark.parquet").collect()}
    want = plain(docs, items)
    assert told(spark, docs, items) == want and want
