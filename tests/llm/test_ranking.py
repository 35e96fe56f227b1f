"""Lexical search, language identification and source divergence against brute force and on odd input."""

import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from loopgrade.llm import common, divergence, language_id, lexical_search

DOCS = "doc_id long, text string, lang string, source string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def words(rng, n, top=400):
    return " ".join(f"W{int(top * rng.random() ** 2)}é" if rng.random() < 0.5 else f"x{int(top * rng.random() ** 3)}" for _ in range(n))


ODD = [(1, None, None, None), (2, "", "en", ""), (3, "İß \x85 99 ---", "en", "s"), (None, "alpha beta alpha", "en", "s"), (4, "alpha beta", "de", "s"), (4, "alpha beta", "de", "s"), (5, "alpha " * 30_000, "de", None), (6, "1234 !!", "de", "t")]


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ODD).withColumn("norm", F.lit("x")).withColumn("item", F.lit(1)).withColumn("score", F.lit(2)).withColumn("a.b", F.lit(2))


# ---- 11 ----
def ranked(rows, items, k=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    found = [(i, split(t)) for i, t in rows]
    found = [(i, t) for i, t in found if t]
    n_all, length = len(found), sum(len(t) for _, t in found)
    df = Counter(w for _, t in found for w in set(t))
    out = set()
    for item, text in {(a, b or "") for a, b in items}:
        scores = []
        for doc, (i, t) in enumerate(found):
            tf, m = Counter(t), 10 + 90 * len(t) * n_all // length
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[w] + 1))) * (1_000_000_000 * tf[w] // (1000 * tf[w] + 8 * m)) for w in set(split(text)) if tf[w])
            if score > 0:
                scores.append((-score, i is None, i or 0, doc))
        out |= {(item, rank, None if none else i, -s) for rank, (s, none, i, _) in enumerate(sorted(scores)[:k], 1)}
    return out


@pytest.mark.parametrize("bucket", [7, 1024])
def test_lexical_search(spark, monkeypatch, bucket):
    monkeypatch.setattr(lexical_search, "BUCKET", bucket)
    rng = random.Random(3)
    rows = [(i, words(rng, rng.randint(1, 120))) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(40)] + [(7, rows[7][1]), (7, rows[7][1])]  # ties beyond the ten, repeated rows
    items = [(i, words(rng, rng.randint(1, 25))) for i in range(12)] + [(50, rows[5][1]), (51, "unknown"), (52, None), (50, rows[5][1]), (7, rows[7][1])]
    got = lexical_search.search(docs(spark, [(i, t, "en", "s") for i, t in rows]).repartition(5), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()) == sorted(ranked(rows, items))


def test_items_in_blocks_and_odd_input(spark, odd, monkeypatch):
    monkeypatch.setattr(lexical_search, "ITEMS", 2)
    items = [(1, "alpha"), (2, "BETA gamma"), (3, "99"), (None, "alpha beta"), (5, None)]
    df = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(3))
    got = [tuple(r) for r in lexical_search.search(odd, df).select("item_id", "rank", "doc_id", "score").collect()]
    assert set(got) == ranked([(i, t) for i, t, *_ in ODD], items) and len(got) == len(set(got))
    assert lexical_search.search(odd.limit(0), df).count() == 0 and lexical_search.search(odd, df.limit(0)).count() == 0


def test_bounds_prune_and_lose_nothing():
    rng = np.random.default_rng(5)
    asked = lexical_search.Asked(list(range(20)), [rng.choice(300, 12, replace=False) for _ in range(20)], {})
    asked.weigh(rng.integers(1, 400, 300), 500, 50_000)
    rows = [np.sort(rng.choice(300, rng.integers(1, 60), replace=False)) for _ in range(400)]
    impact = [asked.weight[t] * rng.integers(1, 50_000, len(t)) // 10 ** int(rng.integers(0, 3)) for t in rows]  # of lengths that differ by much
    order = sorted(range(400), key=lambda r: -float((impact[r].astype(float) ** 2).sum()))
    score = np.array([[impact[r][np.isin(rows[r], t)].sum() for r in order] for t in asked.terms])
    least = np.sort(score, axis=1)[:, -10]
    seen, found = Counter(), [set() for _ in range(20)]
    for lo in range(0, 400, 50):
        part = order[lo : lo + 50]
        ptr = np.append(0, np.cumsum([len(rows[r]) for r in part]))
        item, row, s = lexical_search.search_bucket(asked, least, ptr, np.concatenate([rows[r] for r in part]), np.concatenate([impact[r] for r in part]), seen)
        for i, r, x in zip(item, row, s, strict=True):
            found[i].add((lo + r, x))
    assert [set(zip(np.flatnonzero(score[i] >= least[i]), score[i][score[i] >= least[i]], strict=True)) for i in range(20)] == found
    assert seen["bucket"] > 0 and seen["coordinate"] > 0 and seen["scored"] < 0.6 * 8000


# ---- 12 ----
def speech(rng, lang, n):
    parts = {"en": ["th", "ing", "er", "and", "ou"], "de": ["sch", "ein", "ung", "ü", "ch"], "fr": ["eau", "é", "qu", "oi", "ent"]}[lang]
    return " ".join("".join(rng.choice(parts + list("aeio")) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def spoken():
    rng = random.Random(1)
    return [(i, speech(rng, lang := ("en", "de", "fr")[i % 3], rng.randint(3, 120)), lang, f"s{i % 2}") for i in range(600)]


def test_language_of_held_out_texts(spark, spoken):
    table = docs(spark, spoken)
    model = language_id.train(table, rows=300)
    got = {r.doc_id: r for r in language_id.predict(table, model).collect()}
    held = [i for i, *_ in spoken if crc32(str(i).encode()) % 3 == 1]
    assert {i for i, r in got.items() if r.held_out} == set(held)
    right = [got[i].lang_pred == lang for i, _, lang, _ in spoken if got[i].held_out]
    assert sum(right) >= 0.95 * len(right) and all(0 <= r.score <= 1 for r in got.values())
    passed = [got[i].lang_pred == lang for i, _, lang, _ in spoken if got[i].held_out and got[i].accepted]
    assert sum(passed) >= 0.97 * len(passed) > 0


def test_labels_of_held_out_rows_are_not_read(spark, spoken):
    liars = [(i, t, "xx" if crc32(str(i).encode()) % 3 == 1 else lang, s) for i, t, lang, s in spoken] + [(None, "alpha", "yy", "s"), (10_000, "alpha", None, "s")]
    assert language_id.train(docs(spark, liars), rows=300).languages == ["de", "en", "fr"]


def test_odd_languages(spark, odd, spoken):
    model = language_id.train(docs(spark, spoken), rows=100)
    rows = language_id.predict(odd, model)
    assert rows.columns == ["doc_id", "held_out", "lang_pred", "score", "accepted"]
    got = [(r.doc_id, r.lang_pred, r.score > 0, r.held_out) for r in rows.collect()]
    assert len(got) == len(ODD) and {i for i, p, *_ in got if p == "und"} == {1, 2, 6} and all(s == (p != "und") for _, p, s, _ in got)
    assert [h for i, *_, h in got if i is None] == [True]
    assert {r.lang_pred for r in language_id.predict(odd, None).collect()} == {"und"}
    assert language_id.train(odd.limit(0)) is None and language_id.predict(odd.limit(0), model).count() == 0


def test_subwords_do_not_depend_on_blocks(monkeypatch):
    text = speech(random.Random(2), "de", 400).encode().split()
    whole = language_id.bag(text)
    monkeypatch.setattr(language_id, "BLOCK", 37)
    assert (language_id.bag(text) == whole).all() and whole.sum() > 2000
    assert b" ".join(w for p in language_id.pieces(b" ".join(text)) for w in p) == b" ".join(text)


def test_descent_follows_the_gradient():
    """One step on one batch is the gradient of the mean log loss, by differences."""
    texts, langs = [b"the thing and", b"schein und auch", b"eau qui sont"], ["en", "de", "fr"]
    old, new = (language_id.fit(texts, langs, epochs=1, rate=r, batch=8) for r in (0.0, 1e-3))
    x = language_id._matrix([np.concatenate(list(language_id.subwords(t.split()))).astype(int) for t in texts]).astype(float)

    def loss(embed, out):
        p = language_id.softmax(x @ embed @ out + old.bias)
        return -np.log(p[[0, 1, 2], [old.languages.index(lang) for lang in langs]]).mean()

    for part, scale in (("embed", 1.0), ("out", 0.02)):
        a = getattr(old, part).astype(float)
        step = (a - getattr(new, part)) / (1e-3 * scale)
        at = np.unravel_index(np.abs(step).argmax(), a.shape)
        up, down = a.copy(), a.copy()
        up[at] += 1e-5
        down[at] -= 1e-5
        pair = [(up, old.out.astype(float)), (down, old.out.astype(float))] if part == "embed" else [(old.embed.astype(float), up), (old.embed.astype(float), down)]
        assert (loss(*pair[0]) - loss(*pair[1])) / 2e-5 == pytest.approx(step[at], rel=0.05)


def test_rejection_is_calibrated():
    rng = np.random.default_rng(1)
    model = language_id.Model(["a", "b"], *[np.zeros(1)] * 3)
    z = np.stack([4 * rng.normal(size=4000), np.zeros(4000)], 1)
    y = (rng.random(4000) > 1 / (1 + np.exp(-z[:, 0] / 2))).astype(int)  # scores twice too sharp
    language_id.calibrate(model, z, y, 0.95)
    assert model.temperature == pytest.approx(2, rel=0.15)
    p = language_id.softmax(z / model.temperature)
    passed = p.max(1) >= model.threshold
    assert 0.2 < passed.mean() < 0.95 and (p.argmax(1) == y)[passed].mean() >= 0.95


# ---- labelled samples ----
def test_labelled_samples_are_bounded_after_the_join(spark):
    one = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 700).alias("text"))
    labels = spark.createDataFrame([(1, 1), (1, 0), (1, 1)], "doc_id long, toxic int")
    got = common.labelled_sample(one, labels, "toxic", 5).collect()
    assert len(got) == 5 == len({(bytes(r.b), r.y) for r in got})
    assert common.labelled_sample(one, labels, "toxic", 5000).count() == 1400  # each text once a label


# ---- 13 ----
def audited(rows, least):
    split = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    count, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        key = (lang or "", source or "")
        groups.add(key)
        count[key].update(split(text))
        df[key[0]].update(set(split(text)))
    out = set()
    for lang, source in groups:
        kept = [t for t, n in df[lang].items() if n >= least]
        total = Counter()
        for key in groups:
            if key[0] == lang:
                total.update({t: count[key][t] for t in kept})
        share = lambda c: (lambda n: {t: 1 + 1_000_000_000 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept})(sum(c[t] for t in kept))  # noqa: B023, E731
        gap = lambda p, q: (p - q) ** 2 // (p + q)
        mine = share(count[lang, source])
        pairs = [(s, sum(gap(mine[t], q) for t, q in share(count[lang, s]).items())) for g, s in groups if g == lang and s != source]
        terms = [(t, gap(mine[t], q)) for t, q in share(total).items() if count[lang, source][t] and mine[t] > q]
        for part, found in (("pair", pairs), ("term", terms)):
            for rank, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode())), 1):
                if part == "pair" or rank <= 10:
                    out.add((lang, source, part, item, value, rank))
    return out


@pytest.mark.parametrize(("held", "chunk", "step"), [(300_000, 100_000, 1 << 21), (40, 50, 9)])
def test_divergence(spark, monkeypatch, held, chunk, step):
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "STEP", step)
    rng = random.Random(8)
    rows = [(i, words(rng, int(200 * rng.random() ** 3), 150 + 40 * (i % 4)), ("en", "de", None)[i % 5 % 3], f"s{i % 4}" if i % 3 else "s0") for i in range(400)]
    rows += [(500 + i, "", "en", "without terms") for i in range(2)] + [(600, "alone here", "eo", "s1"), (601, "nothing", "eo", "s2")]
    got = [tuple(r) for r in divergence.audit(docs(spark, rows).repartition(3), chunk=chunk).collect()]
    assert set(got) == audited(rows, 10) and len(got) == len(set(got))


def test_divergence_of_odd_input(spark, odd):
    got = {tuple(r) for r in divergence.audit(odd, least=2).collect()}
    assert got == audited(ODD, 2) and {p for *_, p, _, _, _ in got} == {"pair", "term"}
    assert divergence.audit(odd.limit(0)).count() == 0


def test_shares_are_exact_for_large_counts(spark):
    cases = [(0, 7, 3), (5 * 10**14, 10**15, 10**6), (123_456_789, 987_654_321_012, 77), (9, 9, 1)]
    df = spark.createDataFrame(cases, "c long, n long, v long")
    got = [r.p for r in df.select(divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p")).collect()]
    assert got == [1 + 1_000_000_000 * (c + 2) // (n + 2 * v) for c, n, v in cases]
