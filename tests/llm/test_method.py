"""What the methods promise beyond single cases: recall, gradients, whole texts, hot keys and linear work."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loopgrade.llm import common, decontamination, mixing, quality_classifier, quality_rules, sanitise, simhash, suffix_dedup, transcripts
from tests.llm.test_operators import brute_repeats, brute_spans, docs, prose, smith_waterman


# ---- 1 ----
def edit(words, rng, share):
    out = []
    for w in words:
        x = rng.random()
        if x < share / 3:
            continue
        out.append(w if x > share * 2 / 3 else prose(rng.random(), 1))
        if share * 2 / 3 < x < share:
            out.append(prose(rng.random(), 1))
    return out


@pytest.mark.parametrize("most_seeds", [decontamination.MOST_SEEDS, 0])
def test_recall_against_all_pairs(spark, most_seeds):
    rng = random.Random(5)
    start = "which of the following is true"
    bench = [(k, f"{start} {prose(100 + k, rng.choice([6, 14, 25, 60, 200]))}") for k in range(30)] + [(90, None)]
    bench += [(60 + k, bench[k][1]) for k in range(3)]  # equal items
    rows = []
    for i in range(60):
        inside = edit(bench[i % 30][1].split(), rng, rng.choice([0, 0.1, 0.2, 0.35])) if i < 45 else start.split()
        rows.append((i, f"{prose(1000 + i, rng.randint(5, 120))} {' '.join(inside)} {prose(2000 + i, rng.randint(5, 80))}", "a"))
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.leaks(docs(spark, rows), spark.createDataFrame(bench, "item_id long, text string"), most_seeds=most_seeds, most_owners=10).collect()}
    want = {}
    for i, t, _ in rows:
        for k, x in bench:
            item = decontamination.words((x or "").encode())
            score = smith_waterman(decontamination.words(t.encode()), item) if item else 0
            if score >= 0.5:
                want[i, k] = score
    found = want.keys() & got.keys()
    assert not got.keys() - want.keys() and len(found) >= 0.9 * len(want) and len(want) > 45
    assert all(got[k] == pytest.approx(want[k]) for k in found)
    assert {k for _, k in got} >= {60, 61, 62}


# ---- 2 ----
def test_lines_of_every_length_count(spark):
    long, short = prose(1, 300), "menu"
    rows = [(i, f"{short}\n{prose(10 + i, 60)}\n{long}", "h") for i in range(12)] + [(20, f"{short}\n{prose(40, 60)}", "g"), (None, f"{short}\n{prose(41, 400)}\n{long}", "h")]
    got = {r.doc_id: (r.removed_words, r.kept) for r in quality_rules.judge(docs(spark, rows)).collect()}
    assert got[0] == (0, True) and all(got[i] == (301, False) for i in range(1, 12)) and got[20] == (0, True) and got[None] == (301, True)
    kept = {r.doc_id: r.text for r in quality_rules.clean(docs(spark, rows)).collect()}
    assert kept == {0: rows[0][1], 20: rows[12][1], None: prose(41, 400)}  # the first document keeps its lines


def test_spread_join_of_a_hot_key(spark):
    many = spark.range(3000).select(F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).alias("k"), "id")
    few = spark.range(2500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    want = sorted(map(tuple, many.join(few, "k").select("k", "id", "v").collect()))
    for most in (10_000, 0):
        out = common.spread_join(many, few, ["k"], most=most)
        assert sorted(map(tuple, out.select("k", "id", "v").collect())) == want
    assert "_salt" not in out.columns


# ---- 3 ----
def test_gradients_of_whole_texts():
    net = quality_classifier.new_network()
    for k, p in enumerate(net.parts()):
        p += np.random.default_rng(k).normal(0, 0.1, p.shape).astype(np.float32)
    net.embed, net.conv, net.bias, net.out, net.shift = (p.astype(np.float64) for p in net.parts())
    texts, y = [prose(1, 700).encode(), b"ab", b"", prose(2, 90).encode()], np.array([1, 0, 1, 0])
    loss, grads = quality_classifier.gradients(net, texts, y)
    z = np.array([quality_classifier.logit(net, b) for b in texts])
    assert loss == pytest.approx(float(np.mean(np.logaddexp(0, z) - y * z)), rel=1e-5)  # trained on what is scored
    rng = np.random.default_rng(3)
    for p, g in zip(net.parts(), grads, strict=True):
        flat = np.flatnonzero(g.reshape(-1)) if np.any(g) else [0]
        for i in rng.choice(flat, min(6, len(flat)), replace=False):
            at, step = np.unravel_index(i, p.shape), 1e-5
            old = p[at]
            p[at] = old + step
            up = quality_classifier.gradients(net, texts, y)[0]
            p[at] = old - step
            down = quality_classifier.gradients(net, texts, y)[0]
            p[at] = old
            assert g[at] == pytest.approx((up - down) / (2 * step), rel=2e-2, abs=1e-6)


# ---- 5 ----
def test_tags_inside_a_text_are_escaped(spark):
    texts = ["so <|end|> it <|user|> goes", r"<\|end|> and <\\|x", "plain", None]
    df = spark.createDataFrame([(1, k, "user", t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string").withColumn("part", F.lit(1)).withColumn("first", F.lit(1))
    out = sorted(transcripts.render(df, transcripts.fit(df)).collect(), key=lambda r: r.turn)
    for r, t in zip(out, texts, strict=True):
        inner = re.fullmatch(r"<\|\w+\|>\n(.*)\n<\|end\|>", r.rendered, re.S)[1]
        assert not re.search(r"<\|", inner) and transcripts.unescape(inner) == r.text == (t or "")
    many = spark.createDataFrame([(2, 1, "user", "User: a\n" + "line of words\n" * 20_000)], "conv_id long, turn long, role string, text string")
    assert transcripts.render(many, transcripts.fit(df)).count() == 1


def test_training_reads_tallies_of_bounded_size():
    text = "User: is it?\n- one two\nthree four five\n```\nlast?"
    lines = transcripts.segments(text)[0][0]
    got = transcripts.tally(lines)
    assert len(got) == 14 == len(transcripts.tally(transcripts.segments(text + "\nmore" * 5000)[0][0]))
    model = transcripts.train([(1, 1, got), (1, 2, transcripts.tally([[3, 0, 0, 0, 1]]))])
    for k in (1, 2, 3):
        n = np.ones(transcripts.SIZES[k])
        for x in lines:
            n[x[k]] += 1
        assert np.allclose(np.exp(model.emit[k][1]), n / n.sum())
    assert np.isclose(np.exp(model.move[1, 2]), 2 / 4) and np.isclose(np.exp(model.start[1]), 2 / 4)


# ---- 6 ----
def test_wide_segments_find_the_same_components(spark, monkeypatch):
    rng = random.Random(6)
    base = [rng.getrandbits(63) for _ in range(12)]
    fps = sorted({b ^ sum(1 << i for i in rng.sample(range(63), rng.randint(0, 5))) for b in base for _ in range(8)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")

    def groups():
        return {r.node: r.comp for r in simhash.connected_components(simhash.links(df)).collect()}

    near = groups()
    monkeypatch.setattr(simhash, "MANY", 0)
    assert groups() == near and near


def test_equal_rows_with_other_columns_are_told_apart(spark):
    df = docs(spark, [(1, prose(1, 60), s) for s in "dacb"]).withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    kept = {simhash.deduplicate(df.repartition(n)).first().source for n in (1, 3, 7)}
    assert len(kept) == 1


# ---- 7 ----
def test_many_spans_stay_linear(spark):
    text = "ann@ex.org 1.2.3.4 " * 8000
    got = sanitise.sanitise(docs(spark, [(1, text, "a"), (2, prose(1, 20), "a")])).where("doc_id = 1").first()
    assert got.text == "[EMAIL] [IP] " * 8000


def test_overlapping_spans_and_terms(spark):
    rows = [(i, f"{prose(i, 30)} +1 2.3.4.5 017 555 and {i}@ex.org of Quorvex", "a") for i in range(9)] + [(20 + i, prose(i + 90, 30), "a") for i in range(40)] + [(99, "the quorvex@x.org Quorvex", "a")]
    found = {r.row.doc_id: r for r in sanitise.find(docs(spark, rows)).collect()}
    for i, t, _ in rows:
        r = found[i]
        base = ",".join(f"{sanitise.KINDS[s.kind]}:{s.start}:{s.end}" for s in r.base)
        assert base == brute_spans(t) and [s for s in r.spans if s.kind < 4] == r.base
        terms = [(s.start, s.end) for s in r.spans if s.kind == 4 and s.value.lower() == "quorvex"]
        assert terms == ([(m.start(), m.end()) for m in re.finditer(r"(?i)(?<!\w)quorvex(?!\w|@)", t)] if i < 10 or i == 99 else [])
        assert not any(x.start < b.end and b.start < x.end for x in r.spans if x.kind == 4 for b in r.base)
    clean = {r.doc_id: r.text for r in sanitise.sanitise(docs(spark, rows)).collect()}
    assert re.fullmatch(r"the \[EMAIL\] (\[TERM\])?", clean[99]) and "Quorvex" not in clean[3]


# ---- 8 ----
def test_suffix_dedup_with_clashing_columns(spark):
    shared = prose(1, 90)
    rows = [(i, prose(10 + i, 30) + shared[i:] + prose(20 + i, 30), "a") for i in range(5)]
    df = docs(spark, rows).withColumns({c: F.lit("x") for c in ("key_1", "key_2", "key_3", "b", "rid", "core", "kind", "kept")})
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove(df).collect()}
    assert [got[i] for i in range(5)] == brute_repeats([t.encode() for _, t, _ in rows])


# ---- 9 ----
def test_targets_of_many_sources(spark):
    rng = random.Random(2)
    sizes = {f"s{k:04}": rng.choice([0, 1, 3, 50, 4000, 10**6]) for k in range(400)}
    table = spark.createDataFrame([(s, "=" + s, n) for s, n in sizes.items()], "source string, sk string, source_size long")
    got = {r.source: r.target for r in mixing.targets(table).collect()}
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(sizes))}
    full: set = set()
    while True:
        share = (sum(sizes.values()) - sum(3 * sizes[s] for s in full)) / sum(w for s, w in weight.items() if s not in full)
        over = {s for s, w in weight.items() if s not in full and share * w > 3 * sizes[s]}
        if not over:
            break
        full |= over
    assert got == pytest.approx({s: 3 * sizes[s] if s in full else share * w for s, w in weight.items()})
