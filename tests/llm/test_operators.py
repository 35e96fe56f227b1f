"""Operators of loopgrade.llm against brute force and on odd input."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loopgrade.llm import (
    decontamination,
    mixing,
    quality_classifier,
    quality_rules,
    sanitise,
    simhash,
    suffix_dedup,
    token_counts,
    toxicity,
    transcripts,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


ODD = [(1, None, "a"), (2, "", "a"), (None, "word " * 60, None), (3, "word " * 60, "a"), (3, "word " * 60, "a"), (4, "x" * 50_000, "b"), (5, "é\x85 ü　ß", "b")]


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ODD).withColumn("row", F.lit(1)).withColumn("key_1", F.lit("x")).withColumn("fp", F.lit(0)).withColumn("a.b", F.lit(2))


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, []).withColumn("toxic", F.lit(1)).withColumn("quality", F.lit(1))


# ---- 1 ----
def smith_waterman(doc, item):
    h = [[0.0] * (len(item) + 1) for _ in range(len(doc) + 1)]
    best = 0.0
    for i, d in enumerate(doc, 1):
        for j, x in enumerate(item, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if d == x else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best / (2 * len(item))


def test_alignment_is_smith_waterman():
    rng = random.Random(3)
    ds = [np.array([rng.randint(1, 6) for _ in range(rng.randint(1, 25))]) for _ in range(60)]
    its = [np.array([rng.randint(1, 6) for _ in range(rng.randint(1, 12))]) for _ in range(60)]
    for d, i, (score, a, b) in zip(ds, its, decontamination.align_many(ds, its), strict=True):
        assert score == pytest.approx(smith_waterman(d.tolist(), i.tolist()))
        assert score == 0 or smith_waterman(d[a:b].tolist(), i.tolist()) == pytest.approx(score)


def test_leaks(spark, odd, empty):
    item, other = prose(1, 30), prose(2, 24)
    edited = item.split()
    edited[7], edited[15] = "changed", "words"
    del edited[22]
    rows = [(1, prose(3, 300) + " " + item + " " + prose(4, 200), "a"), (2, prose(5, 90) + "\n" + " ".join(edited).upper() + ".", "a"), (3, prose(6, 400), "a"), (4, other[: len(other) // 4], "b")]
    bench = spark.createDataFrame([(10, item), (11, other), (12, None), (13, "")], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.score for r in decontamination.leaks(docs(spark, rows), bench).collect()}
    assert set(found) == {(1, 10), (2, 10)} and found[1, 10] == 1.0 and 0.6 < found[2, 10] < 1
    joined = {(r.doc_id, r.item_id): r.score for r in decontamination.leaks(docs(spark, rows), bench, most_seeds=0).collect()}
    assert joined == found  # the way beyond the broadcast bound
    assert {r.doc_id for r in decontamination.decontaminate(docs(spark, rows), bench).collect()} == {3, 4}
    assert decontamination.decontaminate(odd, bench).count() == len(ODD)
    assert decontamination.leaks(empty, bench).count() == 0 and decontamination.leaks(odd, bench.limit(0)).count() == 0


@pytest.mark.parametrize("most_seeds", [decontamination.MOST_SEEDS, 0])
def test_short_items_leak_in_long_documents(spark, most_seeds):
    rows = [(1, prose(3, 90) + " Quux zorble! " + prose(4, 50), "a"), (2, prose(5, 90) + " quux of zorble", "a"), (3, prose(6, 70) + " vex quib wump", "a"), (4, "zyx", "a"), (5, prose(7, 40) + " zyx " + prose(8, 9), "a")]
    bench = spark.createDataFrame([(10, "quux zorble"), (11, "Vex, quib wump"), (12, "zyx"), (13, prose(9, 20))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.score, r.start_word, r.end_word) for r in decontamination.leaks(docs(spark, rows), bench, most_seeds=most_seeds).collect()}
    assert got == {(1, 10): (1.0, 90, 92), (3, 11): (1.0, 70, 73), (4, 12): (1.0, 0, 1), (5, 12): (1.0, 40, 41)}


# ---- 2 ----
def brute_counts(t):
    words = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts():
    rng = random.Random(1)
    texts = ["", "a", "a b c a b c", "x\n\nx\n x\r\nx ", "é # ü|ß <b>\x85c"] + ["".join(rng.choice("ab \n#é") for _ in range(200)) for _ in range(80)]
    for t in texts:
        assert quality_rules.base_counts(t.encode())[:5] == brute_counts(t), t


def test_quality_rules(spark, odd, empty):
    menu = "home about the site contact us"
    rows = [(i, menu + "\n" + prose(i, 80), "h") for i in range(12)] + [(20, prose(20, 50) + "\n" + "\n".join(prose(500 + k, 8) for k in range(8)), "h")]
    rows += [(30 + i, prose(i + 50, 5) + "\n" + "\n".join(prose(500 + k, 8) for k in range(8)), "h") for i in range(12)]
    rows += [(60 + i, "copied line of some words\n" + prose(99, 70), "h") for i in range(30)]
    rows += [(100, menu + "\n" + prose(100, 46), "h"), (101, menu + "\n" + prose(101, 44), "h")]  # fewer than 50 words are left
    got = {r.doc_id: r for r in quality_rules.judge(docs(spark, rows)).collect()}
    assert all(got[i].kept and got[i].removed_words == 6 * (i > 0) for i in range(12))  # the first keeps its lines
    assert not any(got[30 + i].kept or got[30 + i].base_failed for i in range(12)) and got[20].kept
    assert all(got[60 + i].kept and got[60 + i].removed_words == 0 for i in range(30))  # copies are one document
    assert [(got[i].kept, got[i].base_failed) for i in (100, 101)] == [(False, False), (False, False)]
    cleaned = {r.doc_id: r for r in quality_rules.clean(docs(spark, rows)).collect()}
    assert cleaned[3].text == prose(3, 80) and cleaned[3].n_chars == len(prose(3, 80)) and 31 not in cleaned
    assert quality_rules.judge(odd).count() == len(ODD) and quality_rules.clean(odd).columns == odd.columns
    assert quality_rules.judge(empty).count() == 0 and quality_rules.clean(empty).count() == 0


# ---- 3 and 10 ----
def labelled(spark, bad):
    rows = [(i, prose(i, 60) + (bad if i % 4 == 0 else "") + prose(-i, 60), "s") for i in range(300)]
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1, 1 if i % 4 == 0 else 0) for i in range(300)], "doc_id long, quality int, toxic int")
    return docs(spark, rows), labels


def held_out_accuracy(scored, wrong):
    rows = [r for r in scored.collect() if r.held_out]
    assert rows and all(0 <= r.score <= 1 for r in rows)
    return np.mean([r.predicted == (wrong if r.doc_id % 4 == 0 else 1 - wrong) for r in rows])


def test_quality_classifier(spark, odd, empty):
    d, labels = labelled(spark, " $$$ *** ### %%% &&& $$$ " * 8)
    net = quality_classifier.train(d, labels)
    assert held_out_accuracy(quality_classifier.score(d, net), 0) > 0.9
    assert quality_classifier.score(odd, net).count() == len(ODD) and quality_classifier.score(empty, net).count() == 0
    assert quality_classifier.train(d, labels.limit(0)) is None
    assert {r.score for r in quality_classifier.score(odd, None).collect()} == {0.5}


def test_classifier_reads_the_whole_text():
    net = quality_classifier.new_network()
    b = prose(1, 30_000).encode()
    x = np.frombuffer(b, np.uint8)
    acts = quality_classifier._windows(net.embed[x]) @ net.conv
    total = 0.0
    for i in range(0, len(acts), quality_classifier.CHUNK):
        part = acts[i : i + quality_classifier.CHUNK]
        total += len(part) * float(np.maximum(part.max(0) + net.bias, 0) @ net.out + net.shift[0])
    assert quality_classifier.logit(net, b) == pytest.approx(total / len(acts), rel=1e-4)


def test_toxicity(spark, odd, empty):
    d, labels = labelled(spark, " you Idiot, ")
    fm = toxicity.train(d, labels)
    assert held_out_accuracy(toxicity.score(d, fm), 1) > 0.95
    assert toxicity.score(odd, fm).count() == len(ODD) and toxicity.score(empty, fm).count() == 0
    assert toxicity.train(d, labels.limit(0)) is None


def test_factorization_machine_learns_a_pair():
    rng = random.Random(2)
    rows, y = [], []
    for _ in range(600):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append(sorted({1 if a else 3, 2 if b else 4, rng.randint(10, 40)}))
        y.append(float(a and b))
    fm = toxicity.fit(rows, np.array(y), epochs=600)
    z = np.array([fm.logit(r) for r in rows])
    assert ((z > 0) == np.array(y, bool)).mean() > 0.97 and np.abs(fm.factors).max() > 0.1
    t = rows[0]
    i = [k for k, p in enumerate(fm.place) if p in t]
    pairs = sum(float(fm.factors[p] @ fm.factors[q]) for p in i for q in i if p < q)
    assert fm.logit(t) == pytest.approx(fm.bias + fm.linear[i].sum() + pairs)


def test_toxic_only_as_a_pair():
    def sample(seed):
        rng = random.Random(seed)
        kinds = [(1, 2), (1,), (2,), (3,)]  # 1 and 2 stand in as many toxic as clean documents; 3 is toxic by itself
        rows = [sorted({*kinds[k % 4], *(rng.randint(10, 400) for _ in range(20))}) for k in range(600)]
        return rows, np.array([float(k % 4 in (0, 3)) for k in range(600)])

    rows, y = sample(1)
    fm = toxicity.fit(rows, y)
    assert {1, 2, 3} <= set(fm.place.tolist())
    new, truth = sample(2)
    assert np.mean([(fm.logit(r) > 0) == bool(t) for r, t in zip(new, truth, strict=True)]) > 0.97
    assert toxicity.associated(rows, y, block=1).tolist() == toxicity.associated(rows, y).tolist()


# ---- 4 ----
def greedy(word, vocab):
    n = i = 0
    while i < len(word):
        j = next((j for j in range(len(word), i, -1) if word[i:j] in vocab), None)
        if j is None:
            return -1
        n, i = n + 1, j
    return n


def test_token_automaton():
    rng = random.Random(5)
    for _ in range(60):
        vocab = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 14))}
        auto = token_counts.Automaton(sorted(vocab))
        for _ in range(60):
            w = "".join(rng.choice("abc") for _ in range(rng.randint(0, 14)))
            assert auto.count(w) == greedy(w, vocab), (w, vocab)


def test_token_counts(spark, odd, empty):
    got = {r.doc_id: r for r in token_counts.count(docs(spark, [(1, "ab abc zz", "s"), (2, None, "s")]), ["▁a", "b", "bc", "▁"]).collect()}
    assert (got[1].n_words, got[1].n_tokens, got[1].n_unknown) == (3, 5, 1) and got[2].n_tokens == 0
    assert token_counts.count(odd, ["▁"]).count() == len(ODD) and token_counts.count(empty, []).count() == 0


# ---- 5 ----
def brute_roles(model, convs):
    """Plain Viterbi over the segments of whole conversations."""
    out = {}
    for conv, records in convs.items():
        segs = [(t, n, model.segment(rows)) for t, text in records for n, (rows, _) in enumerate(transcripts.segments(text))]
        v, back = model.start + segs[0][2], []
        for _, _, e in segs[1:]:
            step = v[:, None] + model.move
            back.append(step.argmax(0))
            v = step.max(0) + e
        j, roles = int(v.argmax()), []
        for b in [*back[::-1], None]:
            roles.append(j)
            j = int(b[j]) if b is not None else j
        for (t, n, _), r in zip(segs, roles[::-1], strict=True):
            out[conv, t, n] = transcripts.ROLES[r]
    return out


def test_transcripts(spark, empty):
    rng = random.Random(4)
    convs = {c: [(t, ("User: " if rng.random() < 0.2 else "") + prose(c * 100 + t, rng.randint(1, 30)) + ("\n### Assistant\n" + prose(t, 9) if rng.random() < 0.2 else "")) for t in range(rng.choice([1, 3, 8, 200]))] for c in range(12)}
    rows = [(c, t, ["system", "user", "assistant"][min(t, 1) + (t + 1) % 2 * (t > 0)], text) for c, ts in convs.items() for t, text in ts]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    model = transcripts.fit(df)
    want = brute_roles(model, convs)
    got = {(r.conv_id, r.turn, r.part): r for r in transcripts.render(df.repartition(7), model).collect()}
    assert {k: r.role for k, r in got.items()} == want
    marked = [(k, r) for k, r in got.items() if k[2] == 1]
    assert marked and all(r.rendered == f"<|{r.role}|>\n{r.text}\n<|end|>" and "###" not in r.text for _, r in marked)
    assert np.mean([r.role == "assistant" for _, r in marked]) > 0.8  # the sample marks speakers against their roles, too


def test_odd_transcripts(spark):
    rows = [(None, 1, "user", "a"), (None, 1, "user", "a"), (1, None, None, None), (1, 0, "x", ""), (1, 0, "x", ""), (2, 5, "user", "Human: hi?\nAI: yes")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("key_1", F.lit(1))
    out = transcripts.render(df, transcripts.fit(df)).collect()
    assert len(out) == 7 and [r.role for r in sorted(out, key=lambda r: r.part) if r.conv_id == 2] == ["user", "assistant"]
    assert transcripts.render(df.limit(0), transcripts.fit(df)).count() == 0


# ---- 6 ----
def brute_fingerprint(t):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
    if not words:
        return 0
    sh = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint():
    for t in ["", "A b", "a b c d", "É Ä x y z", prose(1, 300), "same " * 100]:
        assert simhash.fingerprint(t.encode()) & (1 << 64) - 1 == brute_fingerprint(t)


@pytest.mark.parametrize("large", [64, 3])
def test_links_keep_components(spark, large):
    rng = random.Random(large)
    fps = {rng.getrandbits(64) for _ in range(40)} | {0}
    for f in list(fps)[:12]:
        for _ in range(12):
            g = f
            for b in rng.sample(range(64), rng.randint(1, 4)):
                g ^= 1 << b
            fps.add(g)
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), large=large, block=5)
    got = {r.node: r.comp for r in simhash.connected_components(edges).collect()}
    assert {f: got.get(f, f) for f in fps} == {f: root(f) for f in fps}


def test_deduplicate(spark, odd, empty):
    base = prose(1, 2000)
    rows = [(5, base, "a"), (2, base, "b"), (9, base + " more", "a"), (7, prose(2, 100), "a"), (None, prose(3, 50), "a")]
    assert {r.doc_id for r in simhash.deduplicate(docs(spark, rows)).collect()} == {2, 7, None}
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5]
    assert simhash.components(empty).count() == 0 and simhash.deduplicate(empty).count() == 0


# ---- 7 ----
PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(t):
    out = []
    for k, (name, p) in enumerate(PLAIN):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}.get(name)
            if ok or name == "ip" and all(int(x) <= 255 for x in m[0].split(".")):
                out.append((m.start(), k, m.end()))
    return ",".join(f"{PLAIN[k][0]}:{s}:{e}" for s, k, e in sorted(out))


def test_base_spans(spark):
    rng = random.Random(6)
    pieces = ["a@b.c", "_d@e.f", "1.2.3.4", ".5.6.7.300", "4111 1111 1111 1111", "4111111111111111", "+1 (017) 555-7713", "+", "@", "-", " ", "é", "𝒳", "0001.002.3.4", "5-5", "x..y@z-.q", "9" * 30, "\n"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(400)] + ["1.2.3.4 " * 700, "7" * 20_000, "a." * 20_000, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r.id: r.s for r in df.select("id", sanitise.listed(sanitise.base_spans(F.col("text"))).alias("s")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute_spans(t), t[:200]


def test_disclosing_terms(spark, odd, empty):
    rows = [(i, f"{prose(i, 30)} write to ann@ex.org of Zebrawing {prose(i + 90, 30)}", "a") for i in range(5)] + [(10 + i, prose(i + 300, 40) + " write to the office", "a") for i in range(40)]
    rows += [(90, "the Zebrawing team met", "a")]
    df = docs(spark, rows)
    terms = {r.term: r for r in sanitise.disclosing_terms(df).collect()}
    assert set(terms) == {"zebrawing"} and terms["zebrawing"].p == pytest.approx(5 / 6) and not terms["zebrawing"].remove
    got = {r.doc_id: r.text for r in sanitise.sanitise(df).collect()}
    assert got[90] == "the [TERM] team met" and "write to [EMAIL] of [TERM]" in got[2] and got[11] == rows[6][1]
    again = {r.doc_id: r.text for r in sanitise.sanitise(df, most_rows=0, most_terms=0).collect()}
    assert again == got  # the way beyond the broadcast bounds
    out = sanitise.sanitise(odd)
    assert out.columns == odd.columns and out.count() == len(ODD) and out.where("text is null").count() == 1
    assert sanitise.sanitise(empty).count() == 0 and sanitise.find(empty).count() == 0


def test_rare_values_are_disclosed_over_whole_documents(spark):
    far = lambda i, x: f"{prose(i, 40)} {x} {prose(i + 90, 40)}"
    rows = [(i, far(i, f"mail u{i}@ex{i}.org") + " " + prose(i + 700, 60) + " Quorvexian", "a") for i in range(8)]  # every value once, the term far from it
    rows += [(20 + i, far(i + 20, "call +1 (017) 555-7713") + " " + prose(i + 800, 60) + " Plimbook", "a") for i in range(2)]  # a value in two documents
    rows += [(100 + i, prose(i + 300, 60) + " mail or call of the day", "a") for i in range(60)]
    rows += [(200 + i, far(60, "solo@ex.org") + " " + prose(999, 40) + " " + prose(i + 600, 3), "a") for i in range(9)]  # near copies
    rows += [(300 + i, prose(i + 900, 30) + " Zorblatt", "a") for i in range(9)] + [(400 + i, far(i + 400, f"w{i}@ex.org") + " Zorblatt", "a") for i in range(3)]
    rows += [(500 + i, prose(i + 1200, 60) + " Vexillum Regards, the team, call +1 (017) 555-2222 in the office hours, all days of the week, or come by", "a") for i in range(20)]  # one signature
    terms = {r.term: r.p for r in sanitise.disclosing_terms(docs(spark, rows + rows[:9] * 5)).collect()}  # repeated rows count once
    assert terms["quorvexian"] == terms["plimbook"] == terms["vexillum"] == 1.0
    assert not {"mail", "call", "zorblatt", *(w for w in prose(999, 40).split() if len(w) > 3)} & set(terms)


def test_disclosure_is_the_plain_count_of_documents(spark):
    rng = random.Random(12)
    words = [f"w{i}x" for i in range(60)]
    values = ["ann@ex.org", "bob@ex.org", "10.0.0.1", "+1 (017) 555-7713"]
    rows = []
    for i in range(200):
        text = [rng.choice(words[:40]) for _ in range(rng.randint(10, 40))]
        for k, v in enumerate(values):
            if rng.random() < (0.03, 0.05, 0.1, 0.02)[k]:
                text += [v, *[w for w in words[40 + 5 * k : 45 + 5 * k] if rng.random() < 0.8]]
        text += [w for w in words[40:] if rng.random() < 0.004]
        rng.shuffle(text)
        rows.append((i, " ".join(text), "a"))
    rows += rows[:20]
    want, seen = {}, {t: None for _, t, _ in rows}
    about = []
    for t in seen:
        spans = [s.split(":") for s in brute_spans(t).split(",") if s]
        found = {(k, t[int(a) : int(b)]) for k, a, b in spans}
        for _, a, b in sorted(spans, key=lambda s: -int(s[1])):
            t = t[: int(a)] + " " + t[int(b) :]
        about.append(({*found, *((k, None) for k, _ in found)}, {w for w in re.findall(r"\w{3,}", t.lower())}))
    for entity in set().union(*(e for e, _ in about)):
        weight = 4 if entity[1] is None else 2
        prior = sum(entity in e for e, _ in about) / len(about)
        for term in set().union(*(w for e, w in about if entity in e)):
            n, both = sum(term in w for _, w in about), sum(term in w and entity in e for e, w in about)
            smooth = (both + weight * prior) / (n + weight)
            if smooth >= 0.5 and smooth >= 2 * prior:
                want[term] = max(want.get(term, 0), both / n)
    got = {r.term: r.p for r in sanitise.disclosing_terms(docs(spark, rows)).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()} and len(got) >= 5


def test_masked_characters_are_no_terms(spark):
    letter = "\U00010a60\U00010a60\U00010a60"
    rows = [(i, f"{prose(i, 40)} {letter} mail u{i}@ex{i}.org", "a") for i in range(8)] + [(50 + i, prose(i + 90, 40), "a") for i in range(40)]
    found = {r.row.doc_id: r for r in sanitise.find(docs(spark, rows)).collect()}
    for i in range(8):
        at = rows[i][1].index(letter)
        assert (at, at + 3) in [(s.start, s.end) for s in found[i].spans if s.kind == 4]


# ---- 8 ----
def brute_repeats(texts):
    times = Counter(b[i : i + 200] for b in texts for i in range(len(b) - 199))
    out = []
    for b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if times[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        out.append(bytes(np.frombuffer(b, np.uint8)[~gone]))
    return out


@pytest.mark.parametrize("hot", [4000, 1])
def test_suffix_dedup(spark, odd, empty, hot):
    shared, line = prose(1, 70), prose(2, 12)
    rng = random.Random(hot)
    texts = [prose(10 + i, 60) + shared[: rng.randint(190, len(shared))] + line + prose(40 + i, 50) for i in range(14)]
    texts += [shared, shared, "ab" * 400, "x" * 199, "x" * 200, "é" * 150, "", shared[7:] + shared[:300], texts[0][:500] + "!" + texts[0][500:]]
    rows = [(i, t, "a") for i, t in enumerate(texts)] + [(99, None, "a")]
    got = {r.doc_id: r for r in suffix_dedup.remove(docs(spark, rows), hot=hot).collect()}
    want = brute_repeats([t.encode() for t in texts])
    for i, (t, w) in enumerate(zip(texts, want, strict=True)):
        assert bytes(got[i].kept) == w and got[i].n_removed == len(t.encode()) - len(w), i
        assert got[i].kept_sha256 == hashlib.sha256(w).hexdigest()
    assert got[99].n_bytes == 0
    assert suffix_dedup.remove(odd, hot=hot).count() == len(ODD) and suffix_dedup.remove(empty, hot=hot).count() == 0


def test_suffix_sort_orders_suffixes():
    rng = random.Random(8)
    text = "".join(rng.choice("ab") for _ in range(700)).encode() + b"ab" * 300
    s = suffix_dedup.Suffixes(np.frombuffer(text, np.uint8))
    at = np.arange(len(text) - 199)
    group = np.sort(np.array([rng.randint(0, 5) for _ in at]))
    order = s.sort(at, group)
    for g in range(6):
        mine = [text[i : i + 200] for i in at[order][group == g]]
        assert mine == sorted(mine)


# ---- 9 ----
def test_mixing(spark, odd, empty):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randint(1, 40), s) for i, s in enumerate(["a"] * 900 + ["b"] * 150 + ["c"] * 60 + [None] * 200)]
    got = mixing.mix(docs(spark, rows)).collect()
    size, take, target = Counter(), Counter(), {}
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        size[r.source] += r.size
        take[r.source] += r.taken
        target[r.source] = r.target
    total, weight = sum(size.values()), {"a": 1, "b": 2, "c": 3, None: 1}
    full: set = set()
    while True:
        share = (total - sum(3 * size[s] for s in full)) / sum(w for s, w in weight.items() if s not in full)
        over = {s for s, w in weight.items() if s not in full and share * w > 3 * size[s]}
        if not over:
            break
        full |= over
    for s, w in weight.items():
        assert target[s] == pytest.approx(3 * size[s] if s in full else share * w)
        assert abs(take[s] - target[s]) <= 41
    assert sum(take.values()) <= total
    again = {(r.doc_id, r.taken) for r in mixing.mix(docs(spark, rows[::-1]).repartition(5)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}
    assert mixing.mix(odd).count() == len(ODD) and mixing.mix(empty).count() == 0
