"""Hand-worked cases of the rule tables."""

import math
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from loopgrade.functions.geo import haversine_km
from loopgrade.functions.labels import sub_label, type_label, wilson
from loopgrade.operators import calibrate, carbon, components, curate, evaluate, feedback, hamming, inverted, ordered, predict, ranking, search, vectors

FACTORS = [("iron", "metal", 2.0, False, "b"), ("tin", "metal", 1.0, True, "a"), ("sand", "glass", 0.011, False, "c"), ("clay", "glass", 0.05, False, "c")]


@pytest.fixture(scope="module")
def factors(spark):
    return spark.createDataFrame(FACTORS, "sub_type string, waste_type string, factor double, is_proxy boolean, source string")


@pytest.fixture(scope="module")
def codes(spark):
    return spark.createDataFrame([("metal", "can", "tin")], "waste_type string, photo_sub string, market_sub string")


@pytest.mark.parametrize(
    ("sub", "kind", "outcome", "factor", "proxy"),
    [
        ("iron", "metal", "exact", 2.0, False),
        ("can", "metal", "exact", 1.0, True),
        ("can", None, "error_unknown_sub", None, None),
        ("tile", "metal", "unavailable", None, None),
        ("unknown", "metal", "type_mean", 1.5, True),
        ("", "metal", "type_mean", 1.5, True),
        (None, "paper", "unavailable", None, None),
        (None, None, "error_no_input", None, None),
        ("iron", "glass", "exact", 2.0, False),
    ],
)
def test_factor_resolution(spark, factors, codes, sub, kind, outcome, factor, proxy):
    item = spark.createDataFrame([(sub, kind)], "sub_type string, waste_type string")
    r = carbon.resolve(item, factors, codes).first()
    assert (r.outcome, r.factor, r.is_proxy) == (outcome, factor, proxy)


def test_saved(spark, factors, codes):
    rows = [("sand", "glass", 100.0), ("clay", "glass", 100.0), ("iron", "metal", 0.0), ("iron", "metal", -1.0), ("x", "paper", 5.0)]
    got = carbon.saved(carbon.resolve(spark.createDataFrame(rows, "sub_type string, waste_type string, quantity_kg double"), factors, codes)).collect()
    by = {(r.sub_type, r.quantity_kg): r for r in got}
    assert by["sand", 100.0].co2e_kg == 1.1 and by["sand", 100.0].note and by["clay", 100.0].note == ""
    assert by["iron", 0.0].co2e_kg == 0.0 and by["iron", -1.0].outcome == "error_negative" and by["iron", -1.0].co2e_kg is None
    assert by["x", 5.0].co2e_kg is None and by["x", 5.0].factor_label == "not available"
    assert carbon.impact_totals(spark.createDataFrame([], "quantity_kg long, co2e_kg double, is_proxy boolean")).first().proxy_share == 0.0


def test_haversine_and_labels(spark):
    r = spark.range(1).select(
        haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("far"), sub_label(F.lit("washing_machine")).alias("a"), sub_label(F.lit("glass_jar")).alias("b"), sub_label(F.lit(None).cast("string")).alias("c"),
        type_label(F.lit("e_waste")).alias("d"), *[c.alias(n) for c, n in zip(wilson(F.lit(0.0), F.lit(0.0)), ("low", "high"), strict=True)],
    ).first()
    assert r.far == pytest.approx(math.pi * 6371) and (r.a, r.b, r.c, r.d) == ("Washing machine", "Glass jar", "Not sure", "E-waste") and r.low is None


def test_ranking_ways_agree(spark, monkeypatch):
    listings = spark.createDataFrame([(i, "AB"[i % 2], 500 * i, 12.9 + i / 100, 77.5) for i in range(9)] + [(99, "Z", 1, 0.0, 0.0)], "waste_id long, waste_type string, quantity_kg long, lat double, lon double")
    rec = spark.createDataFrame([(i, f"r{i}", ["A", "B"][: 1 + i % 2], 12.9, 77.5 + i / 50, 1000 * i) for i in range(8)], "recycler_id long, name string, types array<string>, lat double, lon double, capacity long")
    near = sorted(map(tuple, ranking.rank_recyclers(listings, rec, 3).collect()))
    monkeypatch.setattr(ranking, "RECYCLER_ROWS", 0)
    assert sorted(map(tuple, ranking.rank_recyclers(listings, rec, 3).collect())) == near
    assert {r[0] for r in near} == set(range(9))


def test_constant_similarity_is_one(spark):
    df = spark.createDataFrame([(1, 0.4), (2, 0.4)], "waste_id long, similarity double")
    assert {r.similarity for r in ranking.normalised(df).collect()} == {1.0}


@pytest.mark.parametrize(
    ("conf", "knn", "familiar", "other", "want"),
    [
        (0.9, 0.1, False, 0.0, "detected"), (0.9, 0.95, False, 0.0, "unknown"), (0.3, 0.6, False, 0.0, "unknown"), (0.9, 0.6, False, 0.0, "confirm"), (0.3, 0.1, False, 0.0, "confirm"),
        (0.3, None, False, 0.0, "confirm"), (0.9, 0.95, True, 0.0, "detected"), (0.9, 0.5, False, 0.0, "detected"), (0.4, 0.1, False, 0.4, "detected"), (0.4, 0.1, False, 0.41, "unknown"), (0.9, 0.9, False, 0.0, "confirm"),
    ],
)
def test_status(spark, conf, knn, familiar, other, want):
    df = spark.createDataFrame([(conf, knn)], "c double, k double")
    s = predict.status(F.col("c"), F.col("k"), F.lit(0.5), F.lit(0.9), F.lit(0.4), F.lit(familiar), F.lit(other))
    assert df.select(s.alias("s")).first().s == want


LEAVES = "id long, leaf string, waste_type string, sub_type string, p double"


def test_memory_blend(spark):
    leaves = spark.createDataFrame([(i, l, t, s, p) for i in range(5) for l, t, s, p in (("a__x", "a", "x", 0.2), ("a__y", "a", "y", 0.3), ("b", "b", None, 0.5))], LEAVES)
    near = spark.createDataFrame([(0, "a", "x", 0.0), (1, "a", None, 0.25), (2, "other", None, 0.25), (3, "a", "x", 0.5)], "id long, mem_type string, mem_sub string, distance double")
    got = {(r.id, r.leaf): r for r in predict.blend(leaves, near, 0.5).collect()}
    p = lambda i, leaf: got[i, leaf].p
    assert p(0, "a__x") == pytest.approx(0.05 * 0.2 + 0.95) and p(1, "a__x") == pytest.approx(0.5 * 0.2 + 0.5 * 0.4) and p(1, "b") == pytest.approx(0.25)
    assert got[2, "b"].other_mass == pytest.approx(0.5) and p(3, "a__x") == 0.2 and not got[3, "b"].familiar and p(4, "b") == 0.5
    for i in range(5):
        assert sum(p(i, leaf) for leaf in ("a__x", "a__y", "b")) + got[i, "b"].other_mass == pytest.approx(1)


def test_vote_of_one_photo_is_the_roll_up(spark):
    leaves = spark.createDataFrame([(1, "a__x", "a", "x", 0.6), (1, "b", "b", None, 0.4), (2, "a__x", "a", "x", 0.1), (2, "b", "b", None, 0.9), (3, "b", "b", None, 1.0)], LEAVES)
    items = spark.createDataFrame([(1, 10), (2, 20), (3, 20)], "id long, item long")
    got = {(r.id, r.leaf): r.p for r in predict.vote(leaves, items).collect()}
    assert got == {(10, "a__x"): 0.6, (10, "b"): 0.4, (20, "a__x"): 0.05, (20, "b"): 0.95}
    knn = spark.createDataFrame([(1, 0.2), (2, 0.4)], "id long, knn double")
    assert {r.item: r.knn for r in predict.vote_distance(knn, items).collect()} == {10: 0.2, 20: None}


def test_latest_by_order_not_by_time(spark):
    rows = [("k", 1, "2024-01-02 00:00:00", "a"), ("k", 2, "2024-01-01 00:00:00", "b"), ("m", 3, "2024-01-03 00:00:00", "unknown")]
    df = spark.createDataFrame(rows, "item_key string, seq long, t string, actual string").withColumn("created_at", F.col("t").cast("timestamp_ntz"))
    assert {r.item_key: r.actual for r in feedback.latest(df).collect()} == {"k": "b", "m": "unknown"}
    assert feedback.since(df, "2024-01-02 00:00:00").count() == 0  # the latest answer is before the cut-off, though an older one isn't


def test_ece_edges(spark):
    df = spark.createDataFrame([("a", "a", 0.0), ("a", "a", 1.0), ("a", "b", 1 / 15)], "truth string, pred string, confidence double")
    assert evaluate.ece(df).first().ece == pytest.approx((0 + 1 / 15) / 3, abs=1e-6)


def test_running_and_auroc(spark):
    rows = [(i, (i * 37) % 11, i % 3 == 0) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, s long, pos boolean")
    got = sorted((r.rank, r.id, r.t) for r in ordered.running(df.repartition(5), [F.col("s"), F.col("id")], {"t": F.col("s")}).collect())
    total, want = 0, []
    for k, (i, s, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])), 1):
        total += s
        want.append((k, i, total))
    assert got == want
    pairs = [(a[1], b[1]) for a in rows if a[2] for b in rows if not b[2]]
    assert ordered.auroc(df, "s", "pos").first().auroc == pytest.approx(sum((x > y) + (x == y) / 2 for x, y in pairs) / len(pairs), abs=1e-6)
    assert ordered.auroc(df.where("pos"), "s", "pos").first().auroc is None


def test_memory_threshold_falls_back(spark):
    df = spark.createDataFrame([(i, i / 10, False) for i in range(10)], "id long, distance double, agree boolean")
    assert calibrate.memory_threshold(df).first().memory_threshold == pytest.approx(0.045)


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (7, 7), (None, 1)] + [(100 + i, 101 + i) for i in range(60)], "src long, dst long")
    got = {r.node: r.comp for r in components.connected_components(edges).collect()}
    assert got == {5: 2, 4: 2, 3: 2, 2: 2, 9: 8, 8: 8} | {100 + i: 100 for i in range(61)}
    assert components.connected_components(edges.limit(0)).count() == 0


def test_duplicates(spark):
    rows = [(1, "a", "d1", "p1", None), (2, "a", "d1", "p2", "test"), (3, "a", "d2", "p3", "train"), (4, "b", "d3", "p4", None), (5, "c", "d3", "p5", None), (6, "a", "d4", "p6", None)]
    items = spark.createDataFrame(rows, "id long, leaf string, digest string, path string, split string")
    near = spark.createDataFrame([(1, 3)], "src long, dst long")
    got = {r.id: r.reason for r in curate.dedup(curate.duplicate_groups(items, near)).collect()}
    assert got == {1: "exact_copy", 2: "other_split", 3: "kept", 4: "conflict", 5: "conflict", 6: "kept"}


def test_no_group_spans_two_splits(spark):
    rows = [(i, "ab"[i % 2], f"d{i // 3}", f"p{i:03}", None) for i in range(300)]
    items = spark.createDataFrame(rows, "id long, leaf string, digest string, path string, split string").withColumn("leaf", F.lit("a"))
    grouped = curate.duplicate_groups(items)
    kept = curate.dedup(grouped).where("reason = 'kept'").drop("reason")
    split = curate.stratified_split(kept, 0.2, 0.1)
    assert {r.split: r.n for r in split.groupBy("split").agg(F.count("*").alias("n")).collect()} == {"train": 70, "val": 20, "test": 10}
    assert split.groupBy("grp").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0


def test_near_hashes_are_lossless(spark):
    import random

    rng = random.Random(1)
    hs = [rng.getrandbits(63) for _ in range(40)]
    hs += [h ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 5))) for h in hs for _ in range(4)]
    df = spark.createDataFrame(list(enumerate(hs)), "id long, hash long")
    got = {(r.a, r.b) for r in vectors.near_rows(df, 4).collect()}
    first = [hs.index(h) for h in hs]
    want = {(i, j) for i in set(first) for j in set(first) if i < j and (hs[i] ^ hs[j]).bit_count() <= 4}
    assert got == want | {(f, i) for i, f in enumerate(first) if f != i}


def test_neighbours(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    q, b = rng.normal(size=(30, 8)), rng.normal(size=(90, 8))
    qs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "id long, embedding array<double>")
    bs = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(b)], "bank_id long, label int, embedding array<double>")
    d = 1 - (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
    got = {}
    for r in vectors.neighbours(qs, bs, 4, blocks=3).collect():
        got.setdefault(r.id, []).append((r.distance, r.bank_id))
    for i in range(30):
        assert [x for _, x in sorted(got[i])] == np.argsort(d[i])[:4].tolist()
    assert vectors.knn_distance(qs, bs.limit(2), 5).count() == 30


def test_vector_joins_by_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    q, b = rng.normal(size=(30, 8)), rng.normal(size=(40, 8))
    qs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "id long, embedding array<double>")
    ms = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(b)], "mem_id long, label int, embedding array<double>")
    s = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
    for step in (7, 2048):
        monkeypatch.setattr(vectors, "STEP", step)
        near = {(r.id, r.mem_id): r.distance for r in vectors.within(qs, ms, 0.6, blocks=(3, 4)).collect()}
        every = {(r.query_id, r.id): r.similarity for r in vectors.similarities(qs, ms.withColumnRenamed("mem_id", "id"), blocks=(3, 4)).collect()}
        assert near == pytest.approx({(i, j): 1 - s[i, j] for i in range(30) for j in range(40) if 1 - s[i, j] <= 0.6})
        assert every == pytest.approx({(i, j): s[i, j] for i in range(30) for j in range(40)})


def test_oversample_ranks_a_leaf_in_parts(spark):
    import hashlib

    rows = spark.createDataFrame([(i, "abc"[min(i // 40, 2)], f"p{i}", "train") for i in range(300)], "id long, leaf string, path string, split string").where("id < 40 or id >= 73")
    out = curate.oversample(rows)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert all("_b" in x.split("ROWS" if "ROWS" in x else ")")[0] for x in plan.split("row_number() windowspecdefinition")[1:])  # no leaf is sorted whole
    want = {}
    for leaf, ids in (("a", range(40)), ("b", range(73, 80)), ("c", range(80, 300))):
        order = sorted(ids, key=lambda i: (hashlib.md5(f"7:p{i}".encode()).hexdigest(), f"p{i}"))
        extra = max(0, min(40, len(order) * 3) - len(order))
        want |= {i: 1 + extra // len(order) + (k < extra % len(order)) for k, i in enumerate(order)}
    assert {r.id: r.copies for r in out.collect()} == want


def test_round_robin(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3] if i < 20 else "a", i) for i in range(30)], "id long, leaf string, c long")
    assert curate.round_robin(df, 7, "leaf", F.desc("c")).count() == 9  # whole rounds


# ---- rules worked out by hand ----
def test_listing_text_keeps_abbreviations_and_place(spark):
    cols = [F.lit(x) for x in ("e_waste", "circuit_board", "good", "Hosur Road", "old PCB  with PET film, HDPE lids and PETS")]
    want = "circuit board e waste waste, good quality, Hosur Road. old PCB printed circuit board with PET polyethylene terephthalate film, HDPE high-density polyethylene lids and PETS"
    assert spark.range(1).select(search.listing_text(*cols).alias("t")).first().t == want
    assert "pet" in search.term_counts(spark.range(1).select("id", F.lit(want).alias("text"))).toPandas()["term"].tolist()


@pytest.mark.parametrize(
    ("right", "accepted", "both", "want"),
    [(8, 10, 8, "strong"), (8, 5, 5, "strong"), (8, 4, 4, "weak"), (9, 5, 4, "weak"), (7, 10, 7, "weak"), (6, 0, 0, "weak"), (5, 10, 5, "misclassified"), (0, 0, 0, "misclassified")],
)
def test_recognition(spark, right, accepted, both, want):
    """Of 10 readable photos: ``right`` are correct, ``accepted`` detected, ``both`` correct and detected; two more are unreadable and count nowhere."""
    rows = []
    for i in range(10):
        ok = i < right
        detected = i < both or (not ok and i >= 10 - (accepted - both))
        rows.append(("a", "a" if ok else "b", "detected" if detected else "confirm"))
    rows += [("a", "a", "failed")] * 2
    df = spark.createDataFrame([(*r, "s", 0.7, False, False, None) for r in rows], "truth string, pred string, status string, pred_sub string, confidence double, best_guess_correct boolean, memory_adjusted boolean, subtype_correct boolean")
    per = evaluate.per_category(df)
    assert [r.recognition for r in evaluate.recognition(per).collect()] == [want]
    r = per.where("truth is null").first()
    assert (r.images, r.valid, r.unreadable, r.correct, r.accepted, r.strong) == (12, 10, 2, right, accepted, both) and r.conf_median == 0.7
    assert r.predicted == ",".join(f"{k}={n}" for k, n in (("a", right), ("b", 10 - right)) if n)


def test_threshold_sweep_has_rows_that_nobody_passes(spark):
    rows = [("a", "a", "detected", 0.9, False), ("a", "b", "unknown", 0.6, True), ("a", "b", "detected", 0.6, False), ("a", "a", "failed", 1.0, True)]
    df = spark.createDataFrame(rows, "truth string, pred string, status string, confidence double, best_guess_correct boolean")
    got = {(r.threshold, r.mode): (r.accepted, r.correct_acceptance, r.false_acceptance, r.precision) for r in evaluate.threshold_sweep(df, [0.5, 0.95]).collect()}
    third = pytest.approx(1 / 3, abs=1e-6)
    assert got[0.5, "pipeline"] == (2, third, third, 0.5) and got[0.5, "confidence_only"] == (3, pytest.approx(2 / 3, abs=1e-6), third, pytest.approx(2 / 3, abs=1e-6))
    assert got[0.95, "pipeline"] == got[0.95, "confidence_only"] == (0, 0.0, 0.0, None)


def test_usable_feedback(spark):
    rows = [  # key, seq, day, actual, sub, correct, predicted, predicted_sub, files
        ("k1", 1, 5, "a", "x", True, "a", "x", 1), ("k1", 2, 5, "other", None, False, "a", "x", 1), ("k2", 3, 1, "a", "x", True, "a", "x", 1), ("k3", 4, 5, "b", "", False, "a", "x", 2), ("k4", 5, 5, "a", None, True, "a", "y", 1),
        ("k5", 6, 5, "a", None, False, "b", "x", 1), ("k6", 7, 5, "a", "zz", True, "a", "x", 1), ("k7", 8, 5, "a", "y", False, "b", None, 0), ("k8", 9, 5, None, None, False, "a", "x", 1),
    ]
    df = spark.createDataFrame(rows, "item_key string, seq long, day int, actual string, actual_sub string, is_correct boolean, predicted string, predicted_sub string, n_files int")
    df = df.withColumn("created_at", F.make_timestamp_ntz(F.lit(2024), F.lit(1), "day", F.lit(0), F.lit(0), F.lit(0.0)))
    children = spark.createDataFrame([("a", ["x", "y"]), ("b", ["only"])], "waste_type string, subs array<string>")
    got = {r.item_key: (r.reason, r.leaf) for r in feedback.usability(df, children, "2024-01-03 00:00:00").collect()}
    assert got == {
        "k1": ("no_class", None), "k2": ("before_reset", None), "k3": ("used", "b__only"), "k4": ("used", "a__y"), "k5": ("no_sub_type", None), "k6": ("no_sub_type", None), "k7": ("no_photo", None), "k8": ("no_class", None),
    }


def test_split_is_the_first_folder_from_the_root(spark):
    from loopgrade.sources.files import path_parts

    label, split = path_parts(F.col("p"))
    df = spark.createDataFrame([("/d/Train/test/cat/1.jpg",), ("/d/x/validation/1.jpg",), ("/d/cat/val.jpg",)], "p string").select(label.alias("l"), split.alias("s"))
    assert [tuple(r) for r in df.collect()] == [("cat", "train"), ("validation", "val"), ("cat", None)]


def test_quantiles_and_ranks(spark):
    import numpy as np

    rows = [(i, "ab"[i % 7 == 0] if i % 5 else None, float((i * 37) % 23) if i % 11 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, g string, x double")
    for by in ([], ["g"]):
        got = {(r.g if by else 0): (r.n, r.m, r.p) for r in ordered.quantiles(df.repartition(5), by, "x", {"m": 0.5, "p": 0.93}).collect()}
        for g, v in got.items():
            xs = [x for _, k, x in rows if x is not None and (not by or k == g)]
            assert v == (len(xs), pytest.approx(np.quantile(xs, 0.5)), pytest.approx(np.quantile(xs, 0.93)))
        assert len(got) == (3 if by else 1)
    ranks = {r.id: r["rank"] for r in ordered.rank_within(df.repartition(5), ["g"], [F.col("id").desc()]).collect()}
    for g in ("a", "b", None):
        ids = sorted((i for i, k, _ in rows if k == g), reverse=True)
        assert [ranks[i] for i in ids] == list(range(1, len(ids) + 1))


@pytest.mark.parametrize(("limit", "width", "large"), [(4, 63, 64), (4, 63, 2), (9, 256, 3), (0, 20, 64), (22, 256, 64)])
def test_hamming_pairs_are_lossless(spark, monkeypatch, limit, width, large):
    import random

    from loopgrade.operators import hamming

    rng = random.Random(limit)
    base = [rng.getrandbits(width) for _ in range(8)]
    xs = sorted({b ^ sum(1 << i for i in rng.sample(range(width), rng.randint(0, min(width, limit + 2)))) for b in base for _ in range(12)})
    monkeypatch.setattr(hamming, "LARGE", large)
    monkeypatch.setattr(hamming, "BLOCK", 4)
    words = lambda x: [((x >> 64 * w) & (1 << 64) - 1) - ((1 << 64) if x >> (64 * w + 63) & 1 else 0) for w in range(-(-width // 64))]
    df = spark.createDataFrame([(i, words(x)) for i, x in enumerate(xs)], "id long, words array<long>")
    got = sorted(map(tuple, hamming.pairs(df, limit, width).collect()))
    assert got == [(i, j, (xs[i] ^ xs[j]).bit_count()) for i in range(len(xs)) for j in range(i + 1, len(xs)) if (xs[i] ^ xs[j]).bit_count() <= limit]


def test_inverted_index_is_the_join(spark, monkeypatch):
    monkeypatch.setattr(inverted, "SEGMENT", 30)
    monkeypatch.setattr(inverted, "ASKED", 60)  # chunks of queries
    texts = [(i, " ".join(f"w{(i * k) % 29}" for k in range(1, 12)), f"s{i % 7}") for i in range(200)] + [(900, "", "s1"), (901, None, "lonely"), (902, "w1 w2", None)]
    docs = spark.createDataFrame(texts, "id long, text string, kind string")
    asked = spark.createDataFrame([*texts[:200:9], (990, "nothing known", "s3"), (991, None, "s3"), (992, "w1", "none"), (993, "w3 w4", "lonely")], "id long, text string, kind string")
    counts = search.term_counts(docs)
    idf = search.idf_table(counts, docs.count())
    w, q = search.weigh(counts, idf), search.weigh(search.term_counts(asked), idf)
    joined = w.join(q.select(F.col("id").alias("query_id"), "term", F.col("weight").alias("wq")), "term").groupBy("query_id", "id").agg(F.sum(F.col("wq") * F.col("weight")).alias("similarity"))
    every = {(r.query_id, r.id): r.similarity for r in joined.collect()}
    index = inverted.build(docs, "kind")
    asked_ = inverted.vectors(index, asked, "kind")
    got = {(r.query_id, r.id): r.similarity for r in inverted.search(index, asked_, None).collect()}
    assert got == {k: pytest.approx(x) for k, x in every.items()} and len(got) > 300
    want = sorted(map(tuple, search.top(joined, 4).select("query_id", "id", "rank").collect()))
    assert sorted(map(tuple, inverted.search(index, asked_, 4).select("query_id", "id", "rank").collect())) == want
    kinds = {i: k for i, _, k in texts}
    ranks = {r.query_id: r.first_rank for r in inverted.first_rank(index, asked_, "kind").collect()}
    for query, _, kind in asked.collect():
        order = sorted(kinds, key=lambda i: (-round(every.get((query, i), 0), 9), i))  # noqa: B023
        assert ranks[query] == next((n for n, i in enumerate(order, 1) if kinds[i] == kind), None)
    assert ranks[992] is None and ranks[993] > 10


def test_postings_stay_packed_and_rows_of_one_id_are_one_document(spark, monkeypatch):
    monkeypatch.setattr(inverted, "PIECE", 64)  # several rows a segment
    docs = spark.createDataFrame([(i % 290, " ".join(f"w{(i * k) % 31}" for k in range(1, 9))) for i in range(300)] + [(990, None), (991, "a")], "id long, text string")
    index = inverted.build(docs, stats=True)
    n, counts = 292, search.term_counts(docs)
    idf = search.idf_table(counts, n)
    raw = counts.join(idf, "term").groupBy("id", "term").agg(F.sum((1 + F.ln(F.col("n").cast("double"))) * F.col("idf")).alias("w"))
    want = {r.id: (r.n, r.top / r.norm, r.total / r.norm) for r in raw.groupBy("id").agg(F.count("*").alias("n"), F.max("w").alias("top"), F.sum("w").alias("total"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")).collect()}
    got = {i: (c, t, s) for r in index.docs.collect() for i, c, t, s in zip(r.ids, r.counts, r.tops, r.sums, strict=True)}
    assert {i: x for i, x in got.items() if x[0]} == {i: pytest.approx(x) for i, x in want.items()} and got[990][0] == 0 and index.n == n == len(got)
    postings = counts.count()
    assert {r.n for r in index.frequencies.groupBy().agg(F.sum("df").alias("n")).collect()} == {postings}
    assert index.docs.count() < index.packed.count() < postings / 20


def test_ranges_are_skipped(spark):
    rng = np.random.default_rng(2)
    n = 2000
    doc = np.sort(np.concatenate([rng.choice(n, 300, replace=False) for _ in range(40)]).reshape(40, 300), axis=1)
    weight = rng.random((40, 300)) ** 6
    rows = [(t, d // inverted.RANGE, d, w) for t in range(40) for d, w in zip(doc[t], weight[t], strict=True)]
    key = np.array([(t, p) for t, p, _, _ in rows])
    start = np.flatnonzero(np.append(True, (np.diff(key, axis=0) != 0).any(axis=1)))
    flat = np.array([w for *_, w in rows])
    s = inverted.Segment(np.arange(n), np.array([None] * n, object), key[start, 0], key[start, 1], np.maximum.reduceat(flat, start), start, np.diff(np.append(start, len(rows))), np.array([d for _, _, d, _ in rows]), flat)
    seen: dict = {}
    for k in range(20):
        terms, w = np.sort(rng.choice(40, 4, replace=False)), rng.random(4)
        total = s.score(*s.rows(terms, w))
        docs, scores, _ = inverted.best_of(s, terms, w, 5, 0.0, seen=seen)
        assert list(docs) == list(np.lexsort((np.arange(n), -np.round(total, 9)))[:5]) and scores == pytest.approx(total[docs])
        assert inverted.above_of(s, terms, w, round(float(scores[4]), 9), int(docs[4])) == 4
    assert seen["skipped"] > seen["scored"]


def test_dense_similarities_hold_few_pairs_at_a_time(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float((i * k) % 7 + 1) for k in range(1, 5)]) for i in range(90)], "id long, embedding array<float>")
    want = {(r.query_id, r.id): r.similarity for r in vectors.similarities(v.where("id % 3 = 0"), v, (2, 3)).collect()}
    monkeypatch.setattr(vectors, "QUERIES", 12)
    monkeypatch.setattr(vectors, "PAIRS", 50)
    got = vectors.similarities(v.where("id % 3 = 0"), v)
    assert "CoGroup" not in got._jdf.queryExecution().toString()
    rows = got.collect()
    assert len(rows) == 2700 and {(r.query_id, r.id): r.similarity for r in rows} == {k: pytest.approx(x) for k, x in want.items()}
    assert vectors.similarities(v.where("id < 0"), v).count() == 0


def test_metric_index_discards_blocks_and_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 40)
    monkeypatch.setattr(vectors, "PIVOTS", 6)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 16))
    table = lambda n, off, spread: [(off + i, i % 5, [float(x) for x in centres[i % 6] + spread * rng.normal(size=16)]) for i in range(n)]
    bank = spark.createDataFrame([*table(400, 0, 0.15), (700, 0, [1.0] * 16), (701, 1, [1.0] * 16)], "bank_id long, label int, embedding array<double>")
    asked = spark.createDataFrame([*table(90, 1000, 0.2), (2000, 0, [1.0] * 16), (2001, 0, [-1.0] * 16)], "id long, label int, embedding array<double>").select("id", "embedding")
    for k in (1, 100):
        got = sorted((r.id, r.bank_id, r.label, round(r.distance, 9)) for r in vectors.neighbours(asked, bank, k).collect())
        assert got == sorted((r.id, r.bank_id, r.label, round(r.distance, 9)) for r in vectors.neighbours(asked, bank, k, blocks=1).collect()) and len(got) == 92 * k
    memory = bank.withColumnRenamed("bank_id", "mem_id")
    near = lambda **how: sorted((r.id, r.mem_id, round(r.distance, 9)) for r in vectors.within(asked, memory, 0.1, **how).collect())
    assert near() == near(blocks=(1, 1)) and len(near()) > 1000
    at = vectors.pivots(bank, "bank_id", 6)
    pairs = vectors.block_pairs(vectors.placed(asked, "id", at), vectors.placed(bank, "bank_id", at), 6)
    assert pairs.where("apart * apart <= 0.2").count() < 0.4 * pairs.count()


def test_only_two_generations_stay(spark, tmp_path):
    from loopgrade.streaming import jobs

    for n in range(4):
        jobs.write_generation(spark.range(n + 1), str(tmp_path / "s"), n)
    assert sorted(p.name for p in (tmp_path / "s").iterdir()) == ["gen=2", "gen=3"] and jobs.read_last(spark, str(tmp_path / "s")).count() == 4


def test_open_set_needs_no_class_to_be_scanned_twice(spark):
    rows = [("abc"[i % 3], (i * 37 % 101) / 101, (i * 53 % 97) / 97) for i in range(300)]
    got = {r.unseen: r for r in evaluate.open_set(spark.createDataFrame(rows, "truth string, confidence double, knn double"), 0.2, 0.9).collect()}
    for c in "abc":
        own, rest = [r for r in rows if r[0] == c], [r for r in rows if r[0] != c]
        auc = lambda k, s: sum((s * a[k] > s * b[k]) + (a[k] == b[k]) / 2 for a in own for b in rest) / len(own) / len(rest)
        assert got[c].auroc_msp == pytest.approx(auc(1, -1), abs=1e-6) and got[c].auroc_knn == pytest.approx(auc(2, 1), abs=1e-6)
        assert got[c].rejected_combined == pytest.approx(sum(r[2] > 0.9 or r[1] < 0.2 for r in own) / len(own), abs=1e-6)


def test_floor_of_all_others_for_any_number_of_classes(spark):
    rows = [(f"c{i % 1200}", (i * 37 % 101) / 101, (i * 53 % 97) / 97) for i in range(4000)] + [("many", 0.001 * (i // 3), 0.5) for i in range(900)] + [("one", 0.0, 0.5)]
    got = {r.unseen: r for r in evaluate.open_set(spark.createDataFrame(rows, "truth string, confidence double, knn double"), 0.2, 0.9).collect()}
    assert len(got) == 1202
    for c in ("c0", "c7", "c1199", "many", "one"):
        floor = np.quantile([x for t, x, _ in rows if t != c], 0.05)
        own = [x for t, x, _ in rows if t == c]
        assert got[c].n == len(own) and got[c].rejected_msp == pytest.approx(sum(x < floor for x in own) / len(own), abs=1e-6)
    alone = evaluate.open_set(spark.createDataFrame([("a", 0.3, 0.1), ("a", 0.4, 0.2)], "truth string, confidence double, knn double"), 0.2, 0.9).first()
    assert (alone.n, alone.rejected_msp, alone.auroc_msp) == (2, None, None)


def test_curve_choice_and_reports(spark):
    # one photo whose type the memory mends under every curve; a far match (x = 0.9) mends another only where the step curve counts it in full
    leaves = spark.createDataFrame([(i, leaf, leaf[0], leaf[3:], p) for i in (1, 2) for leaf, p in (("a__p", 0.2), ("a__q", 0.1), ("b__p", 0.7))], "id long, leaf string, waste_type string, sub_type string, p double")
    near = spark.createDataFrame([(1, "a", "p", 0.0), (2, "a", "p", 0.45)], "id long, mem_type string, mem_sub string, distance double")
    truths = spark.createDataFrame([(1, "validation", "a", "a__p"), (2, "validation", "a", "a__p")], "id long, phase string, true_type string, true_leaf string")
    out = {r.curve: r for r in evaluate.choose_curve(evaluate.memory_curves(leaves, near, truths, 0.5)).collect()}
    assert {c: (r.type_fixed, r.leaf_fixed, r.matched, r.chosen) for c, r in out.items()} == {"linear": (1, 1, 2, False), "quadratic": (1, 1, 2, False), "step": (2, 2, 2, True)}
    # equal gains: the first curve
    assert [r.curve for r in evaluate.choose_curve(evaluate.memory_curves(leaves, near.where("id = 1"), truths.where("id = 1"), 0.5)).where("chosen").collect()] == ["linear"]

    items = spark.createDataFrame([("d", "l", 10, 20, "RGB"), ("d", "l", 10, 20, "L"), ("d", "l", 30, 5, "RGB"), ("d", "l", None, None, None)], "dataset string, leaf string, w int, h int, mode string")
    r = curate.size_inventory(items).first()
    assert (r.images, r.unreadable, r.min_side, r.max_side, r.median_w, r.median_h, r.most_common, r.modes) == (4, 1, 5, 30, 10, 20, "10x20=2,30x5=1", "L=1,RGB=2")


def test_near_kinds_against_all_pairs(spark):
    from itertools import combinations

    rows = [(i, i % 4, f"x{i}" if i % 5 else "same" + str(i % 4), f"d{i % 2}", f"l{i % 3}", (None, "train", "val")[i % 7 % 3], f"p{i:03d}") for i in range(60)]
    rows += [(100 + i, 50, f"y{i}", "d9", "l9", None, f"q{i}") for i in range(10)] + [(200 + i, 60, "z" if i < 9 else "w", "d8", "l8", None, f"r{i}") for i in range(10)]
    df = spark.createDataFrame(rows, "id long, cls long, digest string, dataset string, leaf string, split string, path string")
    linked = {(0, 1), (1, 3)}
    near = [(a, b) for a, b in combinations(rows, 2) if (a[1] == b[1] or (min(a[1], b[1]), max(a[1], b[1])) in linked) and a[2] != b[2]]
    want: dict = {}
    for a, b in near:
        kind = "cross_dataset" if a[3] != b[3] else "cross_label" if a[4] != b[4] else "cross_split" if a[5] != b[5] else "same_folder"
        x, y = sorted((f"{a[3]}/{a[4]}", f"{b[3]}/{b[4]}"))
        want.setdefault((kind, x, y), set()).add(tuple(sorted((a[6], b[6]))))
    counts, examples = curate.near_kinds(df, spark.createDataFrame([(0, 1), (1, 3)], "a long, b long"))
    assert {(r.kind, r.a, r.b): r.n for r in counts.collect()} == {k: len(v) for k, v in want.items()}
    first = {(k, rank, *pair) for k, v in want.items() for rank, pair in enumerate(sorted(v)[:4], 1)}
    assert {((r.kind, r.a, r.b), r["rank"], r.path_a, r.path_b) for r in examples.collect()} == first


@pytest.mark.parametrize("large", [3])
def test_near_groups_by_three_tests_with_a_forest(spark, monkeypatch, large):
    monkeypatch.setattr(hamming, "LARGE", large)
    monkeypatch.setattr(hamming, "BLOCK", 8)
    rng = np.random.default_rng(6)
    base = np.floor(rng.normal(size=(9, 64)) * 2) / 4
    rows = []
    for i in range(90):  # neighbours at 5 to 10 bits, beyond, and equal ones; a third group is dense
        v = base[0 if i % 3 == 0 else 1 + i % 8].copy()
        at = rng.choice(64, rng.integers(0, 9 if i % 3 else 5), replace=False)
        v[at] += 0.001
        if i % 11 == 5:
            v += np.where(np.arange(64) % 2, 0.2, 0)  # near by the hashes of some, far by the mean difference
        rows.append((i, v.tolist()))
    df = spark.createDataFrame(rows, "id long, v array<double>").withColumn("hash", vectors.gradient_hash(F.col("v"))).withColumn("wide", vectors.wide_hash(F.col("v")))
    got = df.collect()
    bits = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    near = {(a.id, b.id): bits(a.hash, b.hash) for a in got for b in got if a.id < b.id and bits(a.hash, b.hash) <= 10 and sum(map(bits, a.wide, b.wide)) <= 22 and np.abs(np.subtract(a.v, b.v)).mean() <= 0.001}
    assert any(5 <= n <= 10 for n in near.values()) and len(near) > 300
    parent = {r.id: r.id for r in got}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in sorted(near):
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    edges = vectors.near_images(df, mean_difference=0.001, forest=True).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    groups = curate.duplicate_groups(df.select("id", F.concat(F.lit("d"), "id").alias("digest")), edges)
    assert {r.id: r.grp for r in groups.collect()} == {r.id: root(r.id) for r in got}
    assert {(r.src, r.dst) for r in edges.collect()} <= set(near)
    if large == 3:
        assert edges.distinct().count() < vectors.near_images(df, mean_difference=0.001).count()


def test_grid_of_recyclers_scores_few_pairs():
    import pandas as pd

    rng = np.random.default_rng(1)
    n = 6000
    rec = pd.DataFrame({"waste_type": "a", "recycler_id": rng.permutation(n), "lat": 12 + rng.integers(0, 2001, n) / 1000, "lon": 77 + rng.integers(0, 2001, n) / 1000, "capacity": 10_000 + rng.integers(0, 190_000, n), "n_types": rng.integers(1, 5, n)})
    rec.loc[3, "lat"] = np.nan
    need = pd.DataFrame({"waste_id": range(300), "waste_type": rng.choice(list("az"), 300), "quantity_kg": rng.integers(1, 400_000, 300).astype(float), "lat": 12 + rng.integers(0, 2001, 300) / 1000, "lon": 77 + rng.integers(0, 2001, 300) / 1000})
    need.loc[5, ["waste_type", "lon"]] = "a", np.nan
    need.loc[6, "quantity_kg"] = np.nan
    seen: dict = {}
    got = ranking._best(need, ranking.grids(rec), 5, seen)
    rec, mine = rec.sort_values("recycler_id", ignore_index=True), need[need["waste_type"] == "a"]
    total = ranking._scores(mine, rec)[1]
    want = [(w, k, rec["recycler_id"].iloc[c]) for w, t in zip(mine["waste_id"], total, strict=True) for k, c in enumerate(np.argsort(-t, kind="stable")[:5], 1)]
    assert sorted(zip(got["waste_id"], got["rank"], got["recycler_id"], strict=True)) == want
    assert seen["pairs"] < 0.35 * len(mine) * n


def test_cells_of_recyclers_are_near_in_capacity_too():
    import pandas as pd

    rng = np.random.default_rng(3)
    n, m = 40_000, 20_000
    rec = pd.DataFrame({"waste_type": "a", "recycler_id": np.arange(n), "lat": 12.8 + rng.integers(0, 401, n) / 1000, "lon": 77.5 + rng.integers(0, 301, n) / 1000, "capacity": 10_000 + rng.integers(0, 190_000, n), "n_types": rng.integers(1, 5, n)})
    need = pd.DataFrame({"waste_id": np.arange(m), "waste_type": "a", "quantity_kg": rng.integers(185_000, 262_000, m), "lat": 12.8 + rng.integers(0, 401, m) / 1000, "lon": 77.5 + rng.integers(0, 301, m) / 1000})
    rec.loc[[9, 10], ["lat", "capacity"]] = np.nan  # no place, and no capacity: that counts as enough
    rec.loc[11, "capacity"] = np.nan
    seen: dict = {}
    got = ranking._best(need, ranking.grids(rec), 5, seen)
    some = need.index[::200]
    total = ranking._scores(need.loc[some], rec)[1]
    want = {(w, k, c) for w, t in zip(some, total, strict=True) for k, c in enumerate(np.argsort(-t, kind="stable")[:5], 1)}
    got = got[got["waste_id"].isin(some)]
    assert set(zip(got["waste_id"], got["rank"], got["recycler_id"], strict=True)) == want
    assert seen["pairs"] < 400 * m


def test_many_recyclers_are_one_block_and_near_listings_share_cells(spark):
    import pandas as pd

    rng = np.random.default_rng(2)
    n, m = 60_000, 3000
    rec = pd.DataFrame({"waste_type": "a", "recycler_id": np.arange(n), "lat": 12.8 + rng.integers(0, 401, n) / 1000, "lon": 77.5 + rng.integers(0, 301, n) / 1000, "capacity": 10_000 + rng.integers(0, 190_000, n), "n_types": 1})
    need = pd.DataFrame({"waste_id": np.arange(m), "waste_type": "a", "quantity_kg": rng.integers(30_000, 250_000, m), "lat": 12.8 + rng.integers(0, 401, m) / 1000, "lon": 77.5 + rng.integers(0, 301, m) / 1000})
    need.loc[7, "lat"] = np.nan  # without a place all are equal: the first ids
    seen: dict = {}
    got = ranking._best(need, ranking.grids(rec), 3, seen)
    some = need[::100].index.union([7])
    total = ranking._scores(need.loc[some], rec)[1]
    want = {(w, k, c) for w, t in zip(some, total, strict=True) for k, c in enumerate(np.argsort(-t, kind="stable")[:3], 1)}
    found = set(zip(got["waste_id"], got["rank"], got["recycler_id"], strict=True))
    assert want <= found and len(found) == 3 * m and seen["pairs"] < 0.05 * m * n
    types = spark.createDataFrame(rec.drop(columns=["waste_type", "n_types"])).withColumn("types", F.array(F.lit("a")))
    ranked = ranking.rank_recyclers(spark.createDataFrame(need), types, 3)
    assert "CoGroup" not in ranked._jdf.queryExecution().toString()
    assert {(r.waste_id, r.rank, r.recycler_id) for r in ranked.collect()} == found


def test_item_results(spark):
    # item 1: two photos of three say b; mean distance 0.5, one near photo; item 2: a distance is missing, so nothing is tested; item 3: shown apart
    probs = {1: (0.2, 0.8), 2: (0.3, 0.7), 3: (0.6, 0.4), 4: (0.1, 0.9), 5: (0.2, 0.8), 6: (0.9, 0.1), 7: (0.45, 0.55), 8: (0.3, 0.7), 9: (0.4, 0.6)}
    leaves = spark.createDataFrame([(i, leaf, leaf[0], "p", p) for i, ps in probs.items() for leaf, p in zip(("a__p", "b__p"), ps, strict=True)], "id long, leaf string, waste_type string, sub_type string, p double")
    rows = [(1, 1, True, "b", 0.3, True, 0.0, 2, 0.2, 0.5, ["z"]), (2, 1, True, "b", 0.5, True, 0.0, None, None, None, None), (3, 1, True, "a", 0.7, False, 0.0, None, None, None, None)]
    rows += [(4, 2, True, "b", None, True, 0.0, None, None, None, None), (5, 2, True, "b", 9.0, True, 0.0, None, None, None, None)]
    rows += [(6, 3, False, "a", 9.0, False, 0.0, None, None, None, None), (7, 3, False, "b", None, True, 0.7, 1, 0.1, 0.4, ["other"])]
    rows += [(8, 4, True, "b", 0.1, False, 0.0, 1, 0.3, 0.2, ["other"]), (9, 4, True, "b", 0.1, False, 0.0, 3, 0.1, 0.9, ["y", "x"])]
    photos = spark.createDataFrame(rows, "id long, item long, same_item boolean, best_type string, knn double, small boolean, other_mass double, n_similar long, nearest double, weight double, labels array<string>")
    by_type = spark.createDataFrame([("a", 0.4, 1.0), ("b", 0.4, 1.0)], "waste_type string, knn_threshold double, far_threshold double")
    got = {(r.item, r.id): r for r in predict.group_results(photos, leaves, by_type, 0.4, 0.5, 0.6, "b").collect()}
    r = got[1, None]
    assert (r.n_images, r.agreement, r.waste_type, r.status, r.is_confident, r.small_image, r.n_similar, r.labels) == (3, 2, "b", "detected", True, False, 2, "z")
    assert r.type_confidence == pytest.approx(1.9 / 3) and r.knn == pytest.approx(0.5)
    r = got[2, None]
    assert (r.status, r.is_confident, r.small_image, r.knn, r.labels) == ("confirm", False, True, None, "")  # only the guard of small photos
    assert (got[3, 6].status, got[3, 6].n_images, got[3, 7].status, got[3, 7].agreement) == ("unknown", 1, "unknown", 1)
    r = got[4, None]
    assert (r.status, r.n_similar, r.nearest, r.weight, r.labels) == ("unknown", 4, 0.1, 0.9, "other,x,y") and len(got) == 5  # all near, one to other alone


def test_leakage_report(spark):
    rows = [("1", "1", "a", "train", "d1", False), ("2", "2", "a", "val", "d1", False), ("3", "3", "a", "test", "d2", False), ("4", "3", "b", "train", "d2", False), ("5", "5_rep", "a", "train", "d1", True), ("6", "6_rep", "c", "val", "d9", True), ("7", "7", "a", "train", "d1", False)]
    df = spark.createDataFrame(rows, "path string, stem string, leaf string, split string, digest string, is_copy boolean")
    got = {r.check: (r.bad, r.verdict) for r in curate.leakage_checks(df, spark.createDataFrame([("a",)], "leaf string")).collect()}
    assert got == {"class_in_every_split": (2, "FAIL"), "class_in_mapping": (1, "FAIL"), "copy_in_train": (1, "FAIL"), "stem_once": (1, "FAIL"), "digest_in_one_split": (2, "FAIL"), "files": (7, None), "unique_files": (5, None), "copies": (2, None), "repeated_digests": (3, None)}
    clean = df.where("path in ('1', '3')").withColumn("split", F.lit("train"))
    assert {r.verdict for r in curate.leakage_checks(clean, spark.createDataFrame([("a",)], "leaf string")).collect()} == {"PASS", None}
    files_ = spark.createDataFrame([(1, "train", "a"), (1, "train", "a"), (1, "val", "a"), (2, "val", "b"), (3, "test", "b")], "cls long, split string, leaf string")
    near = curate.near_between_splits(files_, spark.createDataFrame([(1, 2)], "a long, b long"))
    assert sorted(map(tuple, near.collect())) == [("train", "train", "a", "a", 1), ("train", "val", "a", "a", 2), ("train", "val", "a", "b", 2), ("val", "val", "a", "b", 1)]


def test_listing_search_from_text_to_ranking(spark):
    listings = spark.createDataFrame([(i, "AB"[i % 2], "s", 100 * i, ("good", "fair")[i % 3 % 2], 12.9 + i / 100, 77.6) for i in range(1, 40)], "waste_id long, waste_type string, sub_type string, quantity_kg long, quality string, lat double, lon double")
    text = F.concat(F.lit("bales of "), F.when(F.col("waste_id") % 5 == 0, "cotton scrap").otherwise("steel"), F.lit(" item"), F.col("waste_id"))
    session = listings.where("waste_id = 5").withColumn("waste_id", F.lit(500).cast("long")).withColumn("text", F.lit("cotton scrap cotton scrap"))
    needs = spark.createDataFrame([(1, "cotton scrap", 12.9, 77.6, None, None, None, None), (2, " ", 12.9, 77.6, "A", None, None, None), (3, "nothing known", None, None, None, None, 1000.0, ["good"]), (4, None, None, None, "C", None, None, None)], "need_id long, text string, lat double, lon double, waste_type string, sub_type string, min_quantity double, qualities array<string>")
    index = inverted.build(listings.select(F.col("waste_id").alias("id"), text.alias("text")))
    got: dict = {}
    for r in search.find_listings(index, listings, needs, 5, session).orderBy("need_id", "rank").collect():
        got.setdefault(r.need_id, []).append(r)
    assert got[1][0].waste_id == 500 and got[1][0].is_session and {r.waste_id % 5 for r in got[1]} == {0}
    assert [r.waste_id for r in got[2]] == [2, 4, 6, 8, 12] or all(r.waste_id % 2 == 0 and r.similarity == 0 for r in got[2])
    assert all(r.distance_km is None and r.waste_id >= 10 for r in got[3]) and [r.waste_id for r in got[3]][0] == 39 and 4 not in got


def test_needs_meet_listings_beside_the_index(spark, monkeypatch):
    from loopgrade.operators import inverted, search

    listings = spark.range(2000).selectExpr("id waste_id", "'A' waste_type", "'s' sub_type", "id * 10 % 7001 quantity_kg", "'good' quality", "12.9 + id / 10000 lat", "77.5D lon", "concat('old cotton w', id % 50, ' lot') text")
    listings = listings.withColumns({c: F.col(c).cast("double") for c in ("lat", "lon")})
    needs = spark.createDataFrame([(n, f"cotton w{n}", 12.9, 77.5, None, None, None, None) for n in range(3)], "need_id long, text string, lat double, lon double, waste_type string, sub_type string, min_quantity double, qualities array<string>")
    index, sizes = inverted.build(listings.where("waste_id % 100 <> 7").select(F.col("waste_id").alias("id"), "text")), []
    kept = search.written
    monkeypatch.setattr(search, "written", lambda df, *more: sizes.append(kept(df, *more)) or sizes[-1])
    got = search.find_listings(index, listings.where("waste_id % 100 <> 7"), needs, 4, listings.where("waste_id % 100 = 7")).collect()
    assert {(r.need_id, r["rank"]) for r in got} == {(n, k) for n in range(3) for k in range(1, 5)} and all(r.waste_id % 50 == r.need_id for r in got)
    assert [r.waste_id for r in sorted(got) if r.need_id == 1] == [1, 51, 101, 151] and not any(r.is_session for r in got)
    assert max(x.count() for x in sizes) < 1000  # 6000 pairs share a word


def test_texts_are_split_together_as_alone():
    from loopgrade.operators import inverted

    texts = ["a bb bb cc", None, "", "bb\0cc dd bb", "\0", "über 12 x_y bb bb bb", "zz"]
    term, row, times = inverted._postings_of(texts)
    alone = inverted._hasher()
    want = sorted((int(t), i, int(n)) for i, text in enumerate(texts) for t, n in zip(*alone(text), strict=True))
    assert list(zip(term.tolist(), row.tolist(), times.tolist(), strict=True)) == want


def test_annotations_meet_in_parts_that_grow(spark, monkeypatch):
    objects = spark.range(3000).selectExpr("id % 100 image", "id % 7 cat")
    images = spark.range(90).selectExpr("id image", "concat('f', id % 3) file").unionByName(spark.createDataFrame([(5, "g")], "image long, file string"))
    cats = spark.range(6).selectExpr("id cat", "concat('c', id % 4) category")
    monkeypatch.setattr(curate, "ANNOTATIONS", 100)
    out = curate.annotations(objects, images, cats, "image", "cat")
    assert out.rdd.getNumPartitions() == 30
    want: dict = {}
    for i in range(3000):
        image, cat = i % 100, i % 7
        for file in ([f"f{image % 3}"] if image < 90 else []) + (["g"] if image == 5 else []):
            if cat < 6:
                key = image, file, f"c{cat % 4}"
                want[key] = want.get(key, 0) + 1
    assert {(r.image, r.file, r.category): r.objects for r in out.collect()} == want


def test_curation_computes_its_input_once(spark):
    def slow(batches):
        yield from batches

    rows = [(i, i // 2, f"d{i % 40}", "ab"[i % 3 > 0], (None, "train")[i % 2], f"p{i}", 2000) for i in range(60)]
    rows = spark.createDataFrame(rows, "id long, grp long, digest string, leaf string, split string, path string, n_chars long")
    rows = rows.mapInPandas(slow, rows.schema)
    for of in (curate.dedup, curate.oversample, lambda r: curate.shadow_copies(r, 0.5, 1000)):
        out = of(rows)
        assert "MapInPandas" not in out._jdf.queryExecution().optimizedPlan().toString() and out.count() >= 30


def test_matches_are_folded_where_they_meet(spark, monkeypatch):
    rng = np.random.default_rng(11)
    q, b = rng.normal(size=(40, 6)), rng.normal(size=(90, 6))
    q[0] = b[0]
    names = [("a", "p"), ("b", "q"), ("d", None)]
    qs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "id long, embedding array<double>")
    ms = spark.createDataFrame([(i, *names[i % 3], v.tolist()) for i, v in enumerate(b)], "mem_id long, mem_type string, mem_sub string, embedding array<double>")
    x = 1 - (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
    want = {}
    for i, j in zip(*np.nonzero(x <= 0.75), strict=True):
        share = min(max(x[i, j] / 0.75, 0.0), 1.0)
        cell = want.setdefault((i, *names[j % 3]), {c: [] for c in predict.CURVES})
        for c, w in (("linear", 1 - share), ("quadratic", 1 - share * share), ("step", 1.0)):
            cell[c].append(w)
    for block, step, blocks in ((16_384, 2048, (2, 3)), (32, 7, None), (16_384, 2048, None)):  # blocks of both sides, the metric index, one block
        monkeypatch.setattr(vectors, "BLOCK", block)
        monkeypatch.setattr(vectors, "STEP", step)
        out = vectors.within_folded(qs, ms, 0.75, predict.CURVES, ["mem_type", "mem_sub"], blocks)
        got = {(r.id, r.mem_type, r.mem_sub): r for r in out.collect()}
        assert got.keys() == want.keys()
        for k, cell in want.items():
            for c, w in cell.items():
                assert got[k][f"w_{c}"] == pytest.approx(sum(w)) and got[k][f"top_{c}"] == pytest.approx(max(w))
    assert vectors.within_folded(qs.where("id < 0"), ms, 0.75, predict.CURVES, ["mem_type", "mem_sub"]).count() == 0


def test_pairs_of_a_curve_choice_do_not_leave_their_task(spark):
    from loopgrade.plans import learning

    rows = spark.createDataFrame([(i, [1.0, 0.001 * i], i % 10) for i in range(900)], "vec_id long, embedding array<float>, label int")
    met, kept = [], learning.cut
    with pytest.MonkeyPatch.context() as m, tempfile.TemporaryDirectory() as d:
        rows.write.parquet(f"{d}/embeddings.parquet")
        m.setattr(learning, "cut", lambda df: met.append(kept(df)) or met[-1])
        assert learning.QUERIES["g_33_curve_choice"](spark, d).count() == 6
    assert met[0].count() <= 4 * 900  # all vectors are near one another: 135,000 pairs


def test_small_buckets_are_not_stored_before_they_meet(spark, monkeypatch):
    stored, kept = [], hamming.cut
    monkeypatch.setattr(hamming, "cut", lambda df: stored.append(kept(df)) or stored[-1])
    df = spark.createDataFrame([(i, [i * 0x9E3779B97F4A7C15 % (1 << 62)]) for i in range(200)] + [(900, [0x9E3779B97F4A7C15 % (1 << 62) ^ 5])], "id long, words array<long>")
    assert [tuple(r) for r in hamming.pairs(df, 4, 63).where("b = 900").collect()] == [(1, 900, 2)]
    assert sum(df.count() for df in stored) == 0
