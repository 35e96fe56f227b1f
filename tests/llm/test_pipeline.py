"""The whole pipeline against a brute-force one, and on odd and empty tables."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loopgrade.llm import decontamination
from tests.llm.test_operators import DOCS, ODD, WORD, brute_counts, brute_fingerprint, brute_spans, prose, smith_waterman


def put(spark, tmp_path, rows, bench):
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def normal(line):
    return " ".join(WORD.findall(line)).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000"))


def quality(docs):
    lines = [[(x, normal(x)) for x in (t or "").split("\n")] for _, t, _ in docs]
    texts, owner = defaultdict(set), {}
    for (i, t, s), own in zip(docs, lines, strict=True):
        for _, n in own:
            if n:
                texts[s, n].add(t)
                owner[s, n] = min(owner.get((s, n), i), i)
    out = []
    for (i, t, s), own in zip(docs, lines, strict=True):
        n_words, *_, repeats = brute_counts(t or "")
        gone = {n for _, n in own if n and len(texts[s, n]) > 10 and owner[s, n] != i}
        lost = sum(len(WORD.findall(x)) for x, n in own if n in gone)
        if n_words >= 50 and 100 * repeats <= 50 * n_words and lost <= 0.5 * n_words and n_words - lost >= 50:
            out.append((i, "\n".join(x for x, n in own if n not in gone), s))
    return out


def near_dedup(docs):
    fps = [brute_fingerprint(t) for _, t, _ in docs]
    group = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    first = {}
    for g, d in sorted(zip(group, docs, strict=True), key=lambda x: x[1][0]):
        first.setdefault(g, d)
    return sorted(first.values())


def decontaminate(docs, bench):
    items = [decontamination.words((t or "").encode()) for _, t in bench]
    return [d for d in docs if not any(x and smith_waterman(decontamination.words(d[1].encode()), x) >= 0.5 for x in items)]


def pii(docs):
    out = []
    for i, t, s in docs:
        new, at = "", 0
        for span in brute_spans(t).split(",") if brute_spans(t) else []:
            kind, start, end = span.split(":")
            if int(start) >= at:
                new += t[at : int(start)] + f"[{kind.upper()}]"
            at = max(at, int(end))
        out.append((i, new + t[at:], s))
    return out


def mix(docs):
    size = {i: len(WORD.findall(t)) for i, t, _ in docs}
    total, of = sum(size.values()), Counter()
    for i, _, s in docs:
        of[s] += size[i]
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(of))}
    full = set()
    while True:
        share = (total - sum(3 * of[s] for s in full)) / sum(w for s, w in weight.items() if s not in full)
        over = {s for s, w in weight.items() if s not in full and share * w > 3 * of[s]}
        if not over:
            break
        full |= over
    queue = []
    for s in of:
        target, run = 3 * of[s] if s in full else share * weight[s], 0
        md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
        for key, i in sorted((md5(f"mix:{i}:{md5(t)}"), i) for i, t, x in docs if x == s):
            run += size[i]
            queue += [((p * of[s] + run) / target, "=" + s, key, i) for p in range(3)]
    taken, run = Counter(), 0
    for *_, i in sorted(queue):
        run += size[i]
        if run > total:
            break
        taken[i] += size[i]
    return {(i, size[i], taken[i]) for i in size}


def test_pipeline_is_its_brute_force(spark, tmp_path):
    item, other = prose(1, 30), prose(2, 12)
    edited = item.split()
    edited[7], edited[15] = "changed", "words"
    notice = prose(77, 40)
    text = lambda i, n=70: "\n".join(prose(10**6 + 1000 * i + k, n // 5) for k in range(5))
    rows = [(i, f"home about contact\n{text(i)}\n{notice}", "a") for i in range(14)]  # a short and a long boilerplate line
    rows += [(20 + i, f"{notice}\n{text(30, 60)}\nown {prose(i, 3)}", "b") for i in range(12)]  # near copies: the first stays whole
    rows += [(40, text(50, 400), "c"), (41, text(50, 400) + " more", "c"), (42, text(50, 400), "a"), (43, text(51), "c"), (44, text(52), "c")]
    rows += [(50, f"{text(60)} {item} {prose(3, 9)}", "a"), (51, f"{text(61)}\n{' '.join(edited).upper()}.", "b"), (52, f"{text(62)} {other} {prose(4, 50)}", "c")]
    rows += [(60, f"{text(70)} mail me@ex.org or +1 (017) 555-7713 from 10.0.0.1", "a"), (61, f"4111 1111 1111 1111 {text(71)}", "b"), (62, "word " * 80, "b"), (63, "short", "b"), (64, "", "a")]
    bench = [(1, item), (2, other), (3, ""), (4, None)]
    d = put(spark, tmp_path, rows, bench)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    want = sorted(rows)
    for (name, stage), brute in zip(corpus_pipeline.STAGES[:-1], (quality, near_dedup, lambda x: decontaminate(x, bench), pii), strict=True):
        docs = spark.createDataFrame(stage(spark, docs, d).collect(), DOCS)
        want = brute(want)
        assert sorted((r.doc_id, r.text, r.source) for r in docs.collect()) == sorted(want), name
        assert all(r.n_chars == len(r.text) for r in docs.collect())
    ids = {i for i, *_ in want}
    assert {0, 13, 20, 40, 43, 60, 61} <= ids and not ids & {21, 31, 41, 42, 50, 51, 52, 62, 63, 64}
    assert notice in dict((i, t) for i, t, _ in want)[0] and notice not in dict((i, t) for i, t, _ in want)[13]
    got = {(r.doc_id, r.size, r.taken) for r in corpus_pipeline.run(spark, d).collect()}
    assert got == mix(want)


@pytest.mark.parametrize("rows", [ODD, []])
def test_pipeline_on_odd_and_empty_tables(spark, tmp_path, rows):
    d = put(spark, tmp_path, [], [(1, "a few words"), (None, None)])
    odd = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)
    odd = odd.withColumn("row", F.lit(1)).withColumn("key_1", F.lit("x")).withColumn("fp", F.lit(0)).withColumn("item_no", F.lit(3)).withColumn("th", F.lit(None).cast("string"))
    odd.write.mode("overwrite").parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, d).columns == odd.columns
    out = corpus_pipeline.run(spark, d).collect()
    assert out == []  # no odd row passes the quality rules
