"""Model evaluation over tables of truths, predictions and confidences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopgrade.functions.labels import wilson
from loopgrade.functions.session import bounded, cut
from loopgrade.operators.ordered import quantiles, running
from loopgrade.operators.predict import CURVES, blend_weighted, memory_weight


def share(c: Column) -> Column:
    """Mean of a condition, null rows left out."""
    return F.round(F.avg(c.cast("double")), 6)


def confusion(rows: DataFrame) -> DataFrame:
    return rows.where("truth is not null and pred is not null").groupBy("truth", "pred").agg(F.count("*").alias("n"))


def confusion_wide(rows: DataFrame, labels: list) -> DataFrame:
    return rows.where("truth is not null").groupBy("truth").pivot("pred", labels).count().na.fill(0)


def per_class(rows: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where undefined. One pass: every row counts once for its truth and once for its prediction."""
    hit = (F.col("truth") == F.col("pred")).cast("long")
    sides = F.array(F.struct(F.col("truth").alias("label"), hit.alias("tp"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).alias("t"), F.lit(1).alias("p")))
    g = rows.select(F.explode(sides).alias("x")).groupBy("x.label").agg(F.sum("x.tp").alias("tp"), F.sum("x.t").alias("support"), F.sum("x.p").alias("predicted"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    g = g.withColumn("precision", ratio("tp", "predicted")).withColumn("recall", ratio("tp", "support"))
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return g.select("label", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(f1, 6).alias("f1"), "support")


def macro_f1(rows: DataFrame) -> DataFrame:
    return per_class(rows).agg(F.round(F.avg("f1"), 4).alias("macro_f1"))


def accuracy(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"), share(F.col("truth") == F.col("pred")).alias("accuracy"))


def accuracy_sets(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Accuracy per ``a`` and per (``a``, ``b``) in one aggregation."""
    return rows.rollup(a, b).agg(F.count("*").alias("n"), share(F.col("truth") == F.col("pred")).alias("accuracy"), F.grouping(F.col(b)).cast("int").alias("all_of_b")).where(F.col(a).isNotNull())


def top_accuracy(rolled: DataFrame, truths: DataFrame, k: int = 3) -> DataFrame:
    """Per true leaf and of all (leaf null): n, shares whose leaf and type are first or among the ``k`` first, and the share flagged as unknown.

    ``rolled``: of :func:`predict.roll_up`. ``truths``: id, true_leaf, true_type, unknown. One pass: the leaves of a row are in it.
    """
    order = F.array_sort(F.transform("leaves", lambda x: F.struct((-x["p"]).alias("minus"), x["leaf"].alias("leaf"))))
    first = F.transform(F.slice(order, 1, k), lambda x: x["leaf"])
    j = truths.join(rolled.select("id", first.alias("first"), "ranked_types"), "id")
    in_ = lambda a, n, c: share(F.array_contains(F.slice(a, 1, n), F.col(c)))
    return j.rollup("true_leaf").agg(
        F.count("*").alias("n"), in_("first", 1, "true_leaf").alias("leaf_top1"), in_("first", k, "true_leaf").alias("leaf_top3"),
        in_("ranked_types", 1, "true_type").alias("type_top1"), in_("ranked_types", k, "true_type").alias("type_top3"), share(F.col("unknown")).alias("flagged_unknown"),
    )


def new_types(rows: DataFrame, known: list[str]) -> DataFrame:
    """Types that the old model doesn't know: n, what it calls them, as counts, and the new model's accuracy. ``rows``: truth, before, after."""
    fresh = rows.where(~F.col("truth").isin(known))
    called = _counted(fresh, "truth", F.col("before")).where(~F.col("_all")).select("_truth", F.col("text").alias("called_before"))
    g = fresh.groupBy("truth").agg(F.count("*").alias("n"), share(F.col("truth") == F.col("after")).alias("accuracy_after"))
    return g.join(bounded(called), F.col("truth") == F.col("_truth"), "left").drop("_truth")


def frequent_confusions(rows: DataFrame, k: int) -> DataFrame:
    """The most frequent confusions, with the accepted ones and the share of the true class that went there."""
    every = rows.groupBy("truth").agg(F.count("*").alias("_all")).select(F.col("truth").alias("_t"), "_all")
    wrong = rows.where("truth <> pred").groupBy("truth", "pred").agg(F.count("*").alias("n"), F.count_if("accepted").alias("accepted"))
    wrong = wrong.join(every, F.col("truth") == F.col("_t")).withColumn("share", F.round(F.col("n") / F.col("_all"), 6)).drop("_t", "_all")
    return wrong.orderBy(F.desc("n"), "truth", "pred").limit(k)


#: Edges of the reliability histogram.
RELIABILITY = (0.0, 0.5, 0.7, 0.9, 0.97, 0.99, 1.0001)


def reliability(rows: DataFrame, edges: tuple[float, ...] = RELIABILITY) -> DataFrame:
    """Half-open bins [lo, hi): rows, mean confidence, accuracy."""
    bin_ = F.coalesce(*[F.when((F.col("confidence") >= lo) & (F.col("confidence") < hi), F.lit(k)) for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))])
    g = rows.withColumn("bin", bin_).where("bin is not null").groupBy("bin")
    return g.agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"), share(F.col("truth") == F.col("pred")).alias("accuracy"))


def ece(rows: DataFrame, bins: int = 15) -> DataFrame:
    """Expected calibration error over bins (lo, hi]; a confidence of 0 falls in none, but counts in the total."""
    b = F.ceil(F.round(F.col("confidence") * bins, 9))
    cells = rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("c"), F.avg((F.col("truth") == F.col("pred")).cast("double")).alias("a"))
    part = F.when(F.col("bin").between(1, bins), F.col("n") * F.abs(F.col("c") - F.col("a")))
    return cells.agg(F.round(F.sum(part) / F.sum("n"), 6).alias("ece"))


def nll(true_p: DataFrame) -> DataFrame:
    """Mean negative log likelihood of the true type, probabilities clipped to [1e-6, 1]."""
    return true_p.agg(F.round(F.avg(-F.ln(F.greatest(F.least("p", F.lit(1.0)), F.lit(1e-6)))), 6).alias("nll"))


def acceptance(rows: DataFrame, *by: str) -> DataFrame:
    ok = F.col("truth") == F.col("pred")
    return rows.groupBy(*by).agg(
        share(ok).alias("accuracy"), share(F.col("status") == "unknown").alias("unknown_rate"), share(F.col("accepted")).alias("acceptance"), share(ok & F.col("accepted")).alias("correct_acceptance"), share(~ok & F.col("accepted")).alias("false_acceptance"),
        F.round(F.try_divide(F.count_if(ok & F.col("accepted")), F.count_if("accepted")), 6).alias("precision_of_accepted"),
        F.round(F.avg(F.when(ok, F.col("confidence"))), 6).alias("confidence_right"), F.round(F.avg(F.when(~ok, F.col("confidence"))), 6).alias("confidence_wrong"),
    )


#: Bounds of a category's class.
STRONG_ACCURACY, STRONG_ACCEPTANCE, STRONG_SHARE, WEAK_ACCURACY = 0.8, 0.5, 0.5, 0.6


def _counted(rows: DataFrame, key: str, value: Column) -> DataFrame:
    """``key, text``: how often each value stands, "a=3,b=1" in order of the value; per ``key`` and, key null, in all."""
    c = rows.where(value.isNotNull()).groupBy(F.col(key).alias("_k"), value.alias("v")).agg(F.count("*").alias("n"))
    every = F.explode(F.array(F.struct(F.col("_k").alias("k"), F.lit(False).alias("all")), F.struct(F.lit(None).cast("string").alias("k"), F.lit(True).alias("all"))))
    c = c.select("v", "n", every.alias("x")).groupBy("x.k", "x.all", "v").agg(F.sum("n").alias("n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("v", "n"))), lambda x: F.concat_ws("=", x["v"], x["n"])), ",")
    return c.groupBy(F.col("k").alias(f"_{key}"), F.col("all").alias("_all")).agg(text.alias("text"))  # labels: a bounded vocabulary


def per_category(rows: DataFrame) -> DataFrame:
    """31 measures per true category, and of all (category null), over the readable rows; counts of all rows are ``images`` and ``unreadable``.

    ``rows``: truth, pred, pred_sub, confidence, status (failed, detected, confirm, unknown), best_guess_correct, memory_adjusted,
    subtype_correct (nullable). A row is accepted where it is detected. One pass with a rollup; medians by counted values.
    """
    valid = F.col("status") != "failed"
    ok, c, a = F.col("truth") == F.col("pred"), F.when(valid, F.col("confidence")), F.col("status") == "detected"
    has = lambda x: F.count_if(valid & x)
    rate = lambda x: share(F.when(valid, x))
    known = F.col("status") != "unknown"
    low, high = wilson(F.col("correct").cast("double"), F.col("valid").cast("double"))
    g = rows.rollup("truth").agg(
        F.grouping("truth").cast("boolean").alias("_all"), F.count("*").alias("images"), F.count_if(valid).alias("valid"), has(ok).alias("correct"), has(~ok).alias("incorrect"), rate(ok).alias("accuracy"),
        has(a).alias("accepted"), rate(a).alias("acceptance_rate"), has(ok & a).alias("strong"), has(ok & ~a).alias("weak"), has(~ok & known).alias("wrong"), has(~ok & a).alias("wrong_accepted"),
        has(~known).alias("rejected_unknown"), has(F.col("status") == "confirm").alias("confirm"), F.count_if(~valid).alias("unreadable"), has(F.col("best_guess_correct")).alias("best_guess_correct"),
        has(F.col("memory_adjusted")).alias("memory_adjusted"), F.round(F.avg(c), 5).alias("conf_mean"), F.min(c).alias("conf_min"), F.max(c).alias("conf_max"),
        rate(F.col("confidence") >= 0.9).alias("ge90"), rate(F.col("confidence") >= 0.8).alias("ge80"), rate(F.col("confidence") >= 0.5).alias("ge50"),
        F.round(F.avg(F.when(ok, c)), 5).alias("conf_correct_mean"), F.round(F.avg(F.when(~ok, c)), 5).alias("conf_wrong_mean"), has(~ok & known & (F.col("confidence") >= 0.9)).alias("confidently_wrong_90"),
        has(F.col("subtype_correct").isNotNull() & ok).alias("subtype_n"), has(F.col("subtype_correct")).alias("subtype_correct"),
    )
    readable = rows.where(valid)
    median = quantiles(readable, ["truth"], "confidence", {"m": 0.5}).select(F.col("truth").alias("_truth"), F.lit(False).alias("_all"), "m")
    median = median.unionByName(quantiles(readable, [], "confidence", {"m": 0.5}).select(F.lit(None).cast("string").alias("_truth"), F.lit(True).alias("_all"), "m"))
    extra = {
        "conf_median": median.withColumnRenamed("m", "text").withColumn("text", F.round("text", 6)),
        "predicted": _counted(readable, "truth", F.col("pred")),
        "predicted_subtypes": _counted(readable.where(known), "truth", F.concat_ws("/", "pred", "pred_sub")),
    }
    for name, table in extra.items():  # a row per category
        t = table.select("_truth", F.col("_all").alias("_same"), F.col("text").alias(name))
        g = g.join(t, F.col("truth").eqNullSafe(F.col("_truth")) & (F.col("_all") == F.col("_same")), "left").drop("_truth", "_same")
    return g.withColumn("ci_low", F.round(low, 6)).withColumn("ci_high", F.round(high, 6)).drop("_all")


def recognition(summary: DataFrame) -> DataFrame:
    """Class of a category from :func:`per_category`: strong by accuracy, acceptance and its share of strong rows; weak by accuracy; else misclassified."""
    n = F.col("valid")
    of = lambda x: F.try_divide(F.col(x), n)
    strong = (of("correct") >= STRONG_ACCURACY) & (of("accepted") >= STRONG_ACCEPTANCE) & (of("strong") >= STRONG_SHARE)
    return summary.where("truth is not null").select("truth", F.when(strong, "strong").when(of("correct") >= WEAK_ACCURACY, "weak").otherwise("misclassified").alias("recognition"))


def threshold_sweep(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """Acceptance of readable rows at every threshold in two modes, also where nothing passes. ``confidence_only`` ignores the status and counts a right best guess.

    The rows are read once: each explodes into the thresholds it passes, combined before the shuffle, and the grid of thresholds and modes is joined to the counts.
    """
    ok = F.col("truth") == F.col("pred")
    modes = F.array(F.struct(F.lit("pipeline").alias("mode"), (F.col("status") == "detected").alias("in"), ok.alias("ok")), F.struct(F.lit("confidence_only").alias("mode"), F.lit(True).alias("in"), (ok | F.col("best_guess_correct")).alias("ok")))
    every = F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")
    valid = rows.where("status <> 'failed'")
    passed = valid.select("confidence", modes.alias("modes"), every).where(F.col("confidence") >= F.col("threshold")).select("threshold", F.explode("modes").alias("m")).where("m.in")
    g = passed.groupBy("threshold", F.col("m.mode").alias("mode")).agg(F.count("*").alias("_n"), F.count_if("m.ok").alias("_k"))
    total = valid.agg(F.count("*").alias("total"))
    grid = total.select("total", every).select("total", "threshold", F.explode(F.array(F.lit("pipeline"), F.lit("confidence_only"))).alias("mode"))
    j = grid.join(g, ["threshold", "mode"], "left").select("threshold", "mode", "total", F.coalesce("_n", F.lit(0)).alias("n"), F.coalesce("_k", F.lit(0)).alias("k"))
    part = lambda x: F.round(F.try_divide(x, F.col("total")), 6)
    n, k = F.col("n"), F.col("k")
    return j.select("threshold", "mode", n.cast("long").alias("accepted"), part(n).alias("acceptance"), part(k).alias("correct_acceptance"), part(n - k).alias("false_acceptance"), F.round(F.try_divide(k, n), 6).alias("precision"))


def condition_matrix(rows: DataFrame) -> DataFrame:
    """Metrics per condition, then their mean per group of conditions."""
    per = rows.groupBy("grp", "condition").agg(F.avg((F.col("truth") == F.col("pred")).cast("double")).alias("a"), F.avg(F.col("accepted").cast("double")).alias("acc"))
    return per.groupBy("grp").agg(F.round(F.avg("a"), 6).alias("accuracy"), F.round(F.avg("acc"), 6).alias("acceptance"), F.count("*").alias("conditions"))


def retrieval(best: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """Per query: share of the ``k`` best that are of its sub-type and of its type (divided by k), rank of the first relevant result in the whole ranking, reciprocal rank (0 if none).

    ``best``: query_id, rank, relevant, type_relevant, the k best at least. ``first``: query_id, first_rank, a row per query.
    """
    rate = lambda c: F.round(F.count_if(c) / F.lit(k), 6)
    g = best.where(F.col("rank") <= k).groupBy("query_id").agg(rate("relevant").alias("precision_at_k"), rate("type_relevant").alias("type_precision_at_k"))
    j = first.join(g, "query_id", "left").fillna(0.0, ["precision_at_k", "type_precision_at_k"])
    return j.withColumn("rr", F.round(F.coalesce(F.try_divide(F.lit(1.0), F.col("first_rank")), F.lit(0.0)), 6))


def mean_retrieval(per_query: DataFrame) -> DataFrame:
    """One row: means of :func:`retrieval` over the queries."""
    rr = F.coalesce(F.try_divide(F.lit(1.0), F.col("first_rank")), F.lit(0.0))
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return per_query.agg(F.count("*").alias("queries"), mean("precision_at_k", "mean_precision_at_k"), mean("type_precision_at_k", "mean_type_precision_at_k"), mean(rr, "mrr"))


def before_after(rows: DataFrame, *by: str) -> DataFrame:
    """Accuracy before and after, and how many were fixed and broken."""
    a, b = F.col("truth") == F.col("before"), F.col("truth") == F.col("after")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), share(a).alias("accuracy_before"), share(b).alias("accuracy_after"), F.count_if(~a & b).alias("fixed"), F.count_if(a & ~b).alias("broken"))


def _best(leaves: DataFrame, name: str, *more: str) -> DataFrame:
    """Best type and leaf per id at 9 digits; equal ones go to the name that sorts first. The leaves of an id, a bounded hierarchy, are folded per id."""
    exact = F.col("p").cast("decimal(28,9)")
    types = leaves.groupBy("id", "waste_type").agg(F.sum(exact).alias("s"), F.max(exact).alias("m"), F.min_by("leaf", F.struct((-exact).alias("minus"), "leaf")).alias("leaf"), *[F.max(c).alias(c) for c in more])
    best = lambda v, c: F.min_by(c, F.struct((-F.col(v)).alias("minus"), F.col(c)))
    return types.groupBy("id").agg(best("s", "waste_type").alias(f"type_{name}"), best("m", "leaf").alias(f"leaf_{name}"), *[F.max(c).alias(c) for c in more])


def memory_curves(leaves: DataFrame, near: DataFrame, truths: DataFrame, threshold: float) -> DataFrame:
    """What a memory does to accuracy under each curve: per ``phase`` and ``curve``, accuracy of type and leaf before and after, fixed and broken.

    ``near``: id, mem_type, mem_sub, distance. For more see :func:`folded_curves`.
    """
    of = lambda c: memory_weight(F.col("distance"), threshold, c)
    folded = near.groupBy("id", "mem_type", "mem_sub").agg(*[f(of(c)).alias(f"{name}_{c}") for c in CURVES for name, f in (("w", F.sum), ("top", F.max))])
    return folded_curves(leaves, folded, truths)


def folded_curves(leaves: DataFrame, near: DataFrame, truths: DataFrame) -> DataFrame:
    """:func:`memory_curves` of matches that are folded per id and label.

    ``leaves``: id, leaf, waste_type, sub_type, p. ``near``: id, mem_type, mem_sub, and for each curve ``w_`` and ``top_``, the sum and the largest
    of the weights. ``truths``: id, phase, true_type, true_leaf. All curves go through one blend, told apart by a struct id.
    """
    every = F.explode(F.array(*[F.lit(c) for c in CURVES]))
    key = F.struct(F.col("curve"), F.col("id").alias("row")).alias("id")
    mine = cut(leaves.join(truths.select("id"), "id", "left_semi"))  # the blend reads them several times
    wide = mine.withColumn("curve", every).select(key, "leaf", "waste_type", "sub_type", "p")
    weights = F.explode(F.array(*[F.struct(F.lit(c).alias("curve"), F.col(f"w_{c}").alias("w"), F.col(f"top_{c}").alias("top")) for c in CURVES]))
    w = near.select("id", "mem_type", "mem_sub", weights.alias("x")).select("id", "mem_type", "mem_sub", "x.*").select(key, "mem_type", "mem_sub", "w", "top")
    after = _best(blend_weighted(wide, w), "after", "familiar").select(F.col("id.row").alias("id"), F.col("id.curve").alias("curve"), "type_after", "leaf_after", F.col("familiar").alias("matched"))
    j = truths.join(_best(mine, "before"), "id").join(after, "id")
    out = [F.count("*").alias("n"), F.count_if("matched").alias("matched")]
    for level in ("type", "leaf"):
        a, b = F.col(f"{level}_before") == F.col(f"true_{level}"), F.col(f"{level}_after") == F.col(f"true_{level}")
        out += [share(a).alias(f"{level}_before"), share(b).alias(f"{level}_after"), F.count_if(~a & b).alias(f"{level}_fixed"), F.count_if(a & ~b).alias(f"{level}_broken")]
    return j.groupBy("phase", "curve").agg(*out)


def choose_curve(simulated: DataFrame, phase: str = "validation") -> DataFrame:
    """``simulated`` with ``chosen``: the curve that nets most on ``phase``, a leaf counting half a type; of equal ones the first of :data:`CURVES`."""
    net = F.col("type_fixed") - F.col("type_broken") + 0.5 * (F.col("leaf_fixed") - F.col("leaf_broken"))
    place = F.coalesce(*[F.when(F.col("curve") == c, F.lit(k)) for k, c in enumerate(CURVES)])
    best = simulated.where(F.col("phase") == phase).agg(F.min_by("curve", F.struct((-net).alias("minus"), place.alias("place"))).alias("_best"))
    return simulated.crossJoin(F.broadcast(best)).withColumn("chosen", F.col("curve") == F.col("_best")).drop("_best")


def gate(old: DataFrame, new: DataFrame, type_drop: float = 0.005, leaf_drop: float = 0.01) -> DataFrame:
    """One row: whether the candidate's accuracies stay within the allowed drops."""
    j = old.select(F.col("type_accuracy").alias("ot"), F.col("leaf_accuracy").alias("ol")).crossJoin(F.broadcast(new.select("type_accuracy", "leaf_accuracy")))
    ok = (F.col("type_accuracy") >= F.col("ot") - type_drop) & (F.col("leaf_accuracy") >= F.col("ol") - leaf_drop)
    return j.select(F.round(F.col("type_accuracy") - F.col("ot"), 6).alias("type_change"), F.round(F.col("leaf_accuracy") - F.col("ol"), 6).alias("leaf_change"), ok.alias("promote"))


def open_set(rows: DataFrame, msp: float, knn: float, quantile: float = 0.05) -> DataFrame:
    """Each class in turn as the unseen one: ``unseen, n, rejected_msp, rejected_combined, auroc_msp, auroc_knn``.

    ``rows``: truth, confidence, knn. The rule by confidence alone rejects below the ``quantile`` of the other classes' confidences;
    the combined rule rejects above ``knn`` or below ``msp``. Everything comes from counts per (class, value), read once: the values
    below a class's rows among the others are those below in all, less those of the class. The quantile of the others is found in
    the same two tables of prefix sums (see :func:`_rank_in_all`), so there is no row per pair of classes and any number of them.
    """
    total = rows.agg(F.count("*").alias("total"))
    out = None
    for name, sign in (("confidence", -1), ("knn", 1)):
        per = rows.groupBy("truth", (sign * F.col(name)).alias("s")).agg(F.count("*").alias("n"))
        every = running(per.groupBy("s").agg(F.sum("n").alias("all")), [F.col("s").asc()], {"upto": F.col("all")}).select(F.col("s").alias("_s"), "all", "upto")
        own = running(per, [F.col("truth").asc(), F.col("s").asc()], {"mine": F.col("n")})
        start = own.groupBy(F.col("truth").alias("_t")).agg(F.min(F.col("mine") - F.col("n")).alias("_start"), F.sum("n").alias("size"))
        j = own.join(bounded(start), F.col("truth") == F.col("_t")).join(every, F.col("s") == F.col("_s")).crossJoin(F.broadcast(total))
        below = (F.col("upto") - F.col("all")) - (F.col("mine") - F.col("_start") - F.col("n"))
        won = F.col("n").cast("decimal(30,1)") * (below + (F.col("all") - F.col("n")) * F.lit("0.5").cast("decimal(2,1)"))
        # by confidence: ranks of the floor's two neighbours among the others, as ranks in all
        ranks = [_rank_in_all(f(F.lit(quantile) * (F.col("total") - F.col("size") - 1)) + 1).alias(k) for k, f in (("lo", F.floor), ("hi", F.ceil))] if sign < 0 else []
        g = j.groupBy("truth").agg(F.sum(won).alias("w"), F.max("size").alias("size"), F.max("total").alias("total"), *ranks)
        auroc_ = F.round(F.try_divide(F.col("w").cast("double"), F.col("size").cast("double") * (F.col("total") - F.col("size"))), 6)
        t = g.select(F.col("truth").alias("unseen"), auroc_.alias({"confidence": "auroc_msp", "knn": "auroc_knn"}[name]), *([F.col("size"), F.col("total"), F.col("lo"), F.col("hi")] if ranks else []))
        if ranks:
            t = cut(t)
            floor = _values_at(t, every, total, quantile)
        out = t.drop("size", "total", "lo", "hi") if out is None else out.join(t, "unseen")
    j = rows.join(bounded(floor), F.col("truth") == F.col("_u"), "left")
    combined = (F.col("knn") > knn) | (F.col("confidence") < msp)
    rejected = j.groupBy(F.col("truth").alias("unseen")).agg(F.count("*").alias("n"), share(F.col("confidence") < F.col("floor")).alias("rejected_msp"), share(combined).alias("rejected_combined"))
    return rejected.join(out, "unseen")


def _rank_in_all(rank: Column) -> Column:
    """The rank in all rows of the row with ``rank`` (from 1, ascending confidence) among those of other classes, as an aggregate over a class's values.

    Own rows at or below that row are those of the last own value with fewer than ``rank`` others at or below it.
    """
    own = F.col("size") - (F.col("mine") - F.col("_start") - F.col("n"))
    others = F.col("total") - (F.col("upto") - F.col("all")) - own
    return F.max(rank) + F.coalesce(F.max(F.when(others < rank, own)), F.lit(0))


def _values_at(classes: DataFrame, every: DataFrame, total: DataFrame, quantile: float, cells: int = 1024) -> DataFrame:
    """``_u, floor``: confidences at the ranks ``lo`` and ``hi``, interpolated. Ranks and values meet by cells of ranks; a class that is all has none."""
    width = F.greatest(F.lit(1), F.ceil(F.col("total") / cells))
    top = F.col("total") - (F.col("upto") - F.col("all"))  # a value has the ranks (top - all, top]
    values = every.crossJoin(F.broadcast(total)).select((-F.col("_s")).alias("v"), top.alias("top"), (top - F.col("all")).alias("under"), width.alias("width"))
    values = values.withColumn("cell", F.explode(F.sequence(F.floor((F.col("under") + 1) / F.col("width")), F.floor(F.col("top") / F.col("width")))))
    asked = classes.where("size < total").select("unseen", (F.lit(quantile) * (F.col("total") - F.col("size") - 1)).alias("at"), width.alias("width"), F.explode(F.array(F.struct(F.lit("lo").alias("k"), F.col("lo").alias("r")), F.struct(F.lit("hi").alias("k"), F.col("hi").alias("r")))).alias("x"))
    asked = asked.select("unseen", "at", "x.k", "x.r", F.floor(F.col("x.r") / F.col("width")).alias("cell"))
    met = asked.join(values.drop("width"), "cell").where((F.col("r") > F.col("under")) & (F.col("r") <= F.col("top")))
    g = met.groupBy("unseen").agg(F.max("at").alias("at"), F.max(F.when(F.col("k") == "lo", F.col("v"))).alias("lo"), F.max(F.when(F.col("k") == "hi", F.col("v"))).alias("hi"))
    return g.select(F.col("unseen").alias("_u"), (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("at") - F.floor("at"))).alias("floor"))
