"""Dataset curation: duplicates, groups, splits, balance and leakage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loopgrade.functions.session import bounded, cut
from loopgrade.operators.components import connected_components
from loopgrade.operators.ordered import quantiles

#: Which official split a duplicate group stays in.
PRIORITY = {"train": 0, "val": 1, "test": 2}


def priority(split: Column) -> Column:
    return F.coalesce(*[F.when(split == s, F.lit(p)) for s, p in PRIORITY.items()], F.lit(9))


def hash_order(seed: str, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))


def duplicate_groups(items: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """``items`` with ``grp``: the smallest id reachable by equal digests and by near pairs (``src, dst`` ids).

    Equal digests are linked to the smallest id of the digest, so a digest of any size costs one edge per row.
    """
    star = items.groupBy("digest").agg(F.min("id").alias("src"))
    edges = items.join(star, "digest").where("id <> src").select("src", F.col("id").alias("dst"))
    edges = edges.unionByName(near.select("src", "dst")) if near is not None else edges
    comp = connected_components(edges)
    return items.join(comp, items["id"] == comp["node"], "left").withColumn("grp", F.coalesce("comp", "id")).drop("node", "comp")


def dedup(grouped: DataFrame) -> DataFrame:
    """Every row with its ``reason``: ``kept`` for one representative per group, else why it goes.

    Groups whose rows disagree on the leaf go whole. The representative has the first official split
    (train, val, test, none) and then the smallest path. Counts and firsts are combined per group before
    the shuffle; only equi-joins bring them back, so a group of any size stays spread.
    """
    grouped = cut(grouped)  # read three times
    lead = F.struct(priority(F.col("split")).alias("prio"), "path", "split")
    g = grouped.groupBy("grp").agg(F.min("leaf").alias("l1"), F.max("leaf").alias("l2"), F.min(lead).alias("rep"))
    first = grouped.groupBy("grp", "digest").agg(F.min(lead).alias("own"))
    j = grouped.join(g, "grp").join(first, ["grp", "digest"])
    reason = (
        F.when(F.col("l1") != F.col("l2"), "conflict")
        .when(F.col("path") == F.col("rep.path"), "kept")
        .when(F.col("path") != F.col("own.path"), "exact_copy")
        .when(F.col("rep.split").isNotNull() & F.col("split").isNotNull() & (F.col("split") != F.col("rep.split")), "other_split")
        .otherwise("near_copy")
    )
    return j.withColumn("reason", reason).drop("l1", "l2", "rep", "own")


def ranked_by_hash(rows: DataFrame, seed: str, key: str) -> DataFrame:
    """``rows`` with ``_rank``, from 1 in hash order within their leaf, and ``_total``, the rows of the leaf.

    The rank is a prefix sum in two levels (256 hash buckets, then inside a bucket), so a leaf with a third
    of all rows is ordered in 256 parts.
    """
    h = rows.withColumn("_h", hash_order(seed, key)).withColumn("_b", F.substring("_h", 1, 2))
    per = h.groupBy("leaf", "_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("leaf").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select(F.col("leaf").alias("_l"), F.col("_b").alias("_k"), before.alias("_before"), F.sum("_n").over(Window.partitionBy("leaf")).alias("_total"))
    inside = F.row_number().over(Window.partitionBy("leaf", "_b").orderBy("_h", key))
    j = h.withColumn("_i", inside).join(per, F.col("leaf").eqNullSafe(F.col("_l")) & (F.col("_b") == F.col("_k")))
    return j.withColumn("_rank", F.col("_before") + F.col("_i")).drop("_h", "_b", "_l", "_k", "_before", "_i")


def stratified_split(rows: DataFrame, val: float, test: float, seed: str = "7", key: str = "path") -> DataFrame:
    """Rows without an official split, ranked by hash within their leaf; round-half-even counts go to val and test."""
    rank, n = F.col("_rank"), F.col("_total").cast("double")
    n_val, n_test = F.bround(n * val, 0), F.bround(n * test, 0)
    split = F.when(rank <= n_val, "val").when(rank <= n_val + n_test, "test").otherwise("train")
    return ranked_by_hash(rows, seed, key).withColumn("split", F.coalesce("split", split)).drop("_rank", "_total")


def unit_split(rows: DataFrame, val: float, test: float, seed: str = "7", unit: str = "scene") -> DataFrame:
    """Whole units hashed to [0, 1] by the first 32 bits of an md5; an official split stays."""
    x = F.conv(F.substring(hash_order(seed, unit), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)
    return rows.withColumn("split", F.coalesce("split", F.when(x < val, "val").when(x < val + test, "test").otherwise("train")))


#: Annotations of a task, on average.
ANNOTATIONS = 400_000


def annotations(objects: DataFrame, images: DataFrame, categories: DataFrame, image: str, category: str) -> DataFrame:
    """``image, file, category, objects``: how many objects of each category an image has; ``images`` name the file, ``categories`` the category.

    Objects are counted per image and category where they meet their image, in tasks whose number grows with the table: each holds a bounded part.
    """
    parts = max(int(objects.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-objects.count() // ANNOTATIONS))
    named = objects.join(categories, category).select(image, "category")
    found = named.repartition(parts, image).groupBy(image, "category").agg(F.count("*").alias("n"))
    return found.join(images.repartition(parts, image), image).groupBy(image, "file", "category").agg(F.sum("n").alias("objects"))


def drop_cross_split(grouped: DataFrame) -> DataFrame:
    """Rows of the first split of their group; members in other splits go."""
    best = grouped.groupBy("grp").agg(F.min(priority(F.col("split"))).alias("_best"))
    return grouped.join(best, "grp").where(priority(F.col("split")) == F.col("_best")).drop("_best")


def viable_leaves(rows: DataFrame, least: int = 30) -> DataFrame:
    """Leaves with enough rows and something in train and val."""
    g = rows.groupBy("leaf").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "val").alias("n_val"))
    return g.where((F.col("n") >= least) & (F.col("n_train") > 0) & (F.col("n_val") > 0))


def oversample(rows: DataFrame, most: float = 3.0, seed: str = "7") -> DataFrame:
    """Train rows with ``copies``: leaves below the median count are repeated round-robin in hash order, up to ``most`` times."""
    train = cut(rows.where("split = 'train'"))  # read four times
    counts = train.groupBy("leaf").agg(F.count("*").alias("n"))
    median = counts.agg(F.floor(F.percentile("n", 0.5)).alias("median"))
    plan = counts.crossJoin(F.broadcast(median)).select(F.col("leaf"), "n", F.greatest(F.lit(0), F.least("median", F.floor(F.col("n") * most)) - F.col("n")).alias("extra"))
    ranked = ranked_by_hash(train, seed, "path")
    copies = 1 + F.floor(F.col("extra") / F.col("n")) + F.when(F.col("_rank") <= F.col("extra") % F.col("n"), 1).otherwise(0)
    return ranked.join(bounded(plan), "leaf").withColumn("copies", copies).drop("_rank", "_total", "n", "extra")


def capped(rows: DataFrame, budget: dict[str, int], seed: str = "7") -> DataFrame:
    """At most ``budget[split]`` rows per (leaf, split) in hash order; this limit is the operator's purpose."""
    limit = F.coalesce(*[F.when(F.col("split") == s, F.lit(n)) for s, n in budget.items()])
    place = F.row_number().over(Window.partitionBy("leaf", "split").orderBy(hash_order(seed, "path"), "path"))
    return rows.withColumn("_p", place).where(F.col("_p") <= max(budget.values())).where(F.col("_p") <= limit).drop("_p")  # the literal bound is cut before the shuffle


def sample_per_class(rows: DataFrame, n: int, seed: str = "7", by: str = "leaf") -> DataFrame:
    place = F.row_number().over(Window.partitionBy(by).orderBy(hash_order(seed, "path"), "path"))
    return rows.withColumn("_p", place).where(F.col("_p") <= n).drop("_p")


def holdout(rows: DataFrame, key: str, least: int = 10) -> DataFrame:
    """Adds ``held_out``: the md5 of the key modulo 5 is 0 (the sum of its hex digits, as 16 is 1 modulo 5), where there are at least ``least`` rows."""
    digest = F.md5(F.col(key).cast("string").cast("binary"))
    digits = F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: F.conv(F.substring(digest, i, F.lit(1)), 16, 10).cast("int"))
    total = F.aggregate(digits, F.lit(0), lambda s, x: s + x)
    n = rows.agg(F.count("*").alias("_n"))
    return rows.crossJoin(F.broadcast(n)).withColumn("held_out", (F.col("_n") >= least) & (total % 5 == 0)).drop("_n")


def shadow_copies(rows: DataFrame, fraction: float, limit: int, seed: str = "7") -> DataFrame:
    """A hash-chosen fraction of the large train rows, again as low-detail rows, after all rows."""
    x = F.conv(F.substring(hash_order(seed, "path"), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)
    rows = cut(rows)  # read twice
    chosen = rows.where((F.col("split") == "train") & (F.col("n_chars") > limit) & (x < fraction))
    return rows.withColumn("low_detail", F.lit(False)).unionByName(chosen.withColumn("low_detail", F.lit(True)))


def replay_mix(fresh: DataFrame, originals: DataFrame, repeat: int, per_leaf: int) -> DataFrame:
    """Feedback rows ``repeat`` times, with at most ``per_leaf`` originals of each leaf."""
    again = fresh.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(repeat))))
    return again.unionByName(sample_per_class(originals, per_leaf).withColumn("copy", F.lit(0)))


def extend_domain(rows: DataFrame, leaking: DataFrame, caps: dict[str, int], rare: str, repeat: int = 3) -> DataFrame:
    """Rows of another domain: leaking ones out, a cap per leaf in hash order, the rare leaf's train rows repeated."""
    kept = rows.join(leaking.select("path").distinct(), "path", "left_anti")
    limit = F.coalesce(*[F.when(F.col("leaf") == k, F.lit(n)) for k, n in caps.items()])
    place = F.row_number().over(Window.partitionBy("leaf").orderBy(hash_order("7", "path"), "path"))
    kept = kept.withColumn("_p", place).where(F.col("_p") <= max(caps.values())).where(F.col("_p") <= limit).drop("_p")
    times = F.when((F.col("leaf") == rare) & (F.col("split") == "train"), F.lit(repeat)).otherwise(F.lit(1))
    return kept.withColumn("copy", F.explode(F.sequence(F.lit(1), times)))


def digest_classes(items: DataFrame) -> DataFrame:
    """Duplicate digests classed cross_dataset > cross_label > cross_split > same_folder."""
    two = lambda c: F.min(c) != F.max(c)
    g = items.groupBy("digest").agg(F.count("*").alias("n"), two("dataset").alias("d"), two("leaf").alias("l"), two(F.coalesce("split", F.lit("-"))).alias("s")).where("n > 1")
    return g.select("digest", "n", F.when(F.col("d"), "cross_dataset").when(F.col("l"), "cross_label").when(F.col("s"), "cross_split").otherwise("same_folder").alias("kind"))


def redundant_by_label(items: DataFrame) -> DataFrame:
    """Copies beyond the first of every digest, by label (the first in path order is the original)."""
    first = items.groupBy("digest").agg(F.min("path").alias("first"), F.count("*").alias("n")).where("n > 1")
    return items.join(first, "digest").where("path <> first").groupBy("leaf").agg(F.count("*").alias("redundant"))


def inventory(items: DataFrame) -> DataFrame:
    cell = items.groupBy("dataset", "leaf", F.coalesce("split", F.lit("-")).alias("split")).agg(F.count("*").alias("n"))
    by = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "n"))), lambda x: F.concat_ws("=", x["split"], x["n"])), ",")
    return cell.groupBy("dataset", "leaf").agg(F.sum("n").alias("n"), by.alias("by_split"))


def size_inventory(items: DataFrame) -> DataFrame:
    """Per dataset and leaf: images, unreadable ones (no width), shortest and longest side, whole medians, the three commonest sizes and the modes.

    ``items``: dataset, leaf, w, h, mode. Equally common sizes come in the order of their text; that three are listed is the report.
    """
    by = ["dataset", "leaf"]
    ok = items.where("w is not null and h is not null")
    keyed = lambda df: df.select(*[F.col(c).alias(f"_{c}") for c in by], *[c for c in df.columns if c not in by])
    total = items.groupBy(*by).agg(
        F.count("*").alias("images"), F.count_if(F.col("w").isNull() | F.col("h").isNull()).alias("unreadable"), F.min(F.least("w", "h")).alias("min_side"), F.max(F.greatest("w", "h")).alias("max_side"),
    )
    medians = [quantiles(ok, by, c, {"m": 0.5}).select(*by, F.floor("m").alias(f"median_{c}")) for c in ("w", "h")]
    sizes = ok.groupBy(*by, F.concat_ws("x", "w", "h").alias("size")).agg(F.count("*").alias("c"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("c"), "size"))
    top = sizes.withColumn("r", place).where("r <= 3").groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "size", "c"))), lambda x: F.concat_ws("=", x["size"], x["c"])), ",").alias("most_common"))
    modes = ok.groupBy(*by, "mode").agg(F.count("*").alias("c")).groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("mode", "c"))), lambda x: F.concat_ws("=", x["mode"], x["c"])), ",").alias("modes"))
    for part in (*medians, top, modes):  # a row per folder
        total = total.join(keyed(part), F.col("dataset").eqNullSafe(F.col("_dataset")) & F.col("leaf").eqNullSafe(F.col("_leaf")), "left").drop("_dataset", "_leaf")
    return total


#: Examples of a kind of near pairs that are reported.
EXAMPLES = 4


def near_kinds(rows: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Near pairs of ``rows`` (id, cls, digest, dataset, leaf, split, path) by kind, files with equal digests left out: counts and examples.

    ``links``: a, b, two classes that are near; rows of one class are near, too. Every pair is counted, none is made: pairs of
    linked classes are products of their counts per folder, less the pairs of one digest. ``counts`` is ``kind, a, b, n``, ``a``
    and ``b`` the two folders in order (equal for one folder's own pairs). ``examples`` has the first four pairs
    ``path_a, path_b`` of each (that number is the report): whichever they are, both files are among the first four of their digest
    and their digest among the first five of their class and folder, so twenty files of a folder and class are looked at.
    """
    folder = ["dataset", "leaf", "split"]
    rows = rows.withColumn("split", F.coalesce("split", F.lit("-"))).select("cls", F.struct(*folder).alias("f"), "digest", "path")
    per = rows.groupBy("cls", "f", "digest").agg(F.count("*").alias("n"), F.min("path").alias("head"))
    cell = per.groupBy("cls", "f").agg(F.sum("n").alias("n"))
    lead = per.withColumn("_d", F.row_number().over(Window.partitionBy("cls", "f").orderBy("head", "digest"))).where(F.col("_d") <= EXAMPLES + 1).select("cls", "f", "digest")
    place = F.row_number().over(Window.partitionBy("cls", "f", "digest").orderBy("path"))
    first = rows.withColumn("_p", place).where(F.col("_p") <= EXAMPLES).join(lead, ["cls", "f", "digest"])
    cell = cell.join(first.groupBy("cls", "f").agg(F.collect_list(F.struct("path", "digest")).alias("files")), ["cls", "f"])
    side = lambda s: cell.select(*[F.col(c).alias(f"{c}_{s}") for c in cell.columns])
    both = links.select(F.col("a").alias("cls_a"), F.col("b").alias("cls_b")).join(side("a"), "cls_a").join(side("b"), "cls_b")
    own = side("a").join(side("b"), (F.col("cls_a") == F.col("cls_b")) & (F.col("f_a") <= F.col("f_b")))  # folders of one class: a bounded vocabulary
    inside = (F.col("cls_a") == F.col("cls_b")) & (F.col("f_a") == F.col("f_b"))
    n = F.when(inside, F.expr("n_a * (n_a - 1) div 2")).otherwise(F.col("n_a") * F.col("n_b"))
    pair = lambda x, y: F.struct(F.least(x["path"], y["path"]).alias("path_a"), F.greatest(x["path"], y["path"]).alias("path_b"))
    every = F.flatten(F.transform("files_a", lambda x: F.transform(F.filter("files_b", lambda y: (x["digest"] != y["digest"]) & (~inside | (x["path"] < y["path"]))), lambda y: pair(x, y))))
    met = both.unionByName(own).select(F.least("f_a", "f_b").alias("x"), F.greatest("f_a", "f_b").alias("y"), n.alias("n"), F.slice(F.array_sort(every), 1, EXAMPLES).alias("sample"))

    same = rows.groupBy("digest", "f").agg(F.count("*").alias("n"))
    half = lambda s: same.select("digest", F.col("f").alias(f"f_{s}"), F.col("n").alias(f"n_{s}"))
    exact = half("a").join(half("b"), "digest").where("f_a <= f_b")
    less = F.when(F.col("f_a") == F.col("f_b"), F.expr("n_a * (n_a - 1) div 2")).otherwise(F.col("n_a") * F.col("n_b"))
    exact = exact.select(F.col("f_a").alias("x"), F.col("f_b").alias("y"), (-less).alias("n"))

    kind = F.when(F.col("x.dataset") != F.col("y.dataset"), "cross_dataset").when(F.col("x.leaf") != F.col("y.leaf"), "cross_label").when(F.col("x.split") != F.col("y.split"), "cross_split").otherwise("same_folder")
    named = lambda df, *more: df.select(kind.alias("kind"), F.concat_ws("/", "x.dataset", "x.leaf").alias("a"), F.concat_ws("/", "y.dataset", "y.leaf").alias("b"), *more)
    counts = named(met.select("x", "y", "n").unionByName(exact), "n").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).where("n > 0")
    place = F.row_number().over(Window.partitionBy("kind", "a", "b").orderBy("path_a", "path_b"))
    pairs = named(met, F.explode("sample").alias("s")).select("kind", "a", "b", "s.path_a", "s.path_b").distinct()
    return counts, pairs.withColumn("rank", place).where(F.col("rank") <= EXAMPLES)


def leaf_summary(rows: DataFrame, most: float = 3.0) -> DataFrame:
    """Per leaf: rows in train, copies that oversampling adds there, rows in val and test, and how many come from which dataset and source label.

    ``rows``: leaf, split, dataset, source_label.
    """
    source = F.concat_ws("/", "dataset", "source_label")
    per = rows.groupBy("leaf", "split", source.alias("source")).agg(F.count("*").alias("n"))
    of = lambda s: F.coalesce(F.sum(F.when(F.col("split") == s, F.col("n"))), F.lit(0)).alias(s)
    g = per.groupBy("leaf").agg(*[of(s) for s in PRIORITY])
    names = per.groupBy("leaf", "source").agg(F.sum("n").alias("n")).groupBy(F.col("leaf").alias("_leaf")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source", "n"))), lambda x: F.concat_ws("=", x["source"], x["n"])), ",").alias("sources"))
    median = g.where("train > 0").agg(F.floor(F.percentile("train", 0.5)).alias("_median"))  # a row per leaf
    added = F.greatest(F.lit(0), F.least("_median", F.floor(F.col("train") * most)) - F.col("train"))
    j = g.crossJoin(F.broadcast(median)).join(names, F.col("leaf").eqNullSafe(F.col("_leaf")))
    return j.select("leaf", "train", F.when(F.col("train") > 0, added).otherwise(0).alias("added"), "val", "test", "sources")


def type_summary(rows: DataFrame, kind: Column) -> DataFrame:
    """Rows per type and split, and of all types (type null), by rollup."""
    g = rows.groupBy(kind.alias("type"), "split").agg(F.count("*").alias("n")).rollup("type")
    of = lambda s: F.coalesce(F.sum(F.when(F.col("split") == s, F.col("n"))), F.lit(0)).alias(s)
    return g.agg(*[of(s) for s in PRIORITY], F.sum("n").alias("total"))


def dataset_summary(rows: DataFrame) -> DataFrame:
    """Counts per (leaf, split), per leaf and in all, by cube."""
    return rows.where("split is not null").cube("leaf", "split").agg(F.count("*").alias("n"))


def imbalance(rows: DataFrame) -> DataFrame:
    per = rows.groupBy("leaf").agg(F.count("*").alias("n"))
    return per.agg(
        F.min_by("leaf", F.struct("n", "leaf")).alias("smallest"), F.max_by("leaf", F.struct("n", "leaf")).alias("largest"), F.min("n").alias("low"), F.max("n").alias("high"),
        F.round(F.max("n") / F.min("n"), 6).alias("ratio"), F.percentile("n", 0.5).alias("median"),
    )


def box_stats(boxes: DataFrame, flags: tuple[str, ...] = ()) -> DataFrame:
    """Per label: objects, scenes, quantiles and counts of the shorter side, objects per split and per flag (boolean columns)."""
    side = F.least("w", "h")
    b = boxes.withColumn("side", side)
    q = quantiles(b, ["label"], "side", {"median": 0.5, "p10": 0.1}).select(F.col("label").alias("_l"), F.round("median", 6).alias("median"), F.round("p10", 6).alias("p10"))
    g = b.groupBy("label").agg(
        F.count("*").alias("objects"), F.count_distinct("scene").alias("scenes"),
        F.count_if(F.col("side") < 24).alias("under_24"), F.count_if(F.col("side") < 64).alias("under_64"), *[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in PRIORITY], *[F.count_if(f).alias(f) for f in flags],
    )
    return g.join(q, F.col("label").eqNullSafe(F.col("_l"))).drop("_l")


def cooccurrence(boxes: DataFrame) -> DataFrame:
    """Pairs a < b of labels that share a scene. Pairs come from the scene's set of labels (a bounded vocabulary), not from a self-join of boxes."""
    s = boxes.groupBy("scene").agg(F.array_sort(F.collect_set("label")).alias("ls"))
    pair = F.transform(F.col("ls"), lambda a: F.transform(F.filter(F.col("ls"), lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    return s.select(F.explode(F.flatten(pair)).alias("x")).groupBy("x.a", "x.b").agg(F.count("*").alias("scenes"))


def labels_per_scene(boxes: DataFrame) -> DataFrame:
    return boxes.groupBy("scene").agg(F.count_distinct("label").alias("labels")).groupBy("labels").agg(F.count("*").alias("scenes"))


def dominant(boxes: DataFrame) -> DataFrame:
    """Per scene: the label of largest area, and the share of the largest type (first letter); the two may differ."""
    area = F.sum((F.col("w") * F.col("h")).cast("decimal(28,4)"))
    per = boxes.withColumn("kind", F.substring("label", 1, 1)).groupBy("scene", "kind", "label").agg(area.alias("a"))
    lab = per.groupBy("scene").agg(F.max_by("label", F.struct("a", "label")).alias("label"), F.sum("a").alias("t"))
    kind = per.groupBy("scene", "kind").agg(F.sum("a").alias("k")).groupBy("scene").agg(F.max_by("kind", F.struct("k", "kind")).alias("kind"), F.max("k").alias("k"))
    return lab.join(kind, "scene").select("scene", "label", "kind", F.round(F.coalesce(F.try_divide(F.col("k").cast("double"), F.col("t").cast("double")), F.lit(0.0)), 6).alias("kind_share"))


def padded_boxes(boxes: DataFrame, frame_w: int, frame_h: int, pad: float = 0.1, least: int = 24) -> DataFrame:
    """Boxes grown by ``pad`` on each side and clipped to the frame; ``usable`` where the shorter side is large enough."""
    x0, y0 = F.greatest(F.lit(0.0), F.col("x") - pad * F.col("w")), F.greatest(F.lit(0.0), F.col("y") - pad * F.col("h"))
    x1, y1 = F.least(F.lit(float(frame_w)), F.col("x") + (1 + pad) * F.col("w")), F.least(F.lit(float(frame_h)), F.col("y") + (1 + pad) * F.col("h"))
    w, h = F.floor(x1) - F.ceil(x0), F.floor(y1) - F.ceil(y0)
    return boxes.withColumn("crop_w", w).withColumn("crop_h", h).withColumn("usable", (F.col("w") > 0) & (F.col("h") > 0) & (F.least(w, h) >= least))


def map_labels(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows with their canonical type and the ``reason`` they are dropped for (null: mapped)."""
    m = mapping.select(F.lower("source_label").alias("_l"), "canonical_type", "status")
    j = rows.join(bounded(m), F.lower("label") == F.col("_l"), "left").drop("_l")
    reason = F.when(F.col("status").isNull(), "not_in_mapping").when(F.col("status") == "unmapped", "unmapped").when(F.coalesce("canonical_type", F.lit("")) == "", "blank_type")
    return j.withColumn("reason", reason)


def leakage_checks(rows: DataFrame, allowed: DataFrame) -> DataFrame:
    """One row per check, ``check, bad, verdict``, over a built dataset; counts that fail nothing have no verdict.

    ``rows``: path, stem (the file's name without ending), leaf, split, digest, is_copy (written by oversampling). ``allowed``: leaf,
    those of the label mapping. Checks: every leaf in every split; leaves of the mapping only; copies in train only; a stem once;
    no digest in two splits (counted are the files beyond the digest's first split).
    """
    unique = rows.where(~F.col("is_copy"))
    n = rows.agg(F.count_distinct("split").alias("all"))
    classes = rows.groupBy("leaf").agg(F.count_distinct("split").alias("n")).crossJoin(F.broadcast(n)).agg(F.count_if(F.col("n") != F.col("all")).alias("bad"))
    known = bounded(allowed.select("leaf").distinct())
    mapped = rows.where("split = 'train'").select("leaf").distinct().join(known, "leaf", "left_anti").agg(F.count("*").alias("bad"))
    stems = unique.groupBy("stem").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("bad"))
    per = unique.groupBy("digest", "split").agg(F.count("*").alias("n")).groupBy("digest").agg(F.sum("n").alias("files"), F.sum(F.col("n") - 1).alias("again"), F.min_by("n", priority(F.col("split"))).alias("first"))
    exact = per.agg(F.coalesce(F.sum(F.col("files") - F.col("first")), F.lit(0)).alias("bad"))
    within = per.agg(F.coalesce(F.sum("files") - F.count("*"), F.lit(0)).alias("bad"))
    sizes = rows.agg(F.count("*").alias("files"), F.count_if(~F.col("is_copy")).alias("unique"), F.count_if(F.col("is_copy")).alias("copies"), F.count_if(F.col("is_copy") & (F.col("split") != "train")).alias("stray"))
    parts = [("class_in_every_split", classes, "bad", True), ("class_in_mapping", mapped, "bad", True), ("copy_in_train", sizes, "stray", True), ("stem_once", stems, "bad", True), ("digest_in_one_split", exact, "bad", True)]
    parts += [("files", sizes, "files", False), ("unique_files", sizes, "unique", False), ("copies", sizes, "copies", False), ("repeated_digests", within, "bad", False)]
    out = None
    for name, table, column, judged in parts:
        verdict = F.when(F.col(column) == 0, "PASS").otherwise("FAIL") if judged else F.lit(None).cast("string")
        row = table.select(F.lit(name).alias("check"), F.col(column).cast("long").alias("bad"), verdict.alias("verdict"))
        out = row if out is None else out.unionByName(row)
    return out


def near_between_splits(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``split_a, split_b, leaf_a, leaf_b, n``: near pairs of files by their splits, train before val before test, and leaves; equal files are near, too.

    ``rows``: cls, split, leaf; ``links``: a, b, two classes that are near. Pairs are products of counts per class, split and leaf; none is made.
    """
    f = F.struct(priority(F.col("split")).alias("at"), "split", "leaf")
    cell = rows.groupBy("cls", f.alias("f")).agg(F.count("*").alias("n"))
    side = lambda s: cell.select(*[F.col(c).alias(f"{c}_{s}") for c in cell.columns])
    both = links.select(F.col("a").alias("cls_a"), F.col("b").alias("cls_b")).join(side("a"), "cls_a").join(side("b"), "cls_b").select("f_a", "f_b", (F.col("n_a") * F.col("n_b")).alias("n"))
    own = side("a").join(side("b"), (F.col("cls_a") == F.col("cls_b")) & (F.col("f_a") <= F.col("f_b")))  # splits and leaves of one class: bounded vocabularies
    own = own.select("f_a", "f_b", F.when(F.col("f_a") == F.col("f_b"), F.expr("n_a * (n_a - 1) div 2")).otherwise(F.col("n_a") * F.col("n_b")).alias("n"))
    met = both.unionByName(own).select(F.least("f_a", "f_b").alias("x"), F.greatest("f_a", "f_b").alias("y"), "n")
    g = met.groupBy(F.col("x.split").alias("split_a"), F.col("y.split").alias("split_b"), F.col("x.leaf").alias("leaf_a"), F.col("y.leaf").alias("leaf_b"))
    return g.agg(F.sum("n").cast("long").alias("n")).where("n > 0")


def round_robin(rows: DataFrame, n: int, by: str = "leaf", *order: Column) -> DataFrame:
    """Whole rounds over the categories, best first, until at least ``n`` rows are picked."""
    r = rows.withColumn("_round", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_round") <= n)  # a round has a row at least
    per = r.groupBy("_round").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_round").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    need = per.select("_round", before.alias("_before")).where(F.col("_before") < n)
    return r.join(F.broadcast(need), "_round").drop("_before").withColumnRenamed("_round", "round")
