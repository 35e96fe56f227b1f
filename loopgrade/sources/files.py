"""Readers and writers: explicit schemas, tolerant logs, manifests and stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loopgrade.functions.session import bounded, cut
from loopgrade.operators.ranking import split_types


def _schema(text: str) -> T.StructType:
    kinds = {"long": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "strings": T.ArrayType(T.StringType())}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in text.split())])


LISTINGS = _schema("waste_id:long waste_type:string sub_type:string quantity_kg:long quality:string location_name:string location_lat:double location_lon:double seller_name:string seller_contact:string price_per_kg:long description:string")
RECYCLERS = _schema("recycler_id:long name:string waste_types:string lat:double lon:double capacity_kg_per_month:long")
PROFILES = _schema("recycler_id:long address:string area:string phone:string email:string website:string is_sample_profile:boolean profile_note:string")
FACTORS = _schema("sub_type:string waste_type:string co2e_saved_kg_per_kg:double factor_basis:string is_proxy:string source:string source_url:string notes:string")
MAPPING = _schema("dataset:string source_label:string canonical_waste_type:string canonical_sub_type:string status:string notes:string")
ANSWER = _schema(
    "id:string created_at:string source:string mode:string item_key:string image_sha256:strings image_files:strings predicted_label:string predicted_sub_type:string predicted_confidence:double "
    "is_correct:boolean actual_label:string actual_sub_type:string type_correct:boolean subtype_correct:boolean model_weights:string"
)


#: Quotes inside a quoted field are doubled; white space belongs to a field.
CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).options(**CSV).csv(path)


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, LISTINGS).withColumn("is_synthetic", F.lit(True))


def read_recyclers(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, RECYCLERS).withColumn("types", split_types(F.col("waste_types")))


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, PROFILES)


def read_factors(spark: SparkSession, path: str) -> DataFrame:
    """``is_proxy`` is true for the trimmed, lower-cased text ``true`` and false for everything else."""
    return read_csv(spark, path, FACTORS).withColumn("is_proxy", F.coalesce(F.lower(F.trim("is_proxy")) == "true", F.lit(False)))


def hierarchy(mapping: DataFrame) -> DataFrame:
    """``waste_type, subs``: sorted distinct sub-types; blank rows are left out."""
    m = mapping.select(F.trim("canonical_waste_type").alias("waste_type"), F.trim("canonical_sub_type").alias("s")).where("waste_type <> '' and s <> ''")
    return m.groupBy("waste_type").agg(F.array_sort(F.collect_set("s")).alias("subs"))


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """Label mapping keyed by dataset and lower-cased label; a key that stands twice is refused."""
    m = read_csv(spark, path, MAPPING).withColumn("label_key", F.lower(F.trim("source_label")))
    twice = m.groupBy("dataset", "label_key").count().where("count > 1").limit(1).count()
    if twice:
        raise ValueError("a (dataset, label) pair is mapped twice")
    return m


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """The feedback log; blank and half-written lines are skipped."""
    schema = T.StructType([*ANSWER.fields, T.StructField("_broken", T.StringType())])
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    return rows.where(F.col("_broken").isNull() & F.col("item_key").isNotNull()).drop("_broken")


def append_answers(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_coco(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``images``, ``annotations`` and ``categories`` of a COCO file, as tables."""
    schema = "images array<struct<id: long, file_name: string>>, annotations array<struct<id: long, image_id: long, category_id: long, bbox: array<double>, area: double, iscrowd: int>>, categories array<struct<id: long, name: string>>"
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    return {part: doc.select(F.explode(part).alias("x")).select("x.*") for part in ("images", "annotations", "categories")}


def coco_rows(coco: dict[str, DataFrame]) -> DataFrame:
    """One row per annotation with its file and category."""
    images = coco["images"].select(F.col("id").alias("image_id"), "file_name")
    cats = coco["categories"].select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    return coco["annotations"].join(images, "image_id").join(cats, "category_id").select("file_name", "category", "bbox", "area", "iscrowd")


def coco_audit(coco: dict[str, DataFrame], files: DataFrame) -> DataFrame:
    """One row of counters; ``files`` has ``file_name``."""
    names, used = coco["images"].select("file_name"), coco["annotations"].select(F.col("image_id").alias("id"))
    box = F.col("bbox")
    bad = (F.size("bbox") < 4) | (F.get(box, F.lit(2)) <= 0) | (F.get(box, F.lit(3)) <= 0)
    counts = [
        names.join(files, "file_name", "left_anti").agg(F.count("*").alias("missing_files")),
        files.join(names, "file_name", "left_anti").agg(F.count("*").alias("unlisted_files")),
        coco["images"].join(used, "id", "left_anti").agg(F.count("*").alias("without_annotation")),
        coco["annotations"].agg(F.count_if(F.coalesce(bad, F.lit(True))).alias("bad_boxes"), F.count_if(F.col("iscrowd") == 1).alias("crowd")),
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.crossJoin(c)  # rows of counters, one each
    return out


def read_voc(spark: SparkSession, path: str) -> DataFrame:
    """One row per ``<object>`` of VOC files, with the scene from the file name."""
    schema = "name string, difficult int, truncated int, occluded int, bndbox struct<xmin: double, ymin: double, xmax: double, ymax: double>"
    rows = spark.read.format("xml").option("rowTag", "object").schema(schema).load(path)
    scene = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.xml$", 1)
    ok = F.col("bndbox.xmax") > F.col("bndbox.xmin")
    return rows.select(scene.alias("scene"), F.col("name").alias("label"), "bndbox.*", (ok & (F.col("bndbox.ymax") > F.col("bndbox.ymin"))).alias("valid"))


VOC = "object array<struct<name: string, difficult: string, truncated: string, occluded: string, polygon: string, bndbox: struct<xmin: string, ymin: string, xmax: string, ymax: string>>>"


def read_voc_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per VOC file under ``path``: ``stem`` (path without extension), ``folder``, ``broken`` (not well-formed) and its ``objects``."""
    text = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").text(path)
    doc = F.from_xml("value", f"struct<{VOC}, _broken: string>", {"rowTag": "annotation", "columnNameOfCorruptRecord": "_broken"})
    where = F.col("_metadata.file_path")
    rows = text.select(F.regexp_replace(where, r"\.xml$", "").alias("stem"), F.regexp_extract(where, r"([^/]+)/[^/]+$", 1).alias("folder"), doc.alias("doc"))
    broken = F.col("doc").isNull() | F.col("doc._broken").isNotNull()
    return rows.select("stem", "folder", broken.alias("broken"), F.when(~broken, F.coalesce("doc.object", F.array())).alias("objects"))


#: Extensions of a photo, in the order in which a file with several is looked up.
PHOTO_ENDS = (".jpg", ".jpeg", ".png", ".JPG")


def voc_objects(files: DataFrame) -> DataFrame:
    """One row per object of well-formed files: scene, label, box, ``problem`` (missing_box, degenerate_box, null) and its flags."""
    o = files.where("not broken").select("stem", "folder", F.explode("objects").alias("o"))
    side = lambda c: F.expr(f"try_cast(trim(o.bndbox.{c}) as double)").alias(c)
    flag = lambda c: (F.trim(F.coalesce(F.col(f"o.{c}"), F.lit("0"))) == "1").alias(c)
    rows = o.select("stem", F.try_element_at(F.create_map(*[F.lit(x) for kv in SPLITS.items() for x in kv]), F.lower("folder")).alias("split"), F.trim(F.coalesce("o.name", F.lit(""))).alias("label"), *[side(c) for c in ("xmin", "ymin", "xmax", "ymax")], F.col("o.polygon").isNotNull().alias("has_polygon"), *[flag(c) for c in ("difficult", "truncated", "occluded")])
    missing = F.greatest(*[F.col(c).isNull() for c in ("xmin", "ymin", "xmax", "ymax")])
    return rows.withColumn("problem", F.when(missing, "missing_box").when((F.col("xmax") <= F.col("xmin")) | (F.col("ymax") <= F.col("ymin")), "degenerate_box"))


def voc_audit(files: DataFrame, photos: DataFrame) -> DataFrame:
    """One row of counters over :func:`read_voc_files`; ``photos`` has a ``path`` per photo, in the same notation.

    A file without photo counts as that alone, whether well-formed or not; a photo is without annotation unless a well-formed file is its.
    """
    cut_ = F.regexp_extract("path", r"^(.*)(\.[^./]+)$", 1).alias("stem")
    end = F.regexp_extract("path", r"(\.[^./]+)$", 1)
    place = F.coalesce(*[F.when(end == e, F.lit(k)) for k, e in enumerate(PHOTO_ENDS)])
    first = photos.select(cut_, place.alias("place")).where("place is not null").groupBy("stem").agg(F.min("place").alias("place"))
    j = files.join(first, "stem", "left").withColumn("found", F.col("place").isNotNull())
    scene = j.where("found and not broken")
    o = voc_objects(scene)
    counts = j.agg(F.count("*").alias("annotation_files"), F.count_if(~F.col("found")).alias("xml_without_image"), F.count_if(F.col("found") & F.col("broken")).alias("malformed_xml"), F.count_if(F.col("found") & ~F.col("broken")).alias("scenes"))
    boxes = o.agg(F.count_if(F.col("problem") == "missing_box").alias("missing_box"), F.count_if(F.col("problem") == "degenerate_box").alias("degenerate_box"), F.count_if(F.col("problem").isNull()).alias("objects"))
    alone = photos.agg(F.count_distinct("path").alias("_photos"))
    return counts.crossJoin(boxes).crossJoin(alone).withColumn("image_without_xml", F.col("_photos") - F.col("scenes")).drop("_photos")  # rows of counters, one each


#: Folder names that mean a split.
SPLITS = {"train": "train", "training": "train", "val": "val", "valid": "val", "validation": "val", "test": "test", "testing": "test"}


def path_parts(path: Column) -> tuple[Column, Column]:
    """Label (the last folder) and split (the first folder from the root that names one, else null) of a file path."""
    parts = F.split(path, "/")
    names = F.create_map(*[F.lit(x) for kv in SPLITS.items() for x in kv])
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    splits = F.filter(F.transform(folders, lambda p: F.try_element_at(names, F.lower(p))), lambda x: x.isNotNull())
    return F.try_element_at(folders, F.lit(-1)), F.try_element_at(splits, F.lit(1))


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: path, label, split, bytes, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    label, split = path_parts(F.col("path"))
    return files.select("path", label.alias("label"), split.alias("split"), F.col("length").alias("bytes"), "content")


def manifest(files: DataFrame) -> DataFrame:
    return files.select("path", F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"), F.sha1(F.concat_ws(":", "path", "bytes").cast("binary")).alias("fingerprint"), "bytes")


def folder_digest(table: DataFrame, buckets: int = 4096) -> DataFrame:
    """One digest of all (path, sha256) pairs, in two levels: a digest per hash bucket, then one over the buckets."""
    line = F.concat_ws(" ", "path", "sha256")
    per = table.groupBy(F.pmod(F.xxhash64("path"), F.lit(buckets)).alias("bucket")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("d"))
    return per.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "d"))), lambda x: x["d"]), "\n"), 256).alias("digest"))


#: Rows of a leaf of a digest tree, on average, and hexadecimal digits of its deepest level.
LEAF_ROWS, DEEPEST = 256, 8


def depth_for(rows: int) -> int:
    """Levels below the root that keep leaves at about ``LEAF_ROWS``; two trees are compared at one depth."""
    depth = 0
    while rows > LEAF_ROWS * 16**depth and depth < DEEPEST:
        depth += 1
    return depth


def _leaf(path: str, depth: int) -> Column:
    return F.substring(F.md5(F.col(path).cast("string").cast("binary")), 1, depth)


def digest_tree(manifest: DataFrame, depth: int) -> DataFrame:
    """``level, node, digest, n`` of a Merkle tree over ``path, sha``: a node is a prefix of the paths' hashes, 16 to a parent.

    A leaf's digest is of its lines "path sha" in order, a parent's of its children "node digest" in order. Leaves are
    of bounded size by ``depth``, so nothing is ordered as a whole; the root stands for all rows.
    """
    line = F.concat_ws(" ", F.col("path").cast("string"), "sha")
    rows = manifest.select(_leaf("path", depth).alias("node"), line.alias("line"))
    sha = lambda lines: F.sha2(F.array_join(F.array_sort(F.collect_list(lines)), "\n").cast("binary"), 256)
    level = rows.groupBy("node").agg(sha(F.col("line")).alias("digest"), F.count("*").alias("n"))
    tree = level = cut(level.select(F.lit(depth).alias("level"), "node", "digest", "n"))
    for at in range(depth - 1, -1, -1):
        up = level.groupBy(F.substring("node", 1, at).alias("node")).agg(sha(F.concat_ws(" ", "node", "digest")).alias("digest"), F.sum("n").alias("n"))
        level = up.select(F.lit(at).alias("level"), "node", "digest", "n")
        tree = tree.unionByName(level)
    return tree


def changed_leaves(old: DataFrame, new: DataFrame, depth: int) -> DataFrame:
    """``node`` of the leaves that differ between two trees, top down: below a node of equal digest nothing is compared."""
    side = lambda t, at, name: t.where(F.col("level") == at).select("node", F.col("digest").alias(name))
    parents = None
    for at in range(depth + 1):
        a, b = side(old, at, "was"), side(new, at, "is")
        if parents is not None:
            inside = lambda t: t.withColumn("_up", F.substring("node", 1, at - 1)).join(parents, "_up", "left_semi").drop("_up")  # noqa: B023, E731
            a, b = inside(a), inside(b)
        parents = cut(a.join(b, "node", "full").where(~F.col("was").eqNullSafe(F.col("is"))).select(F.col("node").alias("_up")))
    return parents.withColumnRenamed("_up", "node")


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``path, change`` (added, removed, changed) between two manifests of ``path, sha``: only the rows of leaves that differ meet."""
    depth = depth_for(max(old.count(), new.count()))
    leaves = bounded(changed_leaves(digest_tree(old, depth), digest_tree(new, depth), depth))
    rows = lambda m, name: m.select("path", F.col("sha").alias(name), _leaf("path", depth).alias("node")).join(leaves, "node", "left_semi").drop("node")
    j = rows(old, "was").join(rows(new, "is"), "path", "full").where(~F.col("was").eqNullSafe(F.col("is")))
    return j.select("path", F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").otherwise("changed").alias("change"))


def cache_key(texts: DataFrame, model: str) -> DataFrame:
    """One row ``key``: a vector cache holds while the model and the texts (id, text), in the order of their ids, are the same."""
    rows = texts.select(F.col("id").alias("path"), F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("sha"))
    root = digest_tree(rows, depth_for(rows.count())).where("level = 0").select("digest")
    none = F.coalesce(F.max("digest"), F.lit(""))  # no texts
    return root.agg(F.sha2(F.concat_ws("\n", F.lit(model), none).cast("binary"), 256).alias("key"))


def cached_or_new(texts: DataFrame, cache: DataFrame, key: str, encode) -> DataFrame:
    """``id, embedding``: the whole cache (key, id, embedding) where its key is the texts' :func:`cache_key`, else all texts encoded anew."""
    mine = cache.where(F.col("key") == key).select("id", "embedding")
    return mine if mine.limit(1).count() else encode(texts)


def store_new(photos: DataFrame, store_path: str, budget_bytes: int) -> int:
    """Append every photo whose sha isn't stored yet; refuse when the store would exceed its budget. Returns the photos written."""
    spark = photos.sparkSession
    fresh = photos.dropDuplicates(["sha"])
    try:
        old = spark.read.schema("sha string, bytes long, content binary").parquet(store_path)
        fresh, used = fresh.join(old.select("sha"), "sha", "left_anti"), old.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    except Exception as e:  # a store that doesn't exist yet is empty
        if "PATH_NOT_FOUND" not in str(e):
            raise
        used = 0
    n, more = fresh.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    if n and used + more > budget_bytes:
        raise OverflowError("the photo store is full")
    if n:
        fresh.select("sha", "bytes", "content").write.mode("append").parquet(store_path)
    return n


def write_tsv(table: DataFrame, path: str) -> None:
    table.write.options(**CSV, sep="\t").csv(path)


def write_rows(table: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with a fixed list of columns; others are left out."""
    table.select(*columns).write.options(**CSV).csv(path)


def write_metrics(row: DataFrame, path: str) -> None:
    """JSON of a one-row table of metrics."""
    row.limit(1).coalesce(1).write.json(path)


def embed_new(texts: DataFrame, cache: DataFrame, model: str, encode) -> DataFrame:
    """Vectors of all ``texts`` (id, text): cached per (model, text) and encoded only where new; ``encode`` maps a DataFrame (sha, text) to (sha, embedding)."""
    keyed = texts.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    have = cache.where(F.col("model") == model).select("sha", "embedding")
    fresh = encode(keyed.select("sha", "text").dropDuplicates(["sha"]).join(have.select("sha"), "sha", "left_anti"))
    return keyed.join(have.unionByName(fresh.select("sha", "embedding")), "sha").select("id", "embedding")


def append_listings(existing: DataFrame, new: DataFrame, order: str, most: int = 1000) -> DataFrame:
    """New rows with the next ids in arrival order; at most ``most`` user listings are held (that limit is the rule), counting those of ``existing`` (``is_user``)."""
    held = existing.where("is_user").count() if "is_user" in existing.columns else 0
    top = existing.agg(F.coalesce(F.max("waste_id"), F.lit(0)).alias("_top"))
    place = F.row_number().over(Window.orderBy(order))
    kept = new.orderBy(order).limit(max(0, most - held)).withColumn("_n", place)
    return kept.crossJoin(F.broadcast(top)).withColumn("waste_id", F.col("_top") + F.col("_n")).drop("_top", "_n")


def validate(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds ``errors``: the names of the broken rules, null counting as broken; valid rows have none."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return rows.withColumn("errors", broken)


#: Rules of a published listing.
LISTING_RULES = {
    "quantity": "quantity_kg > 0 and quantity_kg <= 100000000",
    "quality": "quality in ('good', 'fair', 'poor')",
    "place": "lat between -90 and 90 and lon between -180 and 180",
    "price": "price is null or price between 0 and 1000000",
    "phone": r"phone is null or regexp_like(phone, '^\\+?[0-9]{8,15}$')",
}


#: Rules of a listing's texts.
TEXT_RULES = {
    "sub_type": "sub_type is null or char_length(sub_type) <= 60",
    "location": "char_length(location_name) between 1 and 120",
    "seller": "char_length(seller_name) between 1 and 120",
    "contact": "seller_contact is null or char_length(seller_contact) <= 40",
    "description": "char_length(description) <= 2000",
}
#: Rules of a request for matches: a listing's id, or all that describes one.
MATCH_RULES = {
    "id or fields": "waste_id is not null or (waste_type is not null and quantity_kg is not null and lat is not null and lon is not null)",
    "sub_type": "sub_type is null or char_length(sub_type) <= 60",
    "quantity": "quantity_kg is null or (quantity_kg > 0 and quantity_kg <= 100000000)",
    "place": "(lat is null or lat between -90 and 90) and (lon is null or lon between -180 and 180)",
    "top_k": "top_k between 1 and 50",
}


def match_rules() -> dict[str, Column]:
    return {k: F.expr(v) for k, v in MATCH_RULES.items()}


def listing_rules(texts: bool = False) -> dict[str, Column]:
    """The rules of a listing; with ``texts`` those of its text fields, too."""
    return {k: F.expr(v) for k, v in (LISTING_RULES | TEXT_RULES if texts else LISTING_RULES).items()}
