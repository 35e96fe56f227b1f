"""Sources, sinks and streams on temporary files."""

import json

import pytest
from pyspark.sql import functions as F

from loopgrade.operators import feedback
from loopgrade.sources import files
from loopgrade.streaming import jobs


def test_csv_tables(spark, tmp_path):
    (tmp_path / "r.csv").write_text('recycler_id,name,waste_types,lat,lon,capacity_kg_per_month\n1,A,"textile, plastic",12.9,77.5,1000\n')
    assert files.read_recyclers(spark, str(tmp_path / "r.csv")).first().types == ["textile", "plastic"]
    (tmp_path / "f.csv").write_text("sub_type,waste_type,co2e_saved_kg_per_kg,factor_basis,is_proxy,source,source_url,notes\nx,y,1.5,b, TRUE ,s,,\nz,y,2,b,maybe,s,,\nw,y,2,b,,s,,\n")
    assert {r.sub_type: r.is_proxy for r in files.read_factors(spark, str(tmp_path / "f.csv")).collect()} == {"x": True, "z": False, "w": False}
    (tmp_path / "m.csv").write_text("dataset,source_label,canonical_waste_type,canonical_sub_type,status,notes\nd,A,metal,tin,mapped,\nd,B,metal,iron,mapped,\nd,C,,,unmapped,\n")
    m = files.read_mapping(spark, str(tmp_path / "m.csv"))
    assert [tuple(r) for r in files.hierarchy(m).collect()] == [("metal", ["iron", "tin"])]
    (tmp_path / "m2.csv").write_text("dataset,source_label,canonical_waste_type,canonical_sub_type,status,notes\nd,A,metal,tin,mapped,\nd,a ,metal,iron,mapped,\n")
    with pytest.raises(ValueError, match="twice"):
        files.read_mapping(spark, str(tmp_path / "m2.csv"))
    head = "waste_id,waste_type,sub_type,quantity_kg,quality,location_name,location_lat,location_lon,seller_name,seller_contact,price_per_kg,description\n"
    (tmp_path / "l.csv").write_text(head + "1,metal,tin,5,good,Z,12.9,77.5,S,c,3,d\n")
    assert files.read_listings(spark, str(tmp_path / "l.csv")).first().is_synthetic
    (tmp_path / "q.csv").write_text(head + '1,metal,tin,5,good,Z,12.9,77.5,"The ""Old"" Mill, Z",c,3,"say ""hi"""\n')
    r = files.read_listings(spark, str(tmp_path / "q.csv")).first()
    assert (r.seller_name, r.description, r.price_per_kg) == ('The "Old" Mill, Z', 'say "hi"', 3)


def test_feedback_log(spark, tmp_path):
    lines = [json.dumps({"id": "1", "item_key": "k", "is_correct": True, "image_sha256": ["s"]}), "", '{"id": "2", "item_k', json.dumps({"id": "3", "item_key": "m", "subtype_correct": None})]
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    rows = files.read_answers(spark, str(tmp_path / "log.jsonl"))
    assert sorted(r.id for r in rows.collect()) == ["1", "3"]
    files.append_answers(rows, str(tmp_path / "out"))
    files.append_answers(rows, str(tmp_path / "out"))
    assert files.read_answers(spark, str(tmp_path / "out")).count() == 4


def test_coco(spark, tmp_path):
    doc = {
        "images": [{"id": 1, "file_name": "a.jpg"}, {"id": 2, "file_name": "b.jpg"}],
        "annotations": [{"id": 1, "image_id": 1, "category_id": 7, "bbox": [0, 0, 5, 5], "iscrowd": 0}, {"id": 2, "image_id": 1, "category_id": 7, "bbox": [0, 0, 0, 5], "iscrowd": 1}],
        "categories": [{"id": 7, "name": "tin"}],
    }
    (tmp_path / "c.json").write_text(json.dumps(doc, indent=1))
    coco = files.read_coco(spark, str(tmp_path / "c.json"))
    assert files.coco_rows(coco).count() == 2
    r = files.coco_audit(coco, spark.createDataFrame([("a.jpg",), ("z.jpg",)], "file_name string")).first()
    assert (r.missing_files, r.unlisted_files, r.without_annotation, r.bad_boxes, r.crowd) == (1, 1, 1, 1, 1)


def test_voc_and_folders(spark, tmp_path):
    d = tmp_path / "train" / "brick"
    d.mkdir(parents=True)
    (d / "x.xml").write_text("<annotation><object><name>brick</name><difficult>0</difficult><bndbox><xmin>1</xmin><ymin>1</ymin><xmax>9</xmax><ymax>9</ymax></bndbox></object><object><name>tile</name><bndbox><xmin>5</xmin><ymin>1</ymin><xmax>5</xmax><ymax>9</ymax></bndbox></object></annotation>")
    rows = {r.label: r for r in files.read_voc(spark, str(d)).collect()}
    assert rows["brick"].valid and not rows["tile"].valid and rows["brick"].scene == "x"
    (d / "p.jpg").write_bytes(b"one")
    (d / "q.jpg").write_bytes(b"one")
    photos = files.read_folder(spark, str(tmp_path)).where("path like '%.jpg'")
    assert {(r.label, r.split) for r in photos.collect()} == {("brick", "train")}
    man = files.manifest(photos)
    assert man.select("sha256").distinct().count() == 1 and man.select("fingerprint").distinct().count() == 2
    assert files.folder_digest(man).first().digest == files.folder_digest(man.repartition(3)).first().digest
    files.write_tsv(man.select("path", "md5"), str(tmp_path / "tsv"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "tsv")).columns == ["path", "md5"]


def test_store_and_cache(spark, tmp_path):
    photos = spark.createDataFrame([("s1", 3, b"abc"), ("s1", 3, b"abc"), ("s2", 2, b"xy")], "sha string, bytes long, content binary")
    store = str(tmp_path / "store")
    assert files.store_new(photos, store, 10) == 2 and files.store_new(photos, store, 10) == 0
    with pytest.raises(OverflowError):
        files.store_new(spark.createDataFrame([("s3", 9, b"123456789")], photos.schema), store, 10)
    assert spark.read.parquet(store).count() == 2
    seen = []

    def encode(df):
        seen.append(df.count())
        return df.select("sha", F.array(F.length("text").cast("double")).alias("embedding"))

    cache = spark.createDataFrame([], "model string, sha string, embedding array<double>")
    texts = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, "b")], "id long, text string")
    assert files.embed_new(texts, cache, "m", encode).count() == 3 and seen == [2]


def test_rows_and_ids(spark, tmp_path):
    df = spark.createDataFrame([(1, 5, "good", 1.0, 2.0, 0, None), (2, 0, "x", 99.0, 2.0, -1, "12a")], "waste_id long, quantity_kg long, quality string, lat double, lon double, price long, phone string")
    got = {r.waste_id: r.errors for r in files.validate(df, files.listing_rules()).collect()}
    assert got == {1: [], 2: ["quantity", "quality", "place", "price", "phone"]}
    files.write_rows(df, str(tmp_path / "o"), ["waste_id", "price"])
    assert spark.read.option("header", True).csv(str(tmp_path / "o")).columns == ["waste_id", "price"]
    files.write_metrics(df.agg(F.count("*").alias("n")), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first().n == 2
    new = spark.createDataFrame([("b",), ("a",)], "name string")
    assert [(r.name, r.waste_id) for r in files.append_listings(df, new, "name").orderBy("waste_id").collect()] == [("a", 3), ("b", 4)]


SCHEMA = "seq long, item_key string, actual string, is_correct boolean, created_at timestamp"


def test_streams_equal_batches(spark, tmp_path):
    log = tmp_path / "log"
    rows = [(i, f"k{i % 7}", "ab"[i % 2], i % 3 == 0, f"2024-01-{1 + i // 10:02d} 0{i % 10}:00:00") for i in range(90)]
    df = spark.createDataFrame(rows, "seq long, item_key string, actual string, is_correct boolean, t string").select("seq", "item_key", "actual", "is_correct", F.col("t").cast("timestamp").alias("created_at"))
    for part in (df.where("seq < 50"), df.where("seq >= 50")):  # two arrivals, one run after each
        part.coalesce(1).write.mode("append").parquet(str(log))
        jobs.upsert_latest(jobs.read_log(spark, str(log), SCHEMA), str(tmp_path / "store"), str(tmp_path / "check")).awaitTermination()
        jobs.summary_stream(jobs.read_log(spark, str(log), SCHEMA), str(tmp_path / "s2"), str(tmp_path / "c2")).awaitTermination()
    assert sorted(x.name for x in (tmp_path / "store").iterdir()) == ["gen=0", "new=1"]
    store = jobs.read_latest(spark, str(tmp_path / "store"))
    want = sorted(map(tuple, feedback.latest(df).select("item_key", "seq", "actual").collect()))
    assert sorted(map(tuple, store.select("item_key", "seq", "actual").collect())) == want
    assert jobs.read_summary(spark, str(tmp_path / "s2")).collect() == feedback.summary(df).collect()
    changes = [spark.read.parquet(str(tmp_path / "s2" / x)).first() for x in ("gen=0", "new=1")]
    assert changes[0].n == 7 and changes[1].n == 0  # the second arrival only supersedes: what it adds it takes away
    for n, f in (("trend", jobs.trend), ("sessions", lambda x: jobs.sessions(x, "90 minutes"))):
        q = f(jobs.read_log(spark, str(log), SCHEMA)).writeStream.outputMode("complete").format("memory").queryName(n).trigger(availableNow=True).start()
        q.awaitTermination()
        assert sorted(map(tuple, spark.table(n).collect())) == sorted(map(tuple, f(df).collect()))
    q = jobs.latest_stream(jobs.read_log(spark, str(log), SCHEMA)).writeStream.outputMode("complete").format("memory").queryName("latest").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.item_key, r.seq, r.actual) for r in spark.table("latest").collect()) == want
    assert jobs.restore(spark, str(tmp_path / "none"), str(log), SCHEMA).count() == 90


def test_upsert_merges_every_few_batches(spark, tmp_path):
    schema, store = "seq long, item_key string, actual string", str(tmp_path / "store")
    want = {}
    for n in range(8):
        rows = [(n * 10 + i, f"k{(n * i) % 6}", f"a{n}{i}") for i in range(5)]
        want |= {k: (s, a) for s, k, a in rows}
        batch = spark.createDataFrame(rows, schema)
        for _ in range(1 + n % 2):  # every other batch is replayed
            jobs._merge(batch, n, store, 3)
        assert {r.item_key: (r.seq, r.actual) for r in jobs.read_latest(spark, store).collect()} == want
    assert sorted(x.name for x in (tmp_path / "store").iterdir()) == ["gen=3", "gen=6", "new=4", "new=5", "new=7"]


def test_entry(spark):
    import __spark_entry__ as e

    queries, oracles = e.queries(), e.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 130
    assert e.entry(spark).limit(5).count() == 5


def test_voc_audit(spark, tmp_path):
    d = tmp_path / "Valid"
    d.mkdir()
    box = lambda a, b, c, e: f"<bndbox><xmin>{a}</xmin><ymin>{b}</ymin><xmax>{c}</xmax><ymax>{e}</ymax></bndbox>"
    good = f"<annotation><folder>f</folder><object><name> brick </name><truncated>1</truncated><polygon><x1>3</x1></polygon>{box(1, 1, 9, 9)}</object><object><name>tile</name>{box(5, 1, 5, 9)}</object><object><name>tile</name></object><object><name>tile</name>{box('a', 1, 5, 9)}</object></annotation>"
    (d / "a.xml").write_text(good)
    (d / "b.xml").write_text(good[:60])  # cut off
    (d / "c.xml").write_text(good)  # no photo
    (d / "e.xml").write_text("<annotation><folder>f</folder></annotation>")  # no object
    for name in ("a.jpg", "a.png", "b.jpg", "e.jpeg", "z.jpg"):
        (d / name).write_bytes(b"x")
    voc = files.read_voc_files(spark, str(tmp_path))
    photos = files.read_folder(spark, str(tmp_path)).where("path not like '%.xml'").select("path")
    r = files.voc_audit(voc, photos).first()
    assert (r.annotation_files, r.xml_without_image, r.malformed_xml, r.scenes) == (4, 1, 1, 2)
    assert (r.missing_box, r.degenerate_box, r.objects, r.image_without_xml) == (2, 1, 1, 3)
    o = files.voc_objects(voc).where("problem is null and stem like '%/a'").first()
    assert (o.label, o.split, o.has_polygon, o.truncated, o.difficult, o.xmax) == ("brick", "val", True, True, False, 9.0)


def test_digest_trees_find_changes_top_down(spark, monkeypatch):
    monkeypatch.setattr(files, "LEAF_ROWS", 4)
    old = spark.createDataFrame([(f"p{i}", f"s{i}") for i in range(300)], "path string, sha string")
    new = spark.createDataFrame([(f"p{i}", "other" if i == 7 else f"s{i}") for i in range(301) if i != 9], "path string, sha string")
    assert sorted(map(tuple, files.changes(old, new).collect())) == [("p300", "added"), ("p7", "changed"), ("p9", "removed")]
    depth = files.depth_for(300)
    leaves = files.changed_leaves(files.digest_tree(old, depth), files.digest_tree(new, depth), depth)
    assert depth == 2 and leaves.count() <= 3 and files.changes(old, old).count() == 0
    assert files.changes(old, old.limit(0)).count() == 300 and files.changes(old.limit(0), old.limit(0)).count() == 0


def test_cache_holds_for_the_same_model_and_texts(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, text string")
    key = lambda t, m="m": files.cache_key(t, m).first().key
    assert key(texts) == key(texts.orderBy(F.desc("id"))) and len({key(texts), key(texts, "n"), key(texts.where("id < 3")), key(texts.withColumn("id", 3 - F.col("id"))), key(texts.limit(0))}) == 5
    cache = texts.select(F.lit(key(texts)).alias("key"), "id", F.lit("old").alias("embedding"))
    encode = lambda t: t.select("id", F.lit("new").alias("embedding"))
    assert {r.embedding for r in files.cached_or_new(texts, cache, key(texts), encode).collect()} == {"old"}
    assert {r.embedding for r in files.cached_or_new(texts, cache, key(texts, "n"), encode).collect()} == {"new"}


def test_held_listings_count(spark):
    have = spark.createDataFrame([(i, i > 2) for i in range(1, 6)], "waste_id long, is_user boolean")
    new = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    assert [(r.name, r.waste_id) for r in files.append_listings(have, new, "name", most=5).orderBy("name").collect()] == [("a", 6), ("b", 7)]


def test_written_tables_can_be_released(spark):
    import os

    from loopgrade.functions import session

    session.release(spark)
    rows = session.written(spark.range(5))
    path = rows.inputFiles()[0].removeprefix("file:").replace("//", "/")
    assert rows.count() == 5 and os.path.exists(path) and session.release(spark) == 1 and not os.path.exists(path) and session.release(spark) == 0
