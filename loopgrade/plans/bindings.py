"""How the driver's tables become operator inputs.

Every binding is one SQL text that reads the same in Spark and in DuckDB; the oracles put it in a WITH
clause, :func:`bind` runs it on the Parquet tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_SEG = "CASE (k + {0}) % 4 WHEN 0 THEN 'AUTOMOBILE' WHEN 1 THEN 'BUILDING' WHEN 2 THEN 'FURNITURE' ELSE 'HOUSEHOLD' END"

SQL: dict[str, str] = {
    "listings": """
        SELECT o_orderkey AS waste_id, c_mktsegment AS waste_type,
               CASE WHEN o_orderkey % 11 = 0 THEN 'unknown' ELSE o_orderpriority END AS sub_type,
               CAST(floor(o_totalprice) AS BIGINT) AS quantity_kg,
               CASE o_orderstatus WHEN 'F' THEN 'good' WHEN 'O' THEN 'fair' ELSE 'poor' END AS quality,
               n_name AS location_name,
               CAST(12.8 AS DOUBLE) + CAST(o_custkey * 37 % 401 AS DOUBLE) / 1000 AS lat,
               CAST(77.5 AS DOUBLE) + CAST(o_custkey * 53 % 301 AS DOUBLE) / 1000 AS lon,
               o_orderkey % 128 AS price
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "recyclers": f"""
        SELECT s_suppkey AS recycler_id, s_name AS name,
               CASE WHEN k < 2 THEN {_SEG.format(0)}
                    WHEN k < 4 THEN concat({_SEG.format(0)}, ', ', {_SEG.format(1)})
                    WHEN k < 6 THEN concat({_SEG.format(0)}, ', ', {_SEG.format(1)}, ', ', {_SEG.format(2)})
                    ELSE concat({_SEG.format(0)}, ', ', {_SEG.format(1)}, ', ', {_SEG.format(2)}, ', ', {_SEG.format(3)}) END AS waste_types,
               CAST(12.8 AS DOUBLE) + CAST(s_suppkey * 37 % 401 AS DOUBLE) / 1000 AS lat,
               CAST(77.5 AS DOUBLE) + CAST(s_suppkey * 53 % 301 AS DOUBLE) / 1000 AS lon,
               10000 + s_suppkey * 7919 % 190001 AS capacity
        FROM (SELECT supplier.*, s_suppkey % 8 AS k FROM supplier) AS s""",
    "factors": """
        SELECT * FROM (VALUES
            ('1-URGENT', 'AUTOMOBILE', CAST(1.349 AS DOUBLE), true, 'source b', 'https://www.alpha.example.org/x/y ; http://beta.example.com', 'method one', 'half and half'),
            ('2-HIGH', 'AUTOMOBILE', CAST(0.011 AS DOUBLE), false, 'source a', 'http://gamma.example.net/q', 'method two', ''),
            ('3-MEDIUM', 'BUILDING', CAST(2.5 AS DOUBLE), false, 'source c', NULL, 'method three', NULL),
            ('reel', 'FURNITURE', CAST(0.75 AS DOUBLE), true, 'source d', 'https://delta.example.org', '', 'note'),
            ('cask', 'HOUSEHOLD', CAST(0.05 AS DOUBLE), false, 'source a', 'https://www.eps.example.org/p', 'method five', 'note two')
        ) AS t(sub_type, waste_type, factor, is_proxy, source, source_url, basis, notes)""",
    "codes": """
        SELECT * FROM (VALUES ('FURNITURE', '4-NOT SPECIFIED', 'reel'), ('HOUSEHOLD', '4-NOT SPECIFIED', 'cask'),
                              ('BUILDING', '5-LOW', '3-MEDIUM'), ('MACHINERY', '5-LOW', '5-LOW')) AS t(waste_type, photo_sub, market_sub)""",
    "answers": """
        SELECT event_id AS seq, event_id AS id, user_id AS item_key, ts AS created_at, event_id % 3 <> 0 AS is_correct, event_type AS predicted,
               CASE WHEN event_id % 17 = 0 THEN NULL
                    WHEN event_id % 3 <> 0 THEN event_type
                    ELSE CASE event_id % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'purchase' WHEN 3 THEN 'signup' ELSE 'other' END END AS actual,
               event_id % 4 + 1 AS n_photos, event_id % 5 AS n_files,
               CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat('s', CAST(event_id % 3 AS VARCHAR(20))) END AS predicted_sub,
               CASE WHEN event_id % 6 < 4 THEN '' ELSE concat('s', CAST(event_id % 4 AS VARCHAR(20))) END AS actual_sub
        FROM events""",
    "leaf_probs": """
        SELECT vec_id AS id, leaf, waste_type, sub_type, CAST(w AS DOUBLE) / CAST(sum(w) OVER (PARTITION BY vec_id) AS DOUBLE) AS p
        FROM (SELECT vec_id, leaf, waste_type, sub_type, 1 + (vec_id * 31 + leaf_no * 17) % 97 AS w
              FROM embeddings CROSS JOIN (VALUES (0, 'a__p', 'a', 'p'), (1, 'a__q', 'a', 'q'), (2, 'a__r', 'a', 'r'), (3, 'b__p', 'b', 'p'),
                   (4, 'b__q', 'b', 'q'), (5, 'c__p', 'c', 'p'), (6, 'c__q', 'c', 'q'), (7, 'c__r', 'c', 'r'), (8, 'c__s', 'c', 's'),
                   (9, 'd', 'd', NULL), (10, 'e__p', 'e', 'p'), (11, 'e__q', 'e', 'q')) AS l(leaf_no, leaf, waste_type, sub_type)) AS x""",
    "scored": """
        SELECT doc_id AS id, CAST(quality AS INT) AS truth, CAST(n_chars % 1000 AS DOUBLE) / 1000 AS score,
               CASE WHEN n_chars % 1000 >= 500 THEN 1 ELSE 0 END AS pred, lang, source
        FROM labels JOIN documents USING (doc_id)""",
    "classified": """
        SELECT event_id AS id, event_type AS truth,
               CASE WHEN event_id % 4 < 2 THEN event_type ELSE CASE event_id % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'purchase' WHEN 3 THEN 'signup' ELSE 'error' END END AS pred,
               CAST(event_id * 37 % 1001 AS DOUBLE) / 1000 AS confidence, event_id * 37 % 1001 AS milli, event_type AS condition,
               day(ts) % 2 AS split, event_id % 7 <> 0 AS accepted, CASE WHEN event_type IN ('click', 'view') THEN 'soft' ELSE 'hard' END AS grp,
               CASE WHEN event_id % 29 = 0 THEN 'failed' WHEN event_id % 7 > 0 THEN 'detected' WHEN event_id % 2 = 0 THEN 'unknown' ELSE 'confirm' END AS status,
               event_id % 4 < 2 OR event_id % 9 = 0 AS best_guess_correct, event_id % 31 = 0 AS memory_adjusted, concat('s', CAST(event_id % 3 AS VARCHAR(20))) AS pred_sub,
               CASE WHEN event_id % 4 < 2 AND event_id % 6 <> 5 THEN event_id % 3 > 0 END AS subtype_correct
        FROM events""",
    "boxes": """
        SELECT l_orderkey AS scene, concat(l_returnflag, l_linestatus) AS label, l_quantity AS w, l_discount * 1000 AS h,
               CASE WHEN l_orderkey % 10 < 7 THEN 'train' WHEN l_orderkey % 10 < 9 THEN 'val' ELSE 'test' END AS split
        FROM lineitem""",
    "items": """
        SELECT doc_id AS id, lang AS leaf, md5(text) AS digest, concat(source, '/', CAST(doc_id AS VARCHAR(20))) AS path, source AS dataset, n_chars,
               CASE WHEN source IN ('src1', 'src2') THEN 'test' WHEN source IN ('src3', 'src4', 'src5') THEN 'train' ELSE NULL END AS split
        FROM documents""",
}
_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The operator input ``name``, lazily, on the tables of ``sf_dir``."""
    text = SQL[name].replace("{", "{{").replace("}", "}}")
    used = [t for t in _TABLES if re.search(rf"\b{t}\b", text)]
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 {{{t}}} AS {t}", text)
    return spark.sql(text, **{t: read(spark, sf_dir, t) for t in used})


def sql(query: str, *names: str) -> str:
    """The DuckDB twin: ``query`` with the named bindings as common table expressions."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names) + "\n" + (("," + query.lstrip()[4:]) if query.lstrip().upper().startswith("WITH") else query)
