"""Text search by TF-IDF over words and word pairs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loopgrade.functions.geo import DECAY_KM, EARTH_KM
from loopgrade.functions.labels import quality_weight
from loopgrade.functions.session import spread, written
from loopgrade.operators import inverted, vectors
from loopgrade.operators.ranking import browse_weights

#: Abbreviations and what a listing's text says for them; whole, case-sensitive words.
ABBREVIATIONS = {
    "PP": "PP polypropylene",
    "PET": "PET polyethylene terephthalate",
    "HDPE": "HDPE high-density polyethylene",
    "LDPE": "LDPE low-density polyethylene",
    "PCB": "PCB printed circuit board",
}


def expand(text: Column) -> Column:
    """Abbreviations with their long form behind them; white space is collapsed."""
    names = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    return F.array_join(F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.coalesce(F.try_element_at(names, w), w)), " ")


def listing_text(waste_type: Column, sub_type: Column, quality: Column, location: Column, description: Column) -> Column:
    """One text per listing, "sub type waste type waste, good quality, place. description"; underscores read as spaces."""
    text = lambda c: F.coalesce(c, F.lit(""))
    plain = lambda c: F.replace(text(c), F.lit("_"), F.lit(" "))
    return expand(F.concat(plain(sub_type), F.lit(" "), plain(waste_type), F.lit(" waste, "), text(quality), F.lit(" quality, "), text(location), F.lit(". "), text(description)))


def term_counts(docs: DataFrame) -> DataFrame:
    """``id, term, n`` of the lower-cased words and word pairs; counted where the text stands, so no shuffle."""
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import regex

        token = regex.compile(inverted.TOKEN)
        for batch in batches:
            for k in range(0, len(batch), 256):
                ids, terms, times = [], [], []
                for i, text in zip(batch["id"][k : k + 256], batch["text"][k : k + 256], strict=True):
                    w = token.findall(text or "")
                    n = Counter(w)
                    n.update(map(" ".join, zip(w, w[1:], strict=False)))
                    ids += [i] * len(n)
                    terms += n.keys()
                    times += n.values()
                yield pd.DataFrame({"id": ids, "term": terms, "n": times})

    return spread(docs.select("id", F.lower("text").alias("text"))).mapInPandas(run, f"id {kinds['id']}, term string, n long")


def idf_table(counts: DataFrame, n_docs: int) -> DataFrame:
    """``term, df, idf`` with smoothed idf."""
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    return df.withColumn("idf", F.ln(F.lit(1.0 + n_docs) / (1 + F.col("df"))) + 1)


def weigh(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """``id, term, weight``: (1 + ln tf) idf, each id to unit length; terms outside ``idf`` are ignored."""
    raw = counts.join(idf.select("term", "idf"), "term").withColumn("w", (1 + F.ln(F.col("n").cast("double"))) * F.col("idf"))
    norm = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "id").select("id", "term", (F.col("w") / F.col("norm")).alias("weight"))


def top(scores: DataFrame, k: int) -> DataFrame:
    """The k best ids per query, by similarity rounded to 9 digits, then id, with their rank."""
    return inverted.top(scores, k)


def scores(queries: DataFrame, catalogue: DataFrame, backend: str) -> DataFrame:
    """``query_id, id, similarity`` by the named backend; there is no silent fallback.

    ``tfidf`` reads (id, text) on both sides; ``dense`` reads (id, embedding). Both take any number of queries.
    """
    if backend == "tfidf":
        index = inverted.build(catalogue)
        return inverted.search(index, inverted.vectors(index, queries), None)
    if backend == "dense":
        return vectors.similarities(queries, catalogue)
    raise ValueError(f"unknown backend {backend!r}")


def search(queries: DataFrame, catalogue: DataFrame, backend: str, k: int) -> DataFrame:
    """The ``k`` best catalogue rows of every query by the named backend, with their rank."""
    if backend == "tfidf":
        index = inverted.build(catalogue)
        return inverted.search(index, inverted.vectors(index, queries), k)
    return top(scores(queries, catalogue, backend), k)


#: Needs that are ranked at a time: they are broadcast.
NEEDS = 5_000


def find_listings(index: inverted.Index, listings: DataFrame, needs: DataFrame, k: int = 10, session: DataFrame | None = None) -> DataFrame:
    """The ``k`` best listings for every need: ``need_id, rank, waste_id, similarity, distance_km, score, is_session``.

    ``index`` is that of the catalogue's texts by waste_id. ``listings``: waste_id, waste_type, sub_type, quantity_kg, quality, lat,
    lon. ``session``, with a ``text`` besides, has listings that aren't in the index: they are weighed by the catalogue's frequencies
    and ranked together with it. ``needs``: need_id, text, lat and lon (null: no place), and filters that are null where there are
    none: waste_type, sub_type, min_quantity, qualities (array).

    A need without text is ranked by distance and quality alone. Similarities are scaled to [0, 1] over all listings before any
    filter, 1 where all are equal. Order: score at 9 digits, larger quantity, waste_id. Needs come in chunks of ``NEEDS``, which are
    broadcast. A listing lies beside the segment of the index that holds its postings, and is scored there twice: for the extremes of every need's
    similarity, then for its score. So no pair of a need and a listing leaves a task but what can be among the k best.
    """
    spark = listings.sparkSession
    columns = ["waste_id", "waste_type", "sub_type", "quantity_kg", "quality", "lat", "lon"]
    table = lambda df, session: df.select(*[F.col(c).cast("double").alias(c) if c in ("quantity_kg", "lat", "lon") else F.col(c) for c in columns], F.lit(session).alias("is_session"), quality_weight(F.col("quality")).alias("grade"))
    old = table(listings, False).withColumn("id", F.col("waste_id"))
    query = F.trim(F.coalesce("text", F.lit(""))) != ""
    vectors_ = inverted.vectors(index, needs.where(query).select(F.col("need_id").alias("id"), "text"))
    asked = written(needs.select(F.col("need_id").alias("query_id"), "lat", "lon", "waste_type", "sub_type", "min_quantity", "qualities", query.alias("has_query")).join(vectors_, "query_id", "left"))
    if session is not None:
        weighed = inverted.weigh(index, session.select(F.col("waste_id").alias("id"), "text"))
        new = written(table(session, True).join(weighed, F.col("waste_id").eqNullSafe(F.col("id")), "left"))
    kinds = dict(needs.dtypes)["need_id"], dict(listings.dtypes)["waste_id"]
    ends_schema = f"query_id {kinds[0]}, lo double, hi double"
    schema = f"need_id {kinds[0]}, waste_id {kinds[1]}, quantity_kg double, similarity double, km double, total double, is_session boolean"
    n, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    chunks, out = max(1, -(-n // NEEDS), -(-size // inverted.ASKED)), None
    for chunk in range(chunks):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(chunks)) == chunk).toPandas()
        rows["terms"], rows["weights"] = ([np.array([] if x is None else x, kind) for x in rows[c]] for c, kind in (("terms", np.int64), ("weights", float)))
        idf, sent = inverted.asked_terms(index, list(rows["terms"])), spark.sparkContext.broadcast(rows)
        beside = written(inverted.beside(index, idf, old, _packed(sent, idf), f"{ends_schema}, own binary, of binary"), inverted.BLOCK_BYTES)
        ends = beside.where("own is null").select("query_id", "lo", "hi")
        if session is not None:
            ends = ends.unionByName(new.mapInArrow(_new_ends(sent), ends_schema))
        ends = ends.groupBy("query_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        known = rows.merge(ends.toPandas(), on="query_id", how="left").fillna({"lo": 0.0, "hi": 0.0})
        scaled = spark.sparkContext.broadcast(known)
        part = beside.where("own is not null").select("own", "of").mapInArrow(_ranker(scaled, idf, k), schema)
        if session is not None:
            part = part.unionByName(new.mapInArrow(_new_ranker(scaled, k), schema))
        out = part if out is None else out.unionByName(part)
    place = F.row_number().over(Window.partitionBy("need_id").orderBy(F.desc(F.round("total", inverted.DIGITS)), F.desc("quantity_kg"), "waste_id"))
    best = out.withColumn("rank", place).where(F.col("rank") <= k)
    return best.select("need_id", "rank", "waste_id", F.round("similarity", 3).alias("similarity"), F.round("km", 1).alias("distance_km"), F.round("total", 3).alias("score"), "is_session")


def _bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def _similar(s: inverted.Segment | None, at: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Similarities of the listings at the numbers ``at`` of a segment; -1: it isn't there."""
    if s is None or not len(terms):
        return np.zeros(len(at))
    return np.where(at < 0, 0.0, s.score(*s.rows(terms, weights))[at])


def _at(s: inverted.Segment | None, of: pa.Table) -> np.ndarray:
    if s is None:
        return np.full(of.num_rows, -1)
    ids = of.column("waste_id").combine_chunks()
    return pa.compute.fill_null(pa.compute.index_in(ids, pa.array(s.ids, ids.type)), -1).to_numpy(zero_copy_only=False)


def _ends(needs: pd.DataFrame, s: inverted.Segment | None, at: np.ndarray, kind: pa.DataType) -> pa.Table:
    every = [_similar(s, at, *x) for x in zip(needs["terms"], needs["weights"], strict=True)]
    return pa.table({"query_id": pa.array(needs["query_id"].tolist(), kind), "lo": pa.array([x.min() for x in every], pa.float64()), "hi": pa.array([x.max() for x in every], pa.float64())})


def _packed(sent: Broadcast, idf: Broadcast) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A segment and its listings as a row, and the least and largest similarity of every need as rows."""

    def run(own: pa.Table, of: pa.Table) -> pa.Table:
        needs = sent.value
        kind = _kind(needs)
        none = pa.table({"query_id": pa.nulls(0, kind), "lo": pa.nulls(0, pa.float64()), "hi": pa.nulls(0, pa.float64())})
        of = of.drop_columns(["segment", "id"])
        some = of.num_rows > 0
        s = inverted.opened(own, idf.value) if some else None
        ends = _ends(needs, s, _at(s, of), kind) if some and len(needs) else none
        n = ends.num_rows
        row = pa.table({"query_id": pa.nulls(1, kind), "lo": pa.nulls(1, pa.float64()), "hi": pa.nulls(1, pa.float64()), "own": pa.array([_bytes(own)], pa.binary()), "of": pa.array([_bytes(of)], pa.binary())})
        return pa.concat_tables([ends.append_column("own", pa.nulls(n, pa.binary())).append_column("of", pa.nulls(n, pa.binary())), row.slice(0, int(some))])

    return run


def _kind(needs: pd.DataFrame) -> pa.DataType:
    return pa.string() if needs["query_id"].dtype == object else pa.from_numpy_dtype(needs["query_id"].dtype)


def _new_ends(sent: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and len(sent.value):
                s = inverted.weighed_segment(batch.column("terms"), batch.column("weights"))
                yield from _ends(sent.value, s, np.arange(batch.num_rows), _kind(sent.value)).to_batches()

    return run


def _ranker(sent: Broadcast, idf: Broadcast, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bars: dict = {}
        for batch in batches:
            for own, of in zip(batch.column("own"), batch.column("of"), strict=True):
                own, of = (pa.ipc.open_stream(x.as_buffer()).read_all() for x in (own, of))
                s = inverted.opened(own, idf.value)
                yield from _rank(of, sent.value, s, _at(s, of), k, bars).to_batches()

    return run


def _new_ranker(sent: Broadcast, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bars: dict = {}
        for batch in batches:
            if batch.num_rows:
                s = inverted.weighed_segment(batch.column("terms"), batch.column("weights"))
                yield from _rank(pa.table(batch).drop_columns(["id", "terms", "weights"]), sent.value, s, np.arange(batch.num_rows), k, bars).to_batches()

    return run


def _rank(of: pa.Table, needs: pd.DataFrame, s: inverted.Segment | None, places: np.ndarray, k: int, bars: dict) -> pa.Table:
    """Of some listings those that can be among the ``k`` best of a need; ``bars``: the k-th best of what the task has seen."""
    rows, found = of.to_pandas(), []
    lat, lon = np.radians(rows["lat"].to_numpy(float)), np.radians(rows["lon"].to_numpy(float))
    quantity, grade, ids, new = rows["quantity_kg"].to_numpy(float), rows["grade"].to_numpy(float), rows["waste_id"].to_numpy(), rows["is_session"].to_numpy()
    masks: dict = {}

    def only(column: str, wanted: tuple) -> np.ndarray:
        if (column, wanted) not in masks:
            masks[column, wanted] = rows[column].isin(list(wanted)).to_numpy()
        return masks[column, wanted]

    for i, need in enumerate(needs.itertuples()):
        ok = np.ones(len(rows), bool)
        for column, want in (("waste_type", need.waste_type), ("sub_type", need.sub_type)):
            if want is not None:
                ok &= only(column, (want,))
        if need.min_quantity is not None and not np.isnan(need.min_quantity):
            ok &= quantity >= need.min_quantity
        if need.qualities is not None:
            ok &= only("quality", tuple(need.qualities))
        if not ok.any():
            continue
        at = np.flatnonzero(ok)
        km = np.full(len(at), np.nan)
        if need.lat is not None and not np.isnan(need.lat):
            a, b = np.radians(need.lat), np.radians(need.lon)
            half = np.sin((lat[at] - a) / 2) ** 2 + np.cos(a) * np.cos(lat[at]) * np.sin((lon[at] - b) / 2) ** 2
            km = EARTH_KM * 2 * np.arcsin(np.minimum(1.0, np.sqrt(half)))
        near = np.where(np.isnan(km), 1.0, np.exp(-km / DECAY_KM))
        sim = _similar(s, places, need.terms, need.weights)[at]
        scaled = (sim - need.lo) / (need.hi - need.lo) if need.hi > need.lo else np.ones(len(at))
        w = browse_weights(bool(need.has_query))
        total = w["distance"] * near + w["quality"] * grade[at] + w.get("similarity", 0.0) * scaled
        some = np.flatnonzero(~(total < bars.get(i, -np.inf) - inverted.SLACK))
        rounded = np.round(total[some], inverted.DIGITS)
        first = np.lexsort((ids[at[some]], -quantity[at[some]], -rounded))[:k]
        best = some[first]
        if len(best) == k:
            bars[i] = max(bars.get(i, -np.inf), rounded[first[-1]])
        found.append((np.full(len(best), i), at[best], sim[best], km[best], total[best]))
    who, at, *rest = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, t) for t in (int, int, float, float, float))
    named = [pa.array(needs["query_id"].tolist(), _kind(needs)).take(pa.array(who)), of.column("waste_id").take(pa.array(at)), of.column("quantity_kg").take(pa.array(at)), *[pa.array(x, from_pandas=True) for x in rest], of.column("is_session").take(pa.array(at))]
    return pa.table(named, names=["need_id", "waste_id", "quantity_kg", "similarity", "km", "total", "is_session"])
