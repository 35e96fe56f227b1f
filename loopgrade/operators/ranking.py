"""Ranking joins: recyclers for listings, listings for needs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopgrade.functions.geo import DECAY_KM, EARTH_KM, distance_score, haversine_km
from loopgrade.functions.labels import quality_weight
from loopgrade.functions.session import bounded

#: Weights of the two scores.
RECYCLER_WEIGHTS = {"distance": 0.5, "capacity": 0.3, "specialist": 0.2}
LISTING_WEIGHTS = {"similarity": 0.6, "distance": 0.25, "quality": 0.15}
#: Rows (recycler, accepted type) of one block: its columns, 60 bytes a row, travel with a task.
RECYCLER_ROWS = 1_000_000
#: Listings of a task, those that a task takes at once, and those of a chunk, which look at the same cells: at most, and where it is wide.
TASK_ROWS, GATHERED, CHUNK, LEAST = 200_000, 1 << 16, 128, 4
_BEST = "waste_id long, waste_type string, quantity_kg double, recycler_id long, km double, capacity double, n_types int, total double, rank int"


def split_types(column: Column) -> Column:
    """``"a, b"`` to ``["a", "b"]``."""
    return F.transform(F.split(column, ","), lambda x: F.trim(x))


#: Recyclers of a cell of the grid and of a wide one, at most, degrees of a tile by which listings are dealt, how far apart in their scores
#: listings of a chunk may be by place or quantity, wide cells that are opened first, and cells that a chunk visits at once, first and at most.
CELL, WIDE, TILE, NEAR, OPENED, FIRST, MOST = 8, 512, 0.05, 0.1, 4, 16, 64


@dataclass
class Cells:
    """What the recyclers of cells can score at most."""

    box: np.ndarray  # (cells, 4): lowest and highest latitude and longitude in radians; NaN with a place that is missing
    cos: np.ndarray  # least cosine of a latitude of the cell
    capacity: np.ndarray  # largest of the cell
    special: np.ndarray  # what the cell's recyclers get as specialists

    def bounds(self, box: np.ndarray, quantity: float, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        """No recycler of a cell ``at`` scores more for a listing of the tile ``box`` that holds at least ``quantity``."""
        own = self.box[at]
        gap = lambda lo, hi: np.maximum(np.maximum(own[:, lo] - box[hi], box[lo] - own[:, hi]), 0)
        half = np.sin(np.minimum(gap(0, 1), np.pi) / 2) ** 2 + min(np.cos(box[0]), np.cos(box[1])) * self.cos[at] * np.sin(np.minimum(gap(2, 3), np.pi) / 2) ** 2
        # longitudes that wrap around are nearer than their difference
        wraps = np.maximum(own[:, 3], box[3]) - np.minimum(own[:, 2], box[2]) > np.pi
        km = np.where(wraps | np.isnan(half), 0.0, EARTH_KM * 2 * np.arcsin(np.minimum(1.0, np.sqrt(np.maximum(half, 0)))))
        return RECYCLER_WEIGHTS["distance"] * np.exp(-km / DECAY_KM) + RECYCLER_WEIGHTS["capacity"] * np.fmin(1.0, self.capacity[at] / max(quantity, 1.0)) + self.special[at] + 1e-9


@dataclass
class Grid:
    """The recyclers of one type in cells: equal in the number of types they accept, near one another in place and capacity; wide cells hold whole ones."""

    rows: pd.DataFrame
    values: np.ndarray  # (5, rows): latitude and longitude in radians, the cosine of the first, capacity, what a specialist gets
    ids: np.ndarray  # place of each row in the order of the ids
    start: np.ndarray  # of each cell in ``rows``, and the end
    cells: Cells
    opens: np.ndarray  # of each wide cell in ``cells``, and the end
    wide: Cells
    least: float  # capacity


def _cells(values: np.ndarray, start: np.ndarray) -> Cells:
    low, high = lambda x: np.minimum.reduceat(x, start), lambda x: np.maximum.reduceat(x, start)
    box = np.stack([low(values[0]), high(values[0]), low(values[1]), high(values[1])], 1)
    return Cells(box, np.minimum(np.cos(box[:, 0]), np.cos(box[:, 1])), np.nan_to_num(high(values[3]), nan=np.inf), values[4][start])


def _reach(lat: np.ndarray, lon: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Columns by whose differences scores differ: a kilometre counts as it does nearby."""
    km = EARTH_KM * RECYCLER_WEIGHTS["distance"] / DECAY_KM
    return np.stack([km * lat, km * np.cos(lat) * lon, RECYCLER_WEIGHTS["capacity"] * rest], 1)


def _halved(rows: np.ndarray, place: np.ndarray, most: int, near: float = np.inf, least: int = 0) -> Iterator[np.ndarray]:
    """``rows`` in parts, halved across their widest column of ``place`` until at most ``most`` are left that lie within ``near``, or ``least``."""
    held = [rows]
    while held:
        rows = held.pop()
        x = place[rows]
        spans = np.ptp(x, axis=0) if len(rows) > least else np.zeros(1)
        if len(rows) <= least or len(rows) <= most and (near == np.inf or spans.max() <= near):
            yield rows
        else:
            half = len(rows) // 2
            rows = rows[np.argpartition(x[:, int(np.argmax(spans))], half)]
            held += [rows[half:], rows[:half]]


def grid(recyclers: pd.DataFrame) -> Grid:
    r = recyclers.sort_values("recycler_id", ignore_index=True)
    values = _values(r)
    n, capacity = r["n_types"].to_numpy(float), np.nan_to_num(values[3])
    place = _reach(values[0], values[1], capacity / max(1.0, capacity.max()))
    missing = np.isnan(place).any(axis=1)
    parts, opens = [], [0]
    for of in (np.flatnonzero((n == x) & (missing == y)) for x in np.unique(n) for y in (False, True)):
        for wide in _halved(of, place, WIDE) if len(of) else ():
            parts += [np.sort(x) for x in _halved(wide, place, CELL)]
            opens.append(len(parts))
    order, start = np.concatenate(parts), np.append(0, np.cumsum([len(x) for x in parts]))
    values, opens = values[:, order], np.array(opens)
    rows = r[["recycler_id", "capacity", "n_types"]].iloc[order].reset_index(drop=True)
    return Grid(rows, values, order, start, _cells(values, start[:-1]), opens, _cells(values, start[opens[:-1]]), float(np.fmin.reduce(values[3])))


def _values(r: pd.DataFrame) -> np.ndarray:
    lat, lon, capacity = (r[c].to_numpy(float) for c in ("lat", "lon", "capacity"))
    lat, lon = np.radians(lat), np.radians(lon)
    return np.stack([lat, lon, np.cos(lat), capacity, RECYCLER_WEIGHTS["specialist"] / r["n_types"].to_numpy(float)])


def _pairs(own_lat: np.ndarray, own_lon: np.ndarray, quantity: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kilometres and totals of listings (rows) and recyclers (columns of :attr:`Grid.values`); a pair without a place comes last."""
    own_lat, own_lon, quantity = own_lat[:, None], own_lon[:, None], quantity[:, None]
    lat, lon, cos, capacity, special = r
    half = np.sin((lat - own_lat) / 2) ** 2 + np.cos(own_lat) * cos * np.sin((lon - own_lon) / 2) ** 2
    km = EARTH_KM * 2 * np.arcsin(np.minimum(1.0, np.sqrt(half)))
    total = RECYCLER_WEIGHTS["distance"] * np.exp(-km / DECAY_KM) + RECYCLER_WEIGHTS["capacity"] * np.fmin(1.0, capacity / quantity) + special
    return km, np.where(np.isnan(total), -np.inf, total)


def _asked(x: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lat, lon, quantity = (x[c].to_numpy(float) for c in ("lat", "lon", "quantity_kg"))
    return np.radians(lat), np.radians(lon), np.fmax(quantity, 1.0)


def _scores(x: pd.DataFrame, r: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return _pairs(*_asked(x), _values(r))


def _first(ids: np.ndarray, col: np.ndarray, km: np.ndarray, total: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n first columns of each row, by total, then id."""
    if total.shape[1] > 4 * n:
        floor = np.partition(total, total.shape[1] - n, axis=1)[:, total.shape[1] - n]
        wide = int((total >= floor[:, None]).sum(axis=1).max())  # with those that tie with the last
        near = np.argpartition(-total, wide - 1, axis=1)[:, :wide] if wide < total.shape[1] else np.broadcast_to(np.arange(total.shape[1]), total.shape)
        col, km, total = (np.take_along_axis(a, near, 1) for a in (col, km, total))
    first = np.lexsort((ids[col], -total), axis=1)[:, :n]
    return tuple(np.take_along_axis(a, first, 1) for a in (col, km, total))


def _chunks(lat: np.ndarray, lon: np.ndarray, quantity: np.ndarray, least: float) -> Iterator[np.ndarray]:
    """Numbers of the listings in chunks near in place and quantity, which matters above the least capacity. Those without a place aren't there."""
    return _halved(np.flatnonzero(~np.isnan(lat + lon)), _reach(lat, lon, np.log(np.fmax(quantity, least))), CHUNK, NEAR, LEAST)


def _spans(start: np.ndarray, at: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... up to the next start, for every i of ``at``."""
    lo, size = start[at], start[at + 1] - start[at]
    return np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())


def _visit(g: Grid, lat: np.ndarray, lon: np.ndarray, quantity: np.ndarray, n: int, seen: dict | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``n`` best rows of the grid for a chunk of listings: cells by their bounds, best first, until none can reach the n-th total of any of the listings.

    The best wide cells are opened first; of the others only those that can still hold one of the best.
    """
    box, least = np.array([lat.min(), lat.max(), lon.min(), lon.max()]), float(quantity.min())
    wide = g.wide.bounds(box, least)
    nodes = np.argsort(-wide, kind="stable")
    col, km, total = np.zeros((len(lat), 0), np.int64), np.zeros((len(lat), 0)), np.zeros((len(lat), 0))
    for opened in (nodes[:OPENED], nodes[OPENED:]):
        bar = total[:, n - 1].min() if total.shape[1] >= n else -np.inf
        cells = _spans(g.opens, opened[wide[opened] >= bar])
        bound = g.cells.bounds(box, least, cells)
        order, at, step = np.argsort(-bound, kind="stable"), 0, FIRST
        while at < len(order):
            full = total.shape[1] >= n
            some = order[at : at + step]
            if full:
                some = some[bound[some] >= total[:, n - 1].min()]
                if not len(some):
                    break
            at, step = at + len(some), min(2 * step, MOST)
            take = _spans(g.start, cells[some])
            d, t = _pairs(lat, lon, quantity, g.values[:, take])
            if seen is not None:
                seen["pairs"] = seen.get("pairs", 0) + t.size
            if full:  # only those that are among the best of one of the listings
                best = (t >= total[:, n - 1 :]).any(axis=0)
                take, d, t = take[best], d[:, best], t[:, best]
            if len(take):
                col, km, total = np.concatenate([col, np.broadcast_to(take, t.shape)], axis=1), np.concatenate([km, d], axis=1), np.concatenate([total, t], axis=1)
                col, km, total = _first(g.ids, col, km, total, n)
    return col, km, total


def _best(need: pd.DataFrame, grids: dict[str, Grid], k: int, seen: dict | None = None) -> pd.DataFrame:
    """The k best recyclers of every listing, by total, then recycler_id. ``seen`` counts the pairs that are scored."""
    out = []
    for kind, of_kind in need.groupby("waste_type", observed=True):
        g = grids.get(kind)
        if g is None:
            continue
        n = min(k, len(g.rows))
        lat, lon, quantity = _asked(of_kind)
        # without a place all totals are equal, so the first ids are the best
        col = np.tile(np.argsort(g.ids, kind="stable")[:n], (len(of_kind), 1))
        km, total = np.full(col.shape, np.nan), np.full(col.shape, -np.inf)
        for x in _chunks(lat, lon, quantity, g.least):
            col[x], km[x], total[x] = _visit(g, lat[x], lon[x], quantity[x], n, seen)
        row = np.repeat(np.arange(len(of_kind)), n)
        chosen = {c: g.rows[c].to_numpy()[col.reshape(-1)] for c in ("recycler_id", "capacity", "n_types")}
        own = {c: of_kind[c].to_numpy()[row] for c in ("waste_id", "quantity_kg")}
        out.append(pd.DataFrame(own | chosen | {"waste_type": pd.Categorical.from_codes(np.zeros(len(row), np.int8), [kind]), "km": km.reshape(-1), "total": total.reshape(-1), "rank": np.tile(np.arange(1, n + 1), len(of_kind))}))
    names = [c.split()[0] for c in _BEST.split(", ")]
    return pd.concat([x.assign(waste_type=x["waste_type"].astype(object)) for x in out])[names] if out else pd.DataFrame({c: pd.Series(dtype="object" if c == "waste_type" else "float64") for c in names})


def grids(recyclers: pd.DataFrame) -> dict[str, Grid]:
    return {kind: grid(rows) for kind, rows in recyclers.groupby("waste_type")}


def _gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of ``GATHERED`` rows and more."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= GATHERED:
            yield pd.concat(held, ignore_index=True)
            held = []
    if held:
        yield pd.concat(held, ignore_index=True)


def rank_recyclers(listings: DataFrame, recyclers: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` best recyclers that accept each listing's type, by unrounded score, then recycler_id.

    Recyclers are kept in a grid of cells with a bound on what they can score. Listings are dealt in the order of their type, quantity
    and tile of the map, so that those of a task lie near one another: a chunk of them meets in numpy only the cells that can
    hold one of its k best, and only these leave the task. While the recyclers are one block (counted), their grid is broadcast. A
    larger table is dealt into blocks, each block meets the listings in parts, and the k best of every block are merged: no type is
    gathered in one task.
    """
    spark = listings.sparkSession
    need = listings.select("waste_id", "waste_type", F.col("quantity_kg").cast("double").alias("quantity_kg"), "lat", "lon").where("waste_type is not null")
    each = recyclers.select(F.explode("types").alias("waste_type"), "recycler_id", "lat", "lon", "capacity", F.size("types").alias("n_types"))
    n, size = each.count(), max(1, RECYCLER_ROWS)
    parts = max(1, -(-need.count() // TASK_ROWS))
    if n <= RECYCLER_ROWS:
        sent = spark.sparkContext.broadcast(grids(each.toPandas()))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            return (_best(b, sent.value, k) for b in _gathered(batches))

        near = [F.floor(2 * F.log2(F.greatest("quantity_kg", F.lit(1.0)))).alias("_level"), F.floor(F.col("lat") / TILE).alias("_lat"), F.floor(F.col("lon") / TILE).alias("_lon")]
        by = ["waste_type", "_level", "_lat", "_lon", "waste_id"]
        dealt = need.select("*", *near).repartitionByRange(max(spark.sparkContext.defaultParallelism, parts), *by).sortWithinPartitions(*by)
        found = dealt.drop("_level", "_lat", "_lon").mapInPandas(run, _BEST)
    else:
        blocks = -(-n // size)
        deal = lambda key, m: F.pmod(F.xxhash64(key), F.lit(m))
        every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
        left = need.withColumn("part", deal("waste_id", parts)).withColumn("block", every(blocks)).groupBy("part", "block")
        right = each.withColumn("block", deal("recycler_id", blocks)).withColumn("part", every(parts)).groupBy("part", "block")
        found = left.cogroup(right).applyInPandas(lambda x, r: _best(x, grids(r), k), _BEST)
        row = F.struct((-F.col("total")).alias("minus"), "recycler_id", *[c.split()[0] for c in _BEST.split(", ") if c.split()[0] not in ("recycler_id", "rank")])
        merged = found.groupBy(F.col("waste_id").alias("_key")).agg(F.slice(F.array_sort(F.collect_list(row)), 1, k).alias("x"))  # k of each block
        found = merged.select(F.posexplode("x").alias("rank", "x")).select((F.col("rank") + 1).alias("rank"), "x.*")
    kinds = dict(listings.dtypes) | dict(recyclers.dtypes)
    quantity, capacity = F.col("quantity_kg").cast(kinds["quantity_kg"]), F.col("capacity").cast(kinds["capacity"])
    share = F.least(F.lit(1.0), F.col("capacity") / F.greatest(F.col("quantity_kg"), F.lit(1.0)))
    return found.select(
        "waste_id", "waste_type", quantity.alias("quantity_kg"), F.col("rank").cast("int").alias("rank"), "recycler_id", F.round("km", 1).alias("distance_km"),
        capacity.alias("capacity"), (F.col("capacity") >= F.col("quantity_kg")).alias("can_absorb"), F.round("total", 3).alias("score"),
        F.round(distance_score(F.col("km")), 3).alias("distance_score"), F.round(share, 3).alias("capacity_score"), F.round(1 / F.col("n_types"), 3).alias("specialist_score"),
    )


def months_to_absorb(ranked: DataFrame) -> DataFrame:
    """Adds ``months``: ceil(quantity / capacity) where one month isn't enough, else null."""
    return ranked.withColumn("months", F.when(~F.col("can_absorb"), F.ceil(F.col("quantity_kg") / F.col("capacity"))))


def browse_weights(has_query: bool) -> dict[str, float]:
    """Weights of a listing's score; without a query the similarity's share goes to the rest."""
    if has_query:
        return dict(LISTING_WEIGHTS)
    rest = {k: v for k, v in LISTING_WEIGHTS.items() if k != "similarity"}
    return {k: v / sum(rest.values()) for k, v in rest.items()}


def normalised(listings: DataFrame, score: str = "similarity") -> DataFrame:
    """``score`` scaled to [0, 1] over the whole table, before any filter; 1.0 where it is constant. The extremes travel as one broadcast row."""
    ends = listings.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col(score) - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.lit(1.0))
    return listings.crossJoin(F.broadcast(ends)).withColumn(score, scaled).drop("lo", "hi")


def rank_listings(
    listings: DataFrame, k: int = 10, has_query: bool = True, lat: float | None = None, lon: float | None = None,
    waste_type: str | None = None, sub_type: str | None = None, min_quantity: float | None = None, qualities: list[str] | None = None,
) -> DataFrame:
    """The ``k`` best listings: ``similarity`` (if there is a query), distance decay (1.0 without a place) and quality.

    Similarity is normalised over all listings first; filters come after. Order: score, quantity, waste_id.
    """
    df = normalised(listings) if has_query else listings
    for column, value in (("waste_type", waste_type), ("sub_type", sub_type)):
        df = df.where(F.col(column) == value) if value else df
    df = df.where(F.col("quantity_kg") >= min_quantity) if min_quantity is not None else df
    df = df.where(F.col("quality").isin(qualities)) if qualities else df
    placed = lat is not None and lon is not None
    km = haversine_km(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon")) if placed else F.lit(None).cast("double")
    w = browse_weights(has_query)
    parts = {"distance": distance_score(km) if placed else F.lit(1.0), "quality": quality_weight(F.col("quality"))} | ({"similarity": F.col("similarity")} if has_query else {})
    total = sum((w[p] * c for p, c in sorted(parts.items())), F.lit(0.0))
    best = df.withColumn("km", km).withColumn("total", total).orderBy(F.desc("total"), F.desc("quantity_kg"), "waste_id").limit(k)
    return best.withColumn("distance_km", F.round("km", 1)).withColumn("score", F.round("total", 3)).drop("km", "total")


def best_per_group(listings: DataFrame, group: str, *order: Column) -> DataFrame:
    """First row of every group in the stated order."""
    from pyspark.sql import Window

    return listings.withColumn("_place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("_place = 1").drop("_place")


def cost_and_carbon(listings: DataFrame, factors: DataFrame, need_kg: float) -> DataFrame:
    """Cost and CO2e of the needed amount: a price of 0 means it isn't set, a missing factor means there is none."""
    joined = listings.join(bounded(factors.select("waste_id", "factor")), "waste_id", "left")
    return joined.select("waste_id", F.when(F.col("price") > 0, F.lit(need_kg) * F.col("price")).alias("cost"), F.round(F.lit(need_kg) * F.col("factor"), 2).alias("co2e_kg"))
