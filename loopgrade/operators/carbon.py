"""Carbon-factor resolution and impact rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loopgrade.functions.labels import known
from loopgrade.functions.session import bounded

LOW_FACTOR = 0.05


def to_market(items: DataFrame, codes: DataFrame) -> DataFrame:
    """Adds ``market_sub``: the market code of a photo sub-type, itself where there is none or no type is given."""
    c = codes.select(F.col("waste_type").alias("c_type"), F.col("photo_sub").alias("c_sub"), "market_sub")
    j = items.join(bounded(c), (F.col("waste_type") == F.col("c_type")) & (F.col("sub_type") == F.col("c_sub")), "left")
    return j.withColumn("market_sub", F.coalesce("market_sub", "sub_type")).drop("c_type", "c_sub")


def to_photo(items: DataFrame, codes: DataFrame) -> DataFrame:
    """The reverse translation; of several photo codes the first in order."""
    c = codes.groupBy(F.col("waste_type").alias("c_type"), F.col("market_sub").alias("c_sub")).agg(F.min("photo_sub").alias("photo_sub"))
    j = items.join(bounded(c), (F.col("waste_type") == F.col("c_type")) & (F.col("sub_type") == F.col("c_sub")), "left")
    return j.withColumn("photo_sub", F.coalesce("photo_sub", "sub_type")).drop("c_type", "c_sub")


def type_factors(factors: DataFrame) -> DataFrame:
    """Per waste type: mean factor, number of rows, sorted distinct sources."""
    sources = F.array_join(F.array_sort(F.collect_set("source")), "; ")
    return factors.where("waste_type is not null").groupBy("waste_type").agg(F.avg("factor").alias("mean_factor"), F.count("*").alias("n_factors"), sources.alias("sources"))


def resolve(items: DataFrame, factors: DataFrame, codes: DataFrame) -> DataFrame:
    """Adds ``factor, is_proxy, source, outcome``.

    Outcomes in order: ``exact`` (known sub-type found, whatever its type), ``unavailable`` (known, not found,
    type given), ``error_unknown_sub`` (known, not found, no type), ``type_mean`` (not known, the type has
    factors; always a proxy), ``unavailable`` (not known, type without factors), ``error_no_input``.
    """
    one = factors.select(F.col("sub_type").alias("f_sub"), F.col("factor").alias("f_factor"), F.col("is_proxy").alias("f_proxy"), F.col("source").alias("f_source"))
    mean = type_factors(factors).select(F.col("waste_type").alias("m_type"), "mean_factor", "sources")
    is_known, typed = known(F.col("sub_type")), F.coalesce(F.col("waste_type") != "", F.lit(False))
    j = to_market(items, codes).join(bounded(one), F.col("market_sub") == F.col("f_sub"), "left").join(bounded(mean), F.col("waste_type") == F.col("m_type"), "left")
    exact, averaged = is_known & F.col("f_factor").isNotNull(), ~is_known & typed & F.col("mean_factor").isNotNull()
    outcome = F.when(exact, "exact").when(is_known & typed, "unavailable").when(is_known, "error_unknown_sub").when(averaged, "type_mean").when(typed, "unavailable").otherwise("error_no_input")
    pick = lambda a, b: F.when(exact, a).when(averaged, b)
    return (
        j.withColumn("outcome", outcome)
        .withColumn("factor", pick(F.col("f_factor"), F.col("mean_factor")))
        .withColumn("is_proxy", pick(F.col("f_proxy"), F.lit(True)))
        .withColumn("source", pick(F.col("f_source"), F.col("sources")))
        .drop("f_sub", "f_factor", "f_proxy", "f_source", "m_type", "mean_factor", "sources", "market_sub")
    )


def saved(resolved: DataFrame) -> DataFrame:
    """Adds ``co2e_kg`` (2 decimals), ``co2e_tonnes`` (3, from the unrounded value), ``factor_label, note``; a negative quantity turns the outcome to an error."""
    bad, has = F.col("quantity_kg") < 0, F.col("factor").isNotNull()
    ok = has & ~bad
    raw = F.col("quantity_kg").cast("decimal(18,4)") * F.col("factor").cast("decimal(18,8)")  # exact, so rounding is too
    label = F.when(~has, "not available").when(F.col("is_proxy"), "proxy / conservative estimate").otherwise("sourced factor (still an estimate)")
    return (
        resolved.withColumn("outcome", F.when(bad, "error_negative").otherwise(F.col("outcome")))
        .withColumn("co2e_kg", F.when(ok, F.round(raw, 2).cast("double")))
        .withColumn("co2e_tonnes", F.when(ok, F.round(raw / 1000, 3).cast("double")))
        .withColumn("factor_label", label)
        .withColumn("note", F.when(ok & (F.col("factor") < LOW_FACTOR), "low carbon value: diversion is the main benefit").otherwise(""))
    )


def exact_sum(c: Column) -> Column:
    """Sum of two-decimal doubles that doesn't depend on the order of the rows."""
    return F.sum(c.cast("decimal(28,2)")).cast("double")


def impact_totals(rows: DataFrame) -> DataFrame:
    """One row: kg, CO2e, rows without factor, share of CO2e from proxies (0 without any)."""
    proxy = F.when(F.col("is_proxy"), F.col("co2e_kg"))
    t = rows.agg(F.sum("quantity_kg").alias("kg"), F.coalesce(exact_sum(F.col("co2e_kg")), F.lit(0.0)).alias("co2e_kg"), F.count_if(F.col("co2e_kg").isNull()).alias("without_factor"), F.coalesce(exact_sum(proxy), F.lit(0.0)).alias("p"))
    return t.select("kg", "co2e_kg", "without_factor", F.round(F.coalesce(F.try_divide("p", "co2e_kg"), F.lit(0.0)), 6).alias("proxy_share"))


def levers(rows: DataFrame, by: str) -> DataFrame:
    """Per ``by``, of rows with a value: co2, kg, n, proxy_co2; order co2 desc, key."""
    r = rows.na.drop(subset=["co2e_kg", by])
    proxy = F.when(F.col("is_proxy"), F.col("co2e_kg")).otherwise(F.lit(0.0))
    return r.groupBy(by).agg(exact_sum(F.col("co2e_kg")).alias("co2"), F.sum("quantity_kg").alias("kg"), F.count("*").alias("n"), exact_sum(proxy).alias("proxy_co2")).orderBy(F.desc("co2"), by)


def zone_board(rows: DataFrame) -> DataFrame:
    """Per location: listings, kg, CO2e and the mix of kg by type as sorted entries."""
    cell = rows.where("location_name is not null and waste_type is not null").groupBy("location_name", "waste_type").agg(F.count("*").alias("n"), F.sum("quantity_kg").alias("kg"), F.sum(F.coalesce("co2e_kg", F.lit(0.0)).cast("decimal(28,2)")).alias("co2"))
    mix = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("waste_type", "kg"))), lambda x: F.concat_ws("=", x["waste_type"], x["kg"])), ",")
    return cell.groupBy("location_name").agg(F.sum("n").alias("n"), F.sum("kg").alias("kg"), F.sum("co2").cast("double").alias("co2"), mix.alias("mix")).orderBy(F.desc("kg"), "location_name")


def kpis(rows: DataFrame) -> DataFrame:
    """One row over rated rows: total, average per rated kg, proxy share, count."""
    r = rows.na.drop(subset=["co2e_kg"])
    t = r.agg(exact_sum(F.col("co2e_kg")).alias("total"), F.sum("quantity_kg").alias("kg"), exact_sum(F.when(F.col("is_proxy"), F.col("co2e_kg"))).alias("p"), F.count("*").alias("n"))
    return t.select("total", F.round(F.try_divide("total", "kg"), 6).alias("per_kg"), F.round(F.coalesce(F.try_divide("p", "total"), F.lit(0.0)), 6).alias("proxy_share"), "n")


def biggest_lever(rows: DataFrame) -> DataFrame:
    """The type with most CO2e, its top zone, the zone's share and the class of its basis."""
    top = levers(rows, "waste_type").limit(1)
    zones = rows.na.drop(subset=["co2e_kg", "location_name"]).join(F.broadcast(top.select("waste_type", F.col("co2").alias("type_co2"), "proxy_co2")), "waste_type")
    z = zones.groupBy("waste_type", "type_co2", "proxy_co2", "location_name").agg(exact_sum(F.col("co2e_kg")).alias("zone_co2")).orderBy(F.desc("zone_co2"), "location_name").limit(1)
    share = F.try_divide("proxy_co2", "type_co2")
    basis = F.when(share >= 0.999, "proxy").when(share <= 0.001, "sourced").otherwise("mixed")
    return z.select("waste_type", "type_co2", "location_name", "zone_co2", F.round(F.try_divide("zone_co2", "type_co2"), 6).alias("zone_share"), basis.alias("basis"))


def share_of_total(df: DataFrame, value: str) -> DataFrame:
    """Adds ``share`` (of the sum) and ``bar`` (against the largest), from one broadcast row."""
    ends = df.agg(F.sum(value).alias("_sum"), F.max(value).alias("_max"))
    return df.crossJoin(F.broadcast(ends)).withColumn("share", F.round(F.try_divide(value, "_sum"), 6)).withColumn("bar", F.round(F.try_divide(value, "_max"), 6)).drop("_sum", "_max")


def factor_kpis(factors: DataFrame) -> DataFrame:
    return factors.agg(F.count("*").alias("rows"), F.count_if(~F.col("is_proxy")).alias("sourced"), F.count_if("is_proxy").alias("proxy"), F.max_by("sub_type", F.struct("factor", "sub_type")).alias("highest"))


def factor_view(factors: DataFrame) -> DataFrame:
    """Factors for display: first URL, its domain without ``www.``, method and notes in one text."""
    first = F.trim(F.split_part("source_url", F.lit(";"), F.lit(1)))
    domain = F.regexp_replace(F.parse_url(first, F.lit("HOST")), r"^www\.", "")
    text = F.concat_ws(" - ", F.nullif(F.col("basis"), F.lit("")), F.nullif(F.col("notes"), F.lit("")))
    return factors.select("sub_type", "factor", first.alias("url"), domain.alias("domain"), text.alias("method")).orderBy(F.desc("factor"), "sub_type")


def zone_centroids(listings: DataFrame) -> DataFrame:
    g = listings.where("location_name is not null").groupBy("location_name")
    return g.agg(F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon"))


def price_ranges(listings: DataFrame) -> DataFrame:
    return listings.where("sub_type is not null and quality is not null").groupBy("sub_type", "quality").agg(F.min("price").alias("low"), F.max("price").alias("high"))


def first_rows(df: DataFrame, key: str, *order: Column) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
