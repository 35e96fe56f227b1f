"""Display names, verdicts and other small rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the grades, and of any other; display names of waste types and of sub-types whose name isn't their code.
QUALITY = {"good": 1.0, "fair": 0.7, "poor": 0.4}
OTHER_QUALITY = 0.5
TYPE_LABELS = {
    "textile": "Textile", "plastic": "Plastic", "construction": "Construction", "e_waste": "E-waste",
    "paper": "Paper & cardboard", "glass": "Glass", "metal": "Metal", "biological": "Organic / food",
    "trash": "Mixed trash", "unknown": "Other / unknown material",
}
SUB_LABELS = {
    "pcb": "PCB / circuit board", "media_player": "Media player (CD/record/radio)",
    "gypsum_board": "Gypsum board", "washing_machine": "Washing machine",
    "foam": "Foam (EPS)", "biological": "Food / organic", "trash": "Mixed trash",
}


def mapped(key: Column, names: dict[str, object], default: Column) -> Column:
    """``names[key]``, or ``default`` where the key is absent or null."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), default)


def quality_weight(quality: Column) -> Column:
    return mapped(F.coalesce(quality, F.lit("")), QUALITY, F.lit(OTHER_QUALITY))


def known(sub_type: Column) -> Column:
    """False for the three ways of not knowing: null, empty, ``unknown``."""
    return F.coalesce((sub_type != "") & (sub_type != "unknown"), F.lit(False))


def type_label(waste_type: Column) -> Column:
    return mapped(F.coalesce(waste_type, F.lit("")), TYPE_LABELS, F.when(waste_type == "", F.lit(None)).otherwise(waste_type))


def sub_label(sub_type: Column) -> Column:
    spaced = F.replace(sub_type, F.lit("_"), F.lit(" "))
    plain = F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, 2, 1 << 30))
    return F.when(~known(sub_type), F.lit("Not sure")).otherwise(mapped(F.coalesce(sub_type, F.lit("")), SUB_LABELS, plain))


def photo_verdict(short_side: Column, low: int = 160, fair: int = 224) -> Column:
    return F.when(short_side < low, "low").when(short_side < fair, "fair").otherwise("good")


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval of k of n; null where n is 0."""
    n = F.nullif(n, F.lit(0).cast("double"))
    p = k / n
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    return (mid - half) / scale, (mid + half) / scale
