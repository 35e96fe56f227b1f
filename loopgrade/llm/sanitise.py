"""PII by patterns and by information: native Spark expressions only.

Four kinds of personal data are found by pattern (email, ip, card, phone). Then the corpus says which other
terms give a protected value, or that there is one of its kind, away. Both are estimated over whole documents:
P(value | term) is (documents with both + w P(value)) / (documents with the term + w), where w weighs the
share of the value, or kind, in all documents as a prior. A term discloses where this is at least
``disclosure`` and at least twice the prior (one bit). Kinds cover the values that stand in one document. Such
terms are generalised to ``[TERM]``, or removed from ``removal`` on, wherever they stand.

Documents count by what they testify: equal texts are one document, and so are the texts with findings that are near
copies, by five-word shingles of the whole text and a similarity of 0.8 or more (see :func:`near_copies`), so copies of
one text don't make its words disclose, while unlike texts with one signature or footer count each.

The patterns are written with possessive quantifiers and look-behind so that long runs are scanned once;
they match what the plain forms match. Offsets are code points, by prefix sums over the pieces between
matches, in blocks, so that a text with many matches stays cheap.

Document counts are combined before their shuffle. Candidate terms are broadcast while there are at most
``most_terms`` (checked); beyond that all terms are counted and joined by shuffle. The same holds for rows with findings.

Defined results: a null text is empty and has no spans; repeated rows are handled alike; an empty table
gives an empty result; columns of other names are carried through by :func:`sanitise`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopgrade.functions.session import cut, written
from loopgrade.llm.common import row_keys, spread_join, text_key
from loopgrade.operators.components import connected_components

KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character that every match has: texts without it aren't scanned.
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}
LETTER = r"[\p{L}\p{M}\p{N}]"
#: A noncharacter: no letter, so it stands in no term; a term's neighbours may be neither letters nor it.
MASK = "\uffff"
BESIDE = r"[\p{L}\p{M}\p{N}\x{FFFF}]"
DISCLOSURE, REMOVAL, MOST_TERMS, MOST_ROWS = 0.5, 0.9, 200_000, 200_000
#: Near copies: words of a shingle, least similarity, and bands of so many minima each (a pair at 0.8 meets in one with 0.9998).
SHINGLE, SIMILAR, BANDS, MINIMA = 5, 0.8, 12, 3
#: Documents that the prior counts for: values are rare, so few documents with both can't be chance; kinds aren't.
VALUE_WEIGHT, KIND_WEIGHT = 2.0, 4.0
BLOCK = 256
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` evaluated once however often the body uses it, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda acc, x: acc + x)


def _prefix(a: Column, fold: Callable[[Column], Column], add: Callable[[Column, Column], Column], zero: int) -> Column:
    """Running fold of a non-empty array of ints, in two levels: linear work times the block size."""

    def outer(folds: Column) -> Column:
        return let(F.transform(folds, lambda _, b: F.when(b == 0, F.lit(zero)).otherwise(fold(F.slice(folds, F.lit(1), b)))), inner)

    def inner(before: Column) -> Column:
        at = lambda i: F.floor(i / BLOCK).cast("int")
        return F.transform(a, lambda _, i: add(F.get(before, at(i)), fold(F.slice(a, at(i) * BLOCK + 1, i % BLOCK + 1))))

    blocks = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / BLOCK).cast("int"))
    return let(F.transform(blocks, lambda b: fold(F.slice(a, b * BLOCK + 1, F.lit(BLOCK)))), outer)


def prefix_sums(a: Column) -> Column:
    return _prefix(a, _sum, lambda x, y: x + y, 0)


def furthest(spans: Column) -> Column:
    """Of spans by start: the furthest end up to each."""
    return let(F.transform(spans, lambda s: s["end"]), lambda ends: _prefix(ends, F.array_max, lambda x, y: F.greatest(x, y), 0))


def matches(text: Column, pattern: Column, kind: int, valid: Callable[[Column], Column] | None = None) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` as SPAN; ``valid`` drops matches, without retry."""
    empty = F.from_json(F.lit("[]"), SPAN)

    def placed(found: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), F.char_length)
        ends = let(F.zip_with(gaps, F.transform(found, F.char_length), lambda g, m: g + m), prefix_sums)
        span = lambda m, e: F.struct((e - F.char_length(m)).alias("start"), F.lit(kind).alias("kind"), e.alias("end"), m.alias("value"))
        spans = F.zip_with(found, ends, span)
        kept = F.filter(spans, lambda s: valid(s["value"])) if valid else spans
        return F.when(F.size(found) == 0, empty).otherwise(kept)

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), placed)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    def total(d: Column) -> Column:
        n = F.length(d)
        digit = lambda i: F.substring(d, i, F.lit(1)).cast("int")
        twice = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        terms = F.transform(F.sequence(F.lit(1), n), lambda i: F.when((n - i) % 2 == 1, twice(digit(i))).otherwise(digit(i)))
        return F.when(n.between(12, 19), _sum(terms) % 10 == 0).otherwise(F.lit(False))

    return let(_digits(m), total)


def _octets(m: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.forall(F.transform(F.split(m, r"\."), part), lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(F.lit(False)))


_VALID = {"ip": _octets, "card": _luhn, "phone": lambda m: F.length(_digits(m)).between(9, 15)}


def base_spans(text: Column) -> Column:
    """All four kinds as one SPAN array, by start, then kind."""
    parts = []
    for k, kind in enumerate(KINDS[:4]):
        seen = F.when(F.contains(text, F.lit(_NEEDS[kind])), text).otherwise(F.lit("")) if kind in _NEEDS else text
        parts.append(matches(seen, F.lit(PATTERNS[kind]), k, _VALID.get(kind)))
    return F.array_sort(F.concat(*parts))


def listed(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"], s["end"])), ",")


def terms_of(text: Column) -> Column:
    """Different lower-cased terms (runs of 3 or more letters and digits) of a text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(LETTER + "{3,}"), F.lit(0)))


def near_copies(texts: DataFrame) -> DataFrame:
    """``th, unit``: the texts (th, text; th unique) that are near copies of others, and the smallest th that they hang together with.

    Bands of minima of the shingles' hashes choose candidates; each meets the first text of its bucket, and counts as its copy
    where their shingles are similar enough. A bucket of any size costs a pair a row, also where it holds a third of all texts.
    """
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    starts = lambda w: F.sequence(F.lit(0), F.greatest(F.size(w) - SHINGLE, F.lit(0)))
    shingles = let(words, lambda w: F.array_distinct(F.transform(starts(w), lambda i: F.xxhash64(F.array_join(F.slice(w, i + 1, F.lit(SHINGLE)), " ")))))
    rows = cut(texts.select("th", shingles.alias("sh")))
    least = lambda k: F.array_min(F.transform("sh", lambda x: F.xxhash64(x, F.lit(k))))
    band = lambda b: F.xxhash64(F.lit(b), *[least(b * MINIMA + m) for m in range(MINIMA)])
    buckets = cut(rows.select("th", F.explode(F.array(*[band(b) for b in range(BANDS)])).alias("band")))
    heads = cut(buckets.groupBy("band").agg(F.min("th").alias("head"), F.count("*").alias("n")).where("n > 1").select("band", "head"))
    pairs = cut(spread_join(buckets, heads, ["band"]).where("th <> head").select("th", "head").distinct())
    first = cut(rows.join(pairs.select(F.col("head").alias("th")).distinct(), "th").select(F.col("th").alias("head"), F.col("sh").alias("sh_head")))
    both = spread_join(pairs.join(rows, "th"), first, ["head"], most=10_000)
    common = F.size(F.array_intersect("sh", "sh_head"))
    links = both.where(common >= SIMILAR * (F.size("sh") + F.size("sh_head") - common)).select(F.col("head").alias("src"), F.col("th").alias("dst"))
    return connected_components(links).select(F.col("node").alias("th"), F.col("comp").alias("unit"))


def _replaced(text: Column, spans: Column, tag: Callable[[Column, Column], Column]) -> Column:
    """The text with every span replaced by ``tag(span, characters not covered by spans before)``; one span at least."""

    def pieces(ends: Column) -> Column:
        before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1))
        gap = lambda s, i: F.substring(text, before(i) + 1, F.greatest(s["start"] - before(i), F.lit(0)))
        piece = lambda s, i: F.concat(gap(s, i), tag(s, F.greatest(s["end"] - F.greatest(s["start"], before(i)), F.lit(0))))
        return F.concat(F.array_join(F.transform(spans, piece), ""), F.substring(text, F.get(ends, F.size(ends) - 1) + 1, F.char_length(text)))

    return let(furthest(spans), pieces)


def _outside(text: Column, spans: Column) -> Column:
    """The text without its spans, a space for each."""
    return _replaced(text, spans, lambda s, n: F.lit(" "))


def _masked(text: Column, spans: Column) -> Column:
    """The text with every character of its spans as MASK: offsets stay, and no term begins or ends in or at a span's letters."""
    return F.when(F.size(spans) == 0, text).otherwise(_replaced(text, spans, lambda s, n: F.repeat(F.lit(MASK), n)))


def _bounded(df: DataFrame, most: int, arrays: str | None = None) -> DataFrame:
    """A broadcast where ``df`` has at most so many rows, and elements in the column ``arrays``; otherwise the join shuffles."""
    n = df.agg(F.count("*") + F.coalesce(F.sum(F.size(arrays)), F.lit(0))).first()[0] if arrays else df.limit(most + 1).count()
    return F.broadcast(df) if n <= most else df


def disclosing_terms(
    docs: DataFrame, disclosure: float = DISCLOSURE, removal: float = REMOVAL, most_terms: int = MOST_TERMS, value_weight: float = VALUE_WEIGHT, kind_weight: float = KIND_WEIGHT
) -> DataFrame:
    """``term, p, bits, remove``: terms that give a protected value or kind away, from co-occurrence over all documents."""
    text = F.coalesce("text", F.lit(""))
    found = docs.select(text_key().alias("th"), text.alias("text")).withColumn("spans", base_spans(F.col("text"))).where(F.size("spans") > 0)
    # a kind is an entity beside its values
    entity = lambda s: F.array(F.struct(F.xxhash64(s["kind"], s["value"]).alias("id"), F.lit(False).alias("of_kind")), F.struct(F.xxhash64(s["kind"]).alias("id"), F.lit(True).alias("of_kind")))
    entities = F.array_distinct(F.flatten(F.transform("spans", entity)))
    outside = _outside(F.col("text"), F.col("spans"))
    found = written(found.select("th", entities.alias("entities"), outside.alias("text"), terms_of(F.col("text")).alias("whole")).dropDuplicates(["th"]))
    units = near_copies(found.select("th", "text"))
    held = found.withColumn("terms", terms_of(F.col("text"))).join(units, "th", "left").withColumn("unit", F.coalesce("unit", "th"))
    held = cut(held.select("th", "unit", "entities", "terms", F.array_except("whole", "terms").alias("inner")))  # inner: terms only inside findings
    entity_units = held.select("unit", F.explode("entities").alias("e")).select("unit", "e.id", "e.of_kind").distinct()
    # documents: different texts without findings, and those with them that aren't near copies of another
    copies = docs.groupBy(text_key().alias("th")).agg(F.count("*").alias("n")).where("n > 1")
    texts = docs.count() - (copies.agg(F.sum(F.col("n") - 1)).first()[0] or 0)
    total = max(1, texts - held.count() + held.select("unit").distinct().count())
    weight = F.when(F.col("of_kind"), kind_weight).otherwise(value_weight)
    prior = F.col("n_entity") / F.lit(float(total))
    # what can't reach the threshold even where a term stands in no other document goes before it meets the terms
    n_entity = entity_units.groupBy("id", "of_kind").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") + weight * prior >= disclosure * (F.col("n_entity") + weight))
    n_entity = cut(n_entity)
    highest = n_entity.agg(F.max(prior)).first()[0]
    least = min(value_weight, kind_weight)
    near = held.select("unit", "th", F.explode("terms").alias("term"))
    n_near = near.groupBy("term", "unit").agg(F.count("*").alias("n")).groupBy("term").agg(F.count("*").alias("n_near"), F.sum("n").alias("n_texts"))
    can = lambda n: F.col("n_near") + least * (highest or 0.0) >= disclosure * (n + least)
    n_inner = held.select(F.explode("inner").alias("term")).groupBy("term").agg(F.count("*").alias("n_inner"))
    likely = cut(n_near.where(can(F.col("n_near"))).join(n_inner, "term", "left"))
    words = docs.select(text_key().alias("th"), F.explode(terms_of(text)).alias("term"))
    if likely.limit(most_terms + 1).count() <= most_terms:
        words = words.join(F.broadcast(likely.select("term")), "term")
    words = words.join(_bounded(copies, most_terms), "th", "left")  # a text that stands n times counts a nth each time
    n_all = words.groupBy("term").agg(F.round(F.sum(1 / F.coalesce("n", F.lit(1)))).alias("n_all"))
    n_term = F.col("n_all") - F.col("n_texts") - F.coalesce("n_inner", F.lit(0)) + F.col("n_near")
    likely = cut(likely.join(n_all, "term").withColumn("n_term", n_term).where(can(F.col("n_term"))).select("term", "n_term"))
    term_units = near.join(_bounded(likely.select("term"), most_terms), "term").select("unit", "term").distinct()
    entity_units = entity_units.drop("of_kind").join(_bounded(n_entity, most_terms), "id")
    both = term_units.join(entity_units, "unit").groupBy("term", "id", "of_kind", "n_entity").agg(F.count("*").alias("n_both")).join(likely, "term")
    smooth = (F.col("n_both") + weight * prior) / (F.col("n_term") + weight)
    p = F.col("n_both") / F.col("n_term")
    told = both.select("term", p.alias("p"), F.log2(p / prior).alias("bits"), smooth.alias("smooth"), prior.alias("prior")).where((F.col("smooth") >= disclosure) & (F.col("smooth") >= 2 * F.col("prior")))
    return told.groupBy("term").agg(F.max("p").alias("p"), F.max("bits").alias("bits"), (F.max("smooth") >= removal).alias("remove"))


def find(docs: DataFrame, most_rows: int = MOST_ROWS, **limits: float) -> DataFrame:
    """The rows of ``docs``, as struct ``row``, with ``base`` and ``spans`` (SPAN) and ``remove`` (terms to remove, others are generalised)."""
    told = cut(disclosing_terms(docs, **limits))
    text = F.coalesce("text", F.lit(""))
    key_1, key_2 = row_keys()
    words = docs.select(key_1.alias("key_1"), key_2.alias("key_2"), F.explode(terms_of(text)).alias("term"))
    hits = words.join(_bounded(told, most_rows), "term")
    hits = hits.groupBy("key_1", "key_2").agg(F.array_sort(F.collect_set("term")).alias("terms"), F.collect_set(F.when(F.col("remove"), F.col("term"))).alias("remove"))
    hits = cut(hits)
    keyed = docs.select(F.struct("*").alias("row"), text.alias("t"), key_1.alias("key_1"), key_2.alias("key_2"))
    joined = keyed.join(_bounded(hits, most_rows, "terms"), ["key_1", "key_2"], "left").withColumn("base", base_spans(F.col("t")))
    pattern = F.concat(F.lit(f"(?iu)(?<!{BESIDE})(?:"), F.array_join("terms", "|"), F.lit(f")(?!{BESIDE})"))
    extra = F.when(F.col("terms").isNull(), F.from_json(F.lit("[]"), SPAN)).otherwise(matches(_masked(F.col("t"), F.col("base")), pattern, 4))
    remove = F.coalesce("remove", F.array().cast("array<string>"))
    return joined.select("row", "t", "base", F.array_sort(F.concat("base", extra)).alias("spans"), remove.alias("remove"))


def sanitise(docs: DataFrame, **limits: float) -> DataFrame:
    """All rows and columns of ``docs``; in the text every span is replaced by its kind, ``[EMAIL]`` and so on, or removed.

    Spans that overlap are replaced together, by the kind of the first. A null text stays null; ``n_chars``, where the table has it, follows the text.
    """
    found = find(docs, **limits)
    kind = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    t = F.col("t")

    def tag(s: Column) -> Column:
        gone = (s["kind"] == 4) & F.array_contains("remove", F.lower(s["value"]))
        return F.when(gone, F.lit("")).otherwise(F.element_at(kind, s["kind"] + 1))

    # a span that begins inside another goes with it
    whole = lambda s, n: F.when(n < s["end"] - s["start"], F.lit("")).otherwise(tag(s))
    text = F.when(F.size("spans") == 0, F.col("row.text")).otherwise(_replaced(t, F.col("spans"), whole))
    same = {"text": F.col("clean"), "n_chars": F.length("clean").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return found.select("row", text.alias("clean")).select(*[same[c].alias(c) if c in same else F.col("row")[c].alias(c) for c in docs.columns])
