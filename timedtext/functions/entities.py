"""Protecting named spans of a text behind placeholders, restoring them, and checking what became of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from timedtext.functions.folds import fold

# Labels worth protecting, those whose loss is reported, those kept as they are, and the number of placeholders.
TARGET_LABELS = [
    "PERSON", "PER", "ORG", "WORK_OF_ART", "EVENT", "PRODUCT", "LAW", "GPE", "FACILITY", "LANGUAGE", "NORP", "TIME", "DATE", "NUM", "CARDINAL",
]
IMPORTANT_LABELS = ["PERSON", "ORG", "GPE", "PRODUCT"]
UNTRANSLATED_LABELS = ["PERSON", "PER", "ORG", "ORGANIZATION", "GPE", "PRODUCT"]
NAME_LABELS = ["PER", "PERSON"]
LEAST_CONFIDENCE = 0.85
PLACEHOLDERS = 100
# End of fixed values.

ENTITY = "struct<text:string,label:string,start:int,end:int,language:string>"
ENTITY_MAP = f"map<string,{ENTITY}>"
PLACEHOLDER = r"<extra_id_\d+>"

# Handle-like tokens: a name, a K and digits; letters and one to three digits.
HANDLE = r"(?U)\b[A-Za-z0-9_]+K\d+\b"
NAME_WITH_DIGITS = r"(?U)\b[A-Za-z]+\d{1,3}\b"


def _name(style: str, k: Column, label: Column, start: Column, end: Column) -> Column:
    """The placeholder of entity k."""
    if style == "extra_id":
        return F.concat(F.lit("<extra_id_"), k.cast("string"), F.lit(">"))
    if style == "entity":
        return F.concat(F.lit("__ENTITY_"), label, F.lit("_"), k.cast("string"), F.lit("__"))
    if style == "name":
        return F.concat(F.lit("__NAME_"), start.cast("string"), F.lit("_"), end.cast("string"), F.lit("__"))
    if style == "private":
        return F.char(F.lit(0xE000) + k)
    raise ValueError(f"unknown placeholder style {style!r}")


def should_translate(label: Column) -> Column:
    """Whether an entity of that label is to be translated: names of people, places, organisations and products are not."""
    return ~F.coalesce(label, F.lit("")).isin(UNTRANSLATED_LABELS)


def _cut(text: Column, start: Column, end: Column, by: Column) -> Column:
    return F.concat(F.substring(text, F.lit(1), start), by, F.substring(text, end + 1, F.length(text)))


def protect(
    text: Column, words: list[str], spans: Column, language: Column, labels: list[str] | None = None, most: int = PLACEHOLDERS, style: str = "extra_id"
) -> Column:
    """struct(text, entity_map): words (longest first) and then spans, from the last to the first, behind placeholders.

    spans is an array of struct(start, end, label); its offsets refer to the text after word protection. All
    occurrences of a word share one placeholder. At most ``most`` placeholders are given; labels outside the list stay.
    Style name protects every occurrence of each person's name, from the first span to the last.
    """
    given = F.coalesce(text, F.lit(""))
    entities = F.array().cast(f"array<struct<key:string,value:{ENTITY}>>")
    acc = F.struct(given.alias("text"), F.lit(0).alias("k"), entities.alias("found"))
    ordered = sorted(set(words), key=lambda w: (-len(w), w))

    def placed(acc: Column, new_text: Column, key: Column, found: Column, label: Column, start: Column, end: Column) -> Column:
        place = [start.cast("int").alias("start"), end.cast("int").alias("end")]
        value = F.struct(found.alias("text"), label.alias("label"), *place, language.alias("language"))
        row = F.struct(key.alias("key"), value.alias("value"))
        return F.struct(new_text.alias("text"), (acc["k"] + 1).alias("k"), F.concat(acc["found"], F.array(row)).alias("found"))

    def word(acc: Column, w: Column) -> Column:
        at = F.position(w, acc["text"]) - 1
        key = _name(style, acc["k"], F.lit("CUSTOM"), at, at + F.length(w))
        new = placed(acc, F.replace(acc["text"], w, key), key, w, F.lit("CUSTOM"), at, at + F.length(w))
        return F.when((at >= 0) & (acc["k"] < most), new).otherwise(acc)

    def span(acc: Column, s: Column) -> Column:
        key = _name(style, acc["k"], s["label"], s["start"], s["end"])
        found = F.substring(acc["text"], s["start"] + 1, s["end"] - s["start"])
        new = placed(acc, _cut(acc["text"], s["start"], s["end"], key), key, found, s["label"], s["start"], s["end"])
        return F.when(acc["k"] < most, new).otherwise(acc)

    def every_name(acc: Column, s: Column) -> Column:
        key = _name(style, acc["k"], s["label"], s["start"], s["end"])
        new = placed(acc, F.replace(acc["text"], s["name"], key), key, s["name"], s["label"], s["start"], s["end"])
        return F.when((acc["k"] < most) & (F.trim(s["name"]) != ""), new).otherwise(acc)

    acc = F.aggregate(F.array(*map(F.lit, ordered)) if ordered else F.array().cast("array<string>"), acc, word)
    wanted = labels or (NAME_LABELS if style == "name" else TARGET_LABELS)
    spans = F.coalesce(spans, F.array().cast("array<struct<start:int,end:int,label:string>>"))
    spans = F.filter(spans, lambda s: s["label"].isin(wanted) & (s["start"] >= 0) & (s["end"] > s["start"]))
    if style == "name":
        name = lambda s: F.substring(given, s["start"] + 1, s["end"] - s["start"]).alias("name")
        named = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), name(s))
        done = F.aggregate(F.sort_array(F.transform(spans, named)), acc, every_name)
    else:
        plain = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"))
        done = F.aggregate(F.sort_array(F.transform(spans, plain), asc=False), acc, span)
    none = F.struct(given.alias("text"), F.create_map().cast(ENTITY_MAP).alias("entity_map"))
    found = F.struct(done["text"].alias("text"), F.map_from_entries(done["found"]).alias("entity_map"))
    return F.when(F.trim(given) == "", none).otherwise(found)


def restore_entities(text: Column, entity_map: Column) -> Column:
    """Placeholders, also damaged ones (< extra ID 7 > or in HTML escapes), become their entities' texts; blanks are squeezed."""
    entries = F.coalesce(F.map_entries(entity_map), F.array().cast(f"array<struct<key:string,value:{ENTITY}>>"))
    mended = F.regexp_replace(text, r"(?i)(?:&lt;|<)\s*extra[_\s-]*id[_\s-]*(\d+)\s*(?:&gt;|>)", "<extra_id_$1>")
    out = F.aggregate(entries, mended, lambda t, e: F.replace(t, e["key"], e["value"]["text"]))
    return F.when(F.size(entries) > 0, F.trim(F.regexp_replace(out, r"(?U)\s+", " "))).otherwise(text)


def reapply_entities(text: Column, entity_map: Column) -> Column:
    """A known map put on a text again: at its exact offsets, else at the first occurrence; longest entities first."""
    by_length = F.array_sort(F.map_entries(entity_map), lambda a, b: F.when(F.length(a["value"]["text"]) != F.length(b["value"]["text"]), F.length(b["value"]["text"]) - F.length(a["value"]["text"])).when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))

    def step(t: Column, e: Column) -> Column:
        v = e["value"]
        exact = F.substring(t, v["start"] + 1, v["end"] - v["start"]) == v["text"]
        at = F.position(v["text"], t) - 1
        return F.when(exact, _cut(t, v["start"], v["end"], e["key"])).when(at >= 0, _cut(t, at, at + F.length(v["text"]), e["key"])).otherwise(t)

    return F.coalesce(F.aggregate(by_length, text, step), text)


def lost_placeholders(protected: Column, translated: Column) -> Column:
    find = lambda t: F.regexp_extract_all(t, F.lit(PLACEHOLDER), F.lit(0))
    return F.array_sort(F.array_except(find(protected), find(translated)))


def entity_issues(original: Column, protected: Column, translated: Column, restored: Column, entity_map: Column) -> Column:
    """Array of what went wrong: not protected; placeholder lost; placeholder left; important entity missing; entity broken up."""
    entries = F.array_sort(F.map_entries(entity_map), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    has = lambda t, x: F.contains(t, x)
    text_of = lambda kind, xs: F.transform(xs, lambda e: F.concat(F.lit(f"{kind}: "), e["value"]["text"]))
    unprotected = F.filter(entries, lambda e: has(original, e["value"]["text"]) & ~has(protected, e["key"]))
    left = F.array_distinct(F.regexp_extract_all(restored, F.lit(PLACEHOLDER), F.lit(0)))
    missing = F.filter(entries, lambda e: e["value"]["label"].isin(IMPORTANT_LABELS) & ~has(restored, e["value"]["text"]))
    broken = F.filter(missing, lambda e: F.contains(e["value"]["text"], F.lit(" ")) & F.exists(F.split(e["value"]["text"], " "), lambda w: has(restored, w)))
    named = lambda kind, xs: F.transform(xs, lambda x: F.concat(F.lit(f"{kind}: "), x))
    return F.concat(text_of("not protected", unprotected), named("placeholder lost", lost_placeholders(protected, translated)), named("placeholder left", left), text_of("missing", missing), text_of("broken up", broken))


def entity_map_from_json(text: Column) -> Column:
    """Bad JSON gives an empty map."""
    return F.coalesce(F.from_json(text, ENTITY_MAP), F.create_map().cast(ENTITY_MAP))


def entity_map_to_json(entity_map: Column) -> Column:
    return F.coalesce(F.to_json(entity_map), F.lit("{}"))


def rebase_entities(entity_map: Column, before: Column, length: Column) -> Column:
    """The map for a sentence of that length after so many characters: offsets moved, kept if they begin inside."""
    def moved(_: Column, v: Column) -> Column:
        start = F.greatest(v["start"] - before, F.lit(0)).cast("int")
        return F.struct(v["text"].alias("text"), v["label"].alias("label"), start.alias("start"), (start + v["end"] - v["start"]).cast("int").alias("end"), v["language"].alias("language"))

    return F.map_filter(F.transform_values(entity_map, moved), lambda _, v: v["start"] < length)


def merge_maps(maps: Column) -> Column:
    """Maps of an array in order; of equal keys the later counts."""
    empty = F.create_map().cast(ENTITY_MAP)
    return F.aggregate(F.filter(maps, lambda m: m.isNotNull()), empty, lambda a, b: F.map_zip_with(a, b, lambda k, x, y: F.coalesce(y, x)))


def pattern_entities(text: Column) -> Column:
    """Array of struct(start, end, text) of handle-like tokens, in order, without those inside an earlier one."""
    place = "struct<start:int,end:int,text:string>"

    def places(pattern: str) -> Column:
        found, parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

        def step(acc: Column, x: Column) -> tuple[dict[str, Column], Column]:
            start = acc["at"] + F.length(x["before"])
            end = start + F.length(x["text"])
            return {"at": end}, F.struct(start.alias("start"), end.alias("end"), x["text"].alias("text"))

        pairs = F.filter(F.zip_with(found, parts, lambda m, p: F.struct(m.alias("text"), p.alias("before"))), lambda x: x["text"].isNotNull())
        return fold(pairs, {"at": F.lit(0)}, place, step)

    def outside(acc: Column, x: Column) -> tuple[dict[str, Column], Column]:
        # longer ones come first where two begin alike, so one that ends no later than any before it lies inside that one
        return {"reach": F.greatest(acc["reach"], x["x"]["end"])}, F.when(x["x"]["end"] > acc["reach"], x["x"])

    both = F.array_distinct(F.concat(places(HANDLE), places(NAME_WITH_DIGITS)))
    ordered = F.array_sort(F.transform(both, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), x.alias("x"))))
    return F.filter(fold(ordered, {"reach": F.lit(-1)}, place, outside), lambda x: x.isNotNull())
