"""Cleaning, classifying and splitting of segment texts. Patterns use Unicode classes throughout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What machine translation leaves behind in texts.
PLACEHOLDERS_KEPT_OUT = [r"__ENTITY_[A-Z_]+_\d+__", r"__CUSTOM_PATTERN_\d+__", r"__NAME_\d+_\d+__", r"__ABBR_\d+__", r"__NUM_\d+__", r"\[PLACEHOLDER\]", r"\[MASK\]"]
PLACEHOLDERS_ALL = [*PLACEHOLDERS_KEPT_OUT[:5], r"__[A-Z_]+_\d+__", *PLACEHOLDERS_KEPT_OUT[5:], r"<2[a-z]{2}>", r"<[0-9][a-z]{2}>"]
REFUSALS = [
    "i cannot", "i am unable", "i'm unable", "i am not able", "i'm not able", "as an ai", "as a language model", "my purpose is to",
    "i do not have the ability", "i cannot provide a translation", "refuse to translate",
]
FORBIDDEN_TEXTS = ["de", "en", "fr", "es", "dt>", "de.", "en."]
LANGUAGE_WORDS = ["de", "en", "fr", "es", "it"]
# End of fixed values.

# Letters and their capitals, each of one letter; where the capital would be several (the fi ligature), the letter stays.
_ONE = {c: next((u for u in (c.upper(), c.title()) if len(u) == 1), c) for c in map(chr, range(0x80, 0x1F000)) if not 0xD800 <= ord(c) < 0xE000}
_ONE = {chr(c): chr(c - 32) for c in range(97, 123)} | {c: u for c, u in _ONE.items() if u != c} | {"ß": "ẞ"}
_SMALL, _CAPITAL = "".join(_ONE), "".join(_ONE.values())


def _sub(text: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(text, pattern, by)


def squeeze(text: Column) -> Column:
    return F.trim(_sub(text, r"(?U)\s+", " "))


def _capitalised(text: Column) -> Column:
    """The first letter as a capital; one letter stays one, so that places and lengths stay."""
    return F.concat(F.translate(F.substring(text, 1, 1), _SMALL, _CAPITAL), F.substring(text, 2, 1 << 30))


def upper_first(text: Column) -> Column:
    return F.when(F.substring(text, 1, 1).rlike(r"(?U)^\p{Ll}"), _capitalised(text)).otherwise(text)


def _cleaned(text: Column, patterns: list[str]) -> Column:
    t = reduce(lambda c, p: _sub(c, f"(?i){p}"), patterns, F.coalesce(text, F.lit("")))
    t = _sub(_sub(t, r"(?U)\s+", " "), r"(?U)\s*[,.]\s*[,.]+", ".")
    t = upper_first(squeeze(_sub(t, r"(?U)^[,.\s]+|[,.\s]+$", "")))
    return squeeze(F.translate(t, "|", ","))


def sanitize_text(text: Column) -> Column:
    """Without placeholders and language tags; blanks and punctuation squeezed; first letter upper case; | becomes a comma."""
    return _cleaned(text, PLACEHOLDERS_ALL)


def sanitize_keep_placeholders(text: Column) -> Column:
    """The same but <extra_id_n> placeholders and language tags stay."""
    return _cleaned(text, PLACEHOLDERS_KEPT_OUT)


def escape_fullwidth(text: Column) -> Column:
    return F.translate(text, "|\"'", "︱＂＇")


def clean_translation(text: Column) -> Column:
    """No runs of dots, no dashes between blanks or before words."""
    t = _sub(_sub(text, r"\.{2,}"), r"(?U)\s*-\s*", " ")
    return squeeze(_sub(t, r"(?U)(?<!\w)-(?=\w)"))


def strip_lang_prefix(text: Column, target: str, compat: bool = False) -> Column:
    """Without leading language tags, punctuation and language words; German is capitalised.

    compat: language words go without a word boundary after them, so "Derby" loses "De".
    """
    t = F.trim(_sub(text, rf"^<2{target}>\s*"))
    for pattern in (r"^<2[a-z]{2}>\s*", r"^<[0-9][a-z]{2}>\s*"):
        t = F.trim(_sub(t, pattern))
    t = F.trim(_sub(squeeze(t), r"^[.!?,:;]\s*"))
    edge = "" if compat else r"\b"
    t = F.trim(_sub(t, rf"(?iU)^({'|'.join(LANGUAGE_WORDS)}){edge}\s*[.:]?\s*"))
    return F.when(F.lit(target == "de") & (t != ""), _capitalised(t)).otherwise(t)


def collapse_repeats(text: Column) -> Column:
    """Of more than 4 words, an immediate repetition of 3 and then of 2 words is dropped, as often as it follows."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")

    def drop(ws: Column, n: int) -> Column:
        empty = F.array().cast("array<string>")

        def step(acc: Column, w: Column) -> Column:  # words are given out once they can't belong to a repetition
            out = F.concat(acc, F.array(w))
            tail, before = F.slice(out, -n, n), F.slice(out, -2 * n, n)
            return F.when(F.size(out) >= 2 * n, F.when(tail == before, F.slice(out, 1, F.size(out) - n)).otherwise(out)).otherwise(out)

        return F.aggregate(ws, empty, step)

    return F.when(F.size(words) > 4, F.array_join(drop(drop(words, 3), 2), " ")).otherwise(F.array_join(words, " "))


def strip_trailing_ellipsis(text: Column) -> Column:
    return _sub(text, r"\.\.\.$")


def final_dots_to_ellipsis(text: Column) -> Column:
    return F.trim(_sub(F.trim(text), r"\.+$", "..."))


def strip_html(text: Column) -> Column:
    return _sub(text, r"<.*?>", " ")


def quote_to_apostrophe(text: Column) -> Column:
    return F.translate(text, '"', "'")


def is_refusal(text: Column) -> Column:
    """Empty, a bare placeholder, or a phrase by which a model declines."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return (t == "") | t.startswith("<extra_id_") | t.rlike("|".join(REFUSALS))


def valid_segment(start: Column, end: Column, text: Column) -> Column:
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.coalesce(end > start, F.lit(False)) & (F.length(t) >= 3) & ~F.lower(t).isin(FORBIDDEN_TEXTS)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != ""))


def tts_validity(text: Column, strict: bool = False) -> Column:
    """struct(ok, reason): whether a text can be spoken."""
    t = F.trim(F.coalesce(text, F.lit("")))
    reason = F.when(t == "", "empty").when(~t.rlike(r"[\p{L}\p{N}]"), "no letters or digits")
    if strict:
        reason = reason.when(F.length(t) < 3, "too short").when(word_count(t) < 4, "too few words")
    return F.struct(reason.isNull().alias("ok"), F.coalesce(reason, F.lit("ok")).alias("reason"))


def is_complete_sentence(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike(r"[.!?][\"'”’»]?$"), F.lit(False))


def complete_sentence(text: Column) -> Column:
    t = F.trim(text)
    return F.when((t == "") | is_complete_sentence(t), t).otherwise(F.concat(t, F.lit(".")))


def similarity_status(similarity: Column, threshold: float) -> Column:
    """struct(status, flag) of a quality report."""
    shown = F.format_string("%.3f", similarity)
    low = similarity < threshold
    status = F.when(similarity.isNull() | F.isnan(similarity), "Fehler bei Embedding").when(low, F.concat(F.lit("Niedrig ("), shown, F.lit(")"))).otherwise(F.concat(F.lit("OK ("), shown, F.lit(")")))
    return F.struct(status.alias("status"), F.when(F.coalesce(low, F.lit(True)), "CHECK MANUALLY").otherwise("").alias("flag"))


def token_estimate(text: Column, most: int) -> Column:
    """A token is about four characters."""
    return F.least(F.floor(F.length(text) / 4), F.lit(most)).cast("int")


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)
