"""Text parsing as columns. Patterns are ASCII unless said otherwise; unknown input gives null, never an error."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meridia.functions import stats
from meridia.functions.workers import ship

# Tokens that mean "nothing said", and phrases that say there is no evidence.
NULLISH = ["", "na", "n/a", "nan", "none", "null", "nil", "-", "--", "unknown", "not available", "[]", "{}"]
NO_EVIDENCE = [r"^no .*(details|information|data).*(provided|available|found)", r"^not (mentioned|specified|provided|available)", r"^information not"]
TRUE_WORDS = ["true", "1", "yes", "y"]
FALSE_WORDS = ["false", "0", "no", "n"]


# What in a claim text (in lower case) speaks for a service.
SERVICE_SIGNALS = {
    "maternity": "maternity|maternal|obstetric|gynae|gynec|delivery|labou?r|nicu|neonat|paediatric|pediatric",
    "emergency": "emergency|trauma|icu|critical care|casualty|ambulance|urgent",
    "diagnostic": "diagnostic|pathology|radiology|imaging|laborator|lab test|scan|x-?ray|mri|ct scan|ultrasound",
    "chronic": "cardiac|cardiology|diabetes|hypertension|oncology|cancer|dialysis|nephrology|stroke",
}


def service_signals(c: Column) -> dict[str, Column]:
    """For each service: does a claim text speak for it?"""
    low = F.lower(_or_empty(c))
    return {k: low.rlike(p) for k, p in SERVICE_SIGNALS.items()}


def _or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(_or_empty(c), r"[ \t\r\n]+", " "))


def key_compact(c: Column) -> Column:
    """Trimmed, lower case, & as "and", letters and digits only; null as empty."""
    return F.regexp_replace(F.lower(F.replace(F.trim(_or_empty(c)), F.lit("&"), F.lit("and"))), "[^a-z0-9]+", "")


def key_spaced(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.replace(F.trim(_or_empty(c)), F.lit("&"), F.lit(" and "))), "[^a-z0-9]+", " "))


def key_unicode(c: Column) -> Column:
    return F.regexp_replace(F.lower(_or_empty(c)), r"[^\p{L}\p{N}]", "")


def match_text(c: Column) -> Column:
    """camelCase split, lower case, letters, digits, / and + kept."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(_or_empty(c), "([a-z])([A-Z])", "$1 $2")), "[^a-z0-9/+]+", " "))


# Accented Latin letters and what they fold to.
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def fold_accents(c: Column) -> Column:
    return F.translate(F.lower(_or_empty(c)), _ACCENTED, _PLAIN)


@cache
def _ascii_of() -> tuple[str, str, str]:
    """(characters that NFKD turns into one ASCII character, those characters, characters that it turns into several)."""
    one, become, several = [], [], []
    for code in range(128, sys.maxunicode + 1):
        if not 0xD800 <= code < 0xE000:
            left = "".join(x for x in unicodedata.normalize("NFKD", chr(code)) if x < "\x80")
            if len(left) == 1:
                one.append(chr(code))
                become.append(left)
            elif left:
                several.append(chr(code))
    return "".join(one), "".join(become), "".join(several)


@F.pandas_udf(T.StringType())
def _decomposed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


def ascii_fold(c: Column) -> Column:
    """Compatibility decomposition, then ASCII only: accents, ligatures, widths, styled letters and circled numbers fold.

    The tables come from the Unicode data of the Python that plans the query. Characters that become one letter are
    translated in generated code; only texts with one of the few that become several pass to Python, in Arrow batches.
    """
    ship()
    one, become, several = _ascii_of()
    text = _or_empty(c)
    plain = F.translate(text, one, become)
    rare = F.length(F.translate(plain, several, "")) < F.length(plain)
    return F.coalesce(_decomposed(F.when(rare, text)), F.regexp_replace(plain, r"[^\x00-\x7F]+", ""))


def key_words(c: Column) -> Column:
    """Folded to ASCII, lower case, & as "and", runs of letters and digits between single spaces; null as empty."""
    return F.trim(F.regexp_replace(F.replace(F.lower(ascii_fold(c)), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))


def first_pin(c: Column) -> Column:
    """The first run of six digits that does not begin with 0 and is no part of a longer number."""
    return _found(_or_empty(c), r"(?<![0-9])([1-9][0-9]{5})(?![0-9])")


def first_int(c: Column, most: int | None = None) -> Column:
    """The first run of at most seven digits, thousands commas dropped; null beyond ``most``."""
    n = F.try_to_number(_found(F.replace(_or_empty(c), F.lit(","), F.lit("")), r"(?<![0-9])([0-9]{1,7})(?![0-9])"), F.lit("9999999")).cast("long")
    return n if most is None else F.when(n <= most, n)


def year(c: Column, last: int = 2026) -> Column:
    y = _found(_or_empty(c), r"\b(18[0-9]{2}|19[0-9]{2}|20[0-2][0-9])\b").cast("long")
    return F.when(y.between(1800, last), y)


def number(c: Column, most: float | None = None) -> Column:
    """Digits and dots only, as a double; null where that is none."""
    x = F.regexp_replace(_or_empty(c), "[^0-9.]+", "").try_cast("double")
    return x if most is None else F.when(x <= most, x)


def nullish(c: Column) -> Column:
    return F.lower(F.trim(_or_empty(c))).isin(NULLISH)


def no_evidence(c: Column) -> Column:
    low = F.lower(F.trim(_or_empty(c)))
    out = F.lit(False)
    for pattern in NO_EVIDENCE:
        out = out | low.rlike(pattern)
    return out


def semantic_items(c: Column) -> Column:
    """Meaningful strings of a JSON list, a JSON object's values, or a plain text."""
    text = F.trim(_or_empty(c))
    items = F.when(text.startswith("["), F.from_json(text, "array<string>")).when(
        text.startswith("{"), F.map_values(F.from_json(text, "map<string,string>"))
    )
    items = F.transform(F.coalesce(items, F.array(text)), lambda x: F.trim(F.coalesce(x, F.lit(""))))
    return F.filter(items, lambda x: ~nullish(x) & ~no_evidence(x))


def parse_list(c: Column) -> Column:
    """A JSON list, or parts between commas and semicolons, quotes and brackets dropped."""
    text = _or_empty(c)
    parts = F.transform(F.split(F.regexp_replace(text, r"^\[|\]$", ""), "[,;]"), lambda x: F.trim(F.regexp_replace(x, "[\"']", "")))
    return F.filter(F.coalesce(F.from_json(text, "array<string>"), parts), lambda x: F.coalesce(x, F.lit("")) != "")


def emails(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(_or_empty(c), F.lit(r"([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"), 1), F.lower)))


def phones(c: Column) -> Column:
    """Digits of phone-like runs: a leading 00 dropped, the last ten, eight at least, three distinct digits at least."""
    raw = F.regexp_extract_all(_or_empty(c), F.lit(r"(\+?[0-9(][0-9 ().-]{6,}[0-9])"), 1)
    digits = F.transform(raw, lambda x: F.regexp_replace(F.regexp_replace(x, "[^0-9]", ""), "^00", ""))
    last = F.transform(digits, lambda x: F.when(F.length(x) > 10, F.substring(x, -10, 10)).otherwise(x))
    return F.array_sort(F.array_distinct(F.filter(last, lambda x: (F.length(x) >= 8) & (F.size(F.array_distinct(F.split(x, ""))) >= 3))))


def urls(c: Column) -> Column:
    return F.regexp_extract_all(_or_empty(c), F.lit(r"(https?://[^ \t\r\n\"'<>\]]+)"), 1)


def domain(url: Column) -> Column:
    return F.regexp_replace(F.lower(_found(url, r"^https?://([^/?#:]+)")), r"^www\.", "")


def tokens(c: Column, noise: list[str] = ()) -> Column:
    return F.filter(F.split(key_spaced(c), " "), lambda x: (x != "") & ~x.isin(list(noise)) if noise else x != "")


def token_similarity(a: Column, b: Column) -> Column:
    """0.65 containment + 0.35 Jaccard of token sets."""
    both = F.size(F.array_intersect(a, b))
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least > 0, 0.65 * both / least + 0.35 * both / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance over the longer length."""
    return stats.round_scaled(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)), 3)


def ellipsis(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.rtrim(F.substring(c, 1, n - 3)), F.lit("..."))).otherwise(c)


def boolish(c: Column) -> Column:
    """Three-valued: true, false, or null for anything unclear."""
    low = F.lower(F.trim(c.cast("string")))
    return F.when(low.isin(TRUE_WORDS), True).when(low.isin(FALSE_WORDS), False)


def codes(flags: dict[str, Column]) -> Column:
    """Names of the flags that are true, in order."""
    return F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in flags.items())), lambda x: x.isNotNull())


def label_of(code: Column, labels: dict[str, str]) -> Column:
    known = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))
    return F.coalesce(F.try_element_at(known, code), F.initcap(F.replace(code, F.lit("_"), F.lit(" "))))


def phrase_in(text: Column, phrase: Column) -> Column:
    return F.instr(F.concat(F.lit(" "), key_spaced(text), F.lit(" ")), F.concat(F.lit(" "), key_spaced(phrase), F.lit(" "))) > 0


def ordered_parts(parts: list[Column], sep: str = ", ") -> Column:
    return F.array_join(F.array_distinct(F.filter(F.array(*parts), lambda x: F.coalesce(x, F.lit("")) != "")), sep)


def percent(c: Column, places: int = 1) -> Column:
    return F.when(c.isNull(), "n/a").otherwise(F.concat(F.format_number(c * 100, places), F.lit("%")))


def embedded_json(c: Column, schema: str) -> Column:
    """The outermost {...} of a text, parsed; nulls where it does not parse."""
    return F.from_json(_found(c, r"(?s)(\{.*\})"), schema)


def recency(c: Column, as_of: str, stale_days: int = 730) -> Column:
    """struct(status, confidence) of a date text against a fixed day."""
    d = F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd")), F.try_to_timestamp(c, F.lit("dd/MM/yyyy"))).cast("date")
    day = F.lit(as_of).cast("date")
    status = (
        F.when(nullish(c), "missing").when(d.isNull(), "invalid").when(d > day, "future").when(d <= F.date_sub(day, stale_days), "stale").otherwise("valid")
    )
    trust = F.when(status == "stale", "medium").when(status == "valid", "high").otherwise("low")
    return F.struct(status.alias("status"), trust.alias("confidence"))
