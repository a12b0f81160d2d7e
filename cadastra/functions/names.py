"""Place-name normalisers, Roman numerals and edit distances as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations in the order in which they are replaced.
ABBREVIATIONS = (
    ("brgy.", "barangay"), ("brgy", "barangay"), ("sto.", "santo"), ("sta.", "santa"), ("sr.", "senior"),
    ("jr.", "junior"), ("pob.", "poblacion"), ("mt.", "mount"), ("st.", "saint"),
)
ADMIN_TERMS = ("barangay", "brgy.", "brgy", "bgy.", "bgy")
LARGEST_NUMERAL = 50


def roman(n: int) -> str:
    """Roman numeral of a number up to a few thousand."""
    out = ""
    for value, sign in ((50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        out += sign * (n // value)
        n %= value
    return out


NUMERALS = {n: roman(n) for n in range(1, LARGEST_NUMERAL + 1)}


def blank_to_empty(c: Column) -> Column:
    """Null, blank and the text 'NULL' are no name."""
    return F.when(c.isNull() | (F.trim(c) == "") | (c == "NULL"), F.lit("")).otherwise(c)


def normalize_name(c: Column) -> Column:
    """Lower case, abbreviations as plain substrings, dashes to spaces, single spaces."""
    out = F.lower(F.trim(blank_to_empty(c)))
    for short, full in ABBREVIATIONS:
        out = F.replace(out, F.lit(short), F.lit(full))
    return F.trim(F.regexp_replace(F.regexp_replace(out, "[-–—]", " "), r"\s+", " "))


def roman_to_arabic(c: Column, fix_v: bool = False) -> Column:
    """Whole-word numerals up to 50 to digits, lower case.  A lone V stays (``fix_v`` changes that)."""
    up = F.upper(F.coalesce(c, F.lit("")))
    out = up
    for n, sign in reversed(NUMERALS.items()):
        if sign != "V" or fix_v:
            out = F.regexp_replace(out, rf"\b{sign}\b", str(n))
    return F.lower(F.when(up.rlike(r"\b[IVXL]+\b"), out).otherwise(up))


def arabic_to_roman(c: Column) -> Column:
    """Whole words of one or two digits up to 50 to numerals, lower case."""
    text = F.coalesce(c, F.lit(""))
    out = text
    for n, sign in reversed(NUMERALS.items()):
        out = F.regexp_replace(out, rf"\b{n}\b" if n > 9 else rf"\b0?{n}\b", sign)
    return F.lower(F.when(text.rlike(r"\b\d{1,2}\b"), out).otherwise(text))


def name_base(c: Column) -> Column:
    """Name without its trailing number."""
    return F.when(c.rlike(r"^.+?\s+\d+$"), F.regexp_extract(c, r"^(.+?)\s+(\d+)$", 1)).otherwise(c)


def name_number(c: Column) -> Column:
    """Trailing number of a name, null if none."""
    return F.nullif(F.regexp_extract(c, r"^(.+?)\s+(\d+)$", 2), F.lit(""))


def levenshtein(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def forms(c: Column) -> Column:
    """What the distances compare: the name, with digits, with numerals, its base and
    number.  Computed once per name, before any pairs are made."""
    ar = roman_to_arabic(c)
    return F.struct(c.alias("plain"), ar.alias("arabic"), arabic_to_roman(c).alias("roman"), name_base(ar).alias("base"), name_number(ar).alias("number"))


def distance_three(a: Column, b: Column, k: int) -> Column:
    """``struct(distance, method)`` of two ``forms``: direct, numerals to digits and
    digits to numerals; a later strategy wins only if strictly nearer."""
    direct = F.levenshtein(a["plain"], b["plain"])
    numbered = a["number"].isNotNull() & b["number"].isNotNull()
    second = F.when(numbered, F.when(a["number"] == b["number"], F.levenshtein(a["base"], b["base"])).otherwise(F.lit(k + 1))).otherwise(F.levenshtein(a["arabic"], b["arabic"]))
    best = F.least(direct, second, F.levenshtein(a["roman"], b["roman"]))
    return F.struct(best.alias("distance"), F.when(best == direct, "DIRECT").otherwise("ROMAN_NUMERAL").alias("method"))


def distance_roman(a: Column, b: Column, k: int) -> Column:
    """Distance of two ``forms`` after numerals to digits; null where the names may not
    match: different numbers, or more than ``min(k, 2)`` edits between names without."""
    whole = F.levenshtein(a["arabic"], b["arabic"])
    found = (
        F.when(a["number"].isNotNull() & b["number"].isNotNull(), F.when(a["number"] == b["number"], F.levenshtein(a["base"], b["base"])))
        .when(a["number"].isNotNull() | b["number"].isNotNull(), whole)
        .when(whole <= min(k, 2), whole)
    )
    return F.when(found <= k, found)


def normalize_barangay(c: Column) -> Column:
    """The second normaliser: saints' abbreviations, administrative terms out, a last
    word i to xv to digits, letters and digits only, plain numbers without zeros."""
    out = F.trim(F.lower(F.coalesce(c, F.lit(""))))
    for short, full in (("sta.", "santa"), ("sta ", "santa "), (" sta", " santa"), ("sto.", "santo"), ("sto ", "santo "), (" sto", " santo")):
        out = F.replace(out, F.lit(short), F.lit(full))
    for term in ADMIN_TERMS:
        out = F.replace(out, F.lit(term), F.lit(""))
    numbers = F.create_map(*[F.lit(x) for n in range(1, 16) for x in (NUMERALS[n].lower(), str(n))])
    words = F.split(F.trim(F.regexp_replace(out, r"\s+", " ")), " ")
    last = F.element_at(words, -1)
    joined = F.when(F.element_at(numbers, last).isNotNull(), F.concat(F.array_join(F.slice(words, 1, F.size(words) - 1), ""), F.element_at(numbers, last))).otherwise(out)
    plain = F.regexp_replace(joined, r"[^\p{L}\p{N}]", "")
    return F.when(plain.rlike(r"^\d+$"), F.regexp_replace(plain, r"^0+(?=\d)", "")).otherwise(plain)


def title_case(c: Column) -> Column:
    """Every run of letters with a capital first, as Python's ``str.title`` has it."""
    marked = F.split(F.lower(c), r"(?<=\P{L})(?=\p{L})")
    return F.array_join(F.transform(marked, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), "")


def title_case_smart(c: Column, strict_capitals: bool = False) -> Column:
    """Title case; with ``strict_capitals`` only names all in capitals change."""
    if not strict_capitals:
        return title_case(c)
    return F.when((F.upper(c) == c) & c.rlike(r"\p{Lu}"), title_case(c)).otherwise(c)


def _cut(length: Column, i: Column, k: int) -> tuple[Column, Column]:
    """Start and end of the i-th of k+1 parts of a text."""
    return F.floor(length * i / (k + 1)).cast("int"), F.floor(length * (i + 1) / (k + 1)).cast("int")


def edit_segments(text: Column, k: int) -> Column:
    """A text's k+1 parts as ``struct(l, i, s)``: of two texts within k edits at least one
    part of either is found in the other, at most k places away."""
    length = F.length(text)

    def part(i: Column) -> Column:
        lo, hi = _cut(length, i, k)
        return F.struct(length.alias("l"), i.alias("i"), F.substring(text, lo + 1, hi - lo).alias("s"))

    return F.transform(F.sequence(F.lit(0), F.lit(k)), part)


def edit_probes(text: Column, k: int) -> Column:
    """Every ``struct(l, i, s)`` under which a text within k edits can be found: for each
    length, part and place that k edits allow."""
    length = F.length(text)

    def place(l: Column, i: Column) -> Column:
        lo, hi = _cut(l, i, k)
        shift = length - l
        first = F.greatest(lo - F.floor((F.lit(k) - shift) / 2).cast("int"), F.lit(0))
        last = F.least(lo + F.floor((F.lit(k) + shift) / 2).cast("int"), length - (hi - lo))
        starts = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda at: F.struct(l.alias("l"), i.alias("i"), F.substring(text, at + 1, hi - lo).alias("s")))

    lengths, parts = F.sequence(F.greatest(length - k, F.lit(0)), length + k), F.sequence(F.lit(0), F.lit(k))
    return F.array_distinct(F.flatten(F.transform(lengths, lambda l: F.flatten(F.transform(parts, lambda i: place(l, i))))))
