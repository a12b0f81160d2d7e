"""Hierarchical area codes, identifiers and small text forms as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_code(c: Column) -> Column:
    """Text of a code without the '.0' that spreadsheets add; blank is null."""
    text = F.regexp_replace(F.trim(c.cast("string")), r"\.0$", "")
    return F.when(~F.lower(text).isin("", "null"), text)


def clean_geocode(c: Column, width: int) -> Column:
    """Digits only, filled with zeros to ``width``; longer codes stay whole."""
    digits = F.regexp_replace(F.regexp_replace(F.trim(c.cast("string")), r"\.0$", ""), r"\D", "")
    return F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))


def psgc_to_14(c: Column) -> Column:
    """National code without its region digits, filled to an area's 14 digits."""
    return F.when(F.length(c) > 0, F.concat(F.substring(c, 3, 1 << 20), F.lit("000000"))).otherwise(F.lit(""))


def stable_uuid(*parts: Column) -> Column:
    """UUID-shaped text from a stable key: the same on every evaluation."""
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def next_bsn(uplocation_code: Column, bldg_type: Column, bsn: Column, max_6: Column, max_7: Column) -> Column:
    """Serial number by kind of building: homeless 08 keeps a 6xxxx number or takes the
    next, 09 is 55555, 10 and 11 are 00000, others take the next 7xxxx number."""
    return (
        F.when(bldg_type == "09", "55555")
        .when(bldg_type.isin("10", "11"), "00000")
        .when((bldg_type == "08") & bsn.startswith("6"), bsn)
        .when(bldg_type == "08", F.coalesce(F.lpad((max_6 + 1).cast("string"), 5, "0"), F.lit("60001")))
        .when(uplocation_code.isNotNull(), F.coalesce(F.lpad((max_7 + 1).cast("string"), 5, "0"), F.lit("70001")))
        .otherwise(bsn)
    )


def ean_default(ean: Column, geocode: Column) -> Column:
    return F.coalesce(ean, F.substring(geocode, 9, 6))


def bsn_geoid(geocode: Column, looked_up: Column, bsn: Column) -> Column:
    return F.coalesce(F.concat(geocode, bsn), F.concat(looked_up, bsn))


def correspondence_key(map_uuid: Column, geocode: Column, year: Column) -> Column:
    """``map_uuid:geocode:year``; nulls are empty, '.0' goes."""
    parts = [F.regexp_replace(F.coalesce(F.trim(p.cast("string")), F.lit("")), r"\.0$", "") for p in (map_uuid, geocode, year)]
    return F.concat_ws(":", *parts)


def ea_display_name(name: Column, code: Column) -> Column:
    """``EA`` and the name; without one the code's last six digits, or three, or all of
    it, whichever are digits first; without a code 'EA Unknown'."""
    plain = F.regexp_replace(F.trim(name.cast("string")), r"\.0$", "")
    named = F.when(F.upper(plain).startswith("EA "), plain).otherwise(F.concat(F.lit("EA "), plain))
    tail = F.when(F.substring(code, -6, 6).rlike(r"^\d{6}$"), F.substring(code, -6, 6)).when(F.substring(code, -3, 3).rlike(r"^\d{3}$"), F.substring(code, -3, 3)).otherwise(code)
    return F.when(plain != "", named).when(code != "", F.concat(F.lit("EA "), tail)).otherwise("EA Unknown")


def compose_ea_code(mother: Column, sequence: Column) -> Column:
    """Mother's three digits and the sequence; a mother 000 gives sequence and 000."""
    seq = F.lpad(sequence.cast("string"), 3, "0")
    three = F.substring(F.lpad(mother, 6, "0"), 1, 3)
    return F.when(three == "000", F.concat(seq, F.lit("000"))).otherwise(F.concat(three, seq))


def layer_type_key(c: Column) -> Column:
    """Text inside ``(*_x)``, else after the first underscore."""
    inner = F.regexp_extract(c, r"\(\*_([^)]*)\)", 1)
    return F.when(inner != "", inner).when(c.contains("_"), F.regexp_extract(c, r"^[^_]*_(.*)$", 1)).otherwise(c)


def strip_count_label(c: Column) -> Column:
    return F.regexp_replace(c, r"\s*\[\d+\]\s*$", "")


def export_stem(geocode: Column, province: Column) -> Column:
    return F.concat(F.substring(geocode, 1, 3), F.lit("_"), province)


def slugify(c: Column) -> Column:
    """Lower-case letters and digits (ASCII) joined by single dashes."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, "[^a-zA-Z0-9]+", "-"), "^-+|-+$", ""))


RESERVED = r"(?:COM[0-9]|CON|LPT[0-9]|NUL|PRN|AUX|com[0-9]|con|lpt[0-9]|nul|prn|aux)"


def is_valid_filename(c: Column) -> Column:
    return ~c.rlike(r'[<>:"/\\?*|]') & ~c.rlike(rf"^{RESERVED}$") & (F.length(c) <= 254) & (F.length(c) > 0) & ~c.rlike(r"[\s.]$")


def is_valid_path(c: Column) -> Column:
    return F.forall(F.filter(F.split(c, r"[/\\]"), lambda p: p != ""), is_valid_filename)


def file_parts(c: Column) -> dict[str, Column]:
    return {"dir": F.regexp_extract(c, r"^(.*)/[^/]*$", 1), "stem": F.regexp_extract(c, r"([^/]*?)(\.[^./]*)?$", 1), "ext": F.regexp_extract(c, r"(\.[^./]*)$", 1)}


def semver(c: Column) -> Column:
    at = [F.regexp_extract(c, r"^(\d+)\.(\d+)\.(\d+)(.*)$", i).try_cast("int") for i in (1, 2, 3)]
    return F.struct(at[0].alias("major"), at[1].alias("minor"), at[2].alias("patch"))


def bump(version: Column, part: str) -> Column:
    """Next version; lower parts become zero."""
    a, b, c = version["major"], version["minor"], version["patch"]
    new = {"major": (a + 1, F.lit(0), F.lit(0)), "minor": (a, b + 1, F.lit(0)), "patch": (a, b, c + 1)}[part]
    return F.concat_ws(".", *[x.cast("string") for x in new])


def clean_change_line(c: Column) -> Column:
    """A change note without its bullet, author, link, last ellipsis and commit prefix."""
    out = F.regexp_replace(F.trim(c), r"^\*\s+", "")
    out = F.regexp_replace(out, r"\s+by @[\w-]+ in https?://\S+", "")
    out = F.regexp_replace(F.regexp_replace(out, r"\s+in https?://\S+", ""), "…$", "")
    return F.trim(F.regexp_replace(out, r"(?i)^(?:feat|fix|refactor|perf|docs|style|test|chore|build)(?:\([^)]*\))?[!:]?\s*", ""))


def is_noise_line(c: Column) -> Column:
    """Notes of under five characters, merges, branch names, releases and housekeeping."""
    return c.isNull() | (F.length(c) < 5) | c.rlike(r"(?i)^(?:merge\s|(?:bugfix|feature|hotfix)/|release v\d+|update changelog|(?:chore|ci|bump|wip)\s*[:(])")


def change_category(c: Column) -> Column:
    """By how a note begins."""
    text = F.trim(F.lower(c))
    return F.when(text.rlike("^(?:fixed|resolved|bug)"), "fixes").when(text.rlike("^(?:improved|enhanced|optimized|updated|refactored)"), "improvements").otherwise("features")


def try_number(c: Column, default: float | None = None) -> Column:
    """Finite number or ``default``."""
    n = c.cast("string").try_cast("double")
    return F.when(n.isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf")), n).otherwise(F.lit(default).cast("double"))


def next_free_name(taken: Column, name: Column) -> Column:
    """The name, or it with the least suffix ``_1``, ``_2``... that is not in the array."""
    free = F.filter(F.sequence(F.lit(1), F.size(taken) + 1), lambda i: ~F.array_contains(taken, F.concat(name, F.lit("_"), i.cast("string"))))
    return F.when(F.array_contains(taken, name), F.concat(name, F.lit("_"), F.array_min(free).cast("string"))).otherwise(name)
