"""Attribute joins, matchers, roll-ups, sequences and set operations."""

from __future__ import annotations

import difflib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastra.functions import names


def refactor_fields(df: DataFrame, mapping: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Projection by ``(expression, name, type)``; unlisted columns go, an expression
    that is a bare name of a missing column is null."""
    have = {c.lower() for c in df.columns}
    out = []
    for expr, name, kind in mapping:
        missing = expr.isidentifier() and expr.lower() not in have
        out.append((F.lit(None) if missing else F.expr(expr)).cast(kind).alias(name))
    return df.select(*out)


def resolve_first_column(columns: Sequence[str], aliases: Sequence[str]) -> str | None:
    """First column, in table order, that is one of the aliases (case-insensitive)."""
    wanted = {a.lower() for a in aliases}
    return next((c for c in columns if c.lower() in wanted), None)


def resolve_first_alias(columns: Sequence[str], aliases: Sequence[str]) -> str | None:
    """First alias that is a column; ``_``, ``/`` and spaces do not count."""
    def plain(x: str) -> str:
        return x.lower().replace("_", "").replace("/", "").replace(" ", "")

    by = {}
    for c in columns:
        by.setdefault(plain(c), c)
    return next((by[plain(a)] for a in aliases if plain(a) in by), None)


def join_first(left: DataFrame, right: DataFrame, key: str, order: str, prefix: str = "") -> DataFrame:
    """Left join with the first match in ``order`` only."""
    best = right.groupBy(key).agg(F.min(F.struct(order, *[c for c in right.columns if c not in (key, order)])).alias("m"))
    cols = [F.col(f"m.{c}").alias(prefix + c) for c in right.columns if c != key]
    return left.join(best.select(key, *cols), key, "left")


def join_all(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right, key, "left")


def edit_candidates(left: DataFrame, right: DataFrame, k: int, forms: Sequence[str] = ("plain", "arabic", "roman")) -> DataFrame:
    """Pairs ``(_x, _y)`` of different names ``left(_x, _a)`` and ``right(_y, _b)`` that may
    be within ``k`` edits in one of the forms, or in their bases where their numbers are
    equal.  An equi-join on the parts of one name that must occur in the other, for
    each form: no pair within ``k`` edits is missed, whatever numerals do to lengths."""
    out = None
    for form in [*forms, "base"]:
        on = [F.col(f"_n{t}") for t in "ab"] if form == "base" else []
        x = left.select("_x", F.col("_a.number").alias("_na"), F.explode(names.edit_probes(F.col(f"_a.{form}"), k)).alias("p"))
        y = right.select("_y", F.col("_b.number").alias("_nb"), F.explode(names.edit_segments(F.col(f"_b.{form}"), k)).alias("q"))
        same = (F.col("p.l") == F.col("q.l")) & (F.col("p.i") == F.col("q.i")) & (F.col("p.s") == F.col("q.s"))
        met = x.join(y, same & (on[0] == on[1]) if on else same).select("_x", "_y")
        out = met if out is None else out.union(met)
    return out.distinct()


def _with_forms(src: DataFrame, refs: DataFrame, src_name: str, ref_name: str, k: int, forms: Sequence[str]) -> DataFrame:
    """Candidate pairs of rows with their names' forms ``_a, _b``, which are computed once
    per different name."""
    left = src.select(F.col(src_name).alias("_x")).distinct().select("_x", names.forms(F.col("_x")).alias("_a"))
    right = refs.select(F.col(ref_name).alias("_y")).distinct().select("_y", names.forms(F.col("_y")).alias("_b"))
    pairs = edit_candidates(left, right, k, forms).join(left, "_x").join(right, "_y")
    return pairs.join(src, F.col("_x") == F.col(src_name)).join(refs, F.col("_y") == F.col(ref_name))


def fuzzy_all(src: DataFrame, refs: DataFrame, src_name: str, ref_name: str, k: int) -> DataFrame:
    """All references whose best-of-three distance is at most ``k``."""
    scored = _with_forms(src, refs, src_name, ref_name, k, ("plain", "arabic", "roman")).withColumn("_d", names.distance_three(F.col("_a"), F.col("_b"), k))
    return scored.where(F.col("_d.distance") <= k).withColumn("distance", F.col("_d.distance")).withColumn("method", F.col("_d.method")).drop("_d", "_a", "_b", "_x", "_y")


def fuzzy_roman(src: DataFrame, refs: DataFrame, src_key: str, src_name: str, ref_name: str, ref_order: str, k: int) -> DataFrame:
    """The nearest reference by the numeral-aware distance; ties: reference order."""
    pairs = _with_forms(src, refs, src_name, ref_name, k, ("arabic",)).withColumn("distance", names.distance_roman(F.col("_a"), F.col("_b"), k)).where("distance IS NOT NULL")
    best = pairs.groupBy(src_key).agg(F.min(F.struct("distance", ref_order, ref_name)).alias("m"))
    return best.select(src_key, F.col("m.distance").alias("distance"), F.col(f"m.{ref_order}").alias(ref_order), F.col(f"m.{ref_name}").alias(ref_name))


def _letters(texts: DataFrame) -> DataFrame:
    """``(v, t)``: the different texts with their letters, each with its running number
    among equal ones (``a1``, ``n1``, ``a2``), so that two texts' common letters are the
    common members of both lists."""
    chars = F.col("_c")
    numbered = F.transform(chars, lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda o: o == c)).cast("string")))
    return texts.withColumn("_c", F.regexp_extract_all("v", F.lit("(?s)."), F.lit(0))).select("v", numbered.alias("t"))


def _rarest_first(texts: DataFrame, often: DataFrame) -> DataFrame:
    """The lists of ``_letters`` in the order of how many texts hold a letter."""
    each = texts.select("v", F.explode("t").alias("l")).join(often, "l")
    return each.groupBy("v").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "l"))), lambda x: x["l"]).alias("t"))


def alike_candidates(src: DataFrame, keys: DataFrame, cutoff: float) -> DataFrame:
    """``(name, k)`` of all pairs of the texts ``src.v`` and ``keys.v`` whose common
    letters allow a ratio of ``cutoff`` or more: twice their number by both lengths.

    Texts of ``p`` and ``q`` letters need ``need = cutoff * (p + q) / 2`` common ones, so
    among the ``p - need + 1`` rarest of one and the ``q - need + 1`` rarest of the other
    there is a common letter.  Both are put under these letters and the two lengths and
    meet in an equi-join; a pair is kept under the rarest letter that both lists share
    there, so none is seen twice, then all letters are compared."""
    src, keys = (_letters(df.select("v").where("v <> ''").distinct()) for df in (src, keys))
    often = src.unionByName(keys).select(F.explode("t").alias("l")).groupBy("l").agg(F.count("*").alias("n"))

    def listed(df: DataFrame, own: str, other: str, out: str) -> DataFrame:
        mine, theirs = F.col(own), F.col(other)
        need = F.ceil(cutoff * (F.col("p") + F.col("q")) / 2 - 1e-9)
        low, high = F.ceil(mine * cutoff / (2 - cutoff) - 1e-9), F.floor(mine * (2 - cutoff) / cutoff + 1e-9)
        rows = _rarest_first(df, often).withColumn(own, F.size("t")).withColumn(other, F.explode(F.sequence(F.greatest(low, F.lit(1)), high))).withColumn(other, theirs.cast("int"))
        rows = rows.withColumn("head", F.slice("t", F.lit(1), (mine - need + 1).cast("int")))
        return rows.select(F.struct("v", "t", "head").alias(out), "p", "q", F.explode("head").alias("l"))

    met = listed(src, "p", "q", "a").join(listed(keys, "q", "p", "b"), ["l", "p", "q"])
    once = F.get(F.array_intersect("a.head", "b.head"), F.lit(0)) == F.col("l")
    enough = 2 * F.size(F.array_intersect("a.t", "b.t")) >= cutoff * (F.col("p") + F.col("q")) - 1e-9
    return met.where(once & enough).select(F.col("a.v").alias("name"), F.col("b.v").alias("k"))


def close_matches(src: DataFrame, keys: DataFrame, name: str, key: str, cutoff: float = 0.75) -> DataFrame:
    """``(name, match, ratio)``: the key most alike by matching blocks, of a ratio of
    ``cutoff`` (over 0, at most 1) or more; ties: the last in order.

    For the different names that exact lookups leave; null and empty ones match nothing.
    Only the pairs of ``alike_candidates``, which loses none, are compared by blocks."""
    if not 0 < cutoff <= 1:
        raise ValueError(f"cutoff {cutoff} is not over 0 and at most 1")
    pairs = alike_candidates(src.select(F.col(name).alias("v")), keys.select(F.col(key).alias("v")), cutoff)
    found = pairs.mapInPandas(_ratios(cutoff), "name string, match string, ratio double")
    return found.groupBy("name").agg(F.max(F.struct("ratio", "match")).alias("m")).select("name", "m.match", "m.ratio")


def _ratios(cutoff: float):
    def run(batches):
        for pdf in batches:
            ratio = [difflib.SequenceMatcher(None, k, n).ratio() for n, k in zip(pdf["name"], pdf["k"])]
            out = pd.DataFrame({"name": pdf["name"], "match": pdf["k"], "ratio": ratio})
            yield out[out["ratio"] >= cutoff]

    return run


def cascade_lookup(src: DataFrame, refs: DataFrame, name: str, ref_name: str, ref_code: str, ref_order: str, cutoff: float | None = None) -> DataFrame:
    """Exact, then normalised lookup; of references with one key the last wins.  With
    ``cutoff`` what is left takes the normalised reference most alike (``close_matches``)."""
    def table(key: Column, out: str) -> DataFrame:
        return refs.select(key.alias(f"_{out}"), F.col(ref_code), F.col(ref_order)).where(F.col(f"_{out}") != "").groupBy(f"_{out}").agg(F.max_by(ref_code, ref_order).alias(out))

    exact, normal = table(F.lower(F.trim(ref_name)), "c_exact"), table(names.normalize_barangay(F.col(ref_name)), "c_norm")
    keyed = src.withColumn("_c_exact", F.lower(F.trim(name))).withColumn("_c_norm", names.normalize_barangay(F.col(name)))
    out = keyed.join(exact, "_c_exact", "left").join(normal, "_c_norm", "left")
    found = [("EXACT", "c_exact"), ("NORMALIZED", "c_norm")]
    if cutoff is not None:
        left = out.where("c_exact IS NULL AND c_norm IS NULL")
        close = close_matches(left, normal, "_c_norm", "_c_norm", cutoff).join(normal.toDF("match", "c_close"), "match").select(F.col("name").alias("_c_norm"), "c_close")
        out = out.join(close, "_c_norm", "left")
        found.append(("CLOSE", "c_close"))
    status = F.lit("UNMATCHED")
    for said, column in reversed(found):
        status = F.when(F.col(column).isNotNull(), said).otherwise(status)
    columns = [c for _, c in found]
    return out.withColumn("code", F.coalesce(*columns)).withColumn("status", status).drop("_c_exact", "_c_norm", *columns)


def layer_key(c: Column | str) -> Column:
    """A layer's name without its area suffix, letters and digits only."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"(?i)[_\-\s]+(bgy|barangay)$", "")), "[^a-z0-9]", "")


def _substrings(c: Column) -> Column:
    n = F.length(c)
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda m: F.substr(c, i, m)))))


def city_detect(layers: DataFrame, cities: DataFrame, layer: str, city: str, order: str, cutoff: float | None = None) -> DataFrame:
    """``layers`` with the first city (by ``order``) whose key contains the layer's key or
    lies in it, else with ``cutoff`` the one most alike; null if there is none.

    Containment is an equi-join of one side's keys with the other side's substrings, so
    it takes names, not texts."""
    keyed = layers.withColumn("_key", layer_key(layer))
    names_ = keyed.select(F.col("_key").alias("k")).where("k <> ''").distinct()
    refs = cities.select(F.regexp_replace(F.lower(city), "[^a-z0-9]", "").alias("c"), F.col(city).alias("_city"), F.col(order).alias("_order")).where("c <> ''").groupBy("c").agg(F.min(F.struct("_order", "_city")).alias("r"))
    within = names_.select("k", F.explode(_substrings(F.col("k"))).alias("c")).join(refs, "c")
    around = refs.select("c", "r", F.explode(_substrings(F.col("c"))).alias("k")).join(names_, "k")
    found = within.select("k", "r").union(around.select("k", "r")).groupBy("k").agg(F.min("r")["_city"].alias("_found"))
    if cutoff is not None:
        close = close_matches(names_.join(found, "k", "left_anti"), refs, "k", "c", cutoff).join(refs.select(F.col("c").alias("match"), "r"), "match")
        found = found.union(close.select("name", "r._city"))
    return keyed.join(found.withColumnRenamed("k", "_key"), "_key", "left").drop("_key").withColumnRenamed("_found", "city")


def anti_unmatched(src: DataFrame, matched: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Rows without a match, with default columns."""
    return src.join(matched, key, "left_anti").select("*", *[F.lit(v).alias(c) for c, v in defaults.items()])


def union_layers(layers: Sequence[DataFrame]) -> DataFrame:
    out = layers[0]
    for df in layers[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def cascade_filter(df: DataFrame, **chosen: str | None) -> DataFrame:
    """Case-insensitive equality per column; blank and 'all ...' do not filter."""
    for column, value in chosen.items():
        if value and value.strip() and not value.strip().lower().startswith("all "):
            df = df.where(F.lower(column) == value.strip().lower())
    return df


def text_search(df: DataFrame, columns: Sequence[str], query: str) -> DataFrame:
    if not query.strip():
        return df
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.col(c).cast("string")), F.lit(query.strip().lower()))
    return df.where(F.coalesce(hit, F.lit(False)))


def involved_areas(df: DataFrame, key: str) -> DataFrame:
    """Per issue: its first area's names, all areas and the number of different ones."""
    one = F.min(F.struct("geocode", "region", "province", "city_mun", "barangay"))
    every = F.sort_array(F.collect_list(F.struct("geocode", F.concat_ws(", ", "barangay", "city_mun").alias("b"))))
    return df.groupBy(key).agg(
        one.alias("f"), every.alias("e"), F.count("*").alias("count_involved_areas"),
        *[F.countDistinct(c).alias(f"n_{c}") for c in ("region", "province", "city_mun", "barangay")],
    ).select(key, "f.*", F.array_join("e.geocode", ",").alias("involved_areas"), F.array_join("e.b", ";").alias("involved_bgys"), "count_involved_areas", *[f"n_{c}" for c in ("region", "province", "city_mun", "barangay")])


def with_group_count(df: DataFrame, by: list[str], name: str = "n") -> DataFrame:
    """Each row with the size of its group (a decorrelated count)."""
    return df.withColumn(name, F.count("*").over(Window.partitionBy(*by)))


def new_codes(df: DataFrame, parent: str, is_new: str, order: list[Column], base: str) -> DataFrame:
    """Running numbers of the new rows of each parent, after ``base``."""
    w = Window.partitionBy(parent, is_new).orderBy(*order)
    return df.withColumn("sequence", F.when(F.col(is_new), F.col(base) + F.row_number().over(w)))


def top_candidates(df: DataFrame, key: str, label: Column, order: list[str], k: int = 10) -> DataFrame:
    """The first ``k`` candidates of each key, rendered and joined."""
    s = F.sort_array(F.collect_list(F.struct(*order, label.alias("label"))))
    return df.groupBy(key).agg(F.array_join(F.transform(F.slice(s, 1, k), lambda r: r["label"]), ", ").alias("all_candidates"))


def affine_moments(df: DataFrame, x: str, y: str, lon: str, lat: str) -> dict[str, float]:
    """Sums of centred coordinates and targets in one pass over the pairs."""
    c = df.agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(lon).alias("ml"), F.avg(lat).alias("mt"), F.count("*").alias("n")).first()
    if not c["n"]:
        raise ValueError("no control points")
    u, v, p, q = F.col(x) - c["mx"], F.col(y) - c["my"], F.col(lon) - c["ml"], F.col(lat) - c["mt"]
    s = df.agg(F.sum(u * u).alias("uu"), F.sum(u * v).alias("uv"), F.sum(v * v).alias("vv"), F.sum(u * p).alias("up"), F.sum(v * p).alias("vp"), F.sum(u * q).alias("uq"), F.sum(v * q).alias("vq")).first()
    return c.asDict() | s.asDict()


def affine_fit(df: DataFrame, x: str, y: str, lon: str, lat: str) -> tuple[float, ...]:
    """``(a, b, c, d, e, f)`` of lon = ax + by + c and lat = dx + ey + f by least squares."""
    m = affine_moments(df, x, y, lon, lat)
    det = m["uu"] * m["vv"] - m["uv"] ** 2
    if abs(det) <= 1e-12 * max(1.0, m["uu"] * m["vv"]):
        raise ValueError("control points lie on a line")
    a, b = (m["up"] * m["vv"] - m["vp"] * m["uv"]) / det, (m["vp"] * m["uu"] - m["up"] * m["uv"]) / det
    d, e = (m["uq"] * m["vv"] - m["vq"] * m["uv"]) / det, (m["vq"] * m["uu"] - m["uq"] * m["uv"]) / det
    return a, b, m["ml"] - a * m["mx"] - b * m["my"], d, e, m["mt"] - d * m["mx"] - e * m["my"]


def residual(x: Column, y: Column, lon: Column, lat: Column, fit: tuple[float, ...]) -> Column:
    a, b, c, d, e, f = fit
    return F.hypot(a * x + b * y + c - lon, d * x + e * y + f - lat)


def robust_affine(df: DataFrame, x: str, y: str, lon: str, lat: str, floor: float = 0.05) -> tuple[tuple[float, ...], bool]:
    """Fit in the better of both orientations, then once more without outliers
    (residual over ``max(3 median, floor)``) if enough points stay.  Returns the fit
    and whether x and y were swapped."""
    def median(f, swapped):
        p, q = (y, x) if swapped else (x, y)
        return df.agg(F.percentile(residual(F.col(p), F.col(q), F.col(lon), F.col(lat), f), 0.5)).first()[0]

    plain, turned = affine_fit(df, x, y, lon, lat), affine_fit(df, y, x, lon, lat)
    m0, m1 = median(plain, False), median(turned, True)
    swapped, fit, med = (True, turned, m1) if m1 < m0 else (False, plain, m0)
    p, q = (y, x) if swapped else (x, y)
    near = df.where(residual(F.col(p), F.col(q), F.col(lon), F.col(lat), fit) <= max(3 * med, floor))
    n, kept = df.count(), near.count()
    if n > 4 and 3 <= kept < n:
        try:
            fit = affine_fit(near, p, q, lon, lat)
        except ValueError:
            pass
    return fit, swapped
