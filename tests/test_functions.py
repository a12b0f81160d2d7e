import datetime

import pytest
from pyspark.sql import functions as F

from cadastra.functions import codes, geo, names, rules
from cadastra.operators import relational as rel


def values(spark, data, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


@pytest.mark.parametrize(("fn", "data", "want"), [
    (names.normalize_name, ["Brgy. Sto. Niño", None, "  ", "NULL", "SAN-JOSE  Jr."], ["barangay santo niño", "", "", "", "san jose junior"]),
    (names.roman_to_arabic, ["Poblacion III", "Poblacion V", "XLIX b", "xv", None], ["poblacion 3", "poblacion v", "49 b", "15", ""]),
    (names.arabic_to_roman, ["Poblacion 3", "5", "51", "a 50"], ["poblacion iii", "v", "51", "a l"]),
    (names.name_base, ["poblacion 3", "barurao"], ["poblacion", "barurao"]),
    (names.name_number, ["poblacion 3", "barurao", "san jose 2"], ["3", None, "2"]),
    (names.normalize_barangay, ["Brgy. Sta. Cruz", "Poblacion III", "01", None], ["santacruz", "poblacion3", "1", ""]),
    (names.title_case, ["CRUZ-norte (pob.)", "o'neil 2nd"], ["Cruz-Norte (Pob.)", "O'Neil 2Nd"]),
    (lambda c: codes.clean_geocode(c, 10), ["1400101001.0", "12"], ["1400101001", "0000000012"]),
    (codes.psgc_to_14, ["1400101001", ""], ["00101001000000", ""]),
    (codes.slugify, ["A b__c!"], ["a-b-c"]),
    (codes.strip_count_label, ["Layer [12] "], ["Layer"]),
])
def test_text_functions(spark, fn, data, want):
    assert values(spark, data, fn) == want


def test_levels_and_classes(spark):
    rows = [(2, 1, 1, 1), (1, 2, 1, 1), (1, 1, 2, 1), (1, 1, 1, 2), (1, 1, 1, 1)]
    got = spark.createDataFrame(rows, "r int, p int, c int, b int").select(rules.mbi_level(*map(F.col, "rpcb"))).collect()
    assert [r[0][0] for r in got] == ["1", "2", "3", "4", "5"]
    cls = values(spark, [300, 100, 101, 0, None], lambda c: rules.ea_class(c, F.lit(None).cast("string"), None, F.lit(False)), "int")
    assert cls == ["delineate", "merge", "none", "merge", "merge"]
    strict = values(spark, [300, 100, 301, 99], lambda c: rules.ea_class(c, F.lit(None).cast("string"), None, F.lit(False), inclusive=False), "int")
    assert strict == ["none", "none", "delineate", "merge"]
    assert values(spark, [None, "", "0", "-2", "x", "4"], rules.building_population) == [1, 1, 1, 1, 1, 4]


def test_codes(spark):
    df = spark.createDataFrame([("001000", 6), ("000123", 6)], "m string, s int")
    assert [r[0] for r in df.select(codes.compose_ea_code(F.col("m"), F.col("s"))).collect()] == ["001006", "006000"]
    lon, lat = geo.swap_lon_lat(F.lit(14.6), F.lit(121.0))
    assert spark.range(1).select(lon, lat).first() == (121.0, 14.6)
    assert spark.range(1).select(F.date_format(F.lit(datetime.datetime(2024, 1, 2, 15, 4, 5)), "MM.dd.yyyy - hh:mm:ss a")).first()[0] == "01.02.2024 - 03:04:05 PM"


def test_matchers(spark):
    def one(fn, a, b, k=3):
        df = spark.createDataFrame([(a, b)], "a string, b string").select(names.normalize_name(F.col("a")).alias("a"), names.normalize_name(F.col("b")).alias("b"))
        return df.select(fn(names.forms(F.col("a")), names.forms(F.col("b")), k)).first()[0]

    assert one(names.distance_roman, "Barurao 1", "Barurao II") is None
    assert one(names.distance_roman, "Barurao 1", "Barurao I") == 0 == one(names.distance_roman, "Barurao 2", "Barurao II")
    assert one(names.distance_roman, "Manawe", "Magaud") is None and one(names.distance_roman, "STO. NINO", "Santo Niño") == 1
    assert tuple(one(names.distance_three, "Manawe", "Magaud")) == (3, "DIRECT")


def test_matchers_lose_no_pair(spark):
    """Numerals change lengths by more than the edits allowed; brute force over all pairs."""
    import random

    rng = random.Random(6)
    left = ["lot xxxviii blk xxxviii", "xxxviii", "a", "", "san jose 2", "barurao ii", "pob", "manawe"]
    right = ["lot 38 blk 38", "38", "b", "san josé ii", "san joze 02", "barurao 2", "pob 1", "magaud", "xx"]
    for _ in range(40):
        w = "".join(rng.choice("abci ") for _ in range(rng.randrange(1, 14)))
        left.append(" ".join(w.split()) or "q")
        right.append("".join(c if rng.random() > 0.15 else rng.choice("abx") for c in w).strip() or "r")
    a = spark.createDataFrame([(v,) for v in sorted(set(left))], "a string")
    b = spark.createDataFrame(list(enumerate(sorted(set(right)))), "o int, b string")
    for k in (1, 3):
        got = {(r["a"], r["b"], r["distance"]) for r in rel.fuzzy_all(a, b, "a", "b", k).collect()}
        pairs = a.crossJoin(b).select("a", "b", names.distance_three(names.forms(F.col("a")), names.forms(F.col("b")), k)["distance"].alias("d")).where(F.col("d") <= k)
        assert got == {tuple(r) for r in pairs.collect()}
        assert ("lot xxxviii blk xxxviii", "lot 38 blk 38", 0) in got
        near = a.crossJoin(b).select("a", "o", "b", names.distance_roman(names.forms(F.col("a")), names.forms(F.col("b")), k).alias("d")).where("d IS NOT NULL")
        want = near.groupBy("a").agg(F.min(F.struct("d", "o", "b")).alias("m")).select("a", "m.d", "m.o", "m.b")
        assert {tuple(r) for r in rel.fuzzy_roman(a, b, "a", "a", "b", "o", k).collect()} == {tuple(r) for r in want.collect()}


def test_close_matches_equal_the_library(spark):
    import difflib

    src = ["sanjose", "snjose", "barurao", "zzz", "poblacion1", ""]
    keys = ["sanjoze", "sanjos", "sanjose1", "poblacion", "barurau", "baruraa", "x"]
    got = rel.close_matches(spark.createDataFrame([(v,) for v in [*src, *src]], "n string"), spark.createDataFrame([(k,) for k in keys], "k string"), "n", "k")
    want = {s: m[0] for s in src if s and (m := difflib.get_close_matches(s, keys, n=1, cutoff=0.75))}
    assert {r["name"]: r["match"] for r in got.collect()} == want
    refs = spark.createDataFrame([("San Jose", 1, 1), ("Barurao II", 2, 2), ("Barurao II", 3, 3)], "ref string, code int, o int")
    rows = spark.createDataFrame([(1, "san jose"), (2, "Barurao 2"), (3, "Bararao 2"), (4, "nothing"), (5, None)], "id int, name string")
    found = rel.cascade_lookup(rows, refs, "name", "ref", "code", "o", cutoff=0.75)
    assert {r["id"]: (r["code"], r["status"]) for r in found.collect()} == {1: (1, "EXACT"), 2: (3, "NORMALIZED"), 3: (3, "CLOSE"), 4: (None, "UNMATCHED"), 5: (None, "UNMATCHED")}


@pytest.mark.parametrize("cutoff", [0.3, 0.75, 0.9, 1.0])
def test_close_matches_of_random_names(spark, cutoff):
    """Few letters, many repeats, all lengths: every pair that the library finds, ties too."""
    import difflib
    import random

    r = random.Random(5)
    made = ["".join(r.choice("aabno ñ\n😀") for _ in range(r.choice((1, 2, 3, 5, 9, 14)))) for _ in range(260)]
    src, keys = made[:130], [*made[120:], "ab" * 130]
    got = rel.close_matches(spark.createDataFrame([(v,) for v in [*src, None]], "n string"), spark.createDataFrame([(k,) for k in [*keys, None, ""]], "n string"), "n", "n", cutoff)
    want = {s: m[0] for s in src if (m := difflib.get_close_matches(s, sorted(set(keys)), n=1, cutoff=cutoff))}
    rows = got.collect()
    assert {x["name"]: x["match"] for x in rows} == want and len(rows) == len(want)
    none = spark.createDataFrame([], "n string")
    assert rel.close_matches(none, none, "n", "n", cutoff).collect() == []


def test_fixed_forms(spark):
    assert values(spark, ["CON", "CON.txt", "con", "a.", "a|b", "x" * 255, "ok.csv"], codes.is_valid_filename) == [False, True, False, False, False, False, True]
    assert values(spark, [".git/a", "x/y.pyc", "x/y.py", "docs", "docs2"], lambda c: rules.is_excluded(F.substring_index(c, "/", -1), c)) == [True, True, False, True, False]
    assert values(spark, [None, "123456", "x23", "AB-456", ""], lambda c: codes.ea_display_name(F.lit(None).cast("string"), c)) == ["EA Unknown", "EA 123456", "EA x23", "EA 456", "EA Unknown"]
    assert values(spark, [60000, 60001, 70000, 70001, 80000], lambda c: F.array_join(rules.building_labels(c, F.lit("01")), ",")) == ["", "Homeless", "", "New", ""]


def test_affine_is_recovered_with_swap_and_outliers(spark):
    rows = [(float(i % 7) * 1000, float(i % 5) * 900) for i in range(40)]
    data = [(y, x, 121 + 3e-6 * x, 14 + 3e-6 * y) for x, y in rows[:-1]] + [(0.0, 0.0, 130.0, 20.0)]
    df = spark.createDataFrame(data, "x double, y double, lon double, lat double")
    fit, swapped = rel.robust_affine(df, "x", "y", "lon", "lat")
    lon, lat = geo.affine(fit)(F.col("y" if swapped else "x"), F.col("x" if swapped else "y"))
    worst = df.where("lon < 125").agg(F.max(F.abs(lon - F.col("lon"))), F.max(F.abs(lat - F.col("lat")))).first()
    assert max(worst) < 1e-6
    with pytest.raises(ValueError):
        rel.affine_fit(df.limit(0), "x", "y", "lon", "lat")


def test_aliases():
    assert rel.resolve_first_column(["id", "EAN"], ["ean", "id"]) == "id"
    assert rel.resolve_first_alias(["id", "City/Mun"], ["ean", "city_mun", "id"]) == "City/Mun"


def test_city_of_a_layer(spark):
    cities = spark.createDataFrame([("San Jose", 2), ("San", 3), ("Quezon City", 1), ("", 0), (None, 0)], "name string, o int")
    layers = spark.createDataFrame([(1, "SanJose_bgy"), (2, "quezon - Barangay"), (3, "Quezzon Citi_bgy"), (4, "zzz"), (5, None), (6, "_bgy"), (7, "x San Pedro"), (7, "x San Pedro")], "id long, layer string")
    found = lambda cutoff: sorted((r["id"], r["city"]) for r in rel.city_detect(layers, cities, "layer", "name", "o", cutoff).collect())
    sure = [(1, "San Jose"), (2, "Quezon City"), (3, None), (4, None), (5, None), (6, None), (7, "San"), (7, "San")]
    assert found(None) == sure
    assert found(0.75) == [(3, "Quezon City") if r[0] == 3 else r for r in sure]
