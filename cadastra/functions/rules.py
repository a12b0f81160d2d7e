"""Rule classes, form constraints and code lists as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels and code lists of the survey forms.
BUILDING_TYPES = {
    "01": "01_Single House", "02": "02_Duplex", "03": "03_Apartment/Accessoria/Rowhouse", "04": "04_Condominium/Condotel",
    "05": "05_Other Multi-Unit Residential Building", "06": "06_Commercial/Industrial/Agricultural", "07": "07_Institutional Living Quarter",
    "08": "08_None (Homeless)", "09": "09_Temporary Evacuation Centers/Relocation Area",
    "10": "10_Demolished/Destroyed, Dilapidated, and Out-of-scope", "11": "11_Purely Commercial/Industrial/Agricultural Building", "99": "99_Other Type of Building",
}
ROAD_CLASSES = {2001: "Provincial/National Road", 2002: "Municipal Road", 2003: "Barangay Road", 2004: "Alley", 2005: "Proposed Road", 2010: "Trail"}
REQUIRED = ("region", "province", "city_mun", "barangay", "longitude", "latitude", "map_uuid", "bsn_geoid", "ean", "bsn", "ea_geocode", "bldg_type", "up_feature", "date")
LENGTHS = {"ean": 6, "bsn": 5, "bsn_geoid": 19, "ea_geocode": 14}


def mbi_level(regions: Column, provinces: Column, cities: Column, barangays: Column) -> Column:
    """Severity by the highest level at which the areas involved differ."""
    return (
        F.when(regions > 1, "1_Inter-Region")
        .when(provinces > 1, "2_Inter-Province")
        .when(cities > 1, "3_Inter-City/Municipality")
        .when(barangays > 1, "4_Inter-Barangay")
        .otherwise("5_Within-Barangay")
    )


def keep_issue(area: Column, buildings: Column, geocode: Column) -> Column:
    """Slivers without buildings and issues without an area are noise."""
    return ~((area >= 0) & (area <= 0.1) & (buildings == 0)) & geocode.isNotNull()


def mbi_status_default(category: Column, status: Column) -> Column:
    return F.when(category.startswith("2_") | category.startswith("3_"), "2_Pending").when(category == "4_Inland Water", F.lit(None).cast("string")).otherwise(status)


def building_labels(bsn: Column, bldg_type: Column) -> Column:
    """Every label whose rule holds; rules may overlap."""
    n = bsn.try_cast("int")
    rules = (
        ("Existing", (n > 0) & (n < 40000)), ("Homeless", (n > 60000) & (n < 70000)), ("New", (n > 70000) & (n < 80000)),
        ("Relocation", n == 55555), ("Demolished", bsn == "00000"), ("ILQ", bldg_type == "07"),
    )
    return F.array_compact(F.array(*[F.when(rule, label) for label, rule in rules]))


def form_violations(columns: dict[str, Column], layer_name: Column) -> Column:
    """Names of the constraints that a row breaks."""
    checks = [F.when(F.coalesce(F.length(columns[c]) != n, F.lit(True)), f"{c}_length") for c, n in LENGTHS.items() if c in columns and c != "ea_geocode"]
    checks += [F.when(columns[c].isNull(), f"{c}_null") for c in ("longitude", "latitude", "map_uuid") if c in columns]
    checks.append(F.when(~F.coalesce(F.substring(layer_name, 1, 14) == columns["ea_geocode"], F.lit(False)), "layer_name"))
    return F.array_compact(F.array(*checks))


def needs_check(columns: dict[str, Column]) -> Column:
    """A required value is missing, a code has the wrong length or ``up_feature`` is 0."""
    out = F.coalesce(columns["up_feature"].cast("string") == "0", F.lit(False)) if "up_feature" in columns else F.lit(False)
    for name in REQUIRED:
        if name in columns:
            out = out | columns[name].isNull()
    for name, n in LENGTHS.items():
        if name in columns:
            out = out | F.coalesce(F.length(columns[name]) != n, F.lit(False))
    return out


def decode(c: Column, codes: dict) -> Column:
    """Label of a code by a literal map; null if unknown."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv]), c)


def ea_class(hh: Column, flag_delineate: Column, flag_merge: Column | None, spatial: Column, low: int = 100, high: int = 300, inclusive: bool = True) -> Column:
    """``delineate``, ``merge`` or ``none``.  A merge flag column decides alone where
    there is one.  ``inclusive=False`` gives the strict limits of the dialog."""
    n = F.coalesce(hh, F.lit(0))
    asked = F.coalesce(F.lower(F.trim(flag_delineate)).isin("for delineation", "for_delineation"), F.lit(False))
    over, under = (n >= high, n <= low) if inclusive else (n > high, n < low)
    merge = under if flag_merge is None else F.coalesce(F.lower(F.trim(flag_merge)).isin("for merging", "for_merging"), F.lit(False))
    return F.when(spatial | asked | over, "delineate").when(merge, "merge").otherwise("none")


def building_population(c: Column, missing: float = 1.0) -> Column:
    """Households of a building; missing, blank, not positive and not numeric count as ``missing``."""
    n = c.cast("string").try_cast("double")
    return F.when(n.isNotNull() & ~F.isnan(n) & (n > 0), n).otherwise(F.lit(missing))


def prevention_reasons(supported: Column, valid: Column, localized: Column, remote_raster: Column) -> Column:
    """Why a layer cannot be packaged, an array: an unsupported source, and of an invalid
    layer whether its shared data are missing, its remote raster is out of reach or
    it is invalid as such."""
    broken = F.when(~valid & localized, "localized_path").when(~valid & remote_raster, "invalid_remote_raster_layer").when(~valid, "invalid")
    return F.array_compact(F.array(F.when(~supported, "unsupported_datasource"), broken))


# What a package leaves out, by name or by path from its root.
PACKAGE_EXCLUSIONS = (
    ".git", ".git/*", ".github", ".github/*", ".agents", ".agents/*", ".antigravity*", "docs", "docs/*", "scripts", "scripts/*", "node_modules", "node_modules/*",
    "__pycache__", "__pycache__/*", "*.pyc", "*.zip", "package.json", "package-lock.json", "pnpm-lock.yaml", "tsconfig*.json", ".gitignore", "README.md",
)


def glob_pattern(glob: str) -> str:
    """Java regular expression of a file-name glob: ``*`` and ``?`` match any characters,
    a slash too."""
    return "^" + "".join({"*": ".*", "?": "."}.get(c, c if c.isalnum() or c in "/_" else "\\" + c) for c in glob) + "$"


def is_excluded(name: Column, path: Column) -> Column:
    """Whether a file's name or path matches an exclusion."""
    every = "|".join(f"(?:{glob_pattern(g)})" for g in PACKAGE_EXCLUSIONS)
    return name.rlike(every) | path.rlike(every)
