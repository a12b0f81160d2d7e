"""Rules that a project and its layers must keep before they are packaged, as rows of a
table: each rule is a condition over a table of layer metadata, all are tested in one pass.

``layers``: project, layer, layer_type, valid, supported, provider, storage, encoding,
path (null: no file), localized, pk and fields (arrays of names), read_only, action,
cloud_action, configured, cloud_configured.  ``projects``: project, file, home, absolute,
preset_home, dirty.  ``files``: project, path relative to the home.  A null flag is
false, a null array is empty, a null text breaks no rule; further columns are ignored."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.functions import codes, rules

CABLE, CLOUD = "cable", "cloud"
#: Folder of the packager's own files, which no rule looks at.
PRIVATE = ".sync"


@dataclass(frozen=True)
class Rule:
    level: str
    name: str
    broken: Column
    subject: Column
    scope: str | None = None


def _is(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def layer_key(pk: Column, fields: Column, layer_type: Column) -> Column:
    """Struct of ``name`` and ``error``: the only primary key column, else a field called
    ``fid`` in any case; composite keys, none at all, commas in the name and layers that
    are no vectors are errors, which have no name."""
    pk, fields = (F.coalesce(c, F.array().cast("array<string>")) for c in (pk, fields))
    fid = F.get(F.filter(fields, lambda f: F.lower(f) == "fid"), F.lit(0))
    name = F.when(F.size(pk) == 1, F.get(pk, F.lit(0))).when(F.size(pk) == 0, fid)
    error = (
        F.when(F.coalesce(layer_type, F.lit("")) != "vector", "not_vector").when(F.size(pk) > 1, "composite")
        .when(F.coalesce(name, F.lit("")) == "", "missing").when(F.contains(name, F.lit(",")), "comma")
    )
    return F.struct(F.when(error.isNull(), name).alias("name"), error.alias("error"))


def described(layers: DataFrame) -> DataFrame:
    """``layers`` with ``key`` (``layer_key``) and ``reasons`` against packaging."""
    remote = F.coalesce(F.col("provider") == "wms", F.lit(False))
    reasons = rules.prevention_reasons(_is("supported"), _is("valid"), _is("localized"), remote)
    return layers.withColumn("key", layer_key(F.col("pk"), F.col("fields"), F.col("layer_type"))).withColumn("reasons", reasons)


def layer_rules() -> list[Rule]:
    """Rules of a layer in the order of their tests; columns of ``described`` and ``home``."""
    vector, is_file = F.col("layer_type") == "vector", F.col("path").isNotNull()
    free = F.size("reasons") == 0
    mended = (F.col("storage") == "GPKG") | (F.col("provider") == "postgres") | ((F.col("provider") == "delimitedtext") & (F.col("storage") == "Delimited text file")) | ((F.col("provider") == "ogr") & (F.col("storage") == "CSV"))
    name = F.element_at(F.split("path", "/"), -1)
    return [
        Rule("warning", "encoding", vector & ~F.col("encoding").isin("UTF-8", ""), F.col("encoding")),
        Rule("warning", "file_name", is_file & name.rlike(r"[^\x00-\x7F]"), F.col("path")),
        Rule("warning", "outside_home", is_file & (F.col("path") != "") & ~_is("localized") & (F.col("home") != "") & ~F.startswith("path", F.concat(F.col("home"), F.lit("/"))), F.col("path")),
        Rule("warning", "primary_key", free & vector & ~((F.coalesce("cloud_action", F.lit("")) == "no_action") & ~is_file) & ~_is("read_only") & F.col("key.error").isNotNull(), F.col("key.error"), CLOUD),
        Rule("warning", "memory", _is("valid") & (F.col("provider") == "memory"), F.col("provider")),
        Rule("warning", "not_configured", ~_is("configured") & ~_is("cloud_configured"), F.lit(None).cast("string")),
        Rule("warning", "prevented", ~free, F.array_join("reasons", ",")),
        Rule("warning", "experimental", (F.col("cloud_action") == "offline") & ~_is("read_only") & F.col("provider").isNotNull() & ~F.coalesce(mended, F.lit(False)), F.col("storage"), CLOUD),
    ]


def project_rules() -> list[Rule]:
    nothing = F.lit(None).cast("string")
    return [
        Rule("error", "absolute_paths", _is("absolute"), nothing), Rule("error", "home_path", F.col("preset_home") != "", F.col("preset_home")),
        Rule("warning", "unsaved", _is("dirty"), nothing, CLOUD),
    ]


FOUND = ("project", "layer", "level", "rule", "subject")


def _broken(df: DataFrame, table: list[Rule], scope: str, layer: Column) -> DataFrame:
    """A row per row and rule that it breaks.  A layer's tests end at the first rule whose
    scope, asked for or not, is one for which its action is to remove it."""
    hits, ended = [], F.lit(False)
    for rule in table:
        if rule.scope and "cloud_action" in df.columns:
            own = F.col("action" if rule.scope == CABLE else "cloud_action")
            ended = ended | F.coalesce(own == "remove", F.lit(False))
        if rule.scope in (None, scope):
            hits.append(F.when(rule.broken & ~ended, F.struct(F.lit(rule.level).alias("level"), F.lit(rule.name).alias("rule"), rule.subject.alias("subject"))))
    return df.select("project", layer.alias("layer"), F.explode(F.array_compact(F.array(*hits))).alias("_h")).select("project", "layer", "_h.*")


def mixed_actions(layers: DataFrame) -> DataFrame:
    """``(project, path)`` of files of which some layers are taken offline, others copied."""
    used = layers.where("path IS NOT NULL AND action IN ('offline', 'copy')")
    return used.groupBy("project", "path").agg(F.min("action").alias("_a"), F.max("action").alias("_b")).where("_a <> _b").select("project", "path")


def bad_paths(files: DataFrame) -> DataFrame:
    """Files with characters or reserved names that no system takes."""
    return files.where(F.col("path").isNotNull() & ~F.startswith("path", F.lit(PRIVATE)) & ~codes.is_valid_path(F.col("path")))


def conflicting_names(files: DataFrame, projects: DataFrame) -> DataFrame:
    """Files, besides the project's own, that share its name up to the extension; backups
    (``~``) and the packager's folder do not count.  Only files named like some project
    are joined: the stem is in the key."""
    own = projects.select(F.col("project").alias("_p"), F.col("file").alias("_f"), codes.file_parts(F.col("file"))["stem"].alias("_s"))
    named = files.where(F.col("path").isNotNull() & ~F.endswith("path", F.lit("~")) & ~F.array_contains(F.split("path", "/"), PRIVATE)).withColumn("_stem", codes.file_parts(F.col("path"))["stem"])
    met = named.join(own, (F.col("project") == F.col("_p")) & (F.col("_stem") == F.col("_s")))
    return met.where("path <> _f").select("project", "path")


def check(projects: DataFrame, layers: DataFrame, files: DataFrame, scope: str) -> DataFrame:
    """``(project, layer, level, rule, subject)``: a row per broken rule of a layer, of a
    project (null layer), and per file or path that breaks one.

    Layers that both actions remove are not tested.  ``scope``: what is packaged for,
    ``cable`` or ``cloud``.  Rows repeated in the input are reported as often."""
    if scope not in (CABLE, CLOUD):
        raise ValueError(f"scope {scope!r}")
    homes = projects.select(F.col("project").alias("_p"), "home").dropDuplicates(["_p"])
    gone = (F.col("action") == "remove") & (F.col("cloud_action") == "remove")
    wanted = described(layers.drop("home").where(~F.coalesce(gone, F.lit(False)))).join(homes, F.col("project") == F.col("_p"), "left")

    def plain(df: DataFrame, level: str, rule: str) -> DataFrame:
        return df.select("project", F.lit(None).cast(layers.schema["layer"].dataType).alias("layer"), F.lit(level).alias("level"), F.lit(rule).alias("rule"), F.col("path").alias("subject"))

    none = F.lit(None).cast(layers.schema["layer"].dataType)
    out = _broken(wanted, layer_rules(), scope, F.col("layer")).unionByName(_broken(projects, project_rules(), scope, none))
    out = out.unionByName(plain(bad_paths(files), "error", "forbidden_path"))
    if scope == CABLE:
        return out.unionByName(plain(mixed_actions(layers), "error", "mixed_actions")).select(*FOUND)
    return out.unionByName(plain(conflicting_names(files, projects), "warning", "conflicting_name")).select(*FOUND)


def routed(layers: DataFrame, scope: str) -> DataFrame:
    """``layers`` with ``route``, what packaging does with each, ``key_name`` and
    ``made_read_only``.

    Layers that cannot be packaged are dropped from the package if they are invalid as
    such or of no supported source, else left alone.  Of the rest, the scope's action
    decides: ``offline`` (an editable copy), ``copy`` (also without an action of its own
    on the source), ``copy_if_absent`` or ``remove``; valid vectors without a usable key
    are only copied, read-only, for the cloud.  Unknown actions leave a layer alone."""
    df = described(layers)
    action = F.col("action" if scope == CABLE else "cloud_action")
    bare = _is("valid") & (F.coalesce("layer_type", F.lit("")) == "vector") & F.col("key.error").isNotNull() & F.lit(scope == CLOUD)
    action = F.when(bare, "no_action").otherwise(action)
    prevented = F.size("reasons") > 0
    route = (
        F.when(F.arrays_overlap("reasons", F.array(F.lit("invalid"), F.lit("unsupported_datasource"))), "remove").when(prevented, "leave").when(action == "offline", "offline")
        .when(action.isin("copy", "no_action"), "copy").when(action == "keep_existent", "copy_if_absent").when(action == "remove", "remove").otherwise("leave")
    )
    named = df.withColumn("route", route).withColumn("key_name", F.when(~prevented, F.col("key.name"))).withColumn("made_read_only", bare & ~prevented)
    return named.drop("key", "reasons")
