"""Special areas: reported gaps and overlaps become areas of their own."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.geometry import arrangement as arr
from cadastra.geometry import wkb
from cadastra.operators import polygons, spatial

from . import geometry_ops as ops

#: Common areas up to this size do not count.
TINY = 1e-9


def _common(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    found = [arr.intersection(wkb.parse(x), wkb.parse(y)) for x, y in zip(a, b)]
    return pd.DataFrame({"geom": [wkb.dump(g) for g in found], "area": [float(arr.area(g)) for g in found]})


def _cut(left: DataFrame, right: DataFrame, size: float) -> DataFrame:
    """Pairs ``a``, ``b`` of shapes with their common part ``c``."""
    met = polygons.dealt(spatial.box_join(polygons.boxed(left), polygons.boxed(right), size, closed=False))
    common = F.pandas_udf(_common, "struct<geom:binary,area:double>").asNondeterministic()
    return met.withColumn("c", common("a.geom", "b.geom")).where(F.col("c.area") > TINY)


def inject_special(eas: DataFrame, issues: DataFrame, parents: DataFrame, size: float) -> DataFrame:
    """``eas`` and special areas, with ``issue`` and ``source_id`` (null for ``eas``).

    ``eas``: ea_id, parent, geom and any attributes; ``issues``: issue (the order of the
    new numbers), geom; ``parents``: parent, geom.  An issue is clipped to the parent that
    it overlaps most and taken out of every area that it overlaps; it copies the
    attributes of the area that it overlaps most, else of the parent's first.  Ties: least
    key.  Issues are independent of each other: the source is found before any is taken
    out.  Rows without geometry pass through, issues outside all parents are left out, an
    area covered whole keeps an empty geometry."""
    shapes = eas.select("ea_id", "geom")
    met = _cut(issues.select("issue", "geom"), parents.select("parent", "geom"), size).select("a.issue", "b.parent", "c.geom", "c.area")
    best = met.groupBy("issue").agg(F.min_by(F.struct("parent", "geom"), F.struct(-F.col("area"), "parent")).alias("m")).select("issue", "m.*")
    top = eas.agg(F.coalesce(F.max("ea_id"), F.lit(0))).first()[0]  # one number
    special = spatial.numbered(best, "issue", "fid", top)
    pairs = spatial.cut_lineage(_cut(special.select("issue", "geom"), shapes, size).select("a.issue", "b.ea_id", "c.geom", "c.area"))

    source = pairs.groupBy("issue").agg(F.min_by("ea_id", F.struct(-F.col("area"), "ea_id")).alias("most"))
    first = eas.groupBy("parent").agg(F.min("ea_id").alias("first"))
    large = spatial.not_broadcast
    special = special.join(large(source), "issue", "left").join(large(first), "parent", "left").withColumn("source_id", F.coalesce("most", "first"))
    new = special.join(large(eas.drop("geom", "parent").withColumnRenamed("ea_id", "source_id")), "source_id", "left").withColumnRenamed("fid", "ea_id")

    taken = ops.dissolve(pairs.select("ea_id", "geom"), "ea_id").withColumnRenamed("geom", "_taken")
    left = polygons.dealt(eas.join(large(taken), "ea_id", "left")).withColumn("geom", F.coalesce(ops.difference_of("geom", "_taken"), "geom"))
    kept = left.withColumn("issue", F.lit(None).cast("long")).withColumn("source_id", F.lit(None).cast("long"))
    columns = [*eas.columns, "issue", "source_id"]
    return kept.select(columns).unionByName(new.select(columns))
