"""GeoPackage sink: one file per area code, written by the tasks and put in place at commit.

The folder must be one that driver and executors share.  A task writes under a name of its
own in a staging folder; the driver moves the files of the tasks that count, so lost
executors and repeated tasks leave neither half a file nor a second one."""

from __future__ import annotations

import datetime
import os
import re
import shutil
import sqlite3
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from cadastra.geometry import arrangement as arr
from cadastra.geometry import wkb

#: Fixed values of the format: application id ("GPKG"), version 1.3, WGS 84.
APPLICATION, VERSION, SRS = 0x47504B47, 10300, 4326
#: Column types of the format by Spark type; all others are text.
TYPES = {"boolean": "BOOLEAN", "tinyint": "TINYINT", "smallint": "SMALLINT", "int": "MEDIUMINT", "bigint": "INTEGER", "float": "FLOAT", "double": "DOUBLE", "binary": "BLOB", "date": "DATE", "timestamp": "DATETIME"}
#: Rows that are handed to the file at a time.
BATCH = 1000

TABLES = """
CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER NOT NULL PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);
CREATE TABLE gpkg_contents (table_name TEXT NOT NULL PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME NOT NULL, min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER);
CREATE TABLE gpkg_geometry_columns (table_name TEXT NOT NULL, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL, PRIMARY KEY (table_name, column_name));
"""


def file_stem(code: str | None, template: str) -> str:
    """Name of a code's file and layer: the code and what follows the place of the code in
    ``template``, spaces as underscores; rows without a code are in that of ``null``."""
    code = "null" if code is None else str(code)
    if not code or set(code) & set('/\\:*?"<>|\0') or code in (".", ".."):
        raise ValueError(f"{code!r} cannot name a file")
    return code + template.partition("{geocode}")[2].replace(" ", "_")


def local_path(path: str) -> str:
    """A folder that is mounted, with or without ``file:`` in front; others cannot hold a
    file that is written in place."""
    rest = re.sub(r"^file:(//(?=/))?", "", path)
    if re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*:", rest):
        raise ValueError(f"{path} is no mounted folder")
    return os.path.abspath(rest)


def blob(shape: bytes, srs: int = SRS) -> tuple[bytes, tuple | None]:
    """Geometry bytes of the format, and the bounds of a shape that is not empty."""
    g = wkb.parse(bytes(shape))
    box = arr.bounds(g) if g and any(r for p in g for r in p) else None
    if box is None:
        return b"GP" + struct.pack("<BBi", 0, 0b010001, srs) + bytes(shape), None
    return b"GP" + struct.pack("<BBi4d", 0, 0b000011, srs, box[0], box[2], box[1], box[3]) + bytes(shape), box


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class LayerFile:
    """A layer in a file that is new or of an earlier write."""

    def __init__(self, path: str, layer: str, columns: list[tuple[str, str]], geometry: str):
        self.db = sqlite3.connect(f"file:{path.replace('%', '%25').replace('?', '%3f').replace('#', '%23')}?nolock=1", uri=True, isolation_level=None)
        self.db.execute("PRAGMA journal_mode = OFF")
        self.layer, self.columns, self.geometry, self.rows = layer, columns, geometry, []
        self.box: tuple | None = None
        if not self.db.execute("SELECT 1 FROM sqlite_master WHERE name = 'gpkg_contents'").fetchone():
            self.db.executescript(f"PRAGMA application_id = {APPLICATION}; PRAGMA user_version = {VERSION};{TABLES}")
            self.db.executemany("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, ?, ?, ?, NULL)", [("Undefined Cartesian", -1, "NONE", -1, "undefined"), ("Undefined geographic", 0, "NONE", 0, "undefined"), ("WGS 84", SRS, "EPSG", SRS, 'GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]]')])
        self.db.execute("BEGIN")
        if not self.db.execute("SELECT 1 FROM gpkg_contents WHERE table_name = ?", (layer,)).fetchone():
            taken, key = {c.lower() for c, _ in columns}, "fid"
            while key in taken:
                key = "_" + key
            kinds = ", ".join(f"{_quoted(c)} {'MULTIPOLYGON' if c == geometry else TYPES.get(t, 'TEXT')}" for c, t in columns)
            self.db.execute(f"CREATE TABLE {_quoted(layer)} ({_quoted(key)} INTEGER PRIMARY KEY AUTOINCREMENT NOT NULL, {kinds})")
            spatial = any(c == geometry for c, _ in columns)
            self.db.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, last_change, srs_id) VALUES (?, ?, ?, strftime('%Y-%m-%dT%H:%M:%fZ', 'now'), ?)", (layer, "features" if spatial else "attributes", layer, SRS if spatial else 0))
            if spatial:
                self.db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, ?, 'MULTIPOLYGON', ?, 0, 0)", (layer, geometry, SRS))

    def add(self, row: tuple) -> None:
        out = []
        for (c, kind), v in zip(self.columns, row):
            if v is not None and c == self.geometry:
                v, box = blob(v)
                if box:
                    self.box = box if self.box is None else (min(self.box[0], box[0]), min(self.box[1], box[1]), max(self.box[2], box[2]), max(self.box[3], box[3]))
            elif isinstance(v, (datetime.datetime, datetime.date)):
                v = v.isoformat()
            elif isinstance(v, bytearray):
                v = bytes(v)
            elif v is not None and (kind not in TYPES):
                v = str(v)
            out.append(v)
        self.rows.append(out)
        if len(self.rows) >= BATCH:
            self.flush()

    def flush(self) -> None:
        self.db.executemany(f"INSERT INTO {_quoted(self.layer)} ({', '.join(_quoted(c) for c, _ in self.columns)}) VALUES ({', '.join('?' for _ in self.columns)})", self.rows)
        self.rows = []

    def close(self) -> None:
        self.flush()
        if self.box:
            old = self.db.execute("SELECT min_x, min_y, max_x, max_y FROM gpkg_contents WHERE table_name = ?", (self.layer,)).fetchone()
            box = self.box if old[0] is None else (min(old[0], self.box[0]), min(old[1], self.box[1]), max(old[2], self.box[2]), max(old[3], self.box[3]))
            self.db.execute("UPDATE gpkg_contents SET min_x = ?, min_y = ?, max_x = ?, max_y = ? WHERE table_name = ?", (*box, self.layer))
        self.db.execute("COMMIT")
        self.db.close()


@dataclass
class Written(WriterCommitMessage):
    """Staged file of every name that a task wrote."""

    files: dict[str, str]


class PackageWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.overwrite = local_path(options["path"]), overwrite
        self.name, self.geometry = options.get("name", "_file"), options.get("geometry", "geom")
        self.columns = [(f.name, f.dataType.simpleString()) for f in schema.fields]
        self.staging = os.path.join(self.path, f".staging-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator) -> Written:
        os.makedirs(self.staging, exist_ok=True)
        at = [c for c, _ in self.columns].index(self.name)
        kept = [c for k, c in enumerate(self.columns) if k != at]
        files: dict[str, str] = {}
        name, out = None, None
        for row in iterator:  # in the order of names, or a file is opened again
            if out is None or row[at] != name:
                if out is not None:
                    out.close()
                name = row[at]
                if name not in files:
                    files[name] = os.path.join(self.staging, uuid.uuid4().hex)
                    final = os.path.join(self.path, f"{name}.gpkg")
                    if not self.overwrite and os.path.exists(final):
                        shutil.copyfile(final, files[name])
                out = LayerFile(files[name], name, kept, self.geometry)
            out.add(tuple(v for k, v in enumerate(row) if k != at))
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        every = [kv for m in messages if m is not None for kv in m.files.items()]
        if len(dict(every)) < len(every):
            self.abort(messages)
            raise ValueError("rows of one file came from several tasks: deal them by its name")
        for name, staged in every:
            os.replace(staged, os.path.join(self.path, f"{name}.gpkg"))
        self.abort(messages)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class GeoPackage(DataSource):
    """``df.write.format("geopackage")``: rows go to the file that their column ``name``
    names (option, default ``_file``).  ``overwrite`` replaces files of the names that are
    written and no others, ``append`` adds rows to them."""

    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def writer(self, schema: StructType, overwrite: bool) -> PackageWriter:
        return PackageWriter(dict(self.options), schema, overwrite)


def write_geopackages(df: DataFrame, path: str, code: str = "geocode", template: str = "{geocode}", geom: str = "geom", append: bool = False, rows_per_file: int = 1_000_000) -> None:
    """A GeoPackage per value of ``code`` in the shared folder ``path``, named by
    ``file_stem``.  A code of more than ``rows_per_file`` rows is dealt over that many
    files more, named ``-2`` and so on, by the hash of the whole row: no task gets a hot
    code whole, but for rows that are equal in every column."""
    spark = df.sparkSession
    spark.dataSource.register(GeoPackage)
    stem = F.udf(lambda c: file_stem(c, template), "string")
    many = df.groupBy(code).agg(F.count("*").alias("_n")).withColumn("_of", F.ceil(F.col("_n") / rows_per_file)).withColumn("_stem", stem(F.col(code).cast("string"))).withColumnRenamed(code, "_code").drop("_n")
    joined = df.join(many, df[code].eqNullSafe(F.col("_code")))
    part = F.pmod(F.xxhash64(*df.columns), F.col("_of"))
    named = joined.withColumn("_file", F.when(part == 0, F.col("_stem")).otherwise(F.concat("_stem", F.lit("-"), (part + 1).cast("string")))).select(*df.columns, "_file")
    named.repartition("_file").sortWithinPartitions("_file").write.format("geopackage").mode("append" if append else "overwrite").option("geometry", geom).save(path)
