"""A named set of tables that is loaded, changed and saved together, also in place."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidyshelf.session import file_names, put_new, read_small, remove


class Outdated(RuntimeError):
    """Another version was saved since this one was opened."""


class Catalog:
    """Tables by name, each also a temporary view.

    ``load`` and ``save`` exchange plain folders, one for each table. ``open`` and ``commit`` keep a folder of versions, in which a
    catalogue can be opened, changed and saved in place: tables are written beside the old ones, and a manifest that names the
    tables of the new version comes last. Until it is there, and whenever anything before it fails, readers see the version before.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._tables: dict[str, DataFrame] = {}
        self._home: str | None = None
        self._version = 0
        self._stored: dict[str, dict] = {}

    @classmethod
    def load(cls, spark: SparkSession, folder: str, names: Sequence[str], fmt: str = "parquet",
             suffix: str = ".parquet") -> Catalog:
        catalog = cls(spark)
        for name in names:
            catalog.add(name, spark.read.format(fmt).load(f"{folder.rstrip('/')}/{name}{suffix}"))
        return catalog

    @classmethod
    def open(cls, spark: SparkSession, folder: str, version: int | None = None) -> Catalog:
        """A saved version, the last one if none is named; an empty catalogue if nothing has been saved yet."""
        catalog = cls(spark)
        catalog._home = folder.rstrip("/")
        known = versions(spark, folder)
        if version is None:
            version = known[-1] if known else 0
        elif version not in known:
            raise ValueError(f"there is no version {version} in {folder}")
        if version:
            manifest = _manifest(spark, catalog._home, version)
            for name, entry in manifest["tables"].items():
                schema = StructType.fromJson(entry["schema"])
                catalog.add(name, spark.read.schema(schema).format(entry["format"]).load(f"{catalog._home}/{entry['path']}"))
            catalog._stored, catalog._version = manifest["tables"], version
        return catalog

    @property
    def version(self) -> int:
        """The saved version that this catalogue was opened from or last saved as; 0 if there is none."""
        return self._version

    def add(self, name: str, df: DataFrame) -> None:
        """Add or replace a table."""
        self._tables[name] = df
        self._stored = {n: e for n, e in self._stored.items() if n != name}
        df.createOrReplaceTempView(name.replace("-", "_"))

    def drop(self, name: str) -> None:
        """Leave a table out from now on; saved versions keep it."""
        del self._tables[name]
        self._stored = {n: e for n, e in self._stored.items() if n != name}
        self.spark.catalog.dropTempView(name.replace("-", "_"))

    def get(self, name: str) -> DataFrame:
        return self._tables[name]

    __getitem__ = get

    def __iter__(self) -> Iterator[str]:
        return iter(self._tables)

    def items(self):
        return self._tables.items()

    def commit(self, folder: str | None = None, fmt: str = "parquet") -> int:
        """Save as the next version of ``folder`` (where it was opened, if not given) and return its number.

        Only tables that were added or replaced are written; a version shares the others with the one before. Whoever saves second
        from the same version gets ``Outdated``, and what they wrote is removed. Afterwards this catalogue reads what it saved.
        """
        home = (folder or self._home or "").rstrip("/")
        if not home:
            raise ValueError("a catalogue that was not opened needs a folder to be saved in")
        if home != self._home:
            known = versions(self.spark, home)
            base, stored = known[-1] if known else 0, {}
        else:
            base, stored = self._version, dict(self._stored)
        staged = f"tables/{uuid.uuid4().hex}"
        try:
            for at, (name, df) in enumerate(self._tables.items()):
                if name not in stored:
                    path = f"{staged}/{at}"
                    df.write.format(fmt).save(f"{home}/{path}")
                    stored[name] = {"path": path, "format": fmt, "schema": df.schema.jsonValue()}
            manifest = {"version": base + 1, "tables": {n: stored[n] for n in self._tables}}
            if not put_new(self.spark, f"{home}/manifests/{base + 1:010d}.json", json.dumps(manifest)):
                raise Outdated(f"version {base + 1} of {home} was saved by someone else")
        except BaseException:
            remove(self.spark, f"{home}/{staged}")
            raise
        saved = Catalog.open(self.spark, home, base + 1)
        self.__dict__.update(saved.__dict__)
        return base + 1

    def save(self, folder: str, fmt: str = "parquet", suffix: str = ".parquet", mode: str = "errorifexists") -> None:
        """Write every table into a folder of its own; an existing one is only replaced when ``mode`` says so.

        Replacing empties a folder before it is filled, so a folder that any table of the catalogue reads is refused; ``commit`` saves
        in place. Nothing is written if one is refused.
        """
        targets = {name: f"{folder.rstrip('/')}/{name}{suffix}" for name in self._tables}
        if mode == "overwrite":
            read = [_plain(p) for df in self._tables.values() for p in df.inputFiles()]
            for target in targets.values():
                if any(p == _plain(target) or p.startswith(_plain(target) + "/") for p in read):
                    raise ValueError(f"{target} is read by a table of the catalogue; commit() saves in place")
        for name, df in self._tables.items():
            df.write.mode(mode).format(fmt).save(targets[name])

    def summary(self) -> DataFrame:
        """Rows and columns per table."""
        out = None
        for name, df in self._tables.items():
            part = df.groupBy().agg(F.count("*").alias("rows")).select(
                F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).alias("columns"))
            out = part if out is None else out.unionByName(part)
        return out


def _plain(path: str) -> str:
    """A path without a local scheme, so that both ways to write it compare."""
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith(("file:", "/")) else path


def _manifest(spark: SparkSession, home: str, version: int) -> dict:
    return json.loads(read_small(spark, f"{home}/manifests/{version:010d}.json"))


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The saved versions, ascending."""
    return sorted(int(n.removesuffix(".json")) for n in file_names(spark, f"{folder.rstrip('/')}/manifests") if n.endswith(".json"))


def forget_versions(spark: SparkSession, folder: str, keep: int = 1) -> list[int]:
    """Remove all but the last ``keep`` versions, with the tables that no other version shares; the removed ones.

    Manifests go first, so no version that can be opened lacks a table. Tables that no manifest names, such as those of a save that is
    still under way, are left alone.
    """
    home, known = folder.rstrip("/"), versions(spark, folder)
    gone, left = known[:max(0, len(known) - max(1, keep))], known[max(0, len(known) - max(1, keep)):]
    paths = [{e["path"] for v in some for e in _manifest(spark, home, v)["tables"].values()} for some in (gone, left)]
    for version in gone:
        remove(spark, f"{home}/manifests/{version:010d}.json")
    for path in paths[0] - paths[1]:
        remove(spark, f"{home}/{path}")
    return gone
