"""Baselines: results kept as Parquet beside a manifest, in any folder that Spark reaches."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import asdict
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hashtree
from ..operators.assertions import named
from ..operators.regression import fingerprint, row_changes
from . import scratch

STAMP = "%Y%m%dT%H%M%S%f"


def _saved_at(version: str) -> datetime | None:
    """When a save began, from the name of its version; None of other folders, which are left alone."""
    found = re.fullmatch(r"v(\d{8}T\d{12})-[0-9a-f]{8}", version)
    return datetime.strptime(found[1], STAMP).replace(tzinfo=timezone.utc) if found else None


def canonical_name(target: str) -> str:
    """The name under which a target's baseline is kept unless another is given."""
    return "auto__" + (re.sub(r"[^A-Za-z0-9_.-]+", "_", target).strip("_") or "target")


class BaselineStore:
    """Folders <root>/<name>/<version> with rows/ (Parquet), tree/ (digests of the rows, where asked for) and manifest/ (one JSON text).

    A save writes a new version. It counts from the moment its manifest is complete, which is written last. So a save that breaks
    off anywhere leaves the baseline that was there, and nothing is ever renamed. Versions that were replaced, and saves that haven't ended, are kept
    for `keep_for` more, for readers that loaded one before and for slower saves; after that the next save deletes them.
    """

    def __init__(self, spark: SparkSession, root: str, keep_for: timedelta = timedelta(days=1)):
        self.spark, self.root, self.keep_for = spark, root.rstrip("/"), keep_for
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", name) or name.startswith("."):
            raise ValueError(f"not a baseline name: {name!r}")
        return f"{self.root}/{name}"

    def _folders(self, at: str) -> list[str]:
        if not self._fs.exists(self._path(at)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(at)) if s.isDirectory())

    def _versions(self, name: str) -> list[str]:
        """Complete versions, the oldest first."""
        at = self._at(name)
        return [v for v in self._folders(at) if self._fs.exists(self._path(f"{at}/{v}/manifest/_SUCCESS"))]

    def _current(self, name: str) -> str:
        found = self._versions(name)
        if not found:
            raise KeyError(f"there is no baseline {name}")
        return f"{self._at(name)}/{found[-1]}"

    def exists(self, name: str) -> bool:
        return bool(self._versions(name))

    def list_names(self) -> list[str]:
        return [n for n in self._folders(self.root) if not n.startswith(".") and self.exists(n)]

    def save(self, name: str, df: DataFrame, tree: bool = False, keys: Sequence[str] = (), rows: int | None = None, **provenance) -> dict:
        """A new version. tree: rows are laid out by leaf, with a tree of digests beside them (see operators/hashtree.py); keys choose the leaf, or else the whole row.

        rows: about how many there are, which the depth of the tree depends on. Unless it is given, the version before tells it, or else they are counted, which computes df once more.
        """
        now = datetime.now(timezone.utc)
        at, made = self._at(name), f"v{now.strftime(STAMP)}-{uuid.uuid4().hex[:8]}"
        layout = None
        if tree:
            if rows is None:
                rows = self.manifest(name)["row_count"] if self.exists(name) else df.count()
            layout = hashtree.Layout(tuple(df.columns), tuple(keys), hashtree.depth_for(rows))
            parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            hashtree.laid_out(df, layout, max(parts, min(4096, rows // 1_000_000))).write.partitionBy(hashtree.TOP).parquet(f"{at}/{made}/rows")
        else:
            df.write.parquet(f"{at}/{made}/rows")
        kept = self._rows(f"{at}/{made}", layout)
        if layout:
            hashtree.tree(kept, layout).repartition("level").sortWithinPartitions("node").write.partitionBy("level").parquet(f"{at}/{made}/tree")
            provenance["layout"] = asdict(layout)
        aggregates = {r.name: r.value for r in fingerprint(kept).collect()}
        manifest = {"name": name, "columns": df.columns, "schema": kept.schema.jsonValue(), "row_count": int(aggregates["__row_count"]), "aggregates": aggregates, "created_at": now.isoformat(), **provenance}
        self.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{at}/{made}/manifest")
        self._sweep(name, now)
        return manifest

    def _sweep(self, name: str, now: datetime) -> None:
        """Delete what was replaced, or broke off, over keep_for ago."""
        at, complete = self._at(name), self._versions(name)
        replaced = dict(zip(complete, complete[1:]))  # by the version after it
        for v in self._folders(at):
            since = replaced.get(v) if v in complete else v
            if since is not None and (when := _saved_at(since)) is not None and when + self.keep_for <= now:
                self._fs.delete(self._path(f"{at}/{v}"), True)

    def _rows(self, at: str, layout: hashtree.Layout | None) -> DataFrame:
        rows = self.spark.read.parquet(f"{at}/rows")
        return rows.select(*[named(c) for c in layout.columns]) if layout else rows

    def manifest(self, name: str) -> dict:
        return json.loads("\n".join(r.value for r in self.spark.read.text(f"{self._current(name)}/manifest").collect()))

    def layout(self, name: str) -> hashtree.Layout | None:
        """How the rows are dealt out, if they have a tree."""
        found = self.manifest(name).get("layout")
        return hashtree.Layout(tuple(found["columns"]), tuple(found["keys"]), found["depth"]) if found else None

    def load(self, name: str) -> DataFrame:
        """The rows, lazily."""
        return self._rows(self._current(name), self.layout(name))

    def _as_kept(self, name: str, current: DataFrame) -> DataFrame | None:
        """current with the columns of the baseline in its order, if hashes of both sides can be compared."""
        layout = self.layout(name)
        if layout is None or not hashtree.same_kinds(current.schema, self.load(name).schema):
            return None
        by_name = {c.upper(): c for c in current.columns}
        return current.select(*[named(by_name[c.upper()]).alias(c) for c in layout.columns])

    def changed_leaves(self, name: str, current: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame] | None:
        """(leaves that differ, rows of current in them, rows of the baseline in them), or None if there is no tree for these columns.

        current is computed twice: for its digests, and for its rows in the leaves that differ. Of the baseline only the tree's nodes
        on the way to such leaves and the folders that hold them are read.
        """
        now = self._as_kept(name, current)
        if now is None:
            return None
        layout, at = self.layout(name), self._current(name)
        new = scratch.written(hashtree.tree(now, layout), "tree")
        leaves = scratch.written(hashtree.differing_leaves(self.spark.read.parquet(f"{at}/tree"), new, layout.depth), "leaves")
        columns = [named(c) for c in layout.columns]
        mine = hashtree.in_leaves(hashtree.with_leaf(now, layout), leaves, layout).select(*columns)
        kept = hashtree.in_leaves(self.spark.read.parquet(f"{at}/rows"), leaves, layout, folders=True).select(*columns)
        return leaves, mine, kept

    def row_changes(self, name: str, current: DataFrame) -> DataFrame:
        """What regression.row_changes() tells of current against the whole baseline, from the leaves that differ where there is a tree."""
        found = self.changed_leaves(name, current)
        return row_changes(current, self.load(name)) if found is None else row_changes(*found[1:])

    def index(self) -> DataFrame:
        """name, row_count, created_at and manifest (JSON) of every baseline, read in one job."""
        paths = [f"{self._current(n)}/manifest" for n in self.list_names()]
        if not paths:
            return self.spark.createDataFrame([], "name string, row_count long, created_at string, manifest string")
        field = lambda name: F.get_json_object("value", f"$.{name}")
        rows = self.spark.read.text(paths)
        return rows.select(field("name").alias("name"), field("row_count").cast("long").alias("row_count"), field("created_at").alias("created_at"), F.col("value").alias("manifest"))


def open_store(spark: SparkSession, config: Mapping[str, str] | None = None) -> BaselineStore:
    """The store that a configuration names: {root: folder}, shared if all users name the same; a local one unless told otherwise."""
    config = config or {}
    if extra := set(config) - {"root"}:
        raise ValueError(f"unknown fields: {sorted(extra)}")
    return BaselineStore(spark, config.get("root", "baselines"))
