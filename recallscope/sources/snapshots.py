"""Result sets that change all at once.

The analysis writes about fifteen tables and two texts. Overwritten one by one, a reader that
comes in between sees tables of different logs. Here every publication is a folder of
its own, complete before anything points to it:

    <out>/_versions/<n>-<id>/...     the tables and texts of one publication
    <out>/_versions/<n>.json         its manifest: the folder and what it holds

A publication becomes current when its manifest appears, by a rename that fails where the
name is taken (compare-and-set on the number ``n``): of two writers at once one gets ``n``, the
other tries ``n + 1``. Readers take the highest manifest and keep that version for all
tables they read. Older versions beyond ``keep`` are deleted, and so are folders left by
writers that died, so the folder stays bounded however often is published.
"""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from recallscope.sources import io

KEEP = 3


def _versions(out_dir: str) -> str:
    return f"{out_dir.rstrip('/')}/_versions"


def _listing(spark: SparkSession, folder: str) -> list[str]:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    jfs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in jfs.listStatus(jpath)) if jfs.exists(jpath) else []


def _claim(spark: SparkSession, draft: str, target: str) -> bool:
    """Rename ``draft`` to ``target`` unless that exists."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs
    source, goal = hadoop.Path(draft), hadoop.Path(target)
    files = hadoop.FileContext.getFileContext(
        goal.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)  # none: do not overwrite
    try:
        files.rename(source, goal, options)
        return True
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            return False
        raise


def manifests(spark: SparkSession, out_dir: str) -> list[int]:
    """Numbers of the versions that can be read, ascending."""
    names = _listing(spark, _versions(out_dir))
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())


class Snapshot:
    """One published version, for as many reads as needed."""

    def __init__(self, spark: SparkSession, out_dir: str, version: int | None = None):
        if version is None:
            found = manifests(spark, out_dir)
            if not found:
                raise FileNotFoundError(f"nothing has been published at {out_dir}")
            version = found[-1]
        text = io.read_text(spark, f"{_versions(out_dir)}/{version:012d}.json")
        if text is None:
            raise FileNotFoundError(f"version {version} of {out_dir} is not there (any more)")
        self.spark, self.version = spark, version
        manifest = json.loads(text)
        self.names, self.info, self.folder = manifest["names"], manifest["info"], f"{_versions(out_dir)}/{manifest['folder']}"

    def table(self, name: str, fmt: str = "csv") -> DataFrame:
        reader = io._reader(self.spark, fmt, io.METRIC_SCHEMA if name == "metrics" else None)
        return reader.load(f"{self.folder}/{name}")

    def text(self, name: str) -> str | None:
        return io.read_text(self.spark, f"{self.folder}/{name}")


@contextmanager
def publishing(spark: SparkSession, out_dir: str, keep: int = KEEP, info: dict | None = None):
    """The folder to write a result set into; it becomes the current version when the block ends well,
    and goes when it does not. ``info`` is stored in the manifest (it may be filled inside the block)."""
    if keep < 1:
        raise ValueError("at least the current version is kept")
    versions, info = _versions(out_dir), {} if info is None else info
    n = (manifests(spark, out_dir) or [0])[-1] + 1
    name = f"{n:012d}-{uuid.uuid4().hex[:8]}"
    folder = f"{versions}/{name}"
    try:
        yield folder
    except BaseException:
        io.delete(spark, folder)
        raise
    draft = f"{versions}/.{name}.json"
    io.write_text(spark, draft, json.dumps({"folder": name, "names": [x for x in _listing(spark, folder) if x[0] not in "._"],
                                            "info": info}))
    while not _claim(spark, draft, f"{versions}/{n:012d}.json"):
        n += 1
    _collect(spark, versions, keep)


def _collect(spark: SparkSession, versions: str, keep: int) -> None:
    """Delete versions beyond the last ``keep``: manifests first, so nothing points to a half-deleted folder; then
    folders that no manifest names, but for those begun at or after the oldest kept number (another
    writer may be at work)."""
    names = _listing(spark, versions)
    kept = [n for n in names if n.endswith(".json") and n[0] != "."][-keep:]
    named = {json.loads(text)["folder"] for n in kept if (text := io.read_text(spark, f"{versions}/{n}")) is not None}
    oldest = int(kept[0][:-5])
    for n in names:
        if n.endswith(".json") and n[0] != "." and n not in kept:
            io.delete(spark, f"{versions}/{n}")
    for n in names:
        if not n.endswith(".json") and n not in named and int(n.split("-")[0]) < oldest:
            io.delete(spark, f"{versions}/{n}")


def publish_tables(spark: SparkSession, tables: dict[str, DataFrame], out_dir: str, fmt: str = "csv",
                   order_by: dict[str, list] | None = None, parallel: tuple[str, ...] = (), keep: int = KEEP) -> Snapshot:
    """:func:`write_tables` as one publication; returns what is current afterwards."""
    with publishing(spark, out_dir, keep) as folder:
        io.write_tables(tables, folder, fmt, order_by, parallel)
    return Snapshot(spark, out_dir)
