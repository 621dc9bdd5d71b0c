"""A versioned index at a path. A change writes only the rows it adds and the ids of chunks that they replace.

A version is a folder and a manifest line, written last, that names the parts each table consists of. A reader takes
the newest manifest: rows of a part count unless a later version took their chunk away. Versions are never written
twice: one whose manifest is missing was given up, and its folder is free. Parts are merged once there are too many.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.errors import IndexError_

KEY = "chunk_id"
#: Parts of a table after which a change rewrites it as one.
MOST_PARTS = 12


def manifest(spark: SparkSession, path: str) -> dict | None:
    """The newest manifest, or None if there's no index at the path."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/_manifest")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    row = spark.read.schema("version int, manifest string").json(f"{path}/_manifest").orderBy(F.col("version").desc()).first()
    return None if row is None else json.loads(row["manifest"])


def _table(spark: SparkSession, path: str, found: dict, name: str) -> DataFrame:
    """A table as its parts, without what later versions took away."""
    parts = []
    for version in found["parts"][name]:
        df = spark.read.parquet(f"{path}/v{version}/{name}")
        later = [spark.read.parquet(f"{path}/v{g}/gone") for g in found["gone"] if g > version]
        parts.append(df.join(reduce(DataFrame.unionByName, later), KEY, "left_anti") if later else df)
    return reduce(DataFrame.unionByName, parts)


def load(spark: SparkSession, path: str) -> tuple[int, dict[str, DataFrame]]:
    """(version, tables) of the newest version; a part that lost rows is an error."""
    found = manifest(spark, path)
    if found is None:
        raise IndexError_(f"no index at {path}")
    for part, n in found["counts"].items():
        try:
            have = spark.read.parquet(f"{path}/{part}").count()
        except Exception as e:
            raise IndexError_(f"{part} can't be read") from e
        if have != n:
            raise IndexError_(f"{part} holds {have} rows, its manifest says {n}")
    return found["version"], {name: _table(spark, path, found, name) for name in found["parts"]}


def commit(spark: SparkSession, path: str, added: dict[str, DataFrame], gone: DataFrame | None = None, stream: tuple[str, int] | None = None) -> int:
    """Writes a version: rows to add, by table, and ids (chunk_id) of earlier rows that they replace or that go.

    stream: the name of a stream and the number of its batch, so that a batch that is run again is known.
    """
    old = manifest(spark, path) or {"version": 0, "parts": {}, "gone": [], "counts": {}, "streams": {}}
    version = old["version"] + 1
    new = {"version": version, "parts": {n: list(p) for n, p in old["parts"].items()}, "gone": list(old["gone"]), "counts": dict(old["counts"]), "streams": dict(old["streams"])}

    def write(df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{path}/v{version}/{name}")
        new["counts"][f"v{version}/{name}"] = spark.read.parquet(f"{path}/v{version}/{name}").count()

    if gone is not None and old["version"]:
        write(gone.select(KEY).distinct(), "gone")
        new["gone"].append(version)
    whole = any(len(p) >= MOST_PARTS for p in old["parts"].values())
    for name in {**old["parts"], **added}:
        if whole and name in old["parts"]:
            kept = _table(spark, path, new | {"parts": old["parts"]}, name)
            write(kept.unionByName(added[name]) if name in added else kept, name)
            new["parts"][name] = [version]
        elif name in added:
            write(added[name], name)
            new["parts"].setdefault(name, []).append(version)
    if whole:
        used = {f"v{v}/{n}" for n, p in new["parts"].items() for v in p}
        new["gone"], new["counts"] = [], {k: v for k, v in new["counts"].items() if k in used}
    if stream:
        new["streams"][stream[0]] = stream[1]
    spark.createDataFrame([(version, json.dumps(new))], "version int, manifest string").coalesce(1).write.mode("append").json(f"{path}/_manifest")
    return version


def last_batch(spark: SparkSession, path: str, stream: str) -> int:
    """The number of the last batch of a stream that the index holds; -1 for none."""
    return (manifest(spark, path) or {"streams": {}})["streams"].get(stream, -1)
