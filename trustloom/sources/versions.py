"""Tables that are replaced as a whole: all or nothing, readers follow the last version, old ones stay readable.

Each version writes its tables to places that nothing has used, and then commits one manifest file that names them. The file's number is the
version, and it is created only if it is absent: two writers can't commit the same one, and what isn't in a manifest was never
written as far as readers know. This needs a file system whose create-if-absent is atomic (HDFS, local folders).
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_LOG = "_versions"


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was to become."""


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, base: str) -> list[int]:
    """The numbers of the committed versions, in order."""
    fs, log = _fs(spark, f"{base}/{_LOG}")
    if not fs.exists(log):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(log)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())


def manifest(spark: SparkSession, base: str, version: int | None = None) -> dict | None:
    """A version's manifest (the last one's by default); a file that its writer left unfinished counts as none."""
    known = versions(spark, base)
    for v in [version] if version is not None else reversed(known):
        if v in known:
            fs, at = _fs(spark, f"{base}/{_LOG}/{v:020d}.json")
            stream = fs.open(at)
            try:
                text = bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
            finally:
                stream.close()
            if text.endswith("\n"):
                return json.loads(text) | {"version": v}
    return None


def replace_tables(tables: dict[str, DataFrame], base: str, expected: int | None = None) -> int:
    """Write all tables, then commit them as one version; its number. If writing fails, nothing has changed for readers.

    expected: the version that this one is to follow; Conflict if another one has been committed since. Without it the last writer wins.
    """
    spark = next(iter(tables.values())).sparkSession
    base = base.rstrip("/")
    places = {}
    for name, df in tables.items():
        places[name] = {"path": f"{base}/{name}-{uuid.uuid4().hex}", "schema": df.schema.json()}
        df.write.mode("errorifexists").parquet(places[name]["path"])
    body = (json.dumps({"tables": places}) + "\n").encode()
    while True:
        last = max(versions(spark, base), default=0)
        if expected is not None and last != expected:
            raise Conflict(f"version {last} is there, {expected} was expected")
        fs, at = _fs(spark, f"{base}/{_LOG}/{last + 1:020d}.json")
        try:
            out = fs.create(at, False)
        except Py4JJavaError:
            if not fs.exists(at):
                raise
            continue  # another writer was faster
        out.write(bytearray(body))
        out.close()
        return last + 1


def read_tables(spark: SparkSession, base: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of a version, the last one by default."""
    from pyspark.sql.types import StructType

    found = manifest(spark, base.rstrip("/"), version)
    if found is None:
        raise FileNotFoundError(f"no version {version or ''} of {base}")
    return {n: spark.read.schema(StructType.fromJson(json.loads(t["schema"]))).parquet(t["path"]) for n, t in found["tables"].items()}


def forget(spark: SparkSession, base: str, keep: int = 2) -> int:
    """Delete what only versions before the last `keep` name; how many versions went. Their readers must have ended."""
    base = base.rstrip("/")
    known = versions(spark, base)
    old = known[: max(0, len(known) - keep)]
    kept = {t["path"] for v in known[len(old) :] if (m := manifest(spark, base, v)) for t in m["tables"].values()}
    for v in old:
        for t in (manifest(spark, base, v) or {"tables": {}})["tables"].values():
            if t["path"] not in kept:
                fs, at = _fs(spark, t["path"])
                fs.delete(at, True)
        fs, at = _fs(spark, f"{base}/{_LOG}/{v:020d}.json")
        fs.delete(at, False)
    return len(old)
