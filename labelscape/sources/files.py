"""Listing files through Spark's own file systems, so that a loader's folder may lie wherever Spark can read."""

from __future__ import annotations

from pyspark.sql import SparkSession


def listed(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """Full paths of what matches the pattern below the folder, sorted by name; none if the folder is absent."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{str(folder).rstrip('/')}/{pattern}")
    found = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(path)
    return sorted(status.getPath().toString() for status in found or [])


def exists(spark: SparkSession, path: str) -> bool:
    folder, _, name = str(path).rstrip("/").rpartition("/")
    return bool(listed(spark, folder or ".", name))


def below(spark: SparkSession, folder: str, name: str) -> list[str]:
    """Files of that name in the folder or anywhere below it; none if the folder is absent."""
    path = spark._jvm.org.apache.hadoop.fs.Path(str(folder).rstrip("/"))
    system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not system.exists(path):
        return []
    found, walk = [], system.listFiles(path, True)
    while walk.hasNext():
        status = walk.next()
        if status.getPath().getName() == name:
            found.append(status.getPath().toString())
    return sorted(found)


def only(spark: SparkSession, folder: str, pattern: str) -> str:
    """The one path that matches; none or several are an error."""
    found = listed(spark, folder, pattern)
    if len(found) == 1:
        return found[0]
    if found:
        raise FileExistsError(f"{folder}/{pattern} is ambiguous: {', '.join(p.rpartition('/')[2] for p in found[:5])}")
    raise FileNotFoundError(f"nothing at {folder}/{pattern}")
