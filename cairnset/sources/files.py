"""Small files and folders of any store, through Hadoop's file systems; blob bytes through Arrow's."""

from __future__ import annotations

import os
import re
import uuid
from typing import Any

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str) -> tuple[Any, Any]:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _at(spark, path)
    return system.exists(target)


def delete(spark: SparkSession, path: str) -> None:
    system, target = _at(spark, path)
    system.delete(target, True)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    system, target = _at(spark, path)
    out = system.create(target, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def read_bytes(spark: SparkSession, path: str) -> bytes:
    system, target = _at(spark, path)
    stream = system.open(target)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode())


def read_text(spark: SparkSession, path: str) -> str:
    return read_bytes(spark, path).decode()


def rename(spark: SparkSession, source: str, target: str) -> None:
    system, old = _at(spark, source)
    _, new = _at(spark, target)
    system.mkdirs(new.getParent())
    if not system.rename(old, new):
        raise OSError(f"can't rename {source} to {target}")


def children(spark: SparkSession, path: str) -> list[str]:
    system, target = _at(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(target)) if system.exists(target) else []


def total_bytes(spark: SparkSession, path: str) -> int:
    system, target = _at(spark, path)
    return system.getContentSummary(target).getLength()


def publish_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file as a whole; of several writers of the same path one wins, and none sees a part."""
    own = f"{path}.{uuid.uuid4().hex}"
    write_text(spark, own, text)
    try:
        rename(spark, own, path)
    except OSError:
        if not exists(spark, path):
            raise
        delete(spark, own)


#: Settings of Hadoop's object store client and what Arrow calls them.
S3_OPTIONS = {
    "fs.s3a.access.key": "access_key",
    "fs.s3a.secret.key": "secret_key",
    "fs.s3a.session.token": "session_token",
    "fs.s3a.endpoint.region": "region",
    "fs.s3a.endpoint": "endpoint_override",
}


def _seconds(text: str) -> float:
    """Hadoop's durations: milliseconds, or a number with a unit."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*(ms|s|m|h)?\s*", text).groups()
    return int(number) * {None: 0.001, "ms": 0.001, "s": 1, "m": 60, "h": 3600}[unit]


def arrow_options(spark: SparkSession, path: str) -> dict[str, Any]:
    """What arrow_store() needs on executors to reach a path as Hadoop does: read from the session's settings on the driver."""
    if not re.match("s3[an]?://", path):
        return {}
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out: dict[str, Any] = {own: value for name, own in S3_OPTIONS.items() if (value := conf.get(name))}
    if conf.get("fs.s3a.connection.ssl.enabled") == "false":
        out["scheme"] = "http"
    for name, own in (("fs.s3a.connection.establish.timeout", "connect_timeout"), ("fs.s3a.connection.timeout", "request_timeout")):
        if value := conf.get(name):
            out[own] = _seconds(value)
    if "AnonymousAWSCredentialsProvider" in (conf.get("fs.s3a.aws.credentials.provider") or ""):
        out["anonymous"] = True
    if value := conf.get("fs.s3a.attempts.maximum"):
        out["attempts"] = int(value)
    return out


def arrow_store(path: str, options: dict[str, Any] | None = None) -> tuple[Any, str]:
    """Arrow's file system and the path in it, for use on executors: of all paths that Hadoop takes, relative and bare ones too."""
    from pyarrow import fs

    if found := re.fullmatch(r"s3[an]?://(.+)", path, re.S):
        own = dict(options or {})
        if attempts := own.pop("attempts", None):
            own["retry_strategy"] = fs.AwsStandardS3RetryStrategy(max_attempts=attempts)
        return fs.S3FileSystem(**own), found[1].rstrip("/")
    if found := re.fullmatch(r"file:(?://(?:localhost)?)?(/.*)", path, re.S):
        return fs.LocalFileSystem(), found[1]
    if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)
