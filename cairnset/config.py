"""Configuration: a JSON file named by CAIRNSET_CONFIG, overridden by spark.cairnset.* settings. Read when asked for."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from .layout import Layout


@dataclass(frozen=True)
class Store:
    """A root of datasets."""

    root: str
    blobs_in_dataset: bool = False
    trim: str = ""
    replacement: str = ""

    def layout(self) -> Layout:
        return Layout(self.root, self.blobs_in_dataset, self.trim, self.replacement)


@dataclass(frozen=True)
class Client:
    """Of the object store: 0 and "" leave a setting as it is. Hadoop's client and the executors' Arrow client both follow it."""

    region: str = ""
    connections: int = 0
    read_timeout: float = 0
    connect_timeout: float = 0
    attempts: int = 0

    def apply(self, spark: SparkSession) -> None:
        """Into the session's Hadoop settings."""
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        found = {
            "fs.s3a.endpoint.region": self.region,
            "fs.s3a.connection.maximum": self.connections,
            "fs.s3a.connection.timeout": f"{int(self.read_timeout * 1000)}ms" if self.read_timeout else "",
            "fs.s3a.connection.establish.timeout": f"{int(self.connect_timeout * 1000)}ms" if self.connect_timeout else "",
            "fs.s3a.attempts.maximum": self.attempts,
        }
        for name, value in found.items():
            if value:
                conf.set(name, str(value))


@dataclass(frozen=True)
class Download:
    """Of whole files into a local cache."""

    folder: str = ""
    attempts: int = 3
    timeout: float = 300.0


@dataclass(frozen=True)
class Config:
    object_store: Store | None = None
    filesystems: dict[str, Store] = field(default_factory=dict)
    client: Client = Client()
    download: Download = Download()
    raw: dict = field(default_factory=dict)  # the whole file, for extensions' own sections, such as a tracker's

    @classmethod
    def from_dict(cls, data: dict) -> Config:
        """{"object_store": {"root": ...}, "filesystems": {name: {"root": ...}}, "client": {...}, "download": {...}, ...}"""
        store = data.get("object_store")
        stores = {name: Store(**s) for name, s in data.get("filesystems", {}).items()}
        return cls(Store(**store) if store else None, stores, Client(**data.get("client", {})), Download(**data.get("download", {})), data)

    def section(self, name: str) -> dict:
        if name not in self.raw:
            raise ValueError(f"the configuration has no section {name!r}")
        return self.raw[name]

    @classmethod
    def load(cls, spark: SparkSession | None = None, path: str | None = None) -> Config:
        path = path or os.environ.get("CAIRNSET_CONFIG") or os.path.expanduser("~/.cairnset.json")
        data = {}
        if os.path.exists(path):
            with open(path) as f:
                data = json.load(f)
        if spark is not None and (root := spark.conf.get("spark.cairnset.objectStore.root", None)):
            data["object_store"] = data.get("object_store", {}) | {"root": root}
        return cls.from_dict(data)

    def store(self, kind: str, name: str = "") -> Store:
        """kind: object_store or filesystem; name: of the filesystem."""
        if kind == "object_store":
            if self.object_store is None:
                raise ValueError("the configuration names no object store")
            return self.object_store
        if kind != "filesystem":
            raise ValueError(f"unknown kind of store {kind!r}: object_store or filesystem")
        if name not in self.filesystems:
            raise ValueError(f"the configuration has no filesystem named {name!r}")
        return self.filesystems[name]
