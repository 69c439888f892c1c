"""Whole files and bytes of a store: what an extension for another kind of store implements, and the store of Hadoop's file systems."""

from __future__ import annotations

import os
import shutil
from abc import ABC, abstractmethod

from pyspark.sql import SparkSession

from . import files
from .cache import FileCache


class Storage(ABC):
    """Paths are whole: scheme, bucket and key, or a local path."""

    @abstractmethod
    def exists(self, path: str) -> bool: ...

    @abstractmethod
    def read_bytes(self, path: str) -> bytes: ...

    @abstractmethod
    def write_bytes(self, path: str, data: bytes) -> None: ...

    @abstractmethod
    def put_file(self, local: str, path: str) -> None: ...

    @abstractmethod
    def fetch_file(self, path: str, local: str) -> None: ...

    def cached(self, path: str, folder: str, timeout: float = 300.0) -> str:
        """A local copy; processes of this machine that ask for it fetch it once. No folder: the path itself, for mounted stores."""
        return FileCache(folder, timeout).get(path, lambda to: self.fetch_file(path, to)) if folder else path


class HadoopStorage(Storage):
    """Any store that the session's Hadoop settings reach; for the driver."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def exists(self, path: str) -> bool:
        return files.exists(self.spark, path)

    def read_bytes(self, path: str) -> bytes:
        return files.read_bytes(self.spark, path)

    def write_bytes(self, path: str, data: bytes) -> None:
        files.write_bytes(self.spark, path, data)

    def put_file(self, local: str, path: str) -> None:
        system, target = files._at(self.spark, path)
        system.copyFromLocalFile(False, True, self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{os.path.abspath(local)}"), target)

    def fetch_file(self, path: str, local: str) -> None:
        system, source = files._at(self.spark, path)
        os.makedirs(os.path.dirname(os.path.abspath(local)), exist_ok=True)
        # raw, so that no checksum file is left beside it
        system.copyToLocalFile(False, source, self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{os.path.abspath(local)}"), True)


class LocalStorage(Storage):
    """Folders of this machine, or mounted ones."""

    def local(self, path: str) -> str:
        return path.removeprefix("file://")

    def exists(self, path: str) -> bool:
        return os.path.exists(self.local(path))

    def read_bytes(self, path: str) -> bytes:
        with open(self.local(path), "rb") as f:
            return f.read()

    def write_bytes(self, path: str, data: bytes) -> None:
        os.makedirs(os.path.dirname(self.local(path)), exist_ok=True)
        with open(self.local(path), "wb") as f:
            f.write(data)

    def put_file(self, local: str, path: str) -> None:
        os.makedirs(os.path.dirname(self.local(path)), exist_ok=True)
        shutil.copyfile(local, self.local(path))

    def fetch_file(self, path: str, local: str) -> None:
        os.makedirs(os.path.dirname(os.path.abspath(local)), exist_ok=True)
        shutil.copyfile(self.local(path), local)
