"""Dataset ids and where a dataset's parts lie."""

from __future__ import annotations

import re
from dataclasses import dataclass

from .schema import DatasetSchema

# Fixed values of the stored layout.
BLOBS, TEMP, SCHEMA, ASSETS, SUCCESS = "__COLUMN_CONCATENATED_FILES__", "__TEMP_FILES__", "avro_schema.json", "assets", "_SUCCESS"


@dataclass(frozen=True)
class DatasetID:
    name: str
    version: str

    def __post_init__(self):
        if not re.fullmatch(r"[0-9a-zA-Z_]+", self.name):
            raise ValueError(f"a dataset's name has letters, digits and underscores only: {self.name!r}")
        if not re.fullmatch(r"[0-9]+\.[0-9]+\.[0-9]+", self.version):
            raise ValueError(f"a version is three numbers with dots: {self.version!r}")

    @classmethod
    def parse(cls, text: str) -> DatasetID:
        name, slash, version = text.partition("/")
        if not slash:
            raise ValueError(f"not name/version: {text!r}")
        return cls(name, version)

    def __str__(self) -> str:
        return f"{self.name}/{self.version}"


@dataclass(frozen=True)
class DatasetDefinition:
    id: DatasetID
    schema: DatasetSchema


@dataclass(frozen=True)
class Split:
    """One split (train, test, ...) of a dataset."""

    id: DatasetID
    name: str

    def __post_init__(self):
        check_split(self.name)


def check_split(name: str) -> str:
    if not re.fullmatch(r"[0-9a-zA-Z_.-]+", name or ""):
        raise ValueError(f"a split's name is part of a path: {name!r}")
    return name


@dataclass(frozen=True)
class Layout:
    """Paths under a root. trim, replacement: a prefix of each path that is replaced, for stores that are mounted."""

    root: str
    blobs_in_dataset: bool = False
    trim: str = ""
    replacement: str = ""

    def _path(self, *parts: str) -> str:
        path = "/".join([self.root.rstrip("/"), *parts])
        return self.replacement + path[len(self.trim) :] if self.trim and path.startswith(self.trim) else path

    def dataset(self, id: DatasetID) -> str:
        return self._path(id.name, id.version)

    def split(self, id: DatasetID, split: str) -> str:
        return self._path(id.name, id.version, f"{check_split(split)}.parquet")

    def schema(self, id: DatasetID) -> str:
        return self._path(id.name, id.version, SCHEMA)

    def assets(self, id: DatasetID) -> str:
        return self._path(id.name, id.version, ASSETS)

    def success(self, id: DatasetID) -> str:
        return self._path(id.name, id.version, SUCCESS)

    def blobs(self, dataset: str | None = None) -> str:
        if not self.blobs_in_dataset:
            return self._path(BLOBS)
        if dataset is None:
            raise ValueError("blob files lie in the dataset's folder, so its name is needed")
        return self._path(dataset, BLOBS)

    def temporary(self, id: DatasetID) -> str:
        return self._path(TEMP, id.name, id.version)


def bucket_key(path: str) -> tuple[str, str]:
    """(bucket, key) of an object store's path."""
    found = re.fullmatch(r"s3[an]?://([^/]+)/?(.*)", path, re.S)
    if not found:
        raise ValueError(f"not an object store's path: {path!r}")
    return found[1], found[2]
