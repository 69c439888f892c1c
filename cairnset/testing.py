"""Stand-ins for users' tests: an object store that is a local folder, and a tracker that remembers."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from .layout import bucket_key
from .plans.publish import Tracker
from .sources.storage import LocalStorage


class FolderObjectStore(LocalStorage):
    """s3a://bucket/key is the file root/bucket/key. `broken`: paths whose use fails, for tests of failures."""

    def __init__(self, root: str):
        self.root, self.broken, self.fetched = root.rstrip("/"), set(), []

    def local(self, path: str) -> str:
        if path in self.broken:
            raise OSError(f"{path} can't be reached")
        bucket, key = bucket_key(path)
        return f"{self.root}/{bucket}/{key}"

    def fetch_file(self, path: str, local: str) -> None:
        self.fetched.append(path)
        super().fetch_file(path, local)


class MemoryTracker(Tracker):
    def __init__(self):
        self.logged: list[tuple[str, str, dict[str, Any]]] = []

    def log(self, name: str, reference: str, metadata: Mapping[str, Any]) -> None:
        self.logged.append((name, reference, dict(metadata)))
