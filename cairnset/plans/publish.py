"""Announcing a version to a registry or an experiment tracker."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Mapping
from typing import Any

from ..errors import DatasetError
from ..layout import DatasetID, Layout
from ..sources.files import exists


class Tracker(ABC):
    """What an extension for a tracker implements; credentials are its own matter."""

    @abstractmethod
    def log(self, name: str, reference: str, metadata: Mapping[str, Any]) -> None:
        """Note a dataset under a name, by the path of its assets."""


def publish(spark: Any, id: DatasetID, layout: Layout, tracker: Tracker, metadata: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """Log a written version; what was logged. The version and its path are part of the metadata."""
    if not exists(spark, layout.success(id)):
        raise DatasetError(f"{id} is not a finished version")
    reference = layout.assets(id)
    told = {**(metadata or {}), "version": id.version, "uri": reference}
    tracker.log(f"{id.name}_{id.version}", reference, told)
    return told
