"""Codecs turn objects into bytes and back. A subclass with a name registers itself."""

from __future__ import annotations

import io
import re
from abc import ABC, abstractmethod
from typing import Any

import numpy as np

from .errors import SchemaError

REGISTRY: dict[str, type[Codec]] = {}


class Codec(ABC):
    """Subclasses set `name`, which must be unique, and the methods below."""

    name: str = ""

    def __init_subclass__(cls, **kwargs: Any):
        super().__init_subclass__(**kwargs)
        if cls.name:
            if cls.name in REGISTRY:
                raise KeyError(f"there is a codec named {cls.name!r} already")
            REGISTRY[cls.name] = cls

    def params(self) -> dict[str, Any]:
        """What the schema stores of this codec, as JSON."""
        return {}

    @classmethod
    def from_params(cls, params: dict[str, Any]) -> Codec:
        return cls(**params)

    @abstractmethod
    def encode(self, obj: Any) -> bytes:
        """Check the object and encode it."""

    @abstractmethod
    def decode(self, data: bytes) -> Any:
        """The inverse of encode()."""

    def object_type(self) -> type:
        return object

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Codec) and self.name == other.name and self.params() == other.params()

    def __hash__(self) -> int:
        return hash(self.name)


class BytesCodec(Codec):
    name = "bytes"

    def encode(self, obj: bytes) -> bytes:
        if not isinstance(obj, bytes):
            raise SchemaError(f"expected bytes, got {type(obj).__name__}")
        return obj

    def decode(self, data: bytes) -> bytes:
        return data

    def object_type(self) -> type:
        return bytes


class NumpyCodec(Codec):
    """Arrays as .npy bytes. shape: None for any; -1 for any size of one dimension."""

    name = "numpy"

    def __init__(self, shape: tuple[int, ...] | list[int] | None, dtype: str):
        self.shape = None if shape is None else tuple(shape)
        try:
            self.dtype = np.dtype(dtype)
        except TypeError as e:
            raise SchemaError(f"numpy doesn't know the dtype {dtype!r}") from e

    def params(self) -> dict[str, Any]:
        return {"shape": None if self.shape is None else list(self.shape), "dtype": str(self.dtype)}

    def fits(self, shape: tuple[int, ...]) -> bool:
        return self.shape is None or len(shape) == len(self.shape) and all(want in (-1, have) for want, have in zip(self.shape, shape))

    def encode(self, obj: np.ndarray) -> bytes:
        if obj.dtype != self.dtype:
            raise SchemaError(f"expected an array of {self.dtype}, got {obj.dtype}")
        if not self.fits(obj.shape):
            raise SchemaError(f"expected an array of shape {self.shape}, got {obj.shape}")
        out = io.BytesIO()
        np.save(out, obj, allow_pickle=False)
        return out.getvalue()

    def decode(self, data: bytes) -> np.ndarray:
        return np.load(io.BytesIO(data), allow_pickle=False)

    def object_type(self) -> type:
        return np.ndarray


class RawCodec(Codec):
    """Stands for any codec where objects stay bytes; keeps what the schema stored of it."""

    def __init__(self, name: str, params: dict[str, Any]):
        self.name, self._params = name, params

    def params(self) -> dict[str, Any]:
        return self._params

    def encode(self, obj: bytes) -> bytes:
        return obj

    def decode(self, data: bytes) -> bytes:
        return data

    def object_type(self) -> type:
        return bytes


def find(name: str, params: dict[str, Any], raw: bool = False) -> Codec:
    """The codec that a schema names. Older schemas prefix the built-in array codec's name."""
    if raw:
        return RawCodec(name, params)
    known = REGISTRY.get(name)
    if known is None and re.fullmatch("[a-z0-9]+_numpy", name) and params.keys() == {"shape", "dtype"}:
        known = NumpyCodec
    if known is None and re.fullmatch("[a-z0-9]+_bytes", name) and not params:
        known = BytesCodec
    if known is None:
        raise SchemaError(f"no codec named {name!r} is registered; define a subclass of Codec with that name, or read objects as bytes")
    return known.from_params(params)
