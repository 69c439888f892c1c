"""Rows given as dicts, against a schema: parse() before writing, load() after reading."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from ..errors import SchemaError
from ..schema import DatasetSchema, Field

_PYTHON = {"int": int, "long": int, "string": str, "bool": bool, "float": float, "double": float}
_LIMITS = {"int": 1 << 31, "long": 1 << 63}
_FLOAT_MAX = 3.4028235677973366e38


def _fail(path: str, what: str) -> SchemaError:
    return SchemaError(f"Error at path {path}: {what}")


def _plain(f: Field, value: Any, path: str) -> Any:
    """Numbers keep to their range; a bool is no number, and an int no float."""
    kind = _PYTHON[f.kind]
    if not isinstance(value, kind) or kind is int and isinstance(value, bool):
        raise _fail(path, f"expected {f.kind}, got {type(value).__name__}")
    if kind is int and not -_LIMITS[f.kind] <= value < _LIMITS[f.kind]:
        raise _fail(path, f"{value} is out of range for {f.kind}")
    if f.kind == "float" and abs(value) >= _FLOAT_MAX and abs(value) != float("inf"):
        raise _fail(path, f"{value} is out of range for float")
    return kind(value)


def _join(path: str, name: str) -> str:
    return f"{path}.{name}" if path else name


class _Parser:
    def __init__(self, with_objects: bool):
        self.with_objects = with_objects

    def keeps(self, f: Field) -> bool:
        return self.with_objects or f.kind != "object" and (f.kind != "array" or self.keeps(f.element))

    def record(self, fields: tuple[Field, ...], value: Any, path: str) -> dict[str, Any]:
        if not isinstance(value, Mapping):
            raise _fail(path, f"expected a record, got {type(value).__name__}")
        wanted = {f.name: f for f in fields}
        missing = [n for n, f in wanted.items() if f.required and n not in value]
        if missing:
            raise _fail(path, f"Example missing keys {missing}")
        if extra := [n for n in value if n not in wanted]:
            raise _fail(path, f"Example has keys that the schema lacks: {extra}")
        return {n: self.value(f, value.get(n), _join(path, n)) for n, f in wanted.items() if self.keeps(f)}

    def value(self, f: Field, value: Any, path: str) -> Any:
        if value is None:
            if f.required:
                raise _fail(path, "null in a required field")
            return None
        if f.kind == "record":
            return self.record(f.fields, value, path)
        if f.kind == "array":
            if not isinstance(value, list):
                raise _fail(path, f"expected a list, got {type(value).__name__}")
            return [self.value(f.element, x, f"{path}.elem[{i}]") for i, x in enumerate(value)]
        if f.kind == "object":
            if not isinstance(value, f.codec.object_type()):
                raise _fail(path, f"expected {f.codec.object_type().__name__}, got {type(value).__name__}")
            try:
                return f.codec.encode(value)
            except SchemaError as e:
                raise _fail(path, str(e)) from e
        return _plain(f, value, path)


def parse(row: Mapping[str, Any], schema: DatasetSchema, with_objects: bool = True) -> dict[str, Any]:
    """A new dict in schema order: checked, objects encoded, unset optional keys null. with_objects=False leaves objects out."""
    return _Parser(with_objects).record(schema.fields, row, "")


def load(row: Any, schema: DatasetSchema) -> dict[str, Any]:
    """The inverse: objects decoded. Keys that the schema lacks are ignored, absent ones skipped; a record may be a list of pairs."""
    return _load_record(schema.fields, row, "")


def _load_record(fields: tuple[Field, ...], value: Any, path: str) -> dict[str, Any]:
    if isinstance(value, list):
        value = dict(value)
    if not isinstance(value, Mapping):
        raise _fail(path, f"expected a record, got {type(value).__name__}")
    return {f.name: _load_value(f, value[f.name], _join(path, f.name)) for f in fields if f.name in value}


def _load_value(f: Field, value: Any, path: str) -> Any:
    if value is None:
        if f.required:
            raise _fail(path, "null in a required field")
        return None
    if f.kind == "record":
        return _load_record(f.fields, value, path)
    if f.kind == "array":
        if not isinstance(value, list):
            raise _fail(path, f"expected a list, got {type(value).__name__}")
        return [_load_value(f.element, x, f"{path}.elem[{i}]") for i, x in enumerate(value)]
    if f.kind == "object":
        if not isinstance(value, (bytes, bytearray)):
            raise _fail(path, f"expected bytes, got {type(value).__name__}")
        return f.codec.decode(bytes(value))
    return _plain(f, value, path)
