"""Declared schemas: fields, primary keys, their Spark types, and their Avro-compatible JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

from . import codecs
from .codecs import BytesCodec, Codec, NumpyCodec
from .errors import SchemaError

# Fixed values of the stored format.
JSON_VERSION = 2
PRIMARY_KEYS = "_primary_keys"
AVRO = {"int": "int", "long": "long", "string": "string", "bool": "boolean", "float": "float", "double": "double"}
KEY_KINDS = ("int", "long", "string", "bool")

SPARK = {"int": T.IntegerType(), "long": T.LongType(), "string": T.StringType(), "bool": T.BooleanType(), "float": T.FloatType(), "double": T.DoubleType(), "object": T.BinaryType()}
_NAME = re.compile(r"[a-zA-Z][0-9a-zA-Z_]*")
#: The tag that says what bytes hold. Older files put a prefix of small letters and digits into its name.
_METATYPE = re.compile(r"_(?:[a-z0-9]+_)?metatype")
#: Names in a field's JSON that are not users' tags, beside those that begin with an underscore.
_RESERVED = ("name", "type", "fields", "items")


@dataclass(frozen=True)
class Field:
    """One field. kind: a key of SPARK, "record" (with fields) or "array" (with element). blob: values go to blob files."""

    kind: str
    name: str
    description: str = ""
    required: bool = True
    fields: tuple[Field, ...] = ()
    element: Field | None = None
    codec: Codec | None = None
    blob: bool = field(default=False, compare=False)
    tags: dict[str, Any] = field(default_factory=dict, hash=False)

    def __post_init__(self):
        if not _NAME.fullmatch(self.name):
            raise ValueError(f"a field's name starts with a letter and has letters, digits and underscores only: {self.name!r}")
        if bad := [t for t in self.tags if t in _RESERVED or t.startswith("_")]:
            raise ValueError(f"{self.name}: the schema's own names can't be tags: {bad}")
        if self.kind == "record" and any(f.blob for f in self.fields):
            raise SchemaError(f"{self.name}: a record can't hold blob fields")
        if self.kind == "array" and self.element.blob:
            raise SchemaError(f"{self.name}: an array can't hold blob elements; declare the element with blob=False")
        if self.kind == "object" and not self.codec.name:
            raise SchemaError(f"{self.name}: its codec has no name")

    def spark_type(self) -> T.DataType:
        if self.kind == "record":
            return T.StructType([f.spark_field() for f in self.fields])
        if self.kind == "array":
            return T.ArrayType(self.element.spark_type(), containsNull=not self.element.required)
        return SPARK[self.kind]

    def spark_field(self) -> T.StructField:
        about = {"comment": self.description} if self.description else {}
        return T.StructField(self.name, self.spark_type(), not self.required, about | ({"codec": self.codec.name, "blob": self.blob} if self.codec else {}))

    def to_avro(self) -> dict[str, Any]:
        if self.kind == "array":
            inner = self.element.to_avro()
            inner["items"], inner["type"] = inner["type"], "array"
            return {"name": self.name, "type": self._nullable(inner)}
        own: Any = AVRO.get(self.kind, "bytes")
        if self.kind == "record":
            own = {"type": "record", "name": self.name, "fields": [f.to_avro() for f in self.fields]}
        out = {"name": self.name, "type": self._nullable(own), "_description": self.description, **self.tags}
        if self.codec:
            out |= {"_metatype": "object", "_codec_name": self.codec.name, "_codec_params": json.dumps(self.codec.params()), "_is_heavy_pointer": self.blob}
        return out

    def _nullable(self, own: Any) -> Any:
        return own if self.required else ["null", own]


def _plain(kind: str):
    def make(name: str, description: str = "", required: bool = True, tags: dict[str, Any] | None = None) -> Field:
        return Field(kind, name, description, required, tags=tags or {})

    make.__doc__ = f"A field of type {kind}."
    return make


IntField, LongField, StringField = _plain("int"), _plain("long"), _plain("string")
BoolField, FloatField, DoubleField = _plain("bool"), _plain("float"), _plain("double")


def RecordField(name: str, fields: Sequence[Field], description: str = "", required: bool = True, tags: dict[str, Any] | None = None) -> Field:
    return Field("record", name, description, required, fields=tuple(fields), tags=tags or {})


def ArrayField(element: Field, required: bool = True) -> Field:
    """An array named as its element."""
    return Field("array", element.name, "", required, element=element)


def ObjectField(name: str, codec: Codec, description: str = "", required: bool = True, blob: bool = True, tags: dict[str, Any] | None = None) -> Field:
    return Field("object", name, description, required, codec=codec, blob=blob, tags=tags or {})


def NumpyField(name: str, shape: Sequence[int] | None, dtype: str, description: str = "", required: bool = True, blob: bool = True, tags: dict[str, Any] | None = None) -> Field:
    return ObjectField(name, NumpyCodec(shape, dtype), description, required, blob, tags)


def BytesField(name: str, description: str = "", required: bool = True, blob: bool = True, tags: dict[str, Any] | None = None) -> Field:
    return ObjectField(name, BytesCodec(), description, required, blob, tags)


class SchemaVisitor:
    """A walk over fields: an extension overrides the methods of the kinds it treats apart; results of inner fields are passed on.

    visit() calls the method named as the field's kind (int, long, string, bool, float, double, object, record or array).
    """

    def visit(self, f: Field) -> Any:
        inner = [self.visit(g) for g in f.fields] if f.kind == "record" else [self.visit(f.element)] if f.kind == "array" else []
        return getattr(self, f.kind, self.other)(f, inner)

    def other(self, f: Field, inner: list[Any]) -> Any:
        """Of kinds without a method."""
        raise SchemaError(f"{type(self).__name__} has no method for {f.kind} fields")

    def visit_schema(self, schema: DatasetSchema) -> list[Any]:
        return [self.visit(f) for f in schema.fields]


class DatasetSchema:
    """Ordered top-level fields and the primary key's columns."""

    def __init__(self, fields: Sequence[Field], primary_keys: Sequence[str], allow_no_keys: bool = False):
        self.fields, self.primary_keys = tuple(fields), tuple(primary_keys)
        self.by_name = {f.name: f for f in self.fields}
        if len(self.by_name) != len(self.fields):
            raise SchemaError("two fields have the same name")
        if not self.primary_keys and not allow_no_keys:
            raise SchemaError("a dataset needs at least one primary key")
        for name in self.primary_keys:
            f = self.by_name.get(name)
            if f is None:
                raise SchemaError(f"primary key {name!r} is not a field")
            if f.kind not in KEY_KINDS:
                raise SchemaError(f"primary key {name!r} is of type {f.kind}; keys are of type {', '.join(KEY_KINDS)}")
            if not f.required:
                raise SchemaError(f"primary key {name!r} must be required")

    def __eq__(self, other: object) -> bool:
        return isinstance(other, DatasetSchema) and (self.fields, self.primary_keys) == (other.fields, other.primary_keys)

    __hash__ = None

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def blob_columns(self) -> list[str]:
        return [f.name for f in self.fields if f.blob]

    @property
    def plain_columns(self) -> list[str]:
        return [f.name for f in self.fields if not f.blob]

    def column(self, name: str) -> Field | None:
        return self.by_name.get(name)

    def struct(self) -> T.StructType:
        return T.StructType([f.spark_field() for f in self.fields])

    @classmethod
    def from_struct(cls, struct: T.StructType, primary_keys: Sequence[str], blobs: Sequence[str] = ()) -> DatasetSchema:
        """A schema for an existing DataFrame; its keys become required."""
        fields = [_from_spark(f.name, f.dataType, f.nullable, f.name in blobs) for f in struct]
        return cls([replace(f, required=True) if f.name in primary_keys else f for f in fields], primary_keys)


def loose(t: T.DataType) -> T.DataType:
    """The type without metadata, and nullable throughout, as Parquet gives it back."""
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, loose(f.dataType)) for f in t])
    return T.ArrayType(loose(t.elementType)) if isinstance(t, T.ArrayType) else t


def _from_spark(name: str, kind: T.DataType, nullable: bool, blob: bool = False) -> Field:
    if isinstance(kind, T.StructType):
        return RecordField(name, [_from_spark(f.name, f.dataType, f.nullable) for f in kind], required=not nullable)
    if isinstance(kind, T.ArrayType):
        return ArrayField(_from_spark(name, kind.elementType, kind.containsNull), required=not nullable)
    if isinstance(kind, T.BinaryType):
        return BytesField(name, required=not nullable, blob=blob)
    for own, spark in SPARK.items():
        if type(spark) is type(kind):
            return Field(own, name, required=not nullable)
    raise SchemaError(f"{name}: no field type holds {kind.simpleString()}")


def dumps(schema: DatasetSchema, pretty: bool = True) -> str:
    top = RecordField("fields", [replace(f, blob=False) for f in schema.fields]).to_avro()
    top["type"]["fields"] = [f.to_avro() for f in schema.fields]
    top |= top["type"] | {PRIMARY_KEYS: json.dumps(list(schema.primary_keys)), "_json_version": JSON_VERSION}
    return json.dumps(top, sort_keys=True, indent=4) if pretty else json.dumps(top)


def loads(text: str, raw: bool = False) -> DatasetSchema:
    """raw: objects stay bytes, and codecs needn't be registered."""
    try:
        data = json.loads(text)
    except json.JSONDecodeError as e:
        raise SchemaError(f"not JSON: {text[:200]}") from e
    try:
        fields = [_from_avro(f, raw) for f in data["fields"]]
        return DatasetSchema(fields, json.loads(data.get(PRIMARY_KEYS, "[]")), allow_no_keys=True)
    except KeyError as e:
        raise SchemaError(f"the schema's JSON lacks {e}") from e


def _from_avro(data: dict[str, Any], raw: bool) -> Field:
    kind, required = data["type"], True
    if isinstance(kind, list):
        if len(kind) != 2 or kind[0] != "null":
            raise SchemaError(f"a union must be of null and one type: {kind}")
        kind, required = kind[1], False
    if isinstance(kind, dict) and kind["type"] == "array":
        return ArrayField(_from_avro(kind | {"type": kind["items"]}, raw), required=required)
    tags = {k: v for k, v in data.items() if k not in _RESERVED and not k.startswith("_")}
    common = {"name": data["name"], "description": data.get("_description", ""), "required": required, "tags": tags}
    if isinstance(kind, dict) and kind["type"] == "record":
        return RecordField(fields=[_from_avro(f, raw) for f in kind["fields"]], **common)
    for own, avro in AVRO.items():
        if kind == avro:
            return Field(own, **common)
    if kind != "bytes":
        raise SchemaError(f"unknown type: {kind}")
    # older schemas have metatypes of their own for arrays and bytes; without a flag, values are inline
    metatype = next((v for k, v in data.items() if _METATYPE.fullmatch(k)), None)
    blob = data.get("_is_heavy_pointer", False)
    if metatype == "object":
        return ObjectField(codec=codecs.find(data["_codec_name"], json.loads(data["_codec_params"]), raw), blob=blob, **common)
    if metatype == "numpy":
        return NumpyField(shape=data["_shape"], dtype=data["_dtype"], blob=blob, **common)
    if metatype == "bytes":
        return BytesField(blob=blob, **common)
    raise SchemaError(f"unknown metatype of a bytes field: {metatype}")
