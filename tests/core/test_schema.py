import json

import numpy as np
import pytest

from cairnset import (
    ArrayField,
    BoolField,
    BytesField,
    Codec,
    DatasetSchema,
    DoubleField,
    FloatField,
    IntField,
    LongField,
    NumpyField,
    ObjectField,
    RecordField,
    SchemaError,
    StringField,
    dumps,
    loads,
)
from cairnset.codecs import NumpyCodec
from cairnset.operators.rows import load, parse


class VectorCodec(Codec):
    name = "test_vector"

    def __init__(self, compression_method=0):
        self.compression_method = compression_method

    def params(self):
        return {"compression_method": self.compression_method}

    def encode(self, obj):
        if not all(isinstance(x, int) for x in obj):
            raise SchemaError("integers only")
        return json.dumps(obj).encode()

    def decode(self, data):
        return json.loads(data)

    def object_type(self):
        return list


def driving() -> DatasetSchema:
    lidar = RecordField("lidar", [RecordField("info", [StringField("model"), DoubleField("error", "calibration", required=False)], "about it")], "points")
    fields = [IntField("label", "Label"), lidar, LongField("time"), FloatField("speed"), BoolField("qc", required=False), RecordField("more", [IntField("a"), IntField("b", required=False)], required=False), ArrayField(StringField("names", "some"))]
    return DatasetSchema(fields, ["time"])


ROW = {"label": 1, "lidar": {"info": {"model": "m"}}, "time": 12, "speed": 1.5, "names": ["x", "y"]}

GOLDEN = {
    "_description": "",
    "_json_version": 2,
    "_primary_keys": '["time"]',
    "name": "fields",
    "type": "record",
    "fields": [
        {"_description": "Label", "name": "label", "type": "int"},
        {
            "_description": "points",
            "name": "lidar",
            "type": {
                "name": "lidar",
                "type": "record",
                "fields": [
                    {
                        "_description": "about it",
                        "name": "info",
                        "type": {"name": "info", "type": "record", "fields": [{"_description": "", "name": "model", "type": "string"}, {"_description": "calibration", "name": "error", "type": ["null", "double"]}]},
                    }
                ],
            },
        },
        {"_description": "", "name": "time", "type": "long"},
        {"_description": "", "name": "speed", "type": "float"},
        {"_description": "", "name": "qc", "type": ["null", "boolean"]},
        {"_description": "", "name": "more", "type": ["null", {"name": "more", "type": "record", "fields": [{"_description": "", "name": "a", "type": "int"}, {"_description": "", "name": "b", "type": ["null", "int"]}]}]},
        {"name": "names", "type": {"_description": "some", "items": "string", "name": "names", "type": "array"}},
    ],
}


def test_json_is_the_stored_format():
    assert json.loads(dumps(driving())) == GOLDEN
    assert dumps(driving()) == json.dumps(GOLDEN, sort_keys=True, indent=4)
    assert loads(json.dumps(GOLDEN)) == driving()
    assert loads(dumps(driving(), pretty=False)) == driving()


@pytest.mark.parametrize("text", ["{", "{}", '{"fields": [{"name": "a", "type": "date"}]}', '{"fields": [{"name": "a", "type": "bytes", "_metatype": "x"}]}'])
def test_bad_json(text):
    with pytest.raises(SchemaError):
        loads(text)


def test_old_tags():
    old = {"fields": [{"name": "a", "_description": "", "type": "bytes", "_x_metatype": "numpy", "_shape": [4, 4], "_dtype": "float64"}, {"name": "b", "_description": "", "type": ["null", "bytes"], "_x_metatype": "bytes"}]}
    schema = loads(json.dumps(old))
    assert schema.fields == (NumpyField("a", (4, 4), "float64"), BytesField("b", required=False))
    assert schema.blob_columns == [] and schema.primary_keys == ()


def test_object_fields_round_trip():
    schema = DatasetSchema([ObjectField("v", VectorCodec(12), required=False), StringField("id"), NumpyField("n", None, "int8", blob=False)], ["id"])
    again = loads(dumps(schema))
    assert again == schema and again.column("v").codec.compression_method == 12 and again.blob_columns == ["v"]
    raw = loads(dumps(schema), raw=True)
    assert dumps(raw) == dumps(schema)
    text = dumps(schema).replace("test_vector", "unheard_of")
    with pytest.raises(SchemaError, match="unheard_of"):
        loads(text)
    assert dumps(loads(text, raw=True)) == text
    with pytest.raises(KeyError):
        type("Again", (VectorCodec,), {"name": "test_vector"})


@pytest.mark.parametrize("name", ["with-dash", "1a", "", "a b"])
def test_field_names(name):
    with pytest.raises(ValueError):
        IntField(name)
    assert IntField("a").name == "a"


@pytest.mark.parametrize("fields, keys", [([IntField("a")], []), ([IntField("a")], ["b"]), ([IntField("a", required=False)], ["a"]), ([FloatField("a")], ["a"]), ([DoubleField("a")], ["a"]), ([RecordField("a", [IntField("b")])], ["a"]), ([IntField("a"), IntField("a")], ["a"])])
def test_key_rules(fields, keys):
    with pytest.raises(SchemaError):
        DatasetSchema(fields, keys)


def test_blobs_only_at_the_top():
    with pytest.raises(SchemaError):
        RecordField("r", [BytesField("b")])
    with pytest.raises(SchemaError):
        ArrayField(BytesField("b"))
    assert ArrayField(BytesField("b", blob=False)).element.codec.name == "bytes"


def test_parse_fills_and_copies():
    row = {**ROW, "lidar": {"info": {"model": "m"}}}
    out = parse(row, driving())
    assert out == {"label": 1, "lidar": {"info": {"model": "m", "error": None}}, "time": 12, "speed": 1.5, "qc": None, "more": None, "names": ["x", "y"]}
    assert row == ROW and list(out) == driving().names


def changed(**kw):
    return {**ROW, **kw}


@pytest.mark.parametrize(
    "row, message",
    [
        ({k: v for k, v in ROW.items() if k != "label"}, "Error at path : Example missing keys"),
        (changed(label="1"), "Error at path label:"),
        (changed(label=True), "Error at path label:"),
        (changed(label=1 << 31), "Error at path label:"),
        (changed(time=1 << 63), "Error at path time:"),
        (changed(qc=1), "Error at path qc:"),
        (changed(speed=1), "Error at path speed:"),
        (changed(speed=1e300), "Error at path speed:"),
        (changed(lidar={"info": {"model": "m", "error": "x"}}), "Error at path lidar.info.error:"),
        (changed(lidar={"info": {"model": 5}}), "Error at path lidar.info.model:"),
        (changed(lidar="x"), "Error at path lidar:"),
        (changed(lidar={}), "Error at path lidar: Example missing keys"),
        (changed(names="x"), "Error at path names:"),
        (changed(names=["x", 5]), r"Error at path names.elem\[1\]:"),
        (changed(names=[None]), r"Error at path names.elem\[0\]:"),
        (changed(extra=1), "Error at path : Example has keys"),
        (changed(label=None), "Error at path label: null"),
    ],
)
def test_parse_failures(row, message):
    with pytest.raises(SchemaError, match=message):
        parse(row, driving())


def test_numbers():
    assert parse(changed(speed=np.float64(2.5)), driving())["speed"] == 2.5


def test_load():
    assert load({"label": 5, "unknown": 1}, driving()) == {"label": 5}
    assert load({"lidar": [("info", [("model", "m")])]}, driving()) == {"lidar": {"info": {"model": "m"}}}
    with pytest.raises(SchemaError, match="Error at path label"):
        load({"label": None}, driving())


def test_objects_in_rows():
    schema = DatasetSchema([ObjectField("v", VectorCodec(), required=False), StringField("id")], ["id"])
    assert load(parse({"id": "a", "v": [1, 2]}, schema), schema) == {"id": "a", "v": [1, 2]}
    assert parse({"id": "a"}, schema)["v"] is None
    assert parse({"id": "a", "v": [1]}, schema, with_objects=False) == {"id": "a"}
    for bad in ("x", ["x"]):
        with pytest.raises(SchemaError, match="Error at path v"):
            parse({"id": "a", "v": bad}, schema)


@pytest.mark.parametrize("shape, array, good", [(None, np.zeros(10), True), ((-1, -1), np.zeros((5, 4)), True), ((4, 4), np.eye(4), True), ((4, 4), np.zeros((5, 4)), False), ((-1, -1), np.zeros(10), False), (None, np.zeros(3, "float32"), False)])
def test_numpy_codec(shape, array, good):
    codec = NumpyCodec(shape, "float64")
    if good:
        assert (codec.decode(codec.encode(array)) == array).all()
    else:
        with pytest.raises(SchemaError):
            codec.encode(array)


def test_bad_dtype():
    with pytest.raises(SchemaError):
        NumpyCodec(None, "no such type")


def test_struct_round_trip():
    schema = DatasetSchema([LongField("k"), StringField("s", required=False), ArrayField(IntField("xs"), required=False)], ["k"])
    assert DatasetSchema.from_struct(schema.struct(), ["k"]) == schema
