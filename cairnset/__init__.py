"""A Spark-native engine for versioned, schema-checked machine-learning datasets."""

from .codecs import BytesCodec, Codec, NumpyCodec
from .config import Client, Config, Download, Store
from .errors import DatasetError, SchemaError
from .layout import DatasetDefinition, DatasetID, Layout, Split
from .plans.metadata import KeyValueMetadata, MetadataStore, TableMetadata
from .plans.persist import Persistor, SparkPersistor, from_rdd, from_rows, persist
from .plans.publish import Tracker, publish
from .plans.staging import StagingWriter, commit, jobs, run_jobs, scan_sorted, stage
from .schema import (
    ArrayField,
    BoolField,
    BytesField,
    DatasetSchema,
    DoubleField,
    Field,
    FloatField,
    IntField,
    LongField,
    NumpyField,
    ObjectField,
    RecordField,
    SchemaVisitor,
    StringField,
    dumps,
    loads,
)
from .sources.dataset import Dataset, build_dataset
from .sources.storage import HadoopStorage, LocalStorage, Storage
from .streaming.staging import stage_stream

__all__ = [name for name in dir() if not name.startswith("_")]
