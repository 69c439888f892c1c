"""Two kinds of failure: of a schema or of rows against it, and of a dataset as a whole."""


class SchemaError(Exception):
    """A malformed schema, or a row or DataFrame that doesn't fit its schema."""


class DatasetError(Exception):
    """A dataset that would break its own rules: repeated keys, an existing version, a missing part."""
