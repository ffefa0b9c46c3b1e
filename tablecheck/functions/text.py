"""Text and nested-value rewrites: namespace qualification and secret redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The destination schema inserted between database and table names,
# the redaction markers, and the key fragments that mark a configuration secret.
TARGET_SCHEMA = "AIRBYTE_SCHEMA"
NAMESPACE_RE = r"(?i)\b(FROM|JOIN)\s+([A-Za-z_][A-Za-z0-9_]*)\.([A-Za-z_][A-Za-z0-9_]*)"
REDACTED = "[REDACTED]"
CONFIGURED = "[configured]"
SECRET_KEY_PARTS = ("password", "secret", "token", "access_key", "client_id")


def qualify_namespace(sql: Column, schema: str = TARGET_SCHEMA) -> Column:
    """``FROM a.b`` / ``JOIN a.b`` (any case, any run of blanks) to ``FROM a.<schema>.b``."""
    return F.regexp_replace(sql, NAMESPACE_RE, rf"$1 $2.{schema}.$3")


def redact_literals(text: Column, secrets: Column) -> Column:
    """Replace every non-empty secret of the array, in order, by ``[REDACTED]``."""
    return F.aggregate(secrets, text, lambda acc, s: F.when(F.coalesce(F.length(s), F.lit(0)) > 0,
                                                            F.replace(acc, s, F.lit(REDACTED))).otherwise(acc))


def secret_key(name: str) -> bool:
    low = name.lower()
    return any(part in low for part in SECRET_KEY_PARTS)


def redact_by_key(c: Column, dtype: T.DataType) -> Column:
    """Replace values under secret-looking keys by ``[configured]``, recursively.

    Struct fields are walked from the schema on the driver; map entries are
    checked per key with ``transform_values``; arrays are mapped element-wise.
    A redacted value becomes the string marker, so a redacted struct field is a
    string, and so are all values of a map: text as it is, the others as JSON.
    """
    if isinstance(dtype, T.StructType):
        fields = []
        for f in dtype.fields:
            if secret_key(f.name):
                fields.append(F.when(c.isNotNull(), F.lit(CONFIGURED)).alias(f.name))
            else:
                fields.append(redact_by_key(c[f.name], f.dataType).alias(f.name))
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.MapType):
        def value(k, v):
            inner = redact_by_key(v, dtype.valueType)
            hit = F.lit(False)
            for part in SECRET_KEY_PARTS:
                hit = hit | F.lower(k.cast("string")).contains(part)
            if isinstance(dtype.valueType, (T.StructType, T.MapType, T.ArrayType)):
                inner = F.to_json(inner)
            return F.when(hit, F.lit(CONFIGURED)).otherwise(inner.cast("string"))
        return F.transform_values(c, value)
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: redact_by_key(x, dtype.elementType))
    return c
