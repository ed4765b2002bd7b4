"""Change images: JSON in which every value carries a type tag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postflow import schemas
from postflow.functions.keys import from_wire


def _tagged(kind: T.DataType) -> T.StructType:
    """Type of the tagged JSON that unwraps to ``kind``."""
    if isinstance(kind, T.StructType):
        inner = T.StructType([T.StructField(f.name, _tagged(f.dataType)) for f in kind.fields])
        return T.StructType([T.StructField("M", inner)])
    if isinstance(kind, T.ArrayType):
        return T.StructType([T.StructField("L", T.ArrayType(_tagged(kind.elementType)))])
    if isinstance(kind, T.BooleanType):
        return T.StructType([T.StructField("BOOL", T.BooleanType())])
    if isinstance(kind, (T.LongType, T.DoubleType)):
        return T.StructType([T.StructField("N", T.StringType())])
    return T.StructType([T.StructField("S", T.StringType())])


def _unwrap(col: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        inner = col["M"]
        fields = [_unwrap(inner[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(inner.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(col["L"], lambda e: _unwrap(e, kind.elementType))
    if isinstance(kind, T.BooleanType):
        return col["BOOL"]
    if isinstance(kind, (T.LongType, T.DoubleType)):
        return col["N"].try_cast(kind)
    return col["S"]


def repair_tags(image: Column) -> Column:
    """Some writers spell two of the tags differently."""
    fixed = F.replace(image, F.lit('"Bool"'), F.lit('"BOOL"'))
    return F.replace(fixed, F.lit('"Nul"'), F.lit('"NULL"'))


def decode_images(df: DataFrame, schema: T.StructType, image: str = "new_image") -> DataFrame:
    """Replaces column ``image`` (tagged JSON text) by the columns of ``schema``."""
    parsed = F.from_json(repair_tags(F.col(image)), T.StructType(_tagged(schema)["M"].dataType.fields))
    kept = [c for c in df.columns if c != image]
    values = [_unwrap(F.col("_image")[f.name], f.dataType).alias(f.name) for f in schema.fields]
    return df.withColumn("_image", parsed).select(*kept, *values)


def read_change_images(df: DataFrame, image: str = "new_image") -> DataFrame:
    """Exported change records to state rows, next to their ``event_name``."""
    rows = decode_images(df, schemas.IMAGE, image)
    return rows.withColumn("comprehend", from_wire(F.col("comprehend")))
