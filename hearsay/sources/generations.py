"""Tables whose files were written under several schemas.

    <root>/generation=<n>/part-*.parquet

Each generation keeps the schema it was written with. A read finds the schemas in the footers,
folds them into one and reads the generations of equal schemas in one scan each; what a generation
lacks is NULL in its rows. No file is rewritten.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import (
    ArrayType, ByteType, DataType, DecimalType, DoubleType, FloatType, IntegerType, LongType,
    MapType, NullType, ShortType, StringType, StructField, StructType,
)

_WHOLE = (ByteType, ShortType, IntegerType, LongType)
_DIGITS = {ByteType: 3, ShortType: 5, IntegerType: 10, LongType: 19}


def wider(a: DataType, b: DataType) -> DataType:
    """The smallest type that holds all values of both; text where there is none.

    Whole numbers and decimals widen exactly; a float next to another number is a double (exact
    up to 2**53); structs are merged field by field, arrays and maps by their parts.
    """
    if a == b or isinstance(b, NullType):
        return a
    if isinstance(a, NullType):
        return b
    if isinstance(a, _WHOLE) and isinstance(b, _WHOLE):
        return max(a, b, key=lambda t: _WHOLE.index(type(t)))
    numbers = (*_WHOLE, DecimalType, FloatType, DoubleType)
    if isinstance(a, numbers) and isinstance(b, numbers):
        if isinstance(a, (FloatType, DoubleType)) or isinstance(b, (FloatType, DoubleType)):
            return DoubleType()
        (p, s), (q, t) = ((x.precision, x.scale) if isinstance(x, DecimalType)
                          else (_DIGITS[type(x)], 0) for x in (a, b))
        whole, scale = max(p - s, q - t), max(s, t)
        return DecimalType(whole + scale, scale) if whole + scale <= 38 else StringType()
    if isinstance(a, StructType) and isinstance(b, StructType):
        return merged_schema(a, b)
    if isinstance(a, ArrayType) and isinstance(b, ArrayType):
        return ArrayType(wider(a.elementType, b.elementType))
    if isinstance(a, MapType) and isinstance(b, MapType):
        return MapType(wider(a.keyType, b.keyType), wider(a.valueType, b.valueType))
    return StringType()


def merged_schema(a: StructType, b: StructType) -> StructType:
    """Columns of both, those of ``a`` first, each of the wider type; all may be NULL."""
    later = {f.name: f.dataType for f in b}
    known = {f.name for f in a}
    return StructType([
        StructField(f.name, wider(f.dataType, later.get(f.name, f.dataType))) for f in a
    ] + [StructField(f.name, f.dataType) for f in b if f.name not in known])


def _as(column, have: DataType, want: DataType):
    """A value of the type ``have`` as ``want``; nested values become JSON where text is wanted."""
    if have == want:
        return column
    if isinstance(want, StringType) and isinstance(have, (StructType, ArrayType, MapType)):
        return F.to_json(column)
    if isinstance(want, StructType) and isinstance(have, StructType):
        fields = {f.name: f.dataType for f in have}
        parts = [(_as(column.getField(f.name), fields[f.name], f.dataType) if f.name in fields
                  else F.lit(None)).cast(f.dataType).alias(f.name) for f in want]
        return F.when(column.isNotNull(), F.struct(*parts))
    if isinstance(want, ArrayType) and isinstance(have, ArrayType):
        return F.transform(column, lambda x: _as(x, have.elementType, want.elementType))
    return column.cast(want)


def _folders(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    found = [(int(n.partition("=")[2]), f"{root}/{n}") for n in names
             if n.startswith("generation=") and n.partition("=")[2].isdigit()
             and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS"))]
    return sorted(found)


def write_generation(rows: DataFrame, root: str) -> int:
    """Rows as the next generation, under whatever schema they have; its number. A column cannot
    be called ``generation``, the name that the read gives the number."""
    if "generation" in rows.columns:
        raise ValueError("a column is called generation")
    known = _folders(rows.sparkSession, root)
    number = known[-1][0] + 1 if known else 0
    # What a writer left that died half way is replaced.
    rows.write.mode("overwrite").parquet(f"{root}/generation={number}")
    return number


def read_generations(spark: SparkSession, root: str) -> DataFrame:
    """All finished generations under one schema, with their number as ``generation``. As many
    scans as there are different schemas; columns and filters are pushed into each. Files of one
    generation may differ in their columns, not in a column's type."""
    by_schema: dict[str, tuple[StructType, list[str]]] = {}
    for _, path in _folders(spark, root):
        schema = spark.read.option("mergeSchema", True).parquet(path).schema
        by_schema.setdefault(schema.json(), (schema, []))[1].append(path)
    if not by_schema:
        raise FileNotFoundError(f"no finished generation in {root}")
    whole = reduce(merged_schema, (schema for schema, _ in by_schema.values()), StructType())
    parts = []
    for schema, paths in by_schema.values():
        have = {f.name: f.dataType for f in schema}
        rows = spark.read.option("basePath", root).schema(
            StructType([*schema.fields, StructField("generation", LongType())])).parquet(*paths)
        parts.append(rows.select(*[
            (_as(F.col(f"`{f.name}`"), have[f.name], f.dataType) if f.name in have
             else F.lit(None).cast(f.dataType)).alias(f.name) for f in whole], "generation"))
    return reduce(DataFrame.unionByName, parts)
