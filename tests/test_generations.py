import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DecimalType, DoubleType, FloatType, IntegerType, LongType, StringType,
)

from hearsay.sources import generations as G


def test_generations_are_read_under_one_schema(spark, tmp_path, rows):
    root = str(tmp_path / "t")
    make = spark.createDataFrame
    assert G.write_generation(make([(1, 2, ("x", 1), [1])],
                                   "id int, n int, s struct<a: string, b: int>, l array<int>"),
                              root) == 0
    assert G.write_generation(make([("k", 3.5, None, None)],
                                   "id string, n double, s struct<b: bigint, c: string>, "
                                   "l array<bigint>"), root) == 1
    assert G.write_generation(make([(5, (None, 7), "new", [9, None])],
                                   "id int, s struct<a: string, b: int>, `a.b` string, "
                                   "l array<int>"), root) == 2
    got = G.read_generations(spark, root)
    assert dict(got.dtypes) == {
        "id": "string", "n": "double", "s": "struct<a:string,b:bigint,c:string>",
        "l": "array<bigint>", "a.b": "string", "generation": "bigint"}
    assert rows(got.select("generation", "id", "n", "l", F.to_json("s"), "`a.b`")) == [
        (0, "1", 2.0, [1], '{"a":"x","b":1}', None), (1, "k", 3.5, None, None, None),
        (2, "5", None, [9, None], '{"b":7}', "new")]


def test_equal_schemas_are_one_scan_with_pruned_columns(spark, tmp_path):
    root = str(tmp_path / "t")
    for n in range(3):
        G.write_generation(spark.range(5).select("id", F.lit(n).alias("v")), root)
    G.write_generation(spark.range(5).select("id", F.lit("x").alias("w")), root)
    got = G.read_generations(spark, root)
    plan = got.where("id > 2 and generation > 0").select("id")._jdf.queryExecution()\
        .executedPlan().toString()
    assert plan.count("FileScan") == 2 and plan.count("ReadSchema: struct<id:bigint>") == 2
    assert plan.count("GreaterThan(id,2)") == 2 and plan.count("PartitionFilters: [isnotnull") == 2
    assert got.where("generation = 1").count() == 5


def test_unfinished_and_missing_generations(spark, tmp_path):
    root = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        G.read_generations(spark, root)
    G.write_generation(spark.range(3), root)
    # A writer died: files, but no mark that they are whole.
    spark.range(9).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(
        f"{root}/generation=1")
    assert G.read_generations(spark, root).count() == 3
    assert G.write_generation(spark.range(4), root) == 1
    assert G.read_generations(spark, root).count() == 7
    with pytest.raises(ValueError):
        G.write_generation(spark.range(1).withColumn("generation", F.lit(1)), root)


def test_wider():
    assert G.wider(IntegerType(), LongType()) == LongType()
    assert G.wider(FloatType(), IntegerType()) == DoubleType()
    assert G.wider(DecimalType(10, 2), LongType()) == DecimalType(21, 2)
    assert G.wider(DecimalType(38, 20), LongType()) == StringType()
    assert G.wider(StringType(), LongType()) == StringType()
