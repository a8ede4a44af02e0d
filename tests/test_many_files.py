"""Work that must be spread: files for each speaker, and unit rows that reach Python in small batches."""

import pyarrow as pa
from pyspark.sql import functions as F

from voxrill.operators.search import Search


def test_result_files_are_written_by_many_tasks(spark, monkeypatch):
    from voxrill.plans import fit_queries as FQ

    seen = []
    keep = FQ._written

    def noting(spark, name, write):
        path = keep(spark, name, write)
        names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_extract("path", r"part-(\d+)-", 1).alias("task"))
        seen.append(names.distinct().count())
        return path

    monkeypatch.setattr(FQ, "_written", noting)
    assert FQ.result_join(spark, "/root/testdata/sf0.01").count() == 100
    assert seen[0] > 1


def test_unit_rows_reach_python_in_small_batches(spark):
    phone = F.struct(F.lit(1).cast("long").alias("u"), *[F.rand(i).alias(f"z{i}") for i in (1, 2, 3)])
    units = spark.range(4000, numPartitions=1).select(F.lit(0).alias("fold"), F.lit(1).alias("sex"), F.array_repeat(phone, 200).alias("phones"))
    Search(units, spark.createDataFrame([(0, 0.5, 0.3, 0.2)], "cand long, w1 double, w2 double, w3 double"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["bytes"])

    assert units.mapInArrow(sizes, "bytes long").agg(F.max("bytes")).first()[0] < 2 * 8 * 2**20
