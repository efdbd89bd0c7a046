from __future__ import annotations

from data import QC, qc_rows

from brineframe.operators.cleaning import Box, drop_qc, filter_box
from brineframe.streaming.cleaning import clean_files, clean_rows

SCHEMA = QC + ", longitude float, latitude float, temp float, psal float, pres float"


def test_row_filters_on_a_stream(spark, tmp_path):
    rows = [(*r, float(k), 1.0, 1.0, 1.0, None if r[0] == "S9" else 1.0) for k, r in enumerate(qc_rows())]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    box = Box(0, 5, 0, 5)
    query = clean_rows(stream, box).writeStream.format("memory").queryName("cleaned").trigger(availableNow=True).start()
    query.awaitTermination()
    batch = filter_box(drop_qc(spark.read.parquet(str(tmp_path / "in"))), box)
    assert sorted(map(tuple, spark.table("cleaned").collect()), key=repr) == sorted(map(tuple, batch.collect()), key=repr)


def test_files_are_cleaned_as_they_arrive(spark, tmp_path):
    rows = [(*r, 1.0, 1.0, 1.0, 1.0, None if r[0] == "S9" else 1.0) for r in qc_rows()]
    for part in range(2):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        clean_files(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == 6 * (part + 1)


