"""Exports of matches: folders of part files by default, one file only where the format needs it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import excel


def write_csv(rows: DataFrame, path: str, single: bool = False) -> bool:
    """False, and no file, for empty input."""
    if rows.isEmpty():
        return False
    (rows.coalesce(1) if single else rows).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')
    return True


def write_json(rows: DataFrame, path: str) -> bool:
    rows.write.mode("overwrite").json(path)
    return True


def json_arrays(rows: DataFrame, record: Column, key: str, parts: int) -> DataFrame:
    """value: the lines of a JSON array a part, to be written as text. Each holds one record, so no row grows with the table."""
    w = Window.partitionBy("_part").orderBy(key)
    # both ends over one window, so that rows are shuffled once
    ends = rows.withColumn("_part", F.pmod(F.hash(key), F.lit(parts))).withColumns({"_opens": F.row_number().over(w) == 1, "_closes": F.lead(F.lit(1)).over(w).isNull()})
    return ends.select(F.concat(F.when(F.col("_opens"), "[").otherwise(""), record, F.when(F.col("_closes"), "]").otherwise(",")).alias("value"))


def write_xlsx(rows: DataFrame, path: str, title: str = "Результаты сопоставления", most: int = 1_048_575) -> bool:
    """One workbook; rows come to the driver a partition at a time. The format holds ``most`` rows at most,
    and more raise ValueError."""
    if rows.isEmpty():
        return False
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"a sheet holds {most} rows; export CSV or JSON instead")
    put_bytes(rows.sparkSession, path, excel.workbook(rows.columns, (tuple(r) for r in rows.toLocalIterator()), title))
    return True


def put_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(data)
    finally:
        out.close()


def export(rows: DataFrame, path: str, file_format: str) -> bool:
    writers = {"csv": write_csv, "json": write_json, "xlsx": write_xlsx}
    if file_format not in writers:
        raise ValueError(f"unknown format: {file_format}")
    return writers[file_format](rows, path)


def result_documents(flat: DataFrame) -> DataFrame:
    """One JSON text a match: percentages with two places, retrieval scores with four."""
    return flat.select(F.to_json(F.struct(*flat.columns)).alias("value"))
