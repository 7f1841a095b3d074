"""Tables as files."""

from __future__ import annotations

import csv as csv_module
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumisift.operators.partitioning import to_do


def embeddings(rows: DataFrame, path: str, mode: str = "append") -> None:
    rows.write.mode(mode).parquet(path)


def json_lines(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).option("ignoreNullFields", False).json(path)


def as_object(rows: DataFrame, key: str) -> DataFrame:
    """One row, json: an object with an entry for each key. For exports that one reader is to hold; tables stay rows otherwise."""
    fields = [c for c in rows.columns if c != key]
    value = F.struct(*fields) if len(fields) != 1 else F.col(fields[0])
    own = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(key).alias("key"), value.alias("value")))))
    return rows.agg(F.to_json(own, {"ignoreNullFields": "false", "pretty": "true"}).alias("json"))


def json_object(rows: DataFrame, key: str, path: str) -> None:
    as_object(rows, key).coalesce(1).write.mode("overwrite").text(path)


def csv(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).option("header", True).option("escape", '"').option("quote", '"').option("emptyValue", "").csv(path)


def append_new(rows: DataFrame, done: DataFrame, path: str, key: str = "query_id") -> None:
    """Writes what is not there yet, as new files: nothing is rewritten."""
    to_do(rows, done, key).write.mode("append").parquet(path)


def csv_to(rows: DataFrame, out=None) -> None:
    """Header and rows as CSV on a stream, standard output by default; rows come to the driver one partition at a time."""
    writer = csv_module.writer(out or sys.stdout, lineterminator="\n")
    writer.writerow(rows.columns)
    for row in rows.toLocalIterator():
        writer.writerow(["" if v is None else v for v in row])


def crawled(rows: DataFrame, path: str, images: DataFrame | None = None) -> None:
    """Crawled records as JSON lines under records/, and the bytes of their images(id, content) under images/, which is where `id` finds them again."""
    rows.write.mode("append").option("ignoreNullFields", False).json(f"{path}/records")
    if images is not None:
        images.select("id", "content").where("content is not null").write.mode("append").parquet(f"{path}/images")
