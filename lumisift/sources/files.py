"""Files as tables, through Spark's readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from lumisift.functions import text as S

IMAGE_NAME = r"(?i)\.(jpg|jpeg|png)$"


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """id, path, length, content of the images in a folder; id is the name without its extension. Content is read only if it is used."""
    found = spark.read.format("binaryFile").load(folder).where(F.col("path").rlike(IMAGE_NAME))
    return found.select(S.stem(F.substring_index("path", "/", -1)).alias("id"), "path", "length", "content")


def file_sizes(images: DataFrame) -> DataFrame:
    return images.select("id", (F.col("length") / 1024).alias("kb"))


def decoded(images: DataFrame, decode=None) -> DataFrame:
    """Images whose content can be decoded, with height and width; the others are dropped."""
    from lumisift.functions import pixels

    return images.withColumn("shape", pixels.image_shape(F.col("content"), decode or pixels.decode)).where("shape.height is not null")


def images(spark: SparkSession, folder: str) -> DataFrame:
    """id, path, height, width, channels and data of the JPEG and PNG images in a folder, by Spark's own decoder; files that can't be decoded are left out."""
    found = spark.read.format("image").option("dropInvalid", True).load(folder).select("image.*").where(F.col("origin").rlike(IMAGE_NAME))
    return found.select(S.stem(F.substring_index("origin", "/", -1)).alias("id"), F.col("origin").alias("path"), "height", "width", F.col("nChannels").alias("channels"), "data")


def images_by_name(images: DataFrame, names: DataFrame) -> DataFrame:
    """images of names(name): a path, or a name with or without extension; by id, unknown ones are left out."""
    wanted = names.select(S.stem(F.substring_index("name", "/", -1)).alias("id")).distinct()
    return images.join(wanted, "id")


def embeddings(spark: SparkSession, path: str, id_column: str = "id") -> DataFrame:
    """id and embedding, nulls left out; an empty table is an error."""
    found = spark.read.parquet(path).select(F.col(id_column).alias("id"), "embedding").where("embedding is not null")
    if found.isEmpty():
        raise ValueError(f"no embeddings in {path}")
    return found


def by_ids(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """rows of the ids that exist; each once, however often it is asked for."""
    return rows.join(ids.select(key).distinct(), key)


def json_object(spark: SparkSession, path: str, kind: str, key: str = "key") -> DataFrame:
    """One JSON object of objects as rows: key and the fields of kind, a struct type. For a file that one task can hold."""
    read = spark.read.text(path, wholetext=True)
    rows = read.select(F.explode(F.from_json("value", f"map<string,{kind}>")).alias(key, "v"))
    return rows.select(key, "v.*") if kind.startswith("struct") else rows


def json_list(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"array<{kind}>")).alias("v")).select("v.*")


def json_folder(spark: SparkSession, folder: str, kind: str, required: str | None = None, key: str = "file_key") -> DataFrame:
    """One JSON document a file; key is the name before its first dot. Files that can't be read as kind, or lack the required field, are left out."""
    read = spark.read.text(folder, wholetext=True).select(F.substring_index("_metadata.file_name", ".", 1).alias(key), F.from_json("value", kind).alias("v"))
    if kind.startswith("struct"):
        kept = read.where(F.col(f"v.{required}").isNotNull()) if required else read.where("v is not null")
        return kept.select(key, "v.*")
    return read.where("v is not null")


def tolerant(read, spark: SparkSession, schema: str) -> DataFrame:
    """What read() gives, or an empty table if the path doesn't exist."""
    try:
        return read()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Header, quoted cells that may hold commas, doubled quotes and line ends; an empty cell of a string is ''. See inferred_csv for types from the data."""
    read = spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"', quote='"', enforceSchema=False)
    return read.na.fill("")


def inferred_csv(spark: SparkSession, path: str) -> DataFrame:
    """The same with types found from the data, by one more scan; an empty cell is null."""
    return spark.read.csv(path, header=True, inferSchema=True, multiLine=True, escape='"', quote='"')


def templates(spark: SparkSession, folder: str) -> dict[str, str]:
    """Name without extension, and text, of every .j2 file below a folder: a driver's dictionary of small files."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.j2").text(folder, wholetext=True).select("_metadata.file_name", "value").collect()
    return {r.file_name.rsplit(".", 1)[0]: r.value for r in rows}
