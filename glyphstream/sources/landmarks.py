"""Landmark tables and evaluation logs in files, told apart by their headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COORDINATES = [f"p{i}_{axis}" for i in range(21) for axis in ("x", "y")]
EVAL_COLUMNS = ["person", "condition", "expected", "committed", "correct"]


def landmark_schema(person: bool = True) -> T.StructType:
    keys = ["label", "person"] if person else ["label"]
    return T.StructType([T.StructField(k, T.StringType()) for k in keys] + [T.StructField(c, T.DoubleType()) for c in COORDINATES])


def eval_schema(person: bool = True) -> T.StructType:
    return T.StructType([T.StructField(c, T.BooleanType() if c == "correct" else T.StringType()) for c in EVAL_COLUMNS[0 if person else 1 :]])


def read_header(spark: SparkSession, path: str) -> list[str]:
    """The columns that a CSV's first line names; [] for an empty file."""
    line = spark.read.text(path).first()
    return line[0].split(",") if line else []


def has_person(spark: SparkSession, path: str, current: T.StructType, legacy: T.StructType) -> bool:
    """Which of two known schemas a file has; anything else is refused."""
    header = read_header(spark, path)
    if header not in (current.fieldNames(), legacy.fieldNames()):
        raise ValueError(f"unknown columns in {path}: {header[:4]}...")
    return header == current.fieldNames()


def _read(spark: SparkSession, path: str, current: T.StructType, legacy: T.StructType) -> DataFrame:
    known = has_person(spark, path, current, legacy)
    rows = spark.read.csv(path, schema=current if known else legacy, header=True, enforceSchema=False, mode="FAILFAST")
    return rows if known else rows.withColumn("person", F.lit("unknown")).select(*current.fieldNames())


def read_landmarks(spark: SparkSession, path: str) -> DataFrame:
    """label, person and 42 coordinates; rows of files without persons are 'unknown'."""
    return _read(spark, path, landmark_schema(), landmark_schema(False))


def read_eval_log(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, eval_schema(), eval_schema(False))


def append(rows: DataFrame, path: str) -> None:
    """Append to a CSV folder whose columns must be those of rows; a new folder takes any."""
    spark = rows.sparkSession
    try:
        header = read_header(spark, path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        header = []
    if header and header != rows.columns:
        raise ValueError(f"columns of {path} differ: {header[:4]}...")
    rows.write.mode("append").csv(path, header=True)


def migrate(rows: DataFrame, folder: str, version: str, dry_run: bool = False) -> str:
    """Write rows as a new version of a table and keep the older ones; does nothing if the version is there or on a dry run.

    A version is there once its write was committed: what a broken write left is written again.
    """
    path = f"{folder}/{version}"
    spark = rows.sparkSession
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    done = marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)
    if not dry_run and not done:
        rows.write.mode("overwrite").parquet(path)
    return path


def with_landmarks(rows: DataFrame) -> DataFrame:
    """The 42 coordinates as the array of points that the operators take."""
    points = [F.struct(F.col(f"p{i}_x").alias("x"), F.col(f"p{i}_y").alias("y")) for i in range(21)]
    return rows.withColumn("landmarks", F.array(*points)).drop(*COORDINATES)


def stream_frames(spark: SparkSession, source: str, schema: str, kind: str = "json", **options) -> DataFrame:
    """Frames as a stream: files that land in a folder (json, parquet or csv), or the JSON values of a Kafka topic.

    For Kafka, source is the topic and options hold kafka.bootstrap.servers;
    the connector's package must be on the session's class path.
    """
    if kind == "kafka":
        raw = spark.readStream.format("kafka").options(subscribe=source, **options).load()
        return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("v")).select("v.*")
    if kind not in ("json", "parquet", "csv"):
        raise ValueError(f"unknown kind of source: {kind}")
    return spark.readStream.schema(schema).format(kind).options(**options).load(source)
