"""Readers and writers of line-wise records: lenient, strict and collecting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import emotion_vector


class ManifestError(ValueError):
    def __init__(self, line: int, reason: str):
        super().__init__(f"line {line}: {reason}")
        self.line, self.reason = line, reason


def read_lenient(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON-lines file; blank and broken lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_collecting(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records, and in ``_broken`` the text of lines that are none."""
    kept = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return spark.read.schema(T.StructType([*kept.fields, T.StructField("_broken", T.StringType())])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)


def write_replacing(records: DataFrame, path: str) -> None:
    """Written aside, then put in the old table's place, which is kept as ``.old`` until the new one stands.

    Between the two renames a reader finds no table; a crash there leaves both whole beside each other, and
    ``recover_replaced`` puts the newer one in place.
    """
    spark = records.sparkSession
    records.write.mode("overwrite").json(f"{path}.tmp")
    fs, at = _files(spark, path)
    if fs.exists(at(path)):
        fs.delete(at(f"{path}.old"), True)
        fs.rename(at(path), at(f"{path}.old"))
    fs.rename(at(f"{path}.tmp"), at(path))
    fs.delete(at(f"{path}.old"), True)


def recover_replaced(spark: SparkSession, path: str) -> None:
    """After a crash in ``write_replacing``: if the table is gone, the whole new one or else the old one takes its place."""
    fs, at = _files(spark, path)
    for kept in (f"{path}.tmp", f"{path}.old"):
        if not fs.exists(at(path)) and fs.exists(at(f"{kept}/_SUCCESS")):
            fs.rename(at(kept), at(path))


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


#: Keys that a task may have.
TASK_KEYS = ("text", "text_file", "voice", "output", "emotion_audio", "emotion_text", "emotion_vector", "emotion_weight", "silence_after_ms")
_TASK = "text string, text_file string, voice string, output string, emotion_audio string, emotion_text string, emotion_vector string, emotion_weight double, silence_after_ms string"


def check_tasks(lines: DataFrame, prefix: str = "task") -> DataFrame:
    """Tasks from (line, value) rows with ``error``: the first rule that a line breaks, null for good ones.

    Blank lines are no tasks. A task has exactly one text source and at most one emotion source; unknown keys,
    weights without a source, and an output that an earlier line has are errors. Outputs are named by ordinal if absent.
    """
    from pyspark.sql import Window

    rows = lines.filter(F.trim("value") != "").withColumn("t", F.from_json("value", _TASK)).withColumn("keys", F.json_object_keys("value"))
    order = Window.orderBy("line")  # a manifest is a file that one person wrote
    t = lambda k: F.col(f"t.{k}")
    given = lambda *ks: sum((t(k).isNotNull().cast("int") for k in ks), F.lit(0))
    unknown = F.array_sort(F.array_except("keys", F.array(*map(F.lit, TASK_KEYS))))
    emotion = given("emotion_audio", "emotion_text", "emotion_vector")
    output = F.coalesce(t("output"), F.format_string(f"{prefix}-%04d.wav", F.row_number().over(order)))
    rows = rows.withColumn("output", output)
    error = (
        F.when(F.col("keys").isNull(), "not a JSON object")
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown fields: "), F.array_join(unknown, ", ")))
        .when(given("text", "text_file") != 1, "exactly one of text and text_file")
        .when(emotion > 1, "more than one emotion source")
        .when(t("emotion_weight").isNotNull() & (emotion == 0), "emotion_weight without emotion source")
        .when(t("emotion_vector").isNotNull() & emotion_vector(t("emotion_vector")).isNull(), "emotion_vector is not eight numbers from 0 to 1 that sum to at most 0.8")
        .when(t("silence_after_ms").isNotNull() & ~t("silence_after_ms").rlike(r"^\d+$"), "silence_after_ms is not a whole number")
        .when(F.row_number().over(Window.partitionBy("output").orderBy("line")) > 1, "output of an earlier line")
    )
    return rows.withColumn("error", error).select("line", "output", "error", "t.text", "t.text_file", "t.voice", "t.silence_after_ms")


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """The tasks of a manifest file; the error with the lowest line number is raised."""
    text = spark.sparkContext.textFile(path).zipWithIndex().map(lambda p: (p[1] + 1, p[0])).toDF("line long, value string")
    tasks = check_tasks(text)
    first = tasks.filter("error is not null").orderBy("line").first()
    if first:
        raise ManifestError(first["line"], first["error"])
    return tasks.drop("error")
