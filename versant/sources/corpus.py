"""Sources: reference corpora, dimensions, recordings on disk, earlier runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENT_SCHEMA = T.StructType([
    T.StructField("recording", T.LongType()), T.StructField("seg_idx", T.IntegerType()), T.StructField("group_id", T.IntegerType()),
    T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType()), T.StructField("text", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("words", T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("probability", T.DoubleType())]))),
    T.StructField("pause_duration", T.DoubleType()), T.StructField("is_breath_boundary", T.BooleanType()),
])
SILENCE_SCHEMA = "recording long, start_ms long, end_ms long"


class EngineError(Exception):
    """Root of the errors this package raises; carries its context."""

    def __init__(self, message: str, **context):
        super().__init__(message)
        self.context = context


class CorpusError(EngineError):
    pass


def corpus(spark: SparkSession, path: str, edition: str | None = None) -> DataFrame:
    """id, group_id, unit_no, text from one JSON object of group number -> texts; ids count groups 1 to 114
    in order, then units.  ``edition`` chooses the folder edition=..., so other editions aren't read."""
    path = f"{path}/edition={edition}" if edition else path
    groups = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m")).select(F.explode("m").alias("g", "texts"))
    numbered = groups.filter(F.col("g").rlike("^[0-9]{1,3}$")).select(F.col("g").cast("int").alias("group_id"), F.posexplode("texts").alias("pos", "text")).filter("group_id between 1 and 114")
    sizes = numbered.groupBy("group_id").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("group_id")) - F.col("n")  # at most 114 rows
    bases = F.broadcast(sizes.select(F.col("group_id").alias("g"), before.alias("base")))
    return numbered.join(bases, F.col("group_id") == F.col("g")).select((F.col("base") + F.col("pos") + 1).alias("id"), "group_id", (F.col("pos") + 1).alias("unit_no"), "text")


def dimension(units: DataFrame, names: dict[int, str] | None = None) -> DataFrame:
    """group_id, name (null if unknown) and n_units of each group; 114 rows at most, so it may be broadcast."""
    pairs = F.create_map(*[F.lit(x) for pair in (names or {0: ""}).items() for x in pair])
    return units.groupBy("group_id").agg(F.count("*").alias("n_units")).withColumn("name", F.try_element_at(pairs, F.col("group_id")))


def group_units(units: DataFrame, group: int | str) -> DataFrame:
    """Units of one group; "001" is 1; beyond 1 to 114 an error."""
    number = int(group)
    if not 1 <= number <= 114:
        raise CorpusError(f"group {group} is not between 1 and 114", group=group)
    return units.filter(F.col("group_id") == number)


def unit(units: DataFrame, group: int | str, number: int) -> DataFrame:
    return group_units(units, group).filter(F.col("unit_no") == number).limit(1)


def recordings(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, length and group number of the files of a folder that match; contents aren't read."""
    from ..functions.text import group_number

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "length", group_number("path").alias("group_id"))


def segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments of earlier transcriptions, JSON lines of SEGMENT_SCHEMA."""
    return spark.read.schema(SEGMENT_SCHEMA).json(path)


def silences(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SILENCE_SCHEMA).json(path)


def slice_samples(samples: str, rate: int, start_ms: str, end_ms: str):
    """Column: the samples of an array column between two times in milliseconds."""
    first = F.floor(F.col(start_ms) / 1000 * rate).cast("int")
    last = F.least(F.floor(F.col(end_ms) / 1000 * rate).cast("int"), F.size(samples))
    return F.slice(F.col(samples), first + 1, F.greatest(last - first, F.lit(0)))
