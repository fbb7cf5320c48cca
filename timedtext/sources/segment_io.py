"""Pipe-delimited segment tables, manifests, hypotheses and interval lists as sources and sinks.

The files have a header whose names vary in case and blanks; all values are text and are cast on the way in. Writers
go through Spark's commit protocol, so a half-written result is never seen.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructField, StructType

from timedtext.functions.timecodes import parse_time, strict_seconds

REQUIRED = ("startzeit", "endzeit", "text")


def normalise_header(df: DataFrame) -> DataFrame:
    return df.toDF(*("".join(c.split()).lower() for c in df.columns))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text under normalised names; the three core columns are required. Null texts are empty."""
    df = normalise_header(spark.read.option("sep", "|").option("header", True).option("quote", '"').option("escape", '"').csv(path))
    if missing := [c for c in REQUIRED if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.withColumn("text", F.coalesce("text", F.lit("")))


def read_segments_checked(spark: SparkSession, path: str, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(segments, rejects) from one reading of the files, so that no line is lost.

    Segments are the rows of read_segments with start_sec and end_sec, where both times parse. Rejects are all others: file,
    line, reason. The reason is malformed (more fields or fewer than the header; line is as in the file), or start or end
    does not parse (line is the fields again). Files without a header need the names of their columns.
    """
    options = {"sep": "|", "header": columns is None, "quote": '"', "escape": '"'}
    names = normalise_header(spark.read.options(**options).csv(path)).columns if columns is None else columns
    if missing := [c for c in REQUIRED if c not in names]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    schema = StructType([StructField(c, StringType()) for c in [*names, "__line"]])
    # without column pruning, so that both frames tell malformed lines by all their fields
    read = spark.read.options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord="__line", columnPruning=False).schema(schema).csv(path)
    rows = typed_segments(read.withColumn("file", F.col("_metadata.file_path")))
    reason = F.when(F.col("__line").isNotNull(), "malformed").when(F.col("start_sec").isNull(), "start does not parse").when(F.col("end_sec").isNull(), "end does not parse")
    rows = rows.withColumn("reason", reason)
    fields = F.array_join(F.array(*(F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in names)), "|")
    rejects = rows.filter("reason is not null").select("file", F.coalesce("__line", fields).alias("line"), "reason")
    segments = rows.filter("reason is null").withColumn("text", F.coalesce("text", F.lit("")))
    return segments.drop("__line", "reason", "file"), rejects


def _placed(rows: DataFrame, order: str, name: str) -> DataFrame:
    """rows (file, block, …) with their place in the file, from 0: rows of earlier blocks of the file, and those before in the block.

    No task sees more than one block of a file; of whole files only counts by block are put in order.
    """
    inside = Window.partitionBy("file", "block").orderBy(order)
    counts = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("file", "block", (F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")).alias("__before"))
    numbered = rows.withColumn("__inside", F.row_number().over(inside) - 1).join(before, ["file", "block"])
    return numbered.withColumn(name, F.col("__before") + F.col("__inside")).drop("__before", "__inside")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block, line number within the file, and line, without headers and empty lines; files are read in blocks."""
    header = F.regexp_replace(F.lower("line"), r"\s", "").startswith("startzeit|")
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    rows = spark.read.option("lineSep", "\n").text(path).select(*place, F.regexp_replace("value", r"\r$", "").alias("line"))
    rows = _placed(rows.withColumn("__order", F.monotonically_increasing_id()), "__order", "line_no").drop("__order")
    return rows.filter((F.col("line") != "") & ~header)


def read_segments_strict(spark: SparkSession, path: str) -> DataFrame:
    """start_sec, end_sec, text of rows with exactly three fields whose times are numbers; the header falls out by that."""
    parts = spark.read.text(path).select(F.split("value", r"\|").alias("p")).filter(F.size("p") == 3)
    rows = parts.select(strict_seconds(F.get("p", F.lit(0))).alias("start_sec"), strict_seconds(F.get("p", F.lit(1))).alias("end_sec"), F.trim(F.get("p", F.lit(2))).alias("text"))
    return rows.filter("start_sec is not null and end_sec is not null")


def read_segments_numbered(spark: SparkSession, path: str) -> DataFrame:
    """id (place among the kept rows, from 0), startzeit, endzeit, text of rows with three fields or more, without the header."""
    rows = _lines(spark, path).withColumn("p", F.split("line", r"\|")).filter(F.size("p") >= 3)
    rows = _placed(rows, "line_no", "id")
    field = lambda k: F.get("p", F.lit(k))
    return rows.select("file", "id", field(0).alias("startzeit"), field(1).alias("endzeit"), F.trim(field(2)).alias("text"))


def latest_manifest(rows: DataFrame) -> DataFrame:
    """Of manifest rows (media_id, seq, chunk_path, …, line_no) with a path: the last one of each (media_id, seq)."""
    kept = rows.filter("chunk_path is not null and trim(chunk_path) <> ''")
    others = [c for c in kept.columns if c not in ("media_id", "seq", "line_no")]
    return kept.groupBy("media_id", "seq").agg(F.max_by(F.struct(*others), "line_no").alias("x")).select("media_id", "seq", "x.*")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """original_id, startzeit, endzeit, text, chunk_path of rows with four fields and a path; the last row of an id counts."""
    rows = _lines(spark, path).withColumn("p", F.split("line", r"\|")).filter(F.size("p") >= 4)
    field = lambda k: F.trim(F.get("p", F.lit(k)))
    rows = rows.select("line_no", field(0).alias("startzeit"), field(1).alias("endzeit"), field(2).alias("text"), field(3).alias("chunk_path"), F.coalesce(F.get("p", F.lit(4)), F.col("line_no").cast("string")).try_cast("long").alias("original_id"))
    rows = rows.filter("chunk_path <> '' and original_id is not null")
    last = rows.groupBy("original_id").agg(F.max_by(F.struct("startzeit", "endzeit", "text", "chunk_path"), "line_no").alias("x"))
    return last.select("original_id", "x.*")


def write_segments(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(sep="|", header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def flat_hypotheses(nested: DataFrame) -> DataFrame:
    """Rows of nested n-best lists (segment_id, source_text, hypotheses array of struct); null ids and empty lists fall out."""
    rows = nested.filter("segment_id is not null").select("segment_id", "source_text", F.posexplode("hypotheses").alias("hypothesis_id", "h"))
    return rows.select("segment_id", "source_text", "hypothesis_id", "h.*")


#: Columns of a hypotheses table with their types; those after text may be missing in what is appended.
HYPOTHESIS = {
    "segment_id": "bigint", "source_text": "string", "hypothesis_id": "int", "text": "string",
    "score": "double", "beam_score_raw": "double", "beam_score_norm": "double", "sts_score": "double", "is_best": "boolean",
}


def _as_in(value: Column, mine: DataType, theirs: DataType, name: str) -> Column:
    """value in the type that a table has it in; structs keep the fields that the table lacks. Values that do not fit raise."""
    if isinstance(mine, StructType) and isinstance(theirs, StructType):
        known = {f.name: f.dataType for f in theirs.fields}
        fields = [_as_in(value[f.name], f.dataType, known.get(f.name, f.dataType), f"{name}.{f.name}").alias(f.name) for f in mine.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(mine, ArrayType) and isinstance(theirs, ArrayType):
        return F.transform(value, lambda x: _as_in(x, mine.elementType, theirs.elementType, name))
    if isinstance(mine, StructType | ArrayType | MapType) != isinstance(theirs, StructType | ArrayType | MapType):
        raise ValueError(f"column {name} is {mine.simpleString()} here and {theirs.simpleString()} in the table")
    return value if mine == theirs else value.cast(theirs)


def _merged_schema(spark: SparkSession, path: str) -> StructType | None:
    """The columns of all files of a Parquet table, or None where there is none yet."""
    try:
        return spark.read.option("mergeSchema", True).parquet(path).schema
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def append_hypotheses(nested: DataFrame, path: str) -> None:
    """Appends nested n-best lists as flat rows, with the optional columns that they have.

    What is appended may have fewer columns than the table, or more, in structs too; a column that the table has is
    written in the table's type. Lists with other fields before do not hinder: read_hypotheses gives all columns to all rows.
    """
    flat = flat_hypotheses(nested)
    theirs = {name: StructType.fromDDL(f"x {kind}")["x"].dataType for name, kind in HYPOTHESIS.items()}
    if there := _merged_schema(flat.sparkSession, path):
        theirs |= {f.name: f.dataType for f in there.fields}
    flat.select(*(_as_in(F.col(f"`{f.name}`"), f.dataType, theirs.get(f.name, f.dataType), f.name).alias(f.name) for f in flat.schema.fields)).write.mode("append").parquet(path)


def read_hypotheses(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a hypotheses table whose parts may have different columns: first the known ones, null where a part lacks
    them, then others by name. Fields that a part's structs lack are null too."""
    rows = spark.read.option("mergeSchema", True).parquet(path)
    known = [F.col(c) if c in rows.columns else F.lit(None).cast(kind).alias(c) for c, kind in HYPOTHESIS.items()]
    return rows.select(*known, *(f"`{c}`" for c in sorted(set(rows.columns) - set(HYPOTHESIS))))


def append_manifest(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def export_embeddings(df: DataFrame) -> DataFrame:
    """The vector also as the text [a, b, …]."""
    return df.withColumn("embedding", F.col("embedding").cast("array<float>")).withColumn("embedding_text", F.concat(F.lit("["), F.array_join(F.transform("embedding", lambda x: x.cast("string")), ", "), F.lit("]")))


def write_speech_intervals(df: DataFrame, path: str) -> None:
    df.select("media_id", F.col("start_sec").alias("start"), F.col("end_sec").alias("end")).write.mode("overwrite").json(path)


def settled(df: DataFrame, path: str) -> DataFrame:
    """The rows as a table at path (in the shared folder): what is computed from them no longer depends on how they came."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def typed_segments(df: DataFrame) -> DataFrame:
    """Raw text times parsed; rows whose times do not parse keep nulls."""
    return df.withColumn("start_sec", parse_time(F.col("startzeit"))).withColumn("end_sec", parse_time(F.col("endzeit")))


def resolve_version(base: DataFrame, *versions: DataFrame) -> DataFrame:
    """Texts of the most advanced version that has the row; versions come most advanced first, each (media_id, seq, text)."""
    out, names = base, []
    for k, v in enumerate(versions):
        names.append(f"__text_{k}")
        out = out.join(v.select("media_id", "seq", F.col("text").alias(names[-1])), ["media_id", "seq"], "left")
    return out.withColumn("text", F.coalesce(*names, "text")).drop(*names)
