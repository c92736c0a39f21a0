"""Readers of the text, table and JSON layouts that corpora and artifacts come in. All are lazy; malformed lines are left out, not raised, unless said."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from gridprint.functions import text as T

DOUBLE_XY = Y.MapType(Y.StringType(), Y.StructType([Y.StructField("x", Y.IntegerType()), Y.StructField("y", Y.IntegerType())]))
PASSAGES = Y.ArrayType(Y.StructType([Y.StructField("idx", Y.IntegerType()), Y.StructField("title", Y.StringType()), Y.StructField("text", Y.StringType())]))
PARAGRAPH = Y.StructType([Y.StructField("idx", Y.IntegerType()), Y.StructField("title", Y.StringType()), Y.StructField("paragraph_text", Y.StringType()), Y.StructField("is_supporting", Y.BooleanType())])
ENTRY = Y.StructType([Y.StructField("id", Y.StringType()), Y.StructField("question", Y.StringType()), Y.StructField("answer", Y.StringType()), Y.StructField("paragraphs", Y.ArrayType(PARAGRAPH)), Y.StructField("question_decomposition", Y.ArrayType(Y.StructType([Y.StructField("id", Y.LongType()), Y.StructField("question", Y.StringType()), Y.StructField("answer", Y.StringType())])))])
QUERY = Y.ArrayType(Y.StructType([Y.StructField("id", Y.StringType()), Y.StructField("question", Y.StringType()), Y.StructField("answer", Y.ArrayType(Y.StringType())), Y.StructField("answerable", Y.BooleanType()), Y.StructField("paragraphs", Y.ArrayType(Y.StructType([Y.StructField("title", Y.StringType()), Y.StructField("text", Y.StringType()), Y.StructField("is_supporting", Y.BooleanType()), Y.StructField("idx", Y.IntegerType())])))]))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, ord) of non-blank lines, trimmed."""
    return spark.read.text(path).withColumn("ord", F.monotonically_increasing_id()).withColumn("value", F.trim("value")).where("value <> ''")


def corpus_lines(spark: SparkSession, path: str) -> DataFrame:
    """(context_id, text, ord) of `id,text` lines; the first comma splits, lines without one are skipped, ids repeat."""
    parts = F.split("value", ",", 2)
    return lines(spark, path).where(F.contains("value", F.lit(","))).select(F.trim(parts[0]).alias("context_id"), F.trim(parts[1]).alias("text"), "ord")


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """(context_id, text); the last line of an id counts."""
    return corpus_lines(spark, path).groupBy("context_id").agg(F.max_by("text", "ord").alias("text"))


def normalised_corpus(spark: SparkSession, path: str) -> DataFrame:
    """S3: texts as normalised phrases, empty ones left out."""
    return corpus(spark, path).withColumn("text", T.normalize_phrase(F.col("text"))).where("text is not null")


def phrase_counts(spark: SparkSession, path: str, min_freq: int = 1) -> DataFrame:
    """(phrase, freq) of `phrase:freq` lines; without a number the line is skipped."""
    parts = F.split("value", ":", 2)
    rows = lines(spark, path).select(F.trim(parts[0]).alias("phrase"), F.get(parts, F.lit(1)).alias("f"))
    return rows.select("phrase", F.expr("try_cast(trim(f) as int)").alias("freq")).where(F.col("freq") >= min_freq)


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(phrase, df) of a CSV without header; a bad number raises."""
    rows = spark.read.csv(path, schema="phrase string, df string", quote='"', escape='"')
    return rows.select("phrase", F.col("df").cast("int").alias("df"))


def coordinates_json(spark: SparkSession, path: str) -> DataFrame:
    """(context_id, x, y) of one object id -> {x, y}; entries that lack a coordinate are skipped."""
    m = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", DOUBLE_XY)).alias("context_id", "p"))
    return m.select("context_id", "p.x", "p.y").where("x is not null and y is not null")


def coordinates_csv(spark: SparkSession, path: str) -> DataFrame:
    """(context_id, x, y) of a CSV with header; rows of other than three fields are skipped."""
    return spark.read.csv(path, header=True, schema="context_id string, x double, y double", mode="DROPMALFORMED").dropna()


def coordinates_quoted(spark: SparkSession, path: str) -> DataFrame:
    """Rows `id,"x,y"`."""
    rows = spark.read.csv(path, header=True, schema="context_id string, at string")
    return rows.select("context_id", *[F.expr(f"try_cast(trim(get(split(at, ','), {i})) as double)").alias(c) for i, c in enumerate("xy")]).dropna()


def table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A stored table of ours, with its columns checked."""
    df = spark.read.parquet(path)
    missing = set(columns or []) - set(df.columns)
    if missing:
        raise ValueError(f"{path} lacks {sorted(missing)}")
    return df


def matrix_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The one-object JSON beside a matrix."""
    return spark.read.json(path, multiLine=True)


def fingerprint_cache(spark: SparkSession, path: str, grid: int) -> DataFrame:
    """(id, cell, value) of an object id -> {coordinates, values}, cells counted x * grid + y there; in any number of entries."""
    kind = "map<string, struct<coordinates: array<array<int>>, values: array<double>>>"
    m = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("id", "p"))
    z = m.select("id", F.explode(F.arrays_zip("p.coordinates", "p.values")).alias("z"))
    return z.select("id", (F.col("z.coordinates")[0] * grid + F.col("z.coordinates")[1]).alias("cell"), F.col("z.values").alias("value"))


def bit_lists(spark: SparkSession, path: str) -> DataFrame:
    """(phrase, cell, value) of one JSON file per phrase with its active bits; the file's name is the phrase."""
    rows = spark.read.schema("grid_size int, active_bits array<int>").json(path, multiLine=True)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    return rows.select(F.url_decode(name).alias("phrase"), F.explode("active_bits").alias("cell")).withColumn("value", F.lit(1.0))


def tsv_matrices(spark: SparkSession, path: str) -> DataFrame:
    """(file, y, x, value) of tab-separated matrices; y is the line's number in its file."""
    from pyspark.sql import Window as W

    rows = spark.read.text(path).select(F.input_file_name().alias("file"), "value", F.monotonically_increasing_id().alias("ord"))
    at = rows.withColumn("y", F.row_number().over(W.partitionBy("file").orderBy("ord")) - 1)
    return at.select("file", "y", F.posexplode(F.split("value", "\t")).alias("x", "v")).select("file", "y", "x", F.expr("try_cast(v as double)").alias("value"))


def passages(spark: SparkSession, path: str) -> DataFrame:
    """(idx, title, text) of a JSON array; without an index, the position counts."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", PASSAGES)).alias("pos", "p"))
    return rows.select(F.coalesce("p.idx", "pos").alias("idx"), "p.title", "p.text")


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions with answers and paragraphs."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", QUERY)).alias("q")).select("q.*")


def entries(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per line, with paragraphs and the steps of the question."""
    return spark.read.schema(ENTRY).json(path)


def triples(spark: SparkSession, path: str) -> DataFrame:
    """Subject, predicate, object and chunk of a CSV with header; rows with a blank part are dropped."""
    from gridprint.operators.graph import clean_triples

    return clean_triples(spark.read.csv(path, header=True, schema="subject string, predicate string, object string, source_chunk_id string"))


def document(contexts: DataFrame, context_id: str) -> DataFrame:
    """One document, by a filter that reaches the file."""
    return contexts.where(F.col("context_id") == F.lit(context_id))


def passages_to_lines(rows: DataFrame) -> DataFrame:
    """Passages to `idx,title: text` lines, line ends flattened; rows without title or text are refused."""
    bad = rows.where("title is null or text is null")
    if not bad.isEmpty():
        raise ValueError("a passage lacks its title or text")
    return rows.select(F.concat(F.col("idx").cast("string"), F.lit(","), F.regexp_replace(F.concat("title", F.lit(": "), "text"), r"\s*[\r\n]+\s*", " ")).alias("value"))


def verses_to_csv(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as a table, line ends in texts flattened."""
    rows = spark.read.json(path)
    return rows.select(*[F.regexp_replace(F.col(f.name), r"[\r\n]+", " ").alias(f.name) if f.dataType == Y.StringType() else F.col(f.name) for f in rows.schema])


def active(registry: list[dict], status: str = "active") -> list[dict]:
    """Entries of a small registry (datasets, models) by status."""
    return [r for r in registry if r.get("status", "active") == status]
