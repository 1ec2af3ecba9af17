"""Files and folders as documents, read by Spark's own readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import doc_type_of, html_to_text, title_from_filename

#: Kinds that are read as whole texts; any other suffix is too.
TEXT_KINDS = ("txt", "md", "markdown", "html", "htm")


def _decoded(name: Column) -> Column:
    """A name from the reader's metadata without its percent-encoding."""
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def _described(rows: DataFrame) -> DataFrame:
    """File columns of each row, from the reader's metadata."""
    path = _decoded(F.col("_metadata.file_path"))
    return rows.select("*", path.alias("source"), _decoded(F.col("_metadata.file_name")).alias("file_name"), F.col("_metadata.file_size").alias("file_size"), F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)).alias("file_type"))


def text_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """One document for each text, Markdown or HTML file, folders included; HTML is reduced to its text. A file that cannot be read is an error."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    rows = _described(reader.text(path, wholetext=True)).withColumnRenamed("value", "text")
    text = F.when(F.col("file_type").isin("html", "htm"), html_to_text("text")).otherwise(F.col("text"))
    return rows.withColumns({"text": text, "title": title_from_filename("source"), "doc_type": doc_type_of("source")})


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """One document for each row of CSV files: lines of "column: value"."""
    rows = spark.read.option("header", "true").option("mode", "FAILFAST").csv(path)
    lines = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(f"`{c}`"), F.lit(""))) for c in rows.columns]
    return rows.select(F.concat_ws("\n", *lines).alias("text"), F.col("_metadata.file_path").alias("source"))


def json_documents(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """One document for each JSON value of the files, as text."""
    rows = spark.read.option("multiLine", str(multiline).lower()).json(path)
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("text"), F.col("_metadata.file_path").alias("source"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Fixtures with one JSON object a line."""
    return spark.read.schema(schema).json(path)


def verified(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (source, content) of a manifest (source, sha256), with whether the digest agrees; files of no manifest row stay out."""
    return files.join(manifest, "source").withColumn("intact", F.sha2("content", 256) == F.col("sha256"))


def usable_archives(files: DataFrame, least: int = 250) -> DataFrame:
    """Texts of at least ``least`` characters, overstrikes removed, one for each digest."""
    rows = files.withColumn("text", F.regexp_replace("text", ".\b", "")).where(F.length("text") >= least)
    return rows.withColumn("sha256", F.sha2("text", 256)).dropDuplicates(["sha256"])


def elements(docs: DataFrame, kinds: list[str] | None = None, max_chars: int | None = None) -> DataFrame:
    """Typed elements of text documents: (source, element_no, kind, text) for titles, list items, tables and paragraphs.

    The filter on kinds comes before the texts are cut.
    """
    rows = docs.select("source", F.posexplode(F.split("text", r"\n\s*\n")).alias("element_no", "text")).withColumn("text", F.trim("text")).where("text != ''")
    c = F.col("text")
    kind = F.when(c.rlike(r"^#{1,6}\s"), "Title").when(c.rlike(r"^\|.*\|"), "Table").when(c.rlike(r"^([-*+•]|\d+[.)])\s"), "ListItem").when((F.length(c) < 80) & ~c.rlike(r"[.!?。！？]$"), "Title").otherwise("NarrativeText")
    rows = rows.withColumn("kind", kind)
    if kinds:
        rows = rows.where(F.col("kind").isin(*kinds))
    return rows.withColumn("text", F.substring("text", 1, max_chars)) if max_chars else rows


def synthetic_corpus(spark: SparkSession, per_category: int = 40, categories: tuple[str, ...] = ("policy", "paper", "experiment", "meeting", "guide", "project")) -> DataFrame:
    """A deterministic corpus of short documents in six categories."""
    name = F.get(F.array(*map(F.lit, categories)), (F.col("id") % len(categories)).cast("int"))
    number = F.floor(F.col("id") / len(categories))
    rows = spark.range(per_category * len(categories))
    return rows.select(F.concat_ws("-", name, number.cast("string")).alias("source"), name.alias("category"), F.concat(F.lit("Document "), number.cast("string"), F.lit(" about "), name, F.lit(". It has number "), F.col("id").cast("string"), F.lit(" in all.")).alias("text"))


def topic_corpus(topics: DataFrame) -> DataFrame:
    """A deterministic corpus of short documents: ``n`` of each category of ``topics`` (category, n)."""
    rows = topics.where("category is not null and n > 0").select("category", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("number"))
    number = F.col("number").cast("string")
    return rows.select(F.concat_ws("-", "category", number).alias("source"), "category", F.concat(F.lit("Document "), number, F.lit(" about "), F.col("category"), F.lit(".")).alias("text"))


def relational(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """A table of a relational database, by JDBC."""
    return spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options).load()
