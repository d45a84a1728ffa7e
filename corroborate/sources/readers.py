"""Readers of landed JSON, CSV, Markdown and capture files as entity tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corroborate.functions import text as X
from corroborate.operators.relational import text_from_inverted_index

RECORD = (
    "record_id: string, title: string, authors: array<string>, year: int, venue: string, "
    "doi: string, citations: bigint, abstract: string, openalex_id: string, "
    "openalex_type: string, referenced_works_count: int, categories: array<string>, "
    "source_api: string, pin_reason: string, pin_unresolved: boolean, "
    "snowball_from: array<string>, search_angles: array<string>"
)
EVIDENCE_FILE = (
    "mechanism_id string, fetched_at string, terms array<string>, "
    f"records array<struct<{RECORD}>>, _corrupt string"
)
OBSERVATION = (
    "record_id: string, source_id: string, origin: string, title: string, source_url: string, "
    "source_locator: string, observed_at: string, observation: string, "
    "artifact_context: array<string>, contributed_by: string, license_note: string"
)
OBSERVATION_FILE = f"mechanism_id string, records array<struct<{OBSERVATION}>>, _corrupt string"
WORK_PAGE = (
    "meta struct<count: bigint>, results array<struct<id: string, type: string, doi: string, "
    "title: string, display_name: string, publication_year: int, cited_by_count: bigint, "
    "authorships: array<struct<author: struct<display_name: string>>>, "
    "primary_location: struct<source: struct<display_name: string>>, "
    "abstract_inverted_index: map<string, array<int>>, referenced_works_count: int>>"
)
PAPER_PAGE = (
    "total bigint, data array<struct<title: string, authors: array<struct<name: string>>, "
    "year: int, venue: string, citationCount: bigint, abstract: string, "
    "externalIds: struct<DOI: string>>>"
)


def _json(spark: SparkSession, path: str, schema: str, glob: str, recursive: bool) -> DataFrame:
    reader = (
        spark.read.schema(schema)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", recursive)
    )
    return reader.json(path).withColumn("file_name", F.col("_metadata.file_name"))


def read_evidence(spark: SparkSession, path: str, include_side_files: bool = False) -> DataFrame:
    """Evidence records of one-file-per-topic corpora; the manifest is not a corpus."""
    files = _json(spark, path, EVIDENCE_FILE, "*.json", False).filter("file_name <> 'manifest.json'")
    if not include_side_files:
        files = files.filter(~F.col("file_name").endswith(".regression.json"))
    return files.select(
        F.col("mechanism_id").alias("topic_id"), "fetched_at", "file_name", F.explode("records").alias("r")
    ).select("topic_id", "fetched_at", "file_name", "r.*")


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    files = _json(spark, path, OBSERVATION_FILE, "records.json", True)
    return files.select(F.col("mechanism_id").alias("topic_id"), F.explode("records").alias("r")).select("topic_id", "r.*")


def read_artifacts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One document per file, nested folders, schema files left out."""
    return _json(spark, path, schema, "*.json", True).filter(~F.col("file_name").endswith(".schema.json"))


def read_registry(spark: SparkSession, full_path: str, seed_path: str, schema: str) -> DataFrame:
    full = _json(spark, full_path, schema, "*.json", False).withColumn("kind", F.lit("full"))
    stubs = _json(spark, seed_path, schema, "*.json", False).withColumn("kind", F.lit("stub"))
    return full.unionByName(stubs, allowMissingColumns=True)


def config_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small authored configuration list as a table."""
    names = T.StructType.fromDDL(schema).names
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


# --- reports ------------------------------------------------------------------------------
def read_report(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """Metric rows of a CSV, JSON-array or Markdown-table report, all as strings."""
    columns = ["metric", "category", "value", "unit", "notes"]
    if fmt == "csv":
        raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    elif fmt == "json":
        raw = spark.read.option("multiLine", True).json(path)
    elif fmt == "md":
        texts = spark.read.text(path, wholetext=True)
        return markdown_rows(texts, "value").select(*[F.col("cells")[c].alias(c) for c in columns])
    else:
        raise ValueError(f"unknown report format {fmt}")
    return raw.select(*[(F.col(c) if c in raw.columns else F.lit(None)).cast("string").alias(c) for c in columns])


def markdown_rows(df: DataFrame, column: str) -> DataFrame:
    """Rows of the first pipe table of each text, as maps keyed by the header."""
    lines = F.transform(F.split(column, "\r?\n"), lambda x: F.trim(x))
    marked = F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.startswith("|").alias("bar"), x.alias("text")))

    def first_run(all_lines: Column) -> Column:
        begin = F.array_min(F.transform(F.filter(all_lines, lambda e: e["bar"]), lambda e: e["i"]))
        stop = F.array_min(
            F.transform(F.filter(all_lines, lambda e: ~e["bar"] & (e["i"] > begin)), lambda e: e["i"])
        )
        end = F.coalesce(stop, F.size(all_lines))
        return F.transform(
            F.filter(all_lines, lambda e: (e["i"] >= begin) & (e["i"] < end)), lambda e: e["text"]
        )

    def cells(line: Column) -> Column:
        inner = F.regexp_replace(line, r"^\||\|$", "")
        return F.transform(F.split(inner, r"\|"), lambda c: F.trim(c))

    table = df.withColumn("_t", X.bind(marked, first_run)).withColumn("_head", cells(F.get("_t", F.lit(0))))
    body = table.withColumn("_line", F.explode(F.slice("_t", F.lit(2), F.size("_t"))))
    body = body.filter(~F.col("_line").rlike(r"^\|[\s:|-]+$"))
    width = F.size("_head")
    padded = F.transform(
        F.sequence(F.lit(0), width - 1), lambda i: F.coalesce(F.get(cells(F.col("_line")), i), F.lit(""))
    )
    return body.select(*df.columns, F.map_from_arrays(F.transform("_head", lambda h: F.lower(h)), padded).alias("cells"))


def normalise_metric_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined): trimmed metric rows with a finite value, and the rest."""
    def text(name: str) -> Column:
        clean = X.js_trim(F.col(name))
        return F.when(clean != "", clean)

    value = text("value").try_cast("double")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    reason = (
        F.when(text("metric").isNull(), "metric_empty")
        .when(text("unit").isNull(), "unit_empty")
        .when(text("value").isNull(), "value_empty")
        .when(~finite, "value_not_finite")
    )
    judged = rows.withColumn("reason", reason)
    extra = [c for c in rows.columns if c not in ("metric", "category", "value", "unit", "notes")]
    good = judged.filter("reason IS NULL").select(
        *extra, text("metric").alias("metric"), text("category").alias("category"),
        value.alias("value"), text("unit").alias("unit"), text("notes").alias("notes"),
    )
    return good, judged.filter("reason IS NOT NULL")


# --- provider pages -------------------------------------------------------------------------
def works_to_records(pages: DataFrame, source_api: str = "openalex") -> DataFrame:
    """Raw pages of the works provider as evidence records."""
    works = pages.select(F.col("meta.count").alias("provider_total"), F.posexplode("results").alias("pos", "w"))
    title = F.coalesce("w.title", "w.display_name")
    kept = works.filter(F.coalesce(F.length(title), F.lit(0)) > 0)
    rebuilt = text_from_inverted_index(kept.withColumn("index", F.col("w.abstract_inverted_index")).withColumn("keep", F.struct("provider_total", "pos", "w")), "keep", "index")
    names = F.transform("keep.w.authorships", lambda a: a["author"]["display_name"])
    title = F.coalesce("keep.w.title", "keep.w.display_name")
    return rebuilt.select(
        F.col("keep.provider_total").alias("provider_total"),
        F.col("keep.pos").alias("pos"),
        title.alias("title"),
        _named(names).alias("authors"),
        F.col("keep.w.publication_year").alias("year"),
        F.col("keep.w.primary_location.source.display_name").alias("venue"),
        X.norm_doi(F.col("keep.w.doi")).alias("doi"),
        F.col("keep.w.cited_by_count").alias("citations"),
        F.col("text").alias("abstract"),
        X.norm_provider_id(F.col("keep.w.id")).alias("openalex_id"),
        F.col("keep.w.type").alias("openalex_type"),
        F.col("keep.w.referenced_works_count").alias("referenced_works_count"),
        F.lit(source_api).alias("source_api"),
    )


def papers_to_records(pages: DataFrame) -> DataFrame:
    """Raw pages of the paper-search provider as evidence records."""
    papers = pages.select(F.col("total").alias("provider_total"), F.posexplode("data").alias("pos", "p"))
    kept = papers.filter(F.coalesce(F.length("p.title"), F.lit(0)) > 0)
    venue = F.when(F.length("p.venue") > 0, F.col("p.venue"))
    return kept.select(
        "provider_total",
        "pos",
        F.col("p.title").alias("title"),
        _named(F.transform("p.authors", lambda a: a["name"])).alias("authors"),
        F.col("p.year").alias("year"),
        venue.alias("venue"),
        X.norm_doi(F.col("p.externalIds.DOI")).alias("doi"),
        F.col("p.citationCount").alias("citations"),
        F.col("p.abstract").alias("abstract"),
        F.lit(None).cast("string").alias("openalex_id"),
        F.lit(None).cast("string").alias("openalex_type"),
        F.lit(None).cast("int").alias("referenced_works_count"),
        F.lit("semantic-scholar").alias("source_api"),
    )


def _named(names: Column) -> Column:
    present = F.filter(names, lambda n: F.coalesce(F.length(n), F.lit(0)) > 0)
    return F.coalesce(present, F.array().cast("array<string>"))


def read_api_pages(spark: SparkSession, works_path: str, papers_path: str) -> DataFrame:
    works = spark.read.schema(WORK_PAGE).option("multiLine", True).json(works_path)
    papers = spark.read.schema(PAPER_PAGE).option("multiLine", True).json(papers_path)
    return works_to_records(works).unionByName(papers_to_records(papers))


def captures(rows: DataFrame) -> DataFrame:
    """Archive captures from (domain, timestamp, original); header and odd rows drop out."""
    ok = F.coalesce(F.col("timestamp").rlike("^[0-9]{14}$"), F.lit(False)) & (
        F.coalesce(F.length("original"), F.lit(0)) > 0
    )
    stamp = F.col("timestamp")
    return rows.filter(ok).select(
        "domain",
        "timestamp",
        F.concat_ws("-", F.substring(stamp, 1, 4), F.substring(stamp, 5, 2), F.substring(stamp, 7, 2)).alias("date"),
        F.concat(F.lit("https://web.archive.org/web/"), stamp, F.lit("/"), F.col("original")).alias("wayback_url"),
        F.col("original").alias("original_url"),
    )


def read_capture_index(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, schema="domain string, timestamp string, original string")
    return captures(raw)


def file_inventory(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Path, size and time of every data file below a folder; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path", F.col("length").alias("bytes"), "modificationTime")
    )


def inventory_counts(files: DataFrame, run_report: DataFrame, previous: DataFrame) -> DataFrame:
    """Record counts per file: from the run, else the previous inventory, else 0."""
    now = run_report.select("path", F.col("records").alias("_now"))
    before = previous.select("path", F.col("records").alias("_before"))
    return (
        files.join(now, "path", "left")
        .join(before, "path", "left")
        .withColumn("records", F.coalesce("_now", "_before", F.lit(0)))
        .drop("_now", "_before")
    )
