"""Raw files to the canonical occurrence table.

``null_policy`` "strict" keeps missing strings as nulls; "literal" writes "nan" where a value of a present column is missing and
"None" where the whole column is absent.  Files are listed through Hadoop's file systems and each CSV file is read under its own header.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.numeric import to_double
from strata.sources.schema import COLUMNS, NA_TEXTS, NEOTOMA_RENAMES, PBDB_RENAMES, SCHEMA


def matching_files(spark: SparkSession, pattern: str) -> list[tuple[str, int]]:
    """(path, modification time) of the files that a glob pattern matches, by path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted((f.getPath().toString(), f.getModificationTime()) for f in found or [])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """One CSV file, all columns as text, missing-value texts as nulls.  Fields may hold line ends, so a file is one task: for large
    downloads ask for several intervals, each a file of its own."""
    return without_missing(spark.read.csv(path, header=True, multiLine=True, escape='"'))


def without_missing(raw: DataFrame) -> DataFrame:
    """Columns of text with nulls for texts that stand for a missing value."""
    blank = lambda c: F.when(~F.col(f"`{c}`").isin(*NA_TEXTS), F.col(f"`{c}`"))
    return raw.select(*(blank(c).alias(c) for c in raw.columns))


def read_pbdb(spark: SparkSession, folder: str) -> DataFrame | None:
    """All ``pbdb_occurrences_*.csv``, by column name; files that can't be read are passed over; None without any."""
    frames = []
    for path, _ in matching_files(spark, f"{folder}/pbdb_occurrences_*.csv"):
        try:
            frame = read_csv(spark, path)
        except AnalysisException:
            continue
        if frame.columns:
            frames.append(frame)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None


def read_neotoma(spark: SparkSession, folder: str) -> DataFrame | None:
    """The rows of the latest ``neotoma_occurrences_*.json`` (its ``data``, else the document itself) as one variant column."""
    files = matching_files(spark, f"{folder}/neotoma_occurrences_*.json")
    if not files:
        return None
    latest = max(files, key=lambda f: (f[1], f[0]))[0]
    document = spark.read.text(latest, wholetext=True).select(F.try_parse_json("value").alias("doc"))
    inner = F.expr("try_variant_get(doc, '$.data', 'array<variant>')")
    rows = F.coalesce(inner, F.expr("try_variant_get(doc, '$', 'array<variant>')"), F.when(F.col("doc").isNotNull() & F.expr("try_variant_get(doc, '$.data', 'variant')").isNull(), F.array("doc")))
    return document.select(F.explode(rows).alias("row"))


def conform(frame: DataFrame, null_policy: str = "strict") -> DataFrame:
    """The canonical columns, types and order; absent columns are null."""
    if null_policy not in ("strict", "literal"):
        raise ValueError("null_policy is strict or literal")

    def column(field):
        here = F.col(f"`{field.name}`") if field.name in frame.columns else None
        if field.dataType.typeName() == "double":
            return to_double(here) if here is not None else F.lit(None).cast("double")
        if null_policy == "literal":
            return F.coalesce(here.cast("string"), F.lit("nan")) if here is not None else F.lit("None")
        return here.cast("string") if here is not None else F.lit(None).cast("string")

    return frame.select(*(column(f).alias(f.name) for f in SCHEMA.fields))


def normalize_pbdb(raw: DataFrame, null_policy: str = "strict") -> DataFrame:
    named = raw.withColumnsRenamed({a: b for a, b in PBDB_RENAMES.items() if a in raw.columns}).withColumn("source_db", F.lit("PBDB"))
    if "mid_ma" not in named.columns and "max_ma" in named.columns and "min_ma" in named.columns:
        named = named.withColumn("mid_ma", (to_double(F.col("max_ma")) + to_double(F.col("min_ma"))) / 2)
    return conform(named, null_policy)


def normalize_neotoma(raw: DataFrame, null_policy: str = "strict") -> DataFrame:
    """``raw``: one variant column ``row``.  Ages are years before present, as numbers or under ``age``."""
    get = lambda path, kind: F.expr(f"try_variant_get(row, '{path}', '{kind}')")
    age = F.coalesce(get("$.age.age", "double"), get("$.age", "double"))
    names = {b: get(f"$.{a}", "string") for a, b in NEOTOMA_RENAMES.items()}
    place = "$.site.geography.coordinates"
    frame = raw.select(*(c.alias(n) for n, c in names.items()), (age / 1_000_000).alias("mid_ma"), get(f"{place}[1]", "double").alias("lat"),
                       get(f"{place}[0]", "double").alias("lng"), F.lit("Neotoma").alias("source_db"))
    return conform(frame, null_policy)


def merge(spark: SparkSession, folder: str) -> DataFrame | None:
    """All ``*_occurrences.parquet`` of a folder whose path does not say merged; None without any."""
    frames = []
    for path, _ in matching_files(spark, f"{folder}/*_occurrences.parquet"):
        if "merged" in path:
            continue
        try:
            frames.append(conform(spark.read.parquet(path)))
        except AnalysisException:
            continue
    return reduce(DataFrame.unionByName, frames) if frames else None


def drop_repeats(occ: DataFrame) -> DataFrame:
    """One row for each identifier of a source (downloads may overlap)."""
    rest = [c for c in COLUMNS if c not in ("source_db", "occurrence_id")]
    return occ.groupBy("source_db", "occurrence_id").agg(F.min(F.struct(*rest)).alias("r")).select("source_db", "occurrence_id", "r.*").select(*COLUMNS)


def normalize_folder(spark: SparkSession, source: str, raw_folder: str, out_folder: str, null_policy: str = "strict") -> str | None:
    """Reads, normalises and writes one source (``pbdb`` or ``neotoma``) or the merge of those written; the path, or None without input."""
    if source == "merge":
        frame, path = merge(spark, raw_folder), f"{out_folder}/merged_occurrences.parquet"
    else:
        raw = {"pbdb": read_pbdb, "neotoma": read_neotoma}[source](spark, raw_folder)
        frame = raw and {"pbdb": normalize_pbdb, "neotoma": normalize_neotoma}[source](raw, null_policy)
        path = f"{out_folder}/{source}_occurrences.parquet"
    if frame is None:
        return None
    frame.write.mode("overwrite").parquet(path)
    return path


def quality_report(occ: DataFrame) -> DataFrame:
    """Rows, dated rows and the span of ages of each source."""
    return occ.groupBy("source_db").agg(F.count("*").alias("occurrences"), F.count("mid_ma").alias("dated"), F.min("mid_ma").alias("youngest"), F.max("mid_ma").alias("oldest"))


def preview(spark: SparkSession, path: str, columns: tuple[str, ...] = (), n: int = 5) -> DataFrame:
    """The first rows of a raw CSV file, all columns or the given ones, to check a download."""
    frame = read_csv(spark, path)
    return (frame.select(*columns) if columns else frame).limit(n)


def register(occ: DataFrame, name: str = "occurrences") -> DataFrame:
    """Makes the table known to ``spark.sql`` under ``name``."""
    occ.createOrReplaceTempView(name)
    return occ
