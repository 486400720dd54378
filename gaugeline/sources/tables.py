"""Table readers, inline reference tables, JSON documents with comments, page specs, optional overlays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.functions.drawing import resolved_headers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table; filters and column choice reach its scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task that makes or measures shapes.
SHAPES = 10_000


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt out by a key that hardly repeats, SHAPES rows a task.  A narrow table is a few row groups however many rows
    it has, so that all work on a row would stay in as few tasks."""
    return df.repartition(max(1, -(-df.count() // SHAPES)), key)


def inline(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A small reference table (rules, mappings, enumerations) given as rows."""
    return spark.createDataFrame(rows, ddl)


def values_sql(rows: list[tuple], names: str) -> str:
    """The same rows for an oracle: (VALUES ...) AS t(names)."""

    def lit(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        return repr(v) if isinstance(v, int | float) else "'" + str(v).replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") AS t({names})"


def strip_line_comments(text: Column) -> Column:
    """JSON text without lines that hold only a // comment."""
    return F.regexp_replace(text, r"(?m)^\s*//.*$", "")


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON documents that may carry // line comments, with their file name."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), strip_line_comments(F.col("value")).alias("value"))
    return raw.select("file_name", F.from_json("value", schema).alias("doc"))


def unfolded(docs: DataFrame, skip_by: str = "manual-") -> DataFrame:
    """Cases of documents, one a row; documents written by a skip_by extractor are left out."""
    return docs.where(~F.startswith(F.coalesce("extracted_by", F.lit("")), F.lit(skip_by))).withColumn("case", F.explode("cases"))


def findings(spark: SparkSession, pattern: str, schema: str, skip_by: str = "manual-") -> DataFrame:
    """Findings of many case files, tagged with the file; files written by a skip_by extractor are left out."""
    return unfolded(spark.read.schema(schema).option("multiLine", True).json(pattern).select("*", F.col("_metadata.file_name").alias("file_name")), skip_by)


def overlay_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An optional JSON overlay; without the file, no rows of the same schema."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)
    return spark.read.schema(schema).option("multiLine", True).json(path) if there else spark.createDataFrame([], schema)


def responses(spark: SparkSession, path: str, wanted: dict[str, list[str]], key: str, critical: set[str]) -> DataFrame:
    """Rows of a CSV table whose columns may stand in any order under any of their spellings; rows without a key go."""
    raw = spark.read.option("header", True).csv(path)
    found = resolved_headers(raw.columns, wanted, critical | {key})
    rows = raw.select(*(F.col(f"`{c}`").alias(n) for n, c in found.items()), *(F.lit(None).cast("string").alias(n) for n in wanted if n not in found))
    return rows.where(F.trim(F.coalesce(key, F.lit(""))) != "").select(*wanted)


def page_numbers(spec: Column, n_pages: Column) -> Column:
    """Sorted distinct page numbers of a spec like "1,3-5" or "all"; null when any part is malformed or out of range."""
    parts = F.transform(F.split(spec, ","), lambda p: F.trim(p))
    lo = lambda p: F.try_to_number(F.regexp_extract(p, r"^(\d+)", 1), F.lit("999999999")).cast("int")
    hi = lambda p: F.try_to_number(F.regexp_extract(p, r"(\d+)$", 1), F.lit("999999999")).cast("int")
    good = F.forall(parts, lambda p: F.regexp_like(p, F.lit(r"^\d+(-\d+)?$")) & (lo(p) >= 1) & (lo(p) <= hi(p)) & (hi(p) <= n_pages))
    ranges = F.transform(parts, lambda p: F.sequence(lo(p), hi(p)))
    every = F.sequence(F.lit(1), n_pages.cast("int"))
    return F.when(F.lower(F.trim(spec)) == "all", every).when(good, F.array_sort(F.array_distinct(F.flatten(ranges))))


def preferred(sources: list[DataFrame], key: str) -> DataFrame:
    """One row a key from the first source that has it; sources share columns."""
    ranked = reduce(DataFrame.unionByName, (d.withColumn("_rank", F.lit(i)) for i, d in enumerate(sources)))
    rest = [c for c in sources[0].columns if c != key]
    best = ranked.groupBy(key).agg(F.min_by(F.struct(*rest), "_rank").alias("_best"), F.min("_rank").alias("source_rank"))
    return best.select(key, *(F.col("_best")[c].alias(c) for c in rest), "source_rank")
