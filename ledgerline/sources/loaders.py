"""Readers of declaration, statement, census, foundation, history and journal files, and the Parquet tables they become."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DECL_JSON = "name string, module string, kind string, library string, internal boolean, isProp boolean, propValued boolean, sorried boolean, line int, axioms array<string>, deps array<string>, typeDeps array<string>"
BINDER = "array<struct<index:int,name:string,binderInfo:string,type:string,typeDeps:array<string>>>"
STATEMENT_JSON = f"name string, module string, kind string, library string, role string, boundary boolean, isProp boolean, line int, typeDeps array<string>, bodyDeps array<string>, type string, signature string, binders {BINDER}, result string, typeExprHash string, docstring string, fields array<struct<name:string,projection:string,type:string>>, flags array<string>, missing boolean"
CENSUS_JSON = "family string, items array<struct<id:string,title:string,importance:string,status:string,source_kind:string,source_anchor:string,lean_declarations:array<string>,semantic_review:struct<canonical_declarations:array<string>,supporting_declarations:array<string>>>>"


def snake(name: str) -> str:
    return "".join("_" + c.lower() if c.isupper() else c for c in name)


def _read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    raw = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return raw.select(*[F.col(c).alias(snake(c)) for c in raw.columns])


def declarations(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON line; nullable fields stay null (not indexed), lists of dependencies default to empty."""
    return _read_lines(spark, path, DECL_JSON).withColumns({"deps": F.coalesce("deps", F.array().cast("array<string>")), "internal": F.coalesce("internal", F.lit(False))})


def statements(spark: SparkSession, path: str) -> DataFrame:
    return _read_lines(spark, path, STATEMENT_JSON).withColumn("missing", F.coalesce("missing", F.lit(False)))


def census_claims(spark: SparkSession, path: str, importances: list[str] | None = None) -> DataFrame:
    """Claims of census documents: family by metadata, else by file name; an empty wish for importances means all."""
    docs = spark.read.schema(CENSUS_JSON).option("multiLine", True).json(path).withColumn("file", F.input_file_name())
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"(?:[-_]census)?\.json$", "")
    family = F.coalesce("family", F.initcap(F.regexp_replace(stem, "[-_]", " ")))
    rows = docs.select(family.alias("family"), F.posexplode("items").alias("pos", "i")).select("family", "pos", "i.*")
    review = F.col("semantic_review")
    rows = rows.select(
        "family", "pos", "id", "title", "importance", "status", "source_kind", "source_anchor", F.col("lean_declarations").alias("declarations"),
        review["canonical_declarations"].alias("canonical"), review["supporting_declarations"].alias("supporting"), review.isNotNull().alias("has_explicit"),
    )
    return rows.where(F.col("importance").isin(importances)) if importances else rows


def foundation_map(spark: SparkSession, path: str) -> DataFrame:
    """(module, theory_id) of a CSV; the first mapping of a module wins."""
    rows = spark.read.option("header", True).csv(path).select("module", "theory_id", F.monotonically_increasing_id().alias("pos"))
    return rows.groupBy("module").agg(F.min_by("theory_id", "pos").alias("theory_id"))


def history(spark: SparkSession, path: str) -> DataFrame:
    """Commits of a log whose records start with \\x1e and whose fields (hash, time, name, mail, subject, body) end with \\x1f, numstat lines after them."""
    raw = spark.read.option("lineSep", "\x1e").text(path).where(F.trim("value") != "")
    part = F.split("value", "\x1f")
    stats = F.filter(F.split(F.element_at(part, -1), "\n"), lambda x: x.rlike(r"^[0-9-]+\t[0-9-]+\t"))
    number = lambda i: F.aggregate(F.transform(F.col("stats"), lambda x: F.coalesce(F.split(x, "\t")[i].try_cast("long"), F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x)
    rows = raw.select(part[0].alias("commit"), F.to_timestamp(part[1]).alias("ts"), part[2].alias("author_name"), part[3].alias("author_email"), part[4].alias("subject"), part[5].alias("body"), stats.alias("stats"))
    return rows.select(
        "commit", "ts", "author_name", "author_email", "subject", "body", F.transform("stats", lambda x: F.split(x, "\t")[2]).alias("files"), number(0).alias("additions"), number(1).alias("deletions"),
        F.size(F.filter("stats", lambda x: x.startswith("-"))).alias("binary_files"),
    )


def coauthors(commits: DataFrame) -> DataFrame:
    """(commit, name, email) of the trailers of commit bodies."""
    pattern = r"(?im)^co-authored-by:\s*([^<\n]*?)\s*<([^>\n]+)>"
    pair = F.explode(F.arrays_zip(F.regexp_extract_all("body", F.lit(pattern), F.lit(1)).alias("name"), F.regexp_extract_all("body", F.lit(pattern), F.lit(2)).alias("email")))
    return commits.select("commit", pair.alias("p")).select("commit", "p.name", "p.email")


def journal(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Journal events, newest first; lines that aren't JSON objects are skipped."""
    rows = spark.read.schema("at string, document string, pointer string, before string, after string, author string, note string, broken string").option("columnNameOfCorruptRecord", "broken").json(path)
    rows = rows.where("at is not null").drop("broken").orderBy(F.desc("at"), "document", "pointer")
    return rows.limit(limit) if limit else rows


def text_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, text) of whole files below a folder."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def cached(spark: SparkSession, path: str, fingerprint: str, build) -> DataFrame:
    """A Parquet table kept under its fingerprint: built when absent, read otherwise."""
    at = f"{path.rstrip('/')}/{fingerprint}"
    fs = spark._jvm.org.apache.hadoop.fs.Path(at).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")):
        build().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def fingerprint(files: DataFrame, *facts: str) -> str:
    """One SHA-256 over given facts and every file's path and content hash, in path order."""
    rows = files.select("path", F.sha2("text", 256).alias("h"))
    listed = rows.agg(F.array_sort(F.collect_list(F.concat_ws(":", "path", "h"))).alias("l"))
    return listed.select(F.sha2(F.concat_ws("\n", F.lit("\n".join(facts)), F.concat_ws("\n", "l")), 256)).first()[0]
