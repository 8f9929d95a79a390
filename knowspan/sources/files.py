"""Readers and writers: trees of files, front matter, archives, exports, transcripts, vectors and logs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knowspan.functions import expressions as X
from knowspan.functions import kernels as K
from knowspan.session import table

#: What a golden sample is.
GOLDEN = "type string, source string, expected string, note string, mustInclude array<string>"


def walk(spark: SparkSession, root: str, pattern: str = "*.{md,html}") -> DataFrame:
    """path, size, mtime, md5, content of the files below ``root``; columns that aren't used aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select(F.regexp_replace("path", r"^\w+:/*", "/").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.md5("content").alias("md5"), "content")


def head(content: Column | str, most: int) -> Column:
    """The first bytes as text; a character that is cut off is replaced."""
    return F.decode(F.substring(content, 1, most), "UTF-8")


def markdown_files(spark: SparkSession, root: str) -> DataFrame:
    """Title, agent, date and body of Markdown files: front matter first, then the first heading, then the name."""
    meta = K.column(lambda t: dict(zip(("title", "agent", "date", "body"), (*(K.front_matter(t)[0].get(k) for k in ("title", "agent", "date")), K.front_matter(t)[1]))), "struct<title:string,agent:string,date:string,body:string>")
    found = walk(spark, root, "*.md").withColumn("m", meta(F.decode("content", "UTF-8")))
    heading = F.regexp_extract("m.body", r"(?m)^#{1,6}\s+(.+?)\s*$", 1)
    return found.select("path", "size", F.coalesce("m.title", F.when(heading != "", heading), F.regexp_replace(X.base_name("path"), r"\.[^.]*$", "")).alias("title"), "m.agent", F.try_to_timestamp("m.date", F.lit("yyyy-MM-dd")).alias("date"), "m.body")


def text_lines(spark: SparkSession, path: str, word: str | None = None) -> DataFrame:
    lines = spark.read.text(path)
    return lines.where(F.contains(F.lower("value"), F.lit(word.lower()))) if word else lines


def archive(records: DataFrame, folder: str, time: str) -> None:
    """Append records to a CSV archive by month."""
    records.withColumn("month", F.date_format(time, "yyyy-MM")).write.mode("append").partitionBy("month").option("header", "true").option("quoteAll", "true").option("escape", '"').csv(folder)


def read_archive(spark: SparkSession, folder: str, schema: str, word: str | None = None, month: str | None = None, limit: int = 200) -> DataFrame:
    """Records with a word in any field, of a month, the first ``limit``; a month reads only its folder."""
    rows = spark.read.schema(schema + ", month string").option("header", "true").option("multiLine", "true").option("escape", '"').csv(folder)
    if month:
        rows = rows.where(F.col("month") == month)
    if word:
        rows = rows.where(F.contains(F.lower(F.concat_ws(" ", *(F.col(c).cast("string") for c in rows.columns))), F.lit(word.lower())))
    return rows.limit(limit)


def golden(spark: SparkSession, path: str) -> DataFrame:
    """Samples of a golden set with issue: what is wrong with the ones that can't be used."""
    given = spark.read.schema(f"samples array<struct<{', '.join(f.replace(' ', ':', 1) for f in GOLDEN.split(', '))}>>").option("multiLine", "true").json(path)
    rows = given.select(F.explode("samples").alias("s")).select("s.*")
    issue = F.when(F.col("source").isNull(), "no source").when(~F.col("type").isin("gate", "distill") | F.col("type").isNull(), "unknown type").when((F.col("type") == "gate") & ~F.coalesce(F.col("expected").isin("pass", "reject"), F.lit(False)), "no expectation").when((F.col("type") == "distill") & (F.coalesce(F.size("mustInclude"), F.lit(0)) < 1), "nothing to include")
    return rows.withColumn("issue", issue)


def new_only(existing: DataFrame, imported: DataFrame, key: str) -> DataFrame:
    """Imported rows whose key isn't there yet, each once."""
    return imported.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def transcripts(said: DataFrame, key: str, order: str, role: str, text: str) -> DataFrame:
    """Each conversation as one Markdown text in order."""
    turns = F.array_sort(F.collect_list(F.struct(order, role, text)))
    return said.groupBy(key).agg(F.array_join(F.transform(turns, lambda t: F.concat(F.lit("## "), t[role], F.lit("\n\n"), t[text])), "\n\n").alias("markdown"))


def managed_block(text: Column, body: Column, begin: str = "<!-- begin -->", end: str = "<!-- end -->") -> Column:
    """``text`` with what lies between the marks replaced, or the block added at its end; doing it again changes nothing."""
    block = F.concat(F.lit(begin + "\n"), body, F.lit("\n" + end))
    a, z = F.instr(text, begin), F.instr(text, end)
    inside = F.concat(F.substr(text, F.lit(1), a - 1), block, F.substr(text, z + len(end), F.length(text)))
    return F.when((a > 0) & (z > a), inside).otherwise(F.concat(F.rtrim(text), F.lit("\n\n"), block, F.lit("\n")))


def to_blob(values: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else np.asarray(v, "<f4").tobytes() for v in values], dtype=object)


def from_blob(values: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else np.frombuffer(v, "<f4").tolist() for v in values], dtype=object)


def vectors(column: Column | str) -> Column:
    """Vectors of bytes (float32, little-endian), read in Arrow batches."""
    return F.pandas_udf(lambda v: from_blob(v), "array<float>")(column)


def blobs(column: Column | str) -> Column:
    return F.pandas_udf(lambda v: to_blob(v), "binary")(column)


def vectors_of_text(column: Column | str) -> Column:
    """Vectors that were kept as JSON text; null for other text."""
    return F.from_json(column, "array<float>")


def call_log(calls: DataFrame, args: str, error: str) -> DataFrame:
    """Log rows: arguments cut to 200 characters, status by the words of the error."""
    return calls.withColumn(args, F.substring(args, 1, 200)).withColumn("status", X.call_status(error))


# --- queries over the driver's tables -------------------------------------------------------------


def q_transcripts(spark, d):
    return transcripts(table(spark, d, "conversations"), "conv_id", "turn", "role", "text").select("conv_id", F.sha2("markdown", 256).alias("sha256"))


def q_managed_block(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 2 == 0, F.concat(F.substring("text", 1, 50), F.lit("<!-- begin -->\nold\n<!-- end --> after"))).otherwise(F.substring("text", 1, 50)).alias("t"))
    once = managed_block(F.col("t"), F.col("lang"))
    return docs.withColumn("once", once).select("doc_id", "once", (managed_block(F.col("once"), F.col("lang")) == F.col("once")).alias("stable"))


def q_vector_codec(spark, d):
    v = table(spark, d, "embeddings")
    back = vectors(blobs("embedding"))
    return v.select("vec_id", (back == F.col("embedding")).alias("same"), F.octet_length(blobs("embedding")).alias("bytes"))


def q_csv_round_trip(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit('he said "'), F.substring("text", 1, 30), F.lit('", twice')).alias("title"))
    line = F.to_csv(F.struct("title"), {"quoteAll": "true", "escape": '"'})
    back = F.from_csv(F.regexp_replace(line, "\n", " "), "title string", {"escape": '"'}).getField("title")
    return docs.select("doc_id", back.alias("back"))


def q_call_log(spark, d):
    e = table(spark, d, "events").withColumn("error", F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 3 == 0, "HTTP 429 Too Many Requests").when(F.col("event_id") % 3 == 1, "Request timed out").otherwise("bad output")))
    return call_log(e, "props", "error").groupBy("status").agg(F.count("*").alias("n"), F.max(F.length("props")).alias("longest"))


def q_new_only(spark, d):
    parts, name = table(spark, d, "part"), lambda size: F.concat("p_brand", F.lit("-"), size.cast("string")).alias("name")
    imported = parts.select(name(F.pmod("p_partkey", F.lit(80))), "p_partkey").groupBy("name").agg(F.min("p_partkey").alias("p_partkey"))
    return new_only(parts.select(name(F.col("p_size"))), imported, "name")


QUERIES = {"k07_transcripts": q_transcripts, "k09_managed_block": q_managed_block, "k11_vector_codec": q_vector_codec, "s10_csv_round_trip": q_csv_round_trip, "k12_call_log": q_call_log, "k06_import_new": q_new_only}
SQL = {
    "k07_transcripts": r"SELECT conv_id, sha256(string_agg('## ' || role || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn)) AS sha256 FROM conversations GROUP BY 1",
    "k09_managed_block": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN substring(text, 1, 50) || '<!-- begin -->' || chr(10) || lang || chr(10) || '<!-- end --> after' ELSE rtrim(substring(text, 1, 50), ' ') || chr(10) || chr(10) || '<!-- begin -->' || chr(10) || lang || chr(10) || '<!-- end -->' || chr(10) END AS once, true AS stable FROM documents",
    "k11_vector_codec": "SELECT vec_id, true AS same, (4 * len(embedding))::INTEGER AS bytes FROM embeddings",
    "s10_csv_round_trip": "SELECT doc_id, 'he said \"' || replace(substring(text, 1, 30), chr(10), ' ') || '\", twice' AS back FROM documents",
    "k12_call_log": "SELECT CASE WHEN event_type <> 'error' THEN 'success' WHEN event_id % 3 = 0 THEN 'rate_limited' WHEN event_id % 3 = 1 THEN 'timeout' ELSE 'failed' END AS status, count(*) AS n, max(length(props))::INTEGER AS longest FROM events GROUP BY 1",
    "k06_import_new": "SELECT p_brand || '-' || p_partkey % 80 AS name, min(p_partkey) AS p_partkey FROM part WHERE p_brand || '-' || p_partkey % 80 NOT IN (SELECT p_brand || '-' || p_size FROM part) GROUP BY 1",
}
