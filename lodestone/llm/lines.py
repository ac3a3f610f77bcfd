"""Line dedup with DataFrame functions only: explode, hash, count documents per hash, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import SPACE, cut, lowered, table


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """doc_id, kept_text, n_lines, n_dropped for every row of docs.

    A line's key is the line without white space at both ends and with A-Z lower-cased. Keys of at least min_chars code points
    that at least min_docs documents hold lose their lines everywhere but in the smallest doc_id that holds them. A null or
    empty text is one empty line. Rows with equal ids count as one document. Rows with a null id can't be ordered: they keep
    all lines and don't count. An empty table gives an empty one. doc_id may be of any type with an order. Columns other than doc_id
    and text are ignored.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).select("doc_id", F.xxhash64("t").alias("row_key"), F.split("t", "\n", -1).alias("lines"))
    found = rows.where("doc_id is not null").select("doc_id", "row_key", F.posexplode("lines").alias("pos", "line"))
    key = lowered(F.btrim("line", F.lit(SPACE)))
    found = found.select("doc_id", "row_key", "pos", key.alias("k")).where(F.length("k") >= min_chars)
    # two seeds: 128 bits, so that no two keys meet even among 10^12 lines
    found = found.select("doc_id", "row_key", "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(1), "k").alias("h2"))
    if min_docs == 2:
        counted = found.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    else:
        counted = found.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where(F.col("n") >= min_docs)
    shared = cut(counted.select("h1", "h2", "first"), "lines")  # its true size decides between broadcast and a sort-merge join whose hot keys AQE splits
    dropped = found.join(shared, ["h1", "h2"]).where("doc_id > first").groupBy("doc_id", "row_key").agg(F.collect_set("pos").alias("gone"))
    all_rows = rows.join(dropped, ["doc_id", "row_key"], "left")
    keep = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    text = F.when(F.col("gone").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(keep, lambda i: F.get("lines", i)), "\n"))
    return all_rows.select("doc_id", text.alias("kept_text"), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, r, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l),
s AS (SELECT k, min(doc_id) AS first FROM k WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, k.r, k.line, k.pos, s.k IS NOT NULL AND k.doc_id > s.first AS gone FROM k LEFT JOIN s ON k.k = s.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id, r
"""
