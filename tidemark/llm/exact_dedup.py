"""Exact dedup with a heavy-hitter split.

A Misra-Gries summary of the digests of every partition, merged over all partitions, names the
digests that may be frequent. Their winners are then computed exactly (a map-side aggregation over
a bounded set of keys) and broadcast, so that their rows are decided where they are read. All other
digests go through one ordinary shuffle, in which no group is larger than the summary's error.

Texts are equal when identical after lower-casing A-Z only; null counts as empty. Of equal texts
the row with the largest doc_id stays (null is smaller than any). Repeated rows, the same doc_id
with the same text, are one group, and every row of that doc_id is marked as kept.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._shared import mapped, written

#: Counters of a partition's summary, and digests whose winners are broadcast at most (about 56 bytes each).
COUNTERS, HEAVY = 1024, 4096
#: A digest counts as heavy from this share of all rows, and from so many rows at least.
SHARE, LEAST = 1e-5, 64


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def misra_gries(batches: Iterator[pa.RecordBatch], counters: int = COUNTERS) -> Iterator[pa.RecordBatch]:
    """Misra-Gries counters over the digests of one partition: (digest, lower bound of its count)."""
    counts: dict[bytes, int] = {}
    for batch in batches:
        found = batch.column("digest").value_counts()
        for key, n in zip(found.field("values").to_pylist(), found.field("counts").to_pylist(), strict=True):
            counts[key] = counts.get(key, 0) + n
        if len(counts) > counters:  # the merge step of the summary: subtract the (counters + 1)-th largest count
            least = sorted(counts.values(), reverse=True)[counters]
            counts = {k: n - least for k, n in counts.items() if n > least}
    yield pa.RecordBatch.from_pydict({"digest": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())})


def frequent(digests: DataFrame, counters: int = COUNTERS, heavy: int = HEAVY) -> DataFrame:
    """At most `heavy` digests, among them every one that the merged summary can't rule out as the most frequent."""
    parts = mapped(digests.select("digest"), lambda it: misra_gries(it, counters), "digest binary, n long")
    return parts.groupBy("digest").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "digest").limit(heavy)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256. An empty table gives no rows."""
    rows = written(docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).cast("binary"), 256)).alias("digest")), "digests")
    total = rows.count()
    named = frequent(rows)
    least = max(LEAST, int(SHARE * total))
    # exact counts of the candidates: the broadcast is bounded by HEAVY, the aggregation starts on the map side
    winners = rows.join(F.broadcast(named.select("digest")), "digest").groupBy("digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where(F.col("group_size") >= least)
    winners = written(winners.coalesce(1), "winners")
    marked = rows.join(F.broadcast(winners), "digest", "left")
    heavy = marked.where("group_size is not null").select("id", "digest", "keep_id", "group_size")
    light = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    groups = light.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    light = light.join(groups, "digest").select("id", "digest", "keep_id", "group_size")
    return heavy.unionByName(light).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_exact_dedup": op4_exact_dedup}
ORACLE = {
    "op4_exact_dedup": """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
}
