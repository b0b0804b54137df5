"""Staged, content-addressed publication of tables."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.relational import Refused


def content_digest(df: DataFrame) -> str:
    """A digest of the rows whatever their order: count, sum and exclusive or of row hashes, by column name."""
    row = F.struct(*[F.col(c) for c in sorted(df.columns)])
    low = F.pmod(F.xxhash64(row), F.lit(1 << 62))
    r = df.agg(F.count(F.lit(1)), F.sum(low.cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit(17), row))).first()
    return f"{r[0]}-{int(r[1] or 0) % (1 << 64):016x}-{(r[2] or 0) & (1 << 64) - 1:016x}"


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def publish(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Writes beside the target and renames; a target with the same content stays, another is refused. Returns the digest."""
    spark = df.sparkSession
    target, fs = _fs(spark, path)
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(staged)
    digest = content_digest(spark.read.parquet(staged))
    source, _ = _fs(spark, staged)
    if fs.exists(target):
        same = content_digest(spark.read.parquet(path)) == digest
        fs.delete(source, True)
        if not same:
            raise Refused(f"{path} holds other content")
        return digest
    fs.mkdirs(target.getParent())
    if not fs.rename(source, target):
        raise Refused(f"{path} can't be published")
    return digest


def publish_by_content(df: DataFrame, root: str) -> str:
    """Writes under a folder named by the content; the same content is written once."""
    path = f"{root.rstrip('/')}/{content_digest(df)}"
    publish(df, path)
    return path


def append_batch(df: DataFrame, root: str, batch: int) -> None:
    """One micro-batch under its own number: a batch that is sent again replaces itself."""
    df.write.mode("overwrite").parquet(f"{root.rstrip('/')}/batch={batch}")


def narrow_doubles(df: DataFrame) -> DataFrame:
    """DOUBLE columns whose every value is a FLOAT's become FLOAT."""
    doubles = [c for c, t in df.dtypes if t == "double"]
    if not doubles:
        return df
    wide = df.agg(*[F.max((~F.col(c).cast("float").cast("double").eqNullSafe(F.col(c))).cast("int")).alias(c) for c in doubles]).first()
    return df.withColumns({c: F.col(c).cast("float") for c in doubles if not wide[c]})


def compact(df: DataFrame, keys: list[str], shared_root: str, values_root: str) -> tuple[str, str]:
    """Splits a table into its keys, shared by content with other tables, and its values with the keys' hash."""
    h = F.xxhash64(*keys)
    keyed = df.withColumn("_row", h)
    if keyed.groupBy("_row").count().where("count > 1").limit(1).count():
        raise Refused("rows with equal keys can't be split")
    return publish_by_content(keyed.select("_row", *keys), shared_root), publish_by_content(keyed.drop(*keys), values_root)


def read_compacted(spark: SparkSession, shared: str, values: str) -> DataFrame:
    return spark.read.parquet(shared).join(spark.read.parquet(values), "_row").drop("_row")


def atomic_json(spark: SparkSession, path: str, value: object) -> None:
    """A manifest written beside its place and renamed over it, keys in order, so that a reader sees the old one or the new one."""
    target, fs = _fs(spark, path)
    staged, _ = _fs(spark, f"{path}.staged-{uuid.uuid4().hex}")
    out = fs.create(staged, True)
    out.write(bytearray(json.dumps(value, sort_keys=True, indent=1).encode()))
    out.hsync()
    out.close()
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(staged, target):
        raise Refused(f"{path} can't be published")


def read_json(spark: SparkSession, path: str) -> object:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def write_with_manifest(df: DataFrame, path: str, about: dict | None = None) -> str:
    """A table under `path`/rows and its manifest: columns, rows, digest and what the caller says of it."""
    digest = publish(df, f"{path.rstrip('/')}/rows")
    atomic_json(df.sparkSession, f"{path.rstrip('/')}/manifest.json", {"columns": df.dtypes, "rows": int(digest.split("-")[0]), "digest": digest, "about": about or {}})
    return digest


def read_with_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(rows, manifest), or Refused if the rows aren't the manifest's."""
    manifest = read_json(spark, f"{path.rstrip('/')}/manifest.json")
    df = spark.read.parquet(f"{path.rstrip('/')}/rows")
    if [list(c) for c in df.dtypes] != manifest["columns"] or content_digest(df) != manifest["digest"]:
        raise Refused(f"{path} isn't what its manifest says")
    return df, manifest


def write_large(df: DataFrame, path: str) -> None:
    """A wide table of floats: zstd, large row groups, and no dictionaries but for columns that aren't floats."""
    writer = df.write.option("compression", "zstd").option("parquet.block.size", str(256 << 20))
    for name, kind in df.dtypes:
        if kind in ("float", "double") or "<float>" in kind or "<double>" in kind:
            writer = writer.option(f"parquet.enable.dictionary#{name}", "false")
    writer.mode("errorifexists").parquet(path)


def write_cohort(accepted: DataFrame, excluded: DataFrame, root: str, about: dict | None = None) -> dict:
    """Accepted and excluded rows of a cohort, each published once, with a receipt of both."""
    receipt = {"accepted": publish(accepted, f"{root.rstrip('/')}/accepted"), "excluded": publish(excluded, f"{root.rstrip('/')}/excluded"), "about": about or {}}
    atomic_json(accepted.sparkSession, f"{root.rstrip('/')}/receipt.json", receipt)
    return receipt


def write_aggregates(df: DataFrame, root: str, identity: dict) -> str:
    """A window's aggregates under the hash of what they were computed from, read again bit for bit; the same identity is written once."""
    name = hashlib.sha256(json.dumps(identity, sort_keys=True).encode()).hexdigest()
    path = f"{root.rstrip('/')}/{name}"
    digest = publish(df, path)
    if content_digest(df.sparkSession.read.parquet(path)) != digest:
        raise Refused(f"{path} isn't what was written")
    return path
