"""Readers that take text first, refuse instead of repairing, and account for every row they leave out."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import columns as C
from tidemark.operators.relational import Refused

PRICE_COLUMNS = ("Open", "High", "Low", "Close", "Volume")


def read_source_csv(spark: SparkSession, path: str, numeric: list[str]) -> DataFrame:
    """A CSV file with header: every column is text, the declared numeric ones that exist become exact doubles (NULL if no number)."""
    df = spark.read.csv(path, header=True, inferSchema=False, mode="FAILFAST")
    return df.withColumns({c: C.exact_double(F.col(c)) for c in numeric if c in df.columns}) if set(numeric) & set(df.columns) else df


def compare_number_parsers(spark: SparkSession, path: str, numeric: list[str]) -> DataFrame:
    """Per column: values, those that only a lenient cast takes for numbers, and those whose doubles differ."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    long = df.unpivot([], [c for c in numeric if c in df.columns], "column", "text").where("text is not null")
    lenient, exact = F.expr("try_cast(text AS DOUBLE)"), C.exact_double(F.col("text"))
    return long.groupBy("column").agg(F.count(F.lit(1)).alias("values"), F.count_if(lenient.isNotNull() & exact.isNull()).alias("lenient_only"), F.count_if(~lenient.eqNullSafe(exact) & exact.isNotNull()).alias("differ"))


def read_prices(rows: DataFrame, calendar: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Daily prices with their availability and all reasons against each row.

    rows: Date and price columns as text; calendar: session DATE, decision TIMESTAMP. A row is accepted
    if it has no reason. Overlapping reasons are all kept; the order's relative tolerance relaxes only
    the envelope of high and low.
    """
    if not 0 <= tolerance <= 1e-6:
        raise Refused("the tolerance is at most 1e-6")
    text = rows.columns
    p = rows.select(*text, F.when(F.col("Date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.expr("try_cast(Date AS DATE)")).alias("session"), *[C.exact_double(F.col(c)).alias(f"_{c}") for c in PRICE_COLUMNS])
    o, h, low, c, v = (F.col(f"_{x}") for x in PRICE_COLUMNS)
    known = C.finite(o) & C.finite(h) & C.finite(low) & C.finite(c) & C.finite(v)
    slack = F.lit(1 + tolerance)
    valid = known & (o > 0) & (low > 0) & (c > 0) & (v >= 0) & (h * slack >= F.greatest(o, c, low)) & (low <= F.least(o, c, h) * slack)
    p = p.withColumn("_valid", F.coalesce(valid, F.lit(False))).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("session")))
    p = p.join(F.broadcast(calendar.select("session", F.col("decision").alias("available_at"))), "session", "left")  # a row for each session
    reasons = C.exclusion_reasons(("invalid_date", F.col("session").isNull()), ("duplicate_session", F.col("session").isNotNull() & (F.col("_n") > 1)), ("invalid_ohlc", ~F.col("_valid")), ("non_session", F.col("session").isNotNull() & F.col("available_at").isNull()))
    return p.select("session", *[F.col(f"_{x}").alias(x.lower()) for x in PRICE_COLUMNS], "available_at", reasons.alias("reasons"))


def exclusion_counters(prices: DataFrame) -> DataFrame:
    """Rows accepted and excluded, and rows of each reason; reasons overlap, so that they may add up to more."""
    total = prices.select(F.when(F.size("reasons") == 0, "accepted").otherwise("excluded").alias("counter"))
    return total.unionByName(prices.select(F.explode("reasons").alias("counter"))).groupBy("counter").agg(F.count(F.lit(1)).alias("rows"))


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """Facts of nested filings JSON: namespace, concept, unit and each fact, exploded level by level."""
    fact = "struct<val:double,start:string,end:string,filed:string,accn:string>"
    df = spark.read.schema(f"facts map<string,map<string,struct<units:map<string,array<{fact}>>>>>").json(path, multiLine=True)
    df = df.select(F.explode("facts").alias("namespace", "concepts")).select("namespace", F.explode("concepts").alias("concept", "c"))
    df = df.select("namespace", "concept", F.explode("c.units").alias("unit", "facts")).select("namespace", "concept", "unit", F.explode("facts").alias("f"))
    return df.select("namespace", "concept", "unit", F.col("f.val").alias("value"), F.to_date("f.start").alias("period_start"), F.to_date("f.end").alias("period_end"), F.to_date("f.filed").alias("filed"), F.col("f.accn").alias("accession"))


def read_records(spark: SparkSession, path: str, max_bytes: int = 1 << 20) -> DataFrame:
    """Lines of JSON files as records: ordinal, byte offset and length, hashes, and the state of each.

    A line over max_bytes keeps its hash and state but no payload; a line that is no UTF-8 or no JSON
    object (or one with a repeated key or NaN) is a record with that state, never dropped. Lines end with a
    line feed. Files are read by splits: a line's offset is the bytes before it in its split and those of
    the splits before, so that a file of any size is many tasks.
    """
    df = spark.read.option("lineSep", "\n").text(path)
    df = df.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.col("_metadata.file_size").alias("_size"), F.monotonically_increasing_id().alias("_id"))
    df = df.withColumn("_bytes", F.octet_length("value") + 1)
    before = Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = df.groupBy("path", "_block").agg(F.sum("_bytes").alias("_b"), F.count(F.lit(1)).alias("_n"))
    blocks = blocks.select("path", "_block", F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_offset"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("path", "_block").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({"_o": F.coalesce(F.sum("_bytes").over(inside), F.lit(0)), "_p": F.count(F.lit(1)).over(inside)}).join(blocks, ["path", "_block"])
    df = df.withColumn("byte_offset", F.col("_offset") + F.col("_o"))
    ended = F.col("byte_offset") + F.col("_bytes") <= F.col("_size")  # the last line may lack its line feed
    length = F.when(ended, F.col("_bytes")).otherwise(F.col("_bytes") - 1)
    raw, value = F.when(ended, F.concat(F.col("value").cast("binary"), F.lit(b"\n"))).otherwise(F.col("value").cast("binary")), F.col("value")
    valid = F.is_valid_utf8(value)
    body = F.when(valid, F.rtrim(value, F.lit("\r\n")).cast("binary")).otherwise(F.regexp_replace(value, "\r$", "").cast("binary"))
    state = F.when(length > max_bytes, "oversize").when(~valid, "invalid_utf8").when(F.try_parse_json(F.when(valid, value)).isNull(), "invalid_json").when(~F.ltrim(value).startswith("{"), "invalid_record").otherwise("accepted")
    df = df.select("path", (F.col("_first") + F.col("_p")).alias("ordinal"), "byte_offset", length.cast("long").alias("byte_length"), F.sha2(raw, 256).alias("raw_sha256"), F.sha2(body, 256).alias("record_sha256"), state.alias("state"), F.when(valid, F.rtrim(value, F.lit("\r\n"))).alias("payload"))
    return df.withColumn("payload", F.when(F.col("state") != "oversize", F.col("payload")))


def read_json_array(spark: SparkSession, path: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, census) of files that hold one array of objects: the declared fields as text, and per field how many rows have it, are null there or lack a number's form.

    Fields that aren't declared don't become columns, and nothing here is evidence of a publication.
    """
    schema = ", ".join(f"`{f}` string" for f in fields)
    rows = spark.read.schema(schema).option("primitivesAsString", "true").json(path, multiLine=True)
    long = rows.unpivot([], fields, "field", "text")
    census = long.groupBy("field").agg(F.count(F.lit(1)).alias("rows"), F.count("text").alias("present"), F.count_if(F.col("text").rlike(C.DECIMAL_PATTERN)).alias("numbers"))
    return rows, census


def read_parts(spark: SparkSession, folder: str) -> DataFrame:
    """A table of numbered files part-00000.parquet and on, refused if a number is missing or repeated or the files differ in their columns; `part` is the number."""
    names = [r[0] for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*.parquet").load(folder).select("path").collect()]  # names only, contents aren't read
    found = sorted(names)
    numbers = [int(re.search(r"part-(\d+)\.parquet$", n)[1]) for n in found]
    if not numbers or numbers != list(range(len(numbers))):
        raise Refused(f"parts are numbered {numbers[:5]}")
    schemas = {spark.read.parquet(n).schema.simpleString() for n in found}
    if len(schemas) > 1:
        raise Refused("the parts' columns differ")
    number = F.regexp_extract("_metadata.file_name", r"part-(\d+)\.parquet$", 1).cast("int")
    return spark.read.parquet(*found).select("*", number.alias("part"))


class _Tables(HTMLParser):
    """All tables of a page as rows of cell texts."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[str]]] = []
        self.cell: list[str] | None = None
        self.text: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.cell = []

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th") and self.cell is not None:
            self.tables[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        if self.cell is not None:
            self.cell.append(data)


def release_tables(pages: DataFrame, id_col: str, html_col: str, declared: str, archived_col: str | None = None) -> DataFrame:
    """Rows (indicator, period, value as text) of the tables of release pages: the header names periods, the first column indicators.

    `declared` is a pattern whose first group is the page's one publication date (yyyy-mm-dd); none or
    several different ones leave it NULL. A value is available from the later of that day and the archive's.
    """
    kind = dict(pages.dtypes)[id_col]
    pattern = re.compile(declared)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, html in zip(batch[id_col], batch[html_col], strict=True):
                t = _Tables()
                t.feed(html or "")
                dates = set(pattern.findall("".join(t.text)))
                day = dates.pop() if len(dates) == 1 else None
                for n, table in enumerate(t.tables):
                    header = table[0] if table else []
                    rows += [(key, day, n, line[0], header[i], cell) for line in table[1:] if line for i, cell in enumerate(line) if i and i < len(header)]
            yield pd.DataFrame(rows, columns=["key", "declared", "table", "indicator", "period", "value"])

    schema = f"key {kind}, declared string, table int, indicator string, period string, value string"
    found = pages.select(id_col, html_col).mapInPandas(parse, schema).withColumnRenamed("key", id_col).withColumn("declared", F.expr("try_cast(declared AS DATE)"))
    if archived_col is None:
        return found.withColumn("available", F.col("declared"))
    return found.join(pages.select(id_col, F.col(archived_col).alias("_archived")), id_col).withColumn("available", F.when(F.col("declared").isNotNull(), F.greatest("declared", "_archived"))).drop("_archived")


#: Bytes that a validator unpacks at most of an archive.
UNPACKED = 64 << 20


def validate_formats(files: DataFrame) -> DataFrame:
    """path, kind, state, entries of files (path, content): whether they are what their ending says, within bounds: csv, json, xml, zip and xlsx, pdf, png."""

    def one(path: str, content: bytes) -> tuple[str, str, int]:
        kind = path.rsplit(".", 1)[-1].lower()
        try:
            if kind == "csv":
                rows = list(csv.reader(io.StringIO(content.decode("utf-8-sig"))))
                return kind, "valid" if rows and len({len(r) for r in rows if r}) == 1 else "ragged", max(0, len(rows) - 1)
            if kind == "json":
                found = json.loads(content, object_pairs_hook=_strict)
                return kind, "valid", len(found) if isinstance(found, list | dict) else 0
            if kind == "xml":
                if b"<!ENTITY" in content:
                    return kind, "refused", 0
                return kind, "valid", len(list(ElementTree.fromstring(content)))
            if kind in ("zip", "xlsx"):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    entries = z.infolist()
                    if sum(e.file_size for e in entries) > UNPACKED:
                        return kind, "oversize", len(entries)
                    good = z.testzip() is None and (kind == "zip" or "[Content_Types].xml" in z.namelist())
                    return kind, "valid" if good else "invalid", len(entries)
            if kind in ("pdf", "png"):
                magic = b"%PDF-" if kind == "pdf" else b"\x89PNG\r\n\x1a\n"
                good = content.startswith(magic) and (kind != "pdf" or b"%%EOF" in content[-1024:])
                return kind, "valid" if good else "invalid", content.count(b"/Type /Page") if kind == "pdf" else 1
        except (ValueError, csv.Error, ElementTree.ParseError, zipfile.BadZipFile, RuntimeError):
            return kind, "invalid", 0
        return kind, "unknown", 0

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(p, *one(p, c or b"")) for p, c in zip(batch["path"], batch["content"], strict=True)], columns=["path", "kind", "state", "entries"])

    return files.select("path", "content").mapInPandas(check, "path string, kind string, state string, entries long")


def _strict(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("repeated key")
    return out


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Files with their kind, size, hash and header facts: PNG size, CSV columns, whether JSON is an array."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    head, name = F.substring("content", 1, 65_536), F.element_at(F.split("path", "/"), -1)
    png = F.hex(F.substring("content", 1, 8)) == "89504E470D0A1A0A"
    size = lambda at: F.when(png, F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("int"))
    text = F.regexp_replace(F.try_validate_utf8(head.cast("string")), "^﻿", "") if hasattr(F, "try_validate_utf8") else head.cast("string")
    kind = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return f.select(
        "path", kind.alias("kind"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), size(17).alias("width"), size(21).alias("height"),
        F.when(kind == "csv", F.split(F.regexp_replace(F.split(text, "\n", 2)[0], "\r$", ""), ",")).alias("columns"),
        F.when(kind == "json", F.ltrim(text).startswith("[")).alias("is_array"),
    )


def changed_files(before: DataFrame, now: DataFrame) -> DataFrame:
    """Each path's state between two inventories: new, gone, changed, same."""
    j = before.select("path", F.col("sha256").alias("_a")).join(now.select("path", F.col("sha256").alias("_b")), "path", "full")
    return j.select("path", F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "gone").when(F.col("_a") == F.col("_b"), "same").otherwise("changed").alias("state"))


def vintage_matrix(wide: DataFrame, period: str) -> DataFrame:
    """A column for each vintage to rows of period, vintage, value; absent values have none."""
    vintages = [c for c in wide.columns if c != period]
    return wide.unpivot([period], vintages, "vintage", "value").where("value is not null")


def read_bounded(spark: SparkSession, path: str, max_rows: int) -> DataFrame:
    """A Parquet table, refused by its footers if it has more rows."""
    df = spark.read.parquet(path)
    if df.count() > max_rows:  # from the footers: no column is read
        raise Refused(f"more than {max_rows} rows")
    return df


class _Article(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.canonical, self.lang, self.linked, self.paragraphs, self.links = "", None, None, [], [], 0
        self.open: list[str] = []
        self.text: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag == "html":
            self.lang = a.get("lang")
        if tag == "link" and a.get("rel") == "canonical":
            self.canonical = a.get("href")
        if tag == "a" and a.get("href"):
            self.links += 1
        if tag in ("script", "style", "title", "p", "h1"):
            self.open.append("ld" if tag == "script" and a.get("type") == "application/ld+json" else tag)
            self.text = []

    def handle_endtag(self, tag: str) -> None:
        if self.open and (self.open[-1] == tag or tag == "script" and self.open[-1] == "ld"):
            kind, text = self.open.pop(), "".join(self.text)
            if kind == "title":
                self.title = text.strip()
            elif kind == "p" and text.strip():
                self.paragraphs.append(text.strip())
            elif kind == "ld":
                self.linked.append(text)
            self.text = []

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1] not in ("script", "style"):
            self.text.append(data)


def parse_articles(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """Title, language, canonical link, linked-data author and date, paragraphs and links of pages."""
    kind = dict(pages.dtypes)[id_col]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, html in zip(batch[id_col], batch[html_col], strict=True):
                a = _Article()
                a.feed(html or "")
                meta = {}
                for text in a.linked:
                    try:
                        found = json.loads(text)
                        meta = found if isinstance(found, dict) else meta
                    except ValueError:
                        pass
                rows.append((key, a.title, a.lang, a.canonical, meta.get("datePublished"), len(a.paragraphs), sum(map(len, a.paragraphs)), a.links))
            yield pd.DataFrame(rows, columns=["key", "title", "lang", "canonical", "published", "paragraphs", "chars", "links"])

    return pages.select(id_col, html_col).mapInPandas(parse, f"key {kind}, title string, lang string, canonical string, published string, paragraphs long, chars long, links long").withColumnRenamed("key", id_col)
