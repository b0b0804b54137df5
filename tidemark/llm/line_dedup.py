"""Line dedup over content-defined chunks of lines; DataFrame functions only.

A text's lines are hashed, and a rolling hash over the last one or two line hashes (each of WINDOWS
is a chunking of its own) chooses the lines that end a chunk, so that an insertion moves no boundary
beyond the chunks it touches. A line of LONG words or more is a chunk by itself. Considered are
chunks of two lines or more, also two neighbouring chunks taken together, and the long lines.
With `runs`, as in the query and the pipeline, considered are also the runs of lines from each line
to where they reach LONG words, and on to the last line before the next line's run does; whatever
passage of LONG words or more is repeated is covered by such runs of its own, wherever boundaries are.

The texts are cut once, and the chunks' places and hashes written. Chunks whose hash occurs once
anywhere are done with after one aggregation of bare hashes. A repeated chunk's first place (the
smallest doc_id, then text hash and line) stays; elsewhere its lines go if they are the same lines
as there: the sequences of line hashes are compared, and that a line hash stands for the same bytes
wherever it matters is found by comparing the lines themselves, each distinct one once, the copies
being aggregated where they are read. A chunk with a line whose hash another line shares stays
unless no such line is in it. The first place where a line stands is in no removed chunk, so no
line is lost altogether. Chunks of fewer than LEAST_CHARS characters, such as blank lines, stay.

A null text stays null and an empty one empty; a null doc_id counts as the smallest; rows with the
same doc_id and text are one document, each of whose rows gets the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._shared import drop_written, hot_join, written

WINDOWS, LONG, LEAST_CHARS = (1, 2), 50, 40
#: Lines that are looked at first for where a run reaches LONG words; where they don't, LONG lines are.
FEW = 6


def _numbered(array: Column) -> Column:
    return F.sequence(F.lit(0), F.size(array) - 1)


def _code(start: Column, stop: Column) -> Column:
    """A run of lines as one LONG, which arrays compare by hash and not all with all."""
    return F.shiftleft(start.cast("long"), 32) + stop


def _start(place: Column) -> Column:
    return F.shiftright(place, 32).cast("int")


def _stop(place: Column) -> Column:
    return place.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")


def _chunks(ends: Column) -> Column:
    """The chunks that end at the given lines, and each two neighbours together."""
    before = lambda k, back: F.coalesce(F.get(ends, k - back), F.lit(-1)) + 1
    single = F.transform(ends, lambda e, k: _code(before(k, 1), e))
    double = F.transform(ends, lambda e, k: _code(before(k, 2), e))
    return F.concat(single, F.slice(double, 2, F.greatest(F.size(ends) - 1, F.lit(0))))


def _runs(marks: Column, stops: Column) -> Column:
    """The shortest runs of LONG words: marks are the lines with words, stops the place among them where the run from each ends, their number if nowhere."""
    last = F.size(marks)
    ends = lambda s, k: F.filter(F.sequence(s, F.greatest(s, F.coalesce(F.get(stops, k + 1), last) - 1)), lambda m: m < last)
    return F.flatten(F.transform(stops, lambda s, k: F.transform(ends(s, k), lambda m: _code(F.get(marks, k), F.get(marks, m)))))


def _stops(words: Column) -> Column:
    """Where the run from each place reaches LONG words; words are 1 to LONG at each place."""
    step = 1000  # above the words of a run, its length
    reached = lambda total: F.pmod(total, F.lit(step)) >= LONG
    run = lambda k, most: F.aggregate(F.slice(words, k + 1, most), F.lit(0), lambda total, x: F.when(reached(total), total).otherwise(total + step + x))
    end = lambda k, total, other: F.when(reached(total), k + F.floor(total / step).cast("int") - 1).otherwise(other)
    found = F.transform(words, lambda x, k: F.when(x >= LONG, k).otherwise(end(k, run(k, FEW), F.lit(-1))))
    return F.transform(found, lambda at, k: F.when(at >= 0, at).otherwise(end(k, run(k, LONG), F.size(words))))


def line_hash(line: Column) -> Column:
    return F.xxhash64(line)


def _blanks(text: Column, mark: str) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(mark), F.lit("")))


def chunked(docs: DataFrame, runs: bool = False, hashed: Callable[[Column], Column] = line_hash) -> DataFrame:
    """docs with id, text as (id, h, hashes, chunks): the text's hash, its lines' hashes, and an array of (chunk, place), the hash of each chunk considered and its first and last line as a code."""
    rows = docs.where("text is not null").select("id", F.xxhash64("text").alias("h"), F.split("text", "\n", -1).alias("lines"))
    words = F.transform("lines", lambda x: (_blanks(x, " ") + 1) * F.when(F.trim(x) == "", -1).otherwise(1))  # negative: blanks alone
    rows = rows.select("id", "h", F.transform("lines", hashed).alias("hashes"), F.transform("lines", lambda x: F.length(x)).alias("sizes"), words.alias("words"))
    long = lambda i: F.abs(F.get("words", i)) >= LONG
    found = []
    for window in WINDOWS:
        rolled = lambda i, w=window: F.xxhash64(F.lit(w), *[F.get("hashes", i - k) for k in reversed(range(w))])
        ends = F.filter(_numbered(F.col("hashes")), lambda i: (F.pmod(rolled(i), F.lit(2)) == 0) | long(i) | F.coalesce(long(i + 1), F.lit(True)))
        rows = rows.withColumn(f"ends{window}", ends)
        found.append(f"ends{window}")
    wanted = [_chunks(F.col(c)) for c in found]
    if runs:
        rows = rows.withColumn("marks", F.filter(_numbered(F.col("words")), lambda i: F.get("words", i) > 0))
        rows = rows.withColumn("own", F.transform("marks", lambda i: F.least(F.get("words", i), F.lit(LONG))))
        rows = rows.withColumn("stops", _stops(F.col("own")))
        wanted.append(_runs(F.col("marks"), F.col("stops")))
    rows = rows.withColumn("places", F.array_distinct(F.concat(*wanted)))
    size = lambda p: F.aggregate(_part(F.col("sizes"), p), F.lit(-1), lambda a, x: a + x + 1)
    kept = F.filter("places", lambda p: ((_stop(p) > _start(p)) | long(_start(p))) & (size(p) >= LEAST_CHARS))
    return rows.select("id", "h", "hashes", F.transform(kept, lambda p: F.struct(F.xxhash64(_part(F.col("hashes"), p)).alias("chunk"), p.alias("place"))).alias("chunks"))


def _part(array: Column, place: Column) -> Column:
    return F.slice(array, _start(place) + 1, _stop(place) - _start(place) + 1)


def repeated(docs: DataFrame, runs: bool = False, hashed: Callable[[Column], Column] = line_hash) -> DataFrame:
    """(id, h, chunk, place, part) of the chunks whose hash occurs again; part is the chunk's line hashes."""
    cut = written(chunked(docs, runs, hashed), "chunks")
    common = written(cut.select(F.explode("chunks.chunk").alias("chunk")).groupBy("chunk").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("chunk"), "common")
    bare = cut.select("id", "h", F.explode("chunks").alias("c")).select("id", "h", "c.*").join(common, "chunk", "left_semi")
    # their line hashes come from the documents, once for all places of one: with every place they would weigh as much as the texts
    wanted = bare.groupBy("id", "h").agg(F.collect_set(F.struct("chunk", "place")).alias("wanted"))
    own = cut.select(F.col("id").alias("_id"), F.col("h").alias("_h"), "hashes").dropDuplicates(["_id", "_h"])
    whole = F.transform("wanted", lambda c: F.struct(c["chunk"].alias("chunk"), c["place"].alias("place"), _part(F.col("hashes"), c["place"]).alias("part")))
    seen = wanted.join(own, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))).select("id", "h", F.explode(whole).alias("c")).select("id", "h", "c.*")
    seen = written(seen, "repeated")
    drop_written(cut)
    drop_written(common)
    return seen


def _marked(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """rows with the places of their repeated chunks (null: none): `gone` of those to remove, `all` of the first ones too."""
    place = F.struct("id", "h", "place")
    first = written(seen.groupBy("chunk").agg(F.min(place).alias("first"), F.min_by("part", place).alias("kept")), "first")
    same = hot_join(seen, first, "chunk").where((F.col("part") == F.col("kept")) & ~place.eqNullSafe(F.col("first"))).select("id", "h", "place", F.col("place").alias("gone"))
    marks = same.unionByName(first.select("first.*", F.lit(None).cast("long").alias("gone"))).groupBy("id", "h").agg(F.collect_set("gone").alias("gone"), F.collect_set("place").alias("all"))
    marks = marks.withColumnsRenamed({"id": "_id", "h": "_h"})
    joined = rows.join(marks, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    marked = written(joined.select("row", "text", F.when(F.size("gone") > 0, F.col("gone")).alias("gone"), "all"), "marked")
    drop_written(first)
    return marked


def _shared(marked: DataFrame, hashed: Callable[[Column], Column]) -> DataFrame:
    """The line hashes of repeated chunks that stand for lines of different bytes."""
    lines = marked.where(F.col("all").isNotNull()).select(F.split("text", "\n", -1).alias("lines"), _lines(F.col("all")).alias("all"))
    lines = lines.select(F.explode(F.transform("all", lambda i: F.struct(hashed(F.get("lines", i)).alias("line"), F.get("lines", i).alias("bytes")))).alias("c")).select("c.*")
    return written(lines.distinct().groupBy("line").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("line"), "shared")


def _lines(places: Column) -> Column:
    """The numbers of the lines in the places."""
    return F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(_start(p), _stop(p)))))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: bool = False, counts: bool = True, hashed: Callable[[Column], Column] = line_hash) -> DataFrame:
    """docs with the removed lines gone from the text column; with `counts`, the columns lines_before and lines_removed (LONG) are added, or replaced if docs has them."""
    seen = repeated(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), runs, hashed)
    # the text goes through the join once
    rows = docs.select(F.struct(*([docs[c] for c in docs.columns if c != text_col] or [F.lit(0)])).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    marked = _marked(rows, seen)
    shared = _shared(marked, hashed)
    if not shared.isEmpty():
        spoiled = seen.select("chunk", F.explode("part").alias("line")).join(shared, "line", "left_semi").select("chunk").distinct()
        marked = _marked(rows, seen.join(spoiled, "chunk", "left_anti"))
    drop_written(seen)
    lines = F.split("text", "\n", -1)
    numbered = marked.withColumn("gone", _lines(F.col("gone"))).withColumn("lines", F.when(F.col("gone").isNotNull(), lines))
    numbered = numbered.withColumn("kept", F.array_except(_numbered(F.col("lines")), F.col("gone")))
    clean = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform("kept", lambda i: F.get("lines", i)), "\n"))
    own = [c for c in docs.columns if not counts or c not in ("lines_before", "lines_removed")]
    before = F.coalesce(_blanks(F.col("text"), "\n") + 1, F.lit(0)).cast("long").alias("lines_before")
    removed = F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("lines_removed")
    return numbered.select(*[(clean.alias(c) if c == text_col else F.col("row")[c].alias(c)) for c in own], *([before, removed] if counts else []))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), runs=True)


QUERIES = {"op6_line_dedup": op6_line_dedup}
