"""SimHash near-dedup with BK-trees.

A document's fingerprint has a bit set where over half of its shingles' XXH64 values have it set.
Distinct fingerprints are dealt into shards that any two fingerprints within the radius must share
(pigeonhole: with 2 differing bits, two of four 16-bit blocks are equal). Each shard is a BK-tree,
children keyed by their integer Hamming distance to the parent; a search follows only the edges
whose distance is within the radius of its own. A shard emits a spanning forest of its links,
never all pairs, and the links' components are found by star contraction.

A Spark broadcast is put together on the driver, so that broadcasting every shard's tree would
gather the fingerprints of all documents there; a tree is therefore built in, and sent only to,
the task that its shard key names. A key with more than SHARD_CAP fingerprints is dealt again by
the same rule over its remaining 32 bits, after which a shard can't hold more than 2**16.

Null and empty texts have fingerprint zero and link like any other; a null doc_id counts in no
minimum (component_id is null if a component has no other). Repeated rows are rows of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, groupby
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm._shared import drop_written, hot_join, mapped, signed, slices, written
from tidemark.llm.components import components

SEED = 42
SHARD_CAP = 4096
_CHUNK = 1 << 15


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Unsigned XXH64 of every shingle of `size` words, repeats included; the whole sequence if it has fewer words."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and white space \x20 \x09-\x0D only
    if not words:
        return np.zeros(0, np.uint64)
    join, digest = b" ".join, xxhash.xxh64_intdigest
    if len(words) < size:
        return np.array([digest(join(words), SEED)], np.uint64)
    return np.fromiter((digest(join(w), SEED) for w in zip(*(words[i:] for i in range(size)), strict=False)), np.uint64, len(words) - size + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set where over half of the values have it set; 0 for none."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(hashes[at : at + _CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big")


class BKTree:
    """Integers by Hamming distance; each node's children are keyed by their distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """The node of value, which is new unless the tree has it."""
        new = len(self.values)
        if not new:
            self.values.append(value)
            self.children.append({})
            return 0
        at = 0
        while True:
            distance = (self.values[at] ^ value).bit_count()
            if not distance:
                return at
            step = self.children[at].get(distance)
            if step is None:
                self.children[at][distance] = new
                self.values.append(value)
                self.children.append({})
                return new
            at = step

    def within(self, value: int, radius: int) -> list[tuple[int, int]]:
        """(distance, node) of all nodes within the radius, nearest first."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            distance = (self.values[at] ^ value).bit_count()
            if distance <= radius:
                found.append((distance, at))
            if self.children[at]:
                todo += [child for edge, child in self.children[at].items() if distance - radius <= edge <= distance + radius]
        return sorted(found)


class _Forest:
    """Union-find over the nodes of a shard."""

    def __init__(self) -> None:
        self.up: list[int] = []

    def add(self) -> int:
        self.up.append(len(self.up))
        return len(self.up) - 1

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x


def shard_links(rows: Iterator[tuple[int, int, object]], radius: int, same: Callable | None = None) -> Iterator[tuple[int, int]]:
    """A spanning forest of one shard's links: rows are (id, fingerprint, evidence); same(x, y) decides a candidate pair's link from their evidence."""
    tree, forest, members = BKTree(), _Forest(), []  # members: of each node, the (forest index, id, evidence) at its value
    for uid, value, evidence in rows:
        me = forest.add()
        for _, node in tree.within(value, radius):
            for other, other_id, other_evidence in members[node]:
                if forest.root(other) != forest.root(me) and (same is None or same(evidence, other_evidence)):
                    forest.up[forest.root(me)] = forest.root(other)
                    yield uid, other_id
        node = tree.add(value)
        if node == len(members):
            members.append([])
        members[node].append((me, uid, evidence))


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[Iterator[dict]]:
    """The runs of rows with equal keys of a sorted partition, each to be read before the next."""
    rows = (row for batch in batches for piece in slices([batch], None) for row in piece.to_pylist())
    for _, run in groupby(rows, key=lambda r: tuple(r[k] for k in keys)):
        yield run


def _emit(links: Iterator[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    a, b = [], []
    for x, y in links:
        a.append(x)
        b.append(y)
        if len(a) == 8192:
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
            a, b = [], []
    yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _blocks(value: Column, width: int, count: int) -> list[Column]:
    return [F.shiftrightunsigned(value, width * i).bitwiseAND(F.lit((1 << width) - 1)) for i in range(count)]


def _pairs(blocks: list[Column], width: int) -> Column:
    """The keys of all pairs of blocks: the pair's number above the two blocks' bits."""
    return F.array(*[F.lit(n << (2 * width)).bitwiseOR(F.shiftleft(blocks[i], width)).bitwiseOR(blocks[j]) for n, (i, j) in enumerate(combinations(range(len(blocks)), 2))])


def _rest(value: Column, pair: Column) -> Column:
    """The 32 bits of the two 16-bit blocks that the pair's number leaves out."""
    blocks = _blocks(value, 16, 4)
    out = F.lit(None).cast("long")
    for n, (i, j) in enumerate(combinations(range(4), 2)):
        x, y = (k for k in range(4) if k not in (i, j))
        out = F.when(pair == n, F.shiftleft(blocks[x], 16).bitwiseOR(blocks[y])).otherwise(out)
    return out


def fingerprint_links(values: DataFrame, cap: int = SHARD_CAP) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints `fp` at 2 or fewer differing bits."""
    radius = 2

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _emit(link for run in grouped(batches, ["key", "sub"]) for link in shard_links(((r["fp"], r["fp"] & (1 << 64) - 1, None) for r in run), radius))

    def linked(shards: DataFrame) -> DataFrame:
        return mapped(shards.select("key", "sub", "fp").repartition("key", "sub").sortWithinPartitions("key", "sub", "fp"), search, "a long, b long")

    dealt = values.select("fp", F.explode(_pairs(_blocks(F.col("fp"), 16, 4), 16)).alias("key"))
    sizes = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    dealt = written(dealt.join(sizes, "key"), "shards")
    first = dealt.where(F.col("n") <= cap).withColumn("sub", F.lit(0).cast("long"))
    again = dealt.where(F.col("n") > cap)
    again = again.select("key", "fp", F.explode(_pairs(_blocks(_rest(F.col("fp"), F.shiftrightunsigned("key", 32)), 8, 4), 8)).alias("sub"))
    return linked(first.unionByName(again.select("key", "fp", "sub"), allowMissingColumns=True))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint as a signed LONG."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            values = [signed(fingerprint(shingle_hashes(t, shingle))) for t in piece.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(values, pa.int64())], names=["id", "fp"])

    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return mapped(docs, apply, "id long, fp long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row per input row: id_col, fingerprint (16 hex digits), component_id (the least id reachable over links of 2 or fewer bits)."""
    rows = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    values = written(rows.groupBy("fp").agg(F.min("id").alias("least")), "values")
    roots = written(components(fingerprint_links(values)), "roots")
    linked = roots.unionByName(roots.select(F.col("root").alias("a"), "root").distinct())
    named = linked.join(values, linked["a"] == values["fp"]).groupBy("root").agg(F.min("least").alias("component"))
    named = linked.join(named, "root").select(F.col("a").alias("fp"), "component")
    values = written(values.join(named, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id")), "components")
    return hot_join(rows, values, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Bands of two minimum hashes that deal near-duplicate candidates into shards, and the tree's radius there.
BANDS, VERIFIED_RADIUS, VERIFIED_CAP = 5, 20, 2000
#: Texts of a large key that all its other texts are compared with first.
PIVOTS = 16
_ODD = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) + 2 * k * k & (1 << 64) - 1 | 1 for k in range(2 * BANDS)], np.uint64)


def _band_keys(hashes: np.ndarray) -> list[int]:
    least = []
    for k, odd in enumerate(_ODD):
        mixed = (hashes ^ (hashes >> np.uint64(29))) * odd
        least.append(int((mixed ^ (mixed >> np.uint64(32))).min()))
    return [signed(xxhash.xxh64_intdigest(b"%d %d %d" % (k, least[2 * k], least[2 * k + 1]), SEED)) for k in range(BANDS)]


def alike(x: bytes, y: bytes, similarity: float) -> bool:
    """Whether the Jaccard similarity of two sets, sorted unsigned 32-bit values, is at least `similarity`."""
    a, b = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def _first_blocks(big: DataFrame, cap: int) -> DataFrame:
    """(key, low, high, side, uid, fp): a large key's texts in blocks of about half the cap, each with the key's PIVOTS first texts beside its own, all to be compared."""
    count = F.ceil(F.col("n") / max(1, cap // 2)).cast("int")
    rows = big.select("key", "uid", "fp", count.alias("m"), F.xxhash64("uid").alias("tie")).withColumn("block", F.pmod("tie", "m").cast("int"))
    near = F.row_number().over(Window.partitionBy("key", "block").orderBy("tie"))
    few = rows.withColumn("r", near).where(F.col("r") <= PIVOTS).withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("tie"))).where(F.col("r") <= PIVOTS)
    sent = few.select("key", "uid", "fp", "block", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("there")).where("there <> block").select("key", "uid", "fp", F.col("there").alias("block"))
    both = rows.select("key", "uid", "fp", "block").unionByName(sent)
    return both.select("key", F.col("block").cast("long").alias("low"), F.col("block").cast("long").alias("high"), F.lit(0).alias("side"), "uid", "fp")


def _block_pairs(dealt: DataFrame, cap: int, similarity: float) -> DataFrame:
    """(key, low, high, side, uid, fp): shards of about `cap` texts in which any two texts of a key meet whose set sizes allow the similarity and which aren't both `main`.

    A key's texts are dealt by size into buckets so wide that similar texts are in the same or in neighbouring
    ones, each bucket into its main texts, which are known to be one component, and the others, and these into
    blocks by hash; a shard is a block, or two blocks whose texts are compared across only.
    """
    dealt = dealt.withColumn("part", 2 * F.floor(F.log(F.col("size")) / log(1.01 / similarity)) + F.when(F.col("main"), 0).otherwise(1))
    counts = dealt.groupBy("key", "part").agg(F.ceil(F.count(F.lit(1)) / max(1, cap // 2)).cast("int").alias("m"))
    blocks = counts.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("part", "m"))).alias("blocks"))
    code = lambda part, block: F.shiftleft(part, 32) + block
    first = 2 * F.floor(F.col("part") / 2)  # of the own bucket

    def there(step: int, other: int) -> Column:
        part = (first + 2 * step + other).cast("long")
        many = F.when(F.col("main") & F.lit(other == 0), 0).otherwise(F.coalesce(F.col("blocks")[part], F.lit(0)))
        return F.transform(F.array_repeat(part, many), code)

    rows = hot_join(dealt, written(blocks, "blocks"), "key")
    rows = rows.withColumn("own", code(F.col("part"), F.pmod(F.xxhash64("uid"), F.col("blocks")[F.col("part")])))
    rows = rows.select("key", "uid", "fp", "own", F.explode(F.concat(*[there(step, other) for step in (-1, 0, 1) for other in (0, 1)])).alias("other"))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return rows.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), side.alias("side"), "uid", "fp")


def _with_main(big: DataFrame, roots: DataFrame) -> DataFrame:
    """big with `main`: whether a text is in the largest component that its key's texts have so far."""
    known = big.join(roots.select(F.col("a").alias("uid"), "root"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    known = written(known, "known")
    main = known.groupBy("key", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("key").agg(F.max_by("root", F.struct("k", "root")).alias("top"))
    return hot_join(known, written(main, "main"), "key").withColumn("main", F.col("root") == F.col("top"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, cap: int = VERIFIED_CAP) -> DataFrame:
    """(id, h, keep_id, keep_h) of every distinct (doc_id, text hash): the row of its group that stays, the smallest (null last).

    Texts link if their sets of shingles have a Jaccard similarity of at least `similarity`, decided
    exactly on each candidate pair (on 32-bit hashes of the shingles). Fingerprints alone can't find
    such pairs (they differ in about ten bits at 0.8), so that shards are dealt by bands of two
    minimum hashes of the shingles, of which two texts at 0.8 share one of five with probability 0.994;
    within a shard the BK-tree proposes fingerprints within VERIFIED_RADIUS bits, nearest first. The
    fingerprint is of the distinct shingles here, since the similarity doesn't count repeats either.
    A key of more than `cap` texts is compared in blocks and with PIVOTS of its texts first, which makes
    one component of a group of copies, however large; only texts outside the key's largest component
    are then compared with all others, as pairs of blocks, so that a key's size decides no link.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            rows: list[tuple] = []
            for text in piece.column("text").to_pylist():
                hashes = shingle_hashes(text, shingle)
                uid = signed(xxhash.xxh64_intdigest(hashes.tobytes(), SEED))
                once = np.unique(hashes)
                distinct = np.unique(once.astype(np.uint32)).astype("<u4")
                rows.append((uid, signed(fingerprint(once)), _band_keys(once) if len(once) else [], len(distinct), distinct.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [piece.column("id"), piece.column("h"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.binary())))], names=["id", "h", "uid", "fp", "bands", "size", "shingles"]
            )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def same(x: tuple[int, bytes], y: tuple[int, bytes]) -> bool:
            return (x[0] != y[0] or not x[0]) and alike(x[1], y[1], similarity)

        def links() -> Iterator[tuple[int, int]]:
            for run in grouped(batches, ["key", "low", "high"]):
                yield from shard_links(((r["uid"], r["fp"] & (1 << 64) - 1, (r["side"], r["shingles"])) for r in run), VERIFIED_RADIUS, same)

        return _emit(links())

    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    signs = written(mapped(keyed, sign, "id long, h long, uid long, fp long, bands array<long>, size int, shingles binary"), "signatures")
    texts = signs.groupBy("uid").agg(F.min("fp").alias("fp"), F.min("bands").alias("bands"), F.min("size").alias("size"))
    dealt = texts.select("uid", "fp", "size", F.explode("bands").alias("key"))
    sizes = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    dealt = written(dealt.join(sizes, "key"), "shards")
    sets = signs.groupBy("uid").agg(F.min("shingles").alias("shingles")).join(dealt.select("uid").distinct(), "uid", "left_semi")

    def linked(shards: DataFrame) -> DataFrame:
        rows = shards.join(sets, "uid").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "uid")
        return mapped(rows.select("key", "low", "high", "side", "uid", "fp", "shingles"), search, "a long, b long")

    whole = dealt.where(F.col("n") <= cap).select("key", *[F.lit(0).cast("long").alias(c) for c in ("low", "high")], F.lit(0).alias("side"), "uid", "fp")
    big = dealt.where(F.col("n") > cap)
    if big.isEmpty():
        roots = written(components(linked(whole)), "roots")
    else:
        first = written(linked(whole.unionByName(_first_blocks(big, cap))), "links")
        known = _with_main(big, components(first))
        roots = written(components(first.unionByName(linked(_block_pairs(known, cap, similarity)))), "roots")
        drop_written(first)
    drop_written(dealt)
    place = F.struct(F.col("id").isNull().alias("null"), "id", "h")
    # texts to their groups, then groups to the row that stays; both ways a large group's rows are spread
    own = signs.groupBy("uid").agg(F.min(place).alias("least")).join(roots, F.col("uid") == F.col("a"), "left")
    own = written(own.select("uid", "least", F.coalesce("root", "uid").alias("root")), "groups")
    kept = written(own.groupBy("root").agg(F.min("least").alias("keep")), "kept")
    texts = hot_join(own.select("uid", "root"), kept, "root").select("uid", "keep")
    return hot_join(signs.select("id", "h", "uid"), written(texts, "texts"), "uid").select("id", "h", F.col("keep.id").alias("keep_id"), F.col("keep.h").alias("keep_h")).distinct()


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs that stay: one of each group of near duplicates. Texts without words are one group."""
    found = near_duplicates(docs, id_col, text_col, shingle, similarity)
    gone = found.where(~(F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("h") == F.col("keep_h")))).select(F.col("id").alias("_id"), F.col("h").alias("_h"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"))
    rows = rows.join(gone, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left_anti")
    own = rows.withColumn("place", F.row_number().over(Window.partitionBy("id", "h").orderBy("h")))  # of repeated rows one
    return own.where("place = 1").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op1_simhash": op1_simhash}
