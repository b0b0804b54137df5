"""Secret scans: fixed patterns, and a guess-cost dynamic programme over values in a credential's context.

The base spans are those of three patterns, leftmost and non-overlapping for each kind, a match
counting only if it is long enough. Beside them, the value that follows a credential's name, or
stands between user and host of an address, is a span of kind `guess` if guessing it is expensive:
the dynamic programme finds the cheapest segmentation into words, dates, repeats, keyboard walks,
runs of letters and brute-force spans, as log10 of the guesses they take, and the span counts from
LEAST on. A value that a base span holds too is a span of its own, which tells a password from a
placeholder after its name.

Segments and their prices (log10 of guesses; each but brute force costs STEP more where it follows another):

* a word of a ranked dictionary: its rank, 0.3 to 1 more for capitals, 0.5 for digits in place of letters;
  the dictionary is what guessers try first, then a public tokenizer's whole words, whose ids are their ranks;
* a date or year; a unit of one to four characters repeated (the unit by brute force, and REPEAT);
* a walk of three keys or more (WALK, and TURN for each change of direction);
* three letters or more, each by its probability after the one before it in the dictionary's words;
* one character by brute force.

The recurrence runs over a whole value of any length: repeats, walks and letters carry their best open
segment along, so that it looks back over a bounded window only, and it ends early where nothing in
that window can still make the value cheap.

Starts and ends are code points, ends exclusive. Null counts as empty: no spans.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._shared import bounded, in_slices, mapped, slices
from tidemark.llm.encoding import tokenizer_path

KINDS = ("assign", "access", "hex", "guess")
#: log10 of the guesses from which a value counts, and the shortest value looked at.
LEAST, SHORTEST = 10.0, 8
_FLAGS = re.ASCII | re.IGNORECASE
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _FLAGS)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # as AKIA[A-Z0-9]+ of 18 or more: a shorter match has no longer one inside
_HEX = re.compile(r"[0-9a-f]{16,}")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Names whose value, after a colon, an equals sign or a verb, is in a credential's context.
_CONTEXT = re.compile(
    r"""(?:passphrase|password|passwd|passcode|passwort|kennwort|contrase[\u00f1\u00d1n]a|pwd|secret|credentials?|token|(?:api|access|private|auth|client)[_-]?key|bearer|authorization)["']?(?:[\x20\t]*[:=]+|[\x20\t]+(?:is|ist|es|est)[\x20\t])[\x20\t]*["']?(?:bearer[\x20\t]+)?([^\s"'<>,;]+)""",
    _FLAGS,
)
_ADDRESS = re.compile(r"[a-z][a-z0-9+.-]*://[^\s:/@]+:([^\s/@]+)@", _FLAGS)
_CONTEXT_NAMES = ("pass", "pwd", "kennwort", "contrase", "secret", "credential", "token", "key", "bearer", "authorization")

#: What guessers try first, in their order.
FIRST = (
    "password admin welcome login user test guest root master letmein dragon monkey qwerty secret token changeme default sample example demo temp pass "
    "love hello summer winter spring autumn monday friday server system service account public private access key api prod dev stage local data base "
    "shadow sunshine princess football baseball superman batman trustno money freedom whatever computer internet network office company "
    "your the and for you this that with from none null true false empty string value placeholder redacted hidden here insert enter"
).split()
STEP, REPEAT, WALK, TURN = math.log10(2), 1.0, math.log10(94 * 10), math.log10(6)
_LEET = str.maketrans("0134578@$!", "oleastbasi")
_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")
_DATES = tuple(
    map(
        re.compile,
        (
            r"(?:19|20)\d\d",
            r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])",
            r"(?:0?[1-9]|[12]\d|3[01])[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:19|20)\d\d",
        ),
    )
)
_YEAR, _DAY = math.log10(120), math.log10(120 * 366)


def _steps() -> dict[tuple[str, str], tuple[int, ...]]:
    """Directions in which the second key is next to the first: along a row, down or up a column, on or back in the alphabet."""
    out: dict[tuple[str, str], list[int]] = {}
    for k, row in enumerate(_ROWS):
        kind = 0 if k < 4 else 4
        for a, b in zip(row, row[1:], strict=False):
            out.setdefault((a, b), []).append(kind)
            out.setdefault((b, a), []).append(kind + 1)
    for upper, lower in zip((_ROWS[0][1:], *_ROWS[1:3]), _ROWS[1:4], strict=True):
        for a, b in zip(upper, lower, strict=False):
            out.setdefault((a, b), []).append(2)
            out.setdefault((b, a), []).append(3)
    return {k: tuple(v) for k, v in out.items()}


_DIRECTIONS = _steps()


class Prices:
    """The ranked dictionary and the letters' probabilities in its words."""

    def __init__(self, path: str | None) -> None:
        self.rank = {w: math.log10(i + 2) for i, w in enumerate(FIRST)}
        if path is not None:
            with open(path, encoding="utf-8") as f:
                vocabulary = json.load(f)["model"]["vocab"]
            words = (t[:-4] for t, _ in sorted(vocabulary.items(), key=lambda x: x[1]) if t.endswith("</w>"))
            for w in words:
                if len(w) >= 3 and w.isascii() and w.isalpha():
                    self.rank.setdefault(w, math.log10(len(self.rank) + 2))
        self.longest = max(map(len, self.rank))
        counts = Counter(pair for w in self.rank for pair in zip(" " + w, w, strict=False))
        total = Counter()
        for (a, _), n in counts.items():
            total[a] += n
        letters = "abcdefghijklmnopqrstuvwxyz"
        self.after = {(a, b): -math.log10((counts[a, b] + 1) / (total[a] + 26)) for a in " " + letters for b in letters}


_prices: dict[str | None, Prices] = {}


def prices(path: str | None) -> Prices:
    """The worker's prices by that tokenizer's words."""
    if path not in _prices:
        _prices[path] = Prices(path)
    return _prices[path]


def _brute(c: str) -> float:
    return 1.0 if c.isdigit() else math.log10(26) if "a" <= c <= "z" or "A" <= c <= "Z" else math.log10(33) if c < "\x80" else 2.0


def _cased(value: str, low: str) -> float:
    return 0.0 if value == low else 0.3 if value[1:] == low[1:] or value.isupper() else 1.0


def guess_cost(value: str, by: Prices, enough: float = math.inf) -> float:
    """log10 of the guesses of the cheapest segmentation; any figure from `enough` on if they are as many."""
    n, rank, after, inf = len(value), by.rank, by.after, math.inf
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    clear = low.translate(_LEET)
    cost = [0.0] + [inf] * n  # of the beginning of each length
    back = max(by.longest, 10)
    letters = [inf] * 3  # open runs of one, two, and three or more letters that end here
    walks: tuple[dict[int, float], dict[int, float]] = ({}, {})  # by direction: open walks of two keys, and of three or more
    repeats = {w: [inf] * w for w in (1, 2, 3, 4)}  # by width: open repeats that end at the last places
    _dates(value, 0, cost)
    for j in range(1, n + 1):
        # what ends at j; a segment that begins at i has paid for cost[i] and, but at the beginning, STEP
        here, c = j - 1, low[j - 1]
        best = min(cost[j], cost[here] + _brute(value[here]))  # dates have been put in ahead
        # letters
        if "a" <= c <= "z":
            first = cost[here] + (STEP if here else 0.0) + after[" ", c]
            more = after.get((low[here - 1], c), inf) if here else inf
            big = 0.0 if value[here] == c else 0.5
            letters = [first + big, letters[0] + more + big, min(letters[1], letters[2]) + more + big]
            best = min(best, letters[2])
        else:
            letters = [inf] * 3
        # words
        if "a" <= clear[here] <= "z" or "a" <= c <= "z":
            for i in range(max(0, j - by.longest), j - 2):
                word = rank.get(low[i:j])
                if word is None and (word := rank.get(clear[i:j])) is not None:
                    word += 0.5
                if word is not None:
                    best = min(best, cost[i] + (STEP if i else 0.0) + word + _cased(value[i:j], low[i:j]))
        # walks
        two: dict[int, float] = {}
        three: dict[int, float] = {}
        if j > 1:
            for d in _DIRECTIONS.get((low[j - 2], c), ()):
                two[d] = cost[j - 2] + (STEP if j > 2 else 0.0) + WALK
                three[d] = min((x + (TURN if d != e else 0.0) for old in walks for e, x in old.items()), default=inf)
                best = min(best, three[d])
        walks = two, three
        # repeats: the shortest one that ends here, or an open one a unit longer
        for w, ends in repeats.items():
            found, least = inf, max(2 * w, 3)
            if j >= 2 * w and value[j - w : j] == value[j - 2 * w : j - w]:
                found = ends[j % w]
                if j >= least and value[j - w : j] == value[j - least : j - least + w]:
                    at = j - least
                    found = min(found, cost[at] + (STEP if at else 0.0) + sum(map(_brute, value[j - w : j])) + REPEAT)
            ends[j % w] = found
            best = min(best, found)
        cost[j] = best
        _dates(value, j, cost)
        if best >= enough and min(min(cost[max(0, j - back) : j + 11]), *letters, *two.values(), *three.values(), *(min(e) for e in repeats.values())) >= enough:
            return enough
    return cost[n]


def _dates(value: str, at: int, cost: list[float]) -> None:
    """Dates that begin at a place, put in where they end."""
    if value[at : at + 1].isdigit():
        for pattern in _DATES:
            if m := pattern.match(value, at):
                cost[m.end()] = min(cost[m.end()], cost[at] + (STEP if at else 0.0) + (_YEAR if m.end() - at == 4 else _DAY))


def find(text: str | None, by: Prices) -> list[tuple[int, str, int]]:
    """(start, kind, end), by start and then kind as in KINDS."""
    if not text:
        return []
    out: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    found = []
    if any(name in low for name in _CONTEXT_NAMES):
        found += _CONTEXT.finditer(text)
    if "://" in text and "@" in text:
        found += _ADDRESS.finditer(text)
    taken = set()
    for m in found:
        value = m[1].rstrip(".,:;)]}")
        span = (m.start(1), 3, m.start(1) + len(value))
        if len(value) >= SHORTEST and span not in taken and guess_cost(value, by, LEAST) >= LEAST:
            taken.add(span)
    return [(a, KINDS[k], b) for a, k, b in sorted([*out, *taken])]


def redact(text: str | None, by: Prices, mark: str = "[SECRET]") -> str | None:
    """The text with each run of overlapping spans replaced by the mark."""
    spans = find(text, by)
    if not spans:
        return text
    out, end = [], 0
    for a, _, b in spans:
        if a >= end:
            out += [text[end:a], mark]
        end = max(end, b)
    return "".join([*out, text[end:]])


_SPANS = "array<struct<kind:string,start:long,end:long>>"
#: The tokenizer whose words are the dictionary.
DICTIONARY = "word_bpe_49k.json"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dictionary: str | None = None) -> DataFrame:
    """Per row: doc_id and found, an array of (kind, start, end); dictionary is a tokenizer's file, by default the public DICTIONARY."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    path = dictionary or tokenizer_path(DICTIONARY)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = prices(path)
        for piece in slices(batches):
            found = [[{"kind": k, "start": a, "end": b} for a, k, b in find(t, by)] for t in piece.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(found, kind)], names=["doc_id", "found"])

    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return mapped(docs, apply, f"doc_id long, found {_SPANS}")


def redacted(docs: DataFrame, text_col: str = "text", dictionary: str | None = None) -> DataFrame:
    """docs with the secrets of the text column replaced."""
    path = dictionary or tokenizer_path(DICTIONARY)

    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        by = prices(path)
        for batch in batches:
            yield in_slices(batch, lambda texts: pa.array([redact(t, by) for t in texts], pa.string()), pa.string())

    return bounded(docs).withColumn(text_col, F.arrow_udf(apply, "string", F.ArrowUDFType.SCALAR_ITER)(F.col(text_col)))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.col("found")
    count = lambda kind: F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id",
        *map(count, KINDS[:3]),
        F.sha2(joined(F.filter(found, lambda s: s["kind"] != "guess")).cast("binary"), 256).alias("base_sha256"),
        joined(found).alias("spans"),
    )


QUERIES = {"op9_secret_scan": op9_secret_scan}
