import random
import struct

import xxhash
from pyspark.sql import functions as F

from tests.llm.helpers import clashing, documents
from tidemark.llm import line_dedup as L


def _chain(seed, data):
    return xxhash.xxh64_intdigest(data, seed)


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def shortest_runs(lines):
    """(first, last) of the runs of lines from each with words to where they reach LONG, and on to before the next one's does."""
    marks = [i for i, x in enumerate(lines) if x.strip(" ")]
    words = [min(lines[i].count(" ") + 1, L.LONG) for i in marks]
    n, stops = len(marks), []
    for k in range(n):
        total, m = 0, k
        while m < n and total + words[m] < L.LONG:
            total += words[m]
            m += 1
        stops.append(m)
    stops.append(n)
    return {(marks[k], marks[m]) for k in range(n) for m in range(stops[k], max(stops[k], stops[k + 1] - 1) + 1) if m < n}


def brute(rows, runs=False):
    """The same rule over Python lists."""
    docs = {}
    for doc_id, text in rows:
        if text is not None:
            h = _signed(_chain(42, text.encode()))
            docs[((doc_id is not None, doc_id or 0), h)] = text.split("\n")
    seen = {}
    for key, lines in docs.items():
        n = len(lines)
        hashes = [_chain(42, x.encode()) for x in lines]
        long = [x.count(" ") + 1 >= L.LONG for x in lines]
        spans = set()
        for w in L.WINDOWS:
            ends = []
            for i in range(n):
                r = _chain(42, struct.pack("<i", w))
                for k in reversed(range(w)):
                    if i - k >= 0:
                        r = _chain(r, struct.pack("<Q", hashes[i - k]))
                if _signed(r) % 2 == 0 or long[i] or i == n - 1 or long[i + 1]:
                    ends.append(i)
            for back in (1, 2):
                for k, e in enumerate(ends):
                    if k >= back - 1:
                        spans.add((ends[k - back] + 1 if k >= back else 0, e))
        if runs:
            spans |= shortest_runs(lines)
        for a, b in spans:
            body = "\n".join(lines[a : b + 1])
            if (b > a or long[a]) and len(body) >= L.LEAST_CHARS:
                seen.setdefault(body, []).append((key, a, b))
    gone = {}
    for places in seen.values():
        for key, a, b in sorted(places)[1:]:
            gone.setdefault(key, set()).update(range(a, b + 1))
    out = []
    for doc_id, text in rows:
        if text is None:
            out.append((doc_id, None, 0, 0))
            continue
        lines = text.split("\n")
        drop = gone.get(((doc_id is not None, doc_id or 0), _signed(_chain(42, text.encode()))), set())
        out.append((doc_id, "\n".join(x for i, x in enumerate(lines) if i not in drop), len(lines), len(drop)))
    return sorted(out, key=repr)


def check(df, **more):
    found = [(r["doc_id"], r["text"], r["lines_before"], r["lines_removed"]) for r in L.dedup_lines(df, **more).collect()]
    assert sorted(found, key=repr) == brute([(r["doc_id"], r["text"]) for r in df.collect()], more.get("runs", False))


def test_odd_rows(spark):
    check(documents(spark))
    check(clashing(documents(spark)))
    assert L.dedup_lines(clashing(documents(spark))).columns[: len(documents(spark).columns)] == documents(spark).columns
    assert L.dedup_lines(documents(spark, [])).collect() == []


def passages(seed=3):
    rng = random.Random(seed)
    line = lambda n: " ".join(rng.choice("abcdefghij") * rng.randint(1, 6) for _ in range(n))
    shared = [line(11) for _ in range(7)]
    para = line(60)
    rows = []
    for i in range(60):
        own = [line(8) for _ in range(rng.randint(3, 9))]
        at = rng.randint(0, len(own))
        rows.append((i, "\n".join(own[:at] + (shared if i % 3 == 0 else [para] if i % 3 == 1 else []) + own[at:]), "en", "s", 0))
    return rows, shared, para


def test_passages_go_and_clean_documents_stay(spark):
    rows, shared, para = passages()
    df = documents(spark, rows)
    check(df)
    found = {r["doc_id"]: r for r in L.dedup_lines(df).collect()}
    assert all(found[i]["text"] == rows[i][1] for i in range(60) if i % 3 == 2)
    assert sum(para in found[i]["text"] for i in range(60)) == 1
    assert sum("\n".join(shared) in found[i]["text"] for i in range(60)) == 1
    for s in shared:
        assert any(s in r["text"] for r in found.values())


def planted(sizes, words, seed):
    """Documents of unlike lines around a passage that stands in three of them, and what should be left of each; passages of so many lines."""
    rng = random.Random(seed)
    line = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n))
    rows, left = [], {}
    for lines in sizes:
        passage = [line(words // lines + 2) for _ in range(lines)]
        for copy in range(3):
            own = [line(8) for _ in range(6)]
            at = rng.randint(0, 6)
            left[len(rows)] = "\n".join(own if copy else own[:at] + passage + own[at:])
            rows.append((len(rows), "\n".join(own[:at] + passage + own[at:]), "en", "s", 0))
    return rows, left


def test_short_passages_go_wherever_they_stand(spark, sf_dir):
    from tidemark.llm import pipeline as corpus_pipeline

    rows, left = planted([2, 3, 4] * 12, 50, 4)
    found = corpus_pipeline.drop_lines(spark, documents(spark, rows), sf_dir).collect()
    assert {r["doc_id"]: r["text"] for r in found} == left
    found = L.dedup_lines(documents(spark, rows), runs=True).collect()
    assert {r["doc_id"]: r["text"] for r in found} == left


def test_long_blocks_of_short_lines_go(spark, sf_dir):
    from tidemark.llm import pipeline as corpus_pipeline

    menu = [f"Menu {c}." for c in "abcdefghijklmnopqrstuvwxyzABCDEFGH"]  # 68 words, 7 bytes a line
    block = lambda i, lines: "\n".join([f"before {i} it", *lines, f"after {i} it"])
    rows = [(i, block(i, lines), "en", "s", 0) for i, lines in enumerate([["Wort eins."] * 58, ["Wort eins."] * 35, menu, menu, menu])]
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_lines(spark, documents(spark, rows), sf_dir).collect()}
    assert left == {0: block(0, ["Wort eins."]), 1: block(1, []), 2: block(2, menu), 3: block(3, []), 4: block(4, [])}


def test_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(df)
    check(df, runs=True)
    check(documents(spark), runs=True)


def test_plan_is_native(spark, sf_dir):
    plan = L.op6_line_dedup(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_lines_that_share_a_hash_stay(spark):
    rows, shared, para = passages()
    weak = lambda x: F.when(F.length(x) > 200, F.xxhash64(x)).otherwise(F.xxhash64(F.substring(x, 1, 1)))
    lines = {s for _, text, *_ in rows for s in text.split("\n")}
    found = L.dedup_lines(documents(spark, rows), runs=True, hashed=weak).collect()
    assert lines == {s for r in found for s in r["text"].split("\n")}
    assert sum(para in r["text"] for r in found) == 1
    assert all(r["text"] == rows[r["doc_id"]][1] for r in found if r["doc_id"] % 3 == 2)


def test_columns_named_like_the_counts(spark):
    df = documents(spark).withColumns({"lines_before": F.lit("x"), "lines_removed": F.lit("y")})
    found = L.dedup_lines(df)
    assert [c for c, t in found.dtypes if c.startswith("lines_") and t == "bigint"] == ["lines_before", "lines_removed"]
    assert L.dedup_lines(df, counts=False).columns == df.columns
    assert {r["lines_before"] for r in L.dedup_lines(df, counts=False).collect()} == {"x"}
