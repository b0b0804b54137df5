import hashlib
import string

from tests.llm.helpers import clashing, documents
from tidemark.llm.exact_dedup import exact_dedup, misra_gries

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault((text or "").translate(LOWER), []).append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def check(df, rows):
    assert sorted(map(tuple, exact_dedup(df).collect()), key=repr) == brute(rows)


def test_odd_rows(spark):
    df = documents(spark)
    check(df, df.collect())
    check(clashing(df), df.collect())


def test_empty(spark):
    assert exact_dedup(documents(spark, [])).collect() == []


def test_heavy_group_is_exact(spark):
    rows = [(i, "Hot text" if i % 3 else f"text {i % 700}", "en", "s", 1) for i in range(3000)]
    df = documents(spark, rows).repartition(7)
    check(df, rows)


def test_misra_gries_keeps_the_frequent():
    import pyarrow as pa

    keys = [b"hot" if i % 3 == 0 else str(i).encode() for i in range(3000)]
    out = list(misra_gries(iter([pa.RecordBatch.from_pydict({"digest": pa.array(keys[at : at + 100], pa.binary())}) for at in range(0, 3000, 100)]), 10))[0].to_pydict()
    assert len(out["digest"]) <= 10
    found = dict(zip(out["digest"], out["n"]))
    assert 1000 - 3000 // 11 <= found[b"hot"] <= 1000
