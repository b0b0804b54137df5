import random
import re

import xxhash

from tests.llm.helpers import clashing, documents
from tidemark.llm import simhash
from tidemark.llm.components import components


def brute_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute(rows):
    prints = [brute_fingerprint(r[1]) for r in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                up[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        least.setdefault(root(i), []).append(r[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return sorted(((r[0], f"{p:016x}", least[root(i)]) for i, (r, p) in enumerate(zip(rows, prints))), key=repr)


def test_odd_rows(spark):
    df = documents(spark)
    want = brute(df.collect())
    assert sorted(map(tuple, simhash.near_groups(df).collect()), key=repr) == want
    assert sorted(map(tuple, simhash.near_groups(clashing(df)).collect()), key=repr) == want


def test_empty(spark):
    assert simhash.near_groups(documents(spark, [])).collect() == []


def test_documents_against_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert sorted(map(tuple, simhash.op1_simhash(spark, sf_dir).collect()), key=repr) == brute(rows)


def test_links_of_dense_shards_match_brute_force(spark):
    """Fingerprints around two centres: keys far over the cap are dealt again."""
    rng = random.Random(5)
    values = set()
    for centre in (0x0123456789ABCDEF, 0xFEDCBA9876543210):
        for _ in range(150):
            v = centre
            for bit in rng.sample(range(64), rng.randint(0, 4)):
                v ^= 1 << bit
            values.add(v)
    values = sorted(values)
    df = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    up = {v: v for v in values}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 2:
                up[root(a)] = root(b)
    want = {frozenset(x for x in values if root(x) == r) for r in {root(v) for v in values}}
    for cap in (4096, 3):
        found = {r["a"]: r["root"] for r in components(simhash.fingerprint_links(df, cap)).collect()}
        groups = {}
        for v in values:
            groups.setdefault(found.get(simhash.signed(v), simhash.signed(v)), set()).add(v)
        assert {frozenset(g) for g in groups.values()} == want


def test_bk_tree_search_is_exact():
    rng = random.Random(1)
    values = [rng.getrandbits(16) for _ in range(400)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:50]:
        want = sorted(v for v in set(values) if (v ^ q).bit_count() <= 3)
        assert sorted(tree.values[n] for _, n in tree.within(q, 3)) == want


def test_components_of_a_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(7, 7)]
    found = {r["a"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 41)}, **{x: 100 for x in range(101, 160)}}
