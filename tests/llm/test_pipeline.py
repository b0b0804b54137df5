import random
from array import array
from itertools import combinations

from pyspark.sql import functions as F

from tests.llm.helpers import ODD, clashing, documents
from tidemark.llm import simhash, toxicity


def shingles(text, size=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set())


def survivors(rows):
    """Of each group of linked rows, the smallest (null last)."""
    sets = [shingles(r[1]) for r in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if (not a and not b) or (a or b) and len(a & b) >= 0.8 * len(a | b):
            up[root(i)] = root(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(root(i), []).append(r[0])
    return sorted((min(v, key=lambda x: (x is None, x or 0)) for v in groups.values()), key=repr)


def near_copies(seed=7):
    rng = random.Random(seed)
    rows, vocabulary = [], ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    for group in range(40):
        words = rng.choices(vocabulary, k=rng.choice([8, 40, 200, 600]))
        for _ in range(rng.choice([1, 1, 2, 3, 12])):
            own = list(words)
            for _ in range(rng.choice([0, 1, 1, len(words) // 60])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(own), "en", "s", 0))
    return rows


def test_near_dedup_stage(spark):
    rows = near_copies()
    found = [r["doc_id"] for r in simhash.deduplicate(documents(spark, rows).repartition(3)).collect()]
    want = survivors(rows)
    assert set(want) <= set(found)
    assert len(found) <= len(want) * 1.02 + 1  # a pair of little over 0.8 is missed with probability 0.006
    assert kept(spark, rows, 4) == sorted(found, key=repr)


def templates(count, words, own, changed, seed):
    """count texts of one template, unlike each other, and of each a copy with some of its own words changed."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(8))
    shared, rows = [word() for _ in range(words - own)], []
    for _ in range(count):
        text = shared + [word() for _ in range(own)]
        copy = text[:-changed] + [word() for _ in range(changed)]
        rows += [(len(rows), " ".join(text), "en", "s", 0), (len(rows) + 1, " ".join(copy), "en", "s", 0)]
    return rows


def kept(spark, rows, cap):
    found = simhash.near_duplicates(documents(spark, rows).repartition(3), cap=cap)
    return sorted((r["id"] for r in found.where("id = keep_id").collect()), key=repr)


def test_oversized_shards_are_compared_whole(spark):
    rows = templates(60, 100, 30, 2, 5)
    want = survivors(rows)
    assert len(want) == 60
    assert kept(spark, rows, 10**6) == want
    assert kept(spark, rows, 6) == want


def test_size_of_a_shard_decides_no_link(spark):
    rows = templates(400, 100, 40, 10, 1)  # copies at 0.83
    assert kept(spark, rows, 8) == kept(spark, rows, 10**6)


def test_repeats_within_a_text_decide_no_link(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(8))
    rows = []
    for _ in range(20):
        text, sentence = " ".join(word() for _ in range(200)), " ".join(word() for _ in range(20))
        for times in (1, 50):
            rows.append((len(rows), " ".join([text] + [sentence] * times), "en", "s", 0))
    assert kept(spark, rows, 2000) == survivors(rows)


def test_near_dedup_odd_rows(spark):
    for df in (documents(spark), clashing(documents(spark))):
        found = simhash.deduplicate(df)
        assert found.columns == df.columns
        assert sorted((r["doc_id"] for r in found.collect()), key=repr) == survivors(ODD)
    assert simhash.deduplicate(documents(spark, [])).collect() == []


def test_stages(spark, sf_dir):
    from tidemark.llm import pipeline as corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "simhash_near_dedup", "secret_scan", "packing"]
    rows = docs.unionByName(spark.createDataFrame(ODD, docs.schema))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, sf_dir)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
        kept = out.collect()
        before = rows.collect()
        if name in ("line_dedup", "secret_scan"):
            assert len(kept) == len(before)
        if name == "simhash_near_dedup":
            assert len(kept) >= len(survivors([tuple(r) for r in before]))
        rows = spark.createDataFrame(kept, docs.schema)
    pieces = corpus_pipeline.STAGES[-1][1](spark, rows, sf_dir)
    assert pieces.agg(F.countDistinct("doc_id")).first()[0] == rows.agg(F.countDistinct("doc_id")).first()[0]
    empty = spark.createDataFrame([], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).collect() == []


def test_run(spark, sf_dir):
    """Every document's tokens against the stages done one text at a time in plain Python."""
    from tests.llm.test_line_dedup import brute
    from tests.llm.test_tokens import BYTE, ids_of
    from tidemark.llm import pipeline as corpus_pipeline
    from tidemark.llm import secret_scan
    from tidemark.llm.encoding import tokenizer_path

    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.learned_from(spark, table, sf_dir)
    rows = [(r["doc_id"], r["text"]) for r in table.collect() if float(model.scores([r["text"]])[0]) < 0.5]
    rows = [(i, text) for i, text, *_ in brute(rows, runs=True)]
    stay = set(survivors([(i, text, None, None, None) for i, text in rows]))
    by = secret_scan.prices(tokenizer_path(secret_scan.DICTIONARY))
    want = {i: ids_of(BYTE, secret_scan.redact(text, by), 0) for i, text in rows if i in stay}
    found = {}
    for r in sorted(corpus_pipeline.run(spark, sf_dir).collect(), key=lambda r: r["start"]):
        found.setdefault(r["doc_id"], []).extend(array("I", bytes(r["ids"])).tolist())
    assert found == want


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = toxicity.op8_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in rows) / len(rows)
    assert right >= 0.9
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_toxicity_odd_rows(spark, sf_dir):
    docs = documents(spark)
    for model in (toxicity.Model({}, 0.1), toxicity.learned_from(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "/root/testdata/sf0.01")):
        for df in (docs, clashing(docs)):
            assert toxicity.score(df, model).where("toxicity between 0 and 1").count() == docs.count()
        assert toxicity.score(documents(spark, []), model).collect() == []


def test_isotonic_is_monotone_and_fits():
    import numpy as np

    x = np.array([0.0, 1, 2, 3, 4, 5])
    places, values = toxicity.isotonic(x, np.array([0.0, 1, 0, 0, 1, 1]))
    assert (np.diff(values) >= 0).all()
    assert abs(np.interp(2, places, values) - 1 / 3) < 1e-9


def test_a_large_group_of_copies_is_one_component_early(spark, monkeypatch):
    """A key's texts that are one group meet a few of their own, not all of each other: rows grow with the group."""
    sent = []
    real = simhash._block_pairs

    def counted(dealt, cap, similarity):
        out = real(dealt, cap, similarity)
        sent.append(out.count())
        return out

    monkeypatch.setattr(simhash, "_block_pairs", counted)
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(8))
    base = [word() for _ in range(150)]
    for n in (200, 800):
        rows = [(i, " ".join(base[:-1] + [word()]), "en", "s", 0) for i in range(n)] + [(n, " ".join(base[:100] + [word() for _ in range(50)]), "en", "s", 0)]
        assert kept(spark, rows, 20) == survivors(rows)
    assert sent[1] < 8 * max(sent[0], 800)
