import numpy as np

from tests.llm.helpers import clashing, documents
from tidemark.llm import language_id as L

TEXTS = {"en": ["the quick brown fox jumps over the lazy dog", "this is the thing that the others think"], "de": ["der schnelle braune fuchs springt", "das ist die sache die andere denken"]}


def naive(model_texts, order, word_lists=None):
    """Interpolated Kneser-Ney over dictionaries."""
    out = {}
    alphabet = set()
    for lang, texts in model_texts.items():
        grams = [dict() for _ in range(order + 1)]
        stream = []
        for t in texts:
            stream += [0] * (order - 1) + L.symbols(t).tolist()
        alphabet |= set(stream)
        for n in range(1, order + 1):
            for i in range(n - 1, len(stream)):
                g = tuple(stream[i - n + 1 : i + 1])
                grams[n][g] = grams[n].get(g, 0) + 1
        counts = [None] * (order + 1)
        for n in range(1, order + 1):
            counts[n] = dict(grams[n])
            if n < order:
                kinds = {}
                for g in grams[n + 1]:
                    kinds[g[1:]] = kinds.get(g[1:], 0) + 1
                counts[n] = {g: kinds.get(g, 1) for g in grams[n]}
        out[lang] = counts
    return out, 1 / (1 + len(alphabet))


def naive_prob(counts, floor, gram):
    n = len(gram)
    if not n:
        return floor
    own = counts[n]
    ones, twos = sum(c == 1 for c in own.values()), sum(c == 2 for c in own.values())
    d = min(0.95, max(0.05, ones / max(1, ones + 2 * twos)))
    seen = [c for g, c in own.items() if g[:-1] == gram[:-1]]
    lower = naive_prob(counts, floor, gram[1:])
    if not seen:
        return lower
    return max(own.get(gram, 0) - d, 0) / sum(seen) + d * len(seen) / sum(seen) * lower


def test_probabilities_match_a_naive_model():
    model = L.Model(TEXTS, 3)
    counts, floor = naive(TEXTS, 3)
    text = "the fuchs xq"
    s = np.concatenate([np.zeros(2, np.uint32), L.symbols(text)])
    got = model._log_probs(s, np.arange(2, len(s)))
    for k, lang in enumerate(model.langs):
        want = [np.log(naive_prob(counts[lang], floor, tuple(s[i - 2 : i + 1].tolist()))) for i in range(2, len(s))]
        assert np.allclose(got[:, k], want, atol=1e-4)


def test_long_texts_equal_their_windows():
    model = L.Model(TEXTS, 4)
    text = "the quick fuchs " * 3000
    whole = model.entropies([text, "x", None, "1 2 3", ""])
    old = L._WINDOW
    try:
        L._WINDOW = 1000
        parts = model.entropies([text, "x", None, "1 2 3", ""])
    finally:
        L._WINDOW = old
    assert np.allclose(whole[0], parts[0]) and (whole[1] == parts[1]).all()
    assert (whole[1][2:] == 0).all()


def test_odd_rows(spark):
    model = L.Model(TEXTS)
    for df in (documents(spark), clashing(documents(spark))):
        rows = L.identify(df, model).collect()
        assert len(rows) == df.count()
        by_id = {r["doc_id"]: r for r in rows}
        assert by_id[1]["lang_pred"] == by_id[2]["lang_pred"] == by_id[3]["lang_pred"] == "und"
        assert by_id[4]["lang_pred"] == "en"
    assert L.identify(documents(spark, []), model).collect() == []
    none = L.learned(documents(spark, []).selectExpr("doc_id as id", "text", "lang"))
    assert {r["lang_pred"] for r in L.identify(documents(spark), none).collect()} == {"und"}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = L.op2_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.98


def test_sample_is_bounded_and_takes_every_label(spark):
    rows = [(i, f"text number {i} " + "ab " * (i % 9), f"l{i % 90:02d}") for i in range(900)] + [(7, "another text of the same id", "l07")] * 40
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    found = L.sampled(df, docs_each=5).collect()
    assert len({r["lang"] for r in found}) == 90 and max(r["place"] for r in found) == 5 and len(found) == 450
    small = L.sampled(df, docs_each=5, model_values=90**2 * 60).collect()
    per = {}
    for r in small:
        per[r["lang"]] = per.get(r["lang"], 0) + len(r["text"])
    assert len(per) == 90 and all(n <= 60 or sum(r["lang"] == k for r in small) == 1 for k, n in per.items())
    again = L.sampled(df.repartition(7), docs_each=5).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, found))
