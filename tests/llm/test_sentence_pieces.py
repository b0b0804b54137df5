import random
import zlib
from array import array

import pytest
import sentencepiece

from tests.llm.helpers import clashing, documents
from tidemark.llm import sentence_pieces as P
from tidemark.llm.encoding import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
TEXTS = ["", " ", "   a", "a  b   c    d        e", "x\ty\nz\r\n", "漢字 שלום \U0001f600\U0001f469‍\U0001f4bb", "a▁b ▁", "<s> </s> <unk> <0x41>", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "ab" * 300, "\x00\x01", "éé", "\n\n\n", "1234567890", "don't!!! ...", " trailing  ", " nbsp　"]


def test_equal_to_the_library(spark, sf_dir):
    rng = random.Random(4)
    texts = TEXTS + [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    texts += ["".join(rng.choice("abcde \néб.,") for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    model = P.Pieces(PATH)
    for at in range(0, len(texts), 100):
        for text, found in zip(texts[at : at + 100], model.encode(texts[at : at + 100])):
            ids = array("I", found).tolist()
            assert ids == LIBRARY.encode(text), text
            assert model.decode(ids) == text.replace("▁", " ")


def test_best_sum_of_scores_is_another_encoding():
    """Why paths are restricted to compatible ones."""
    model = P.Pieces(PATH)
    differ = 0
    for word in ("▁international", "▁thereafter", "▁disgusting", "▁nothing", "▁another"):
        best = [(0.0, [])]
        for i in range(1, len(word) + 1):
            best.append(max((best[j][0] + model.scores[word[j:i]], best[j][1] + [word[j:i]]) for j in range(i) if word[j:i] in model.scores))
        differ += best[-1][1] != model.merged(word)
    assert differ


def test_scores_decide_where_they_are_probabilities():
    """Against all segmentations, for words that share prefixes."""
    model = P.Pieces(PATH, merges=False)
    words = ["▁international", "▁internal", "▁inter", "▁thereafter", "▁therefore", "▁there", "▁q😀z"]
    found = model.learn(words)
    for word in words:
        best = [(0.0, [])]
        for i in range(1, len(word) + 1):
            best.append(max(((best[j][0] + model.scores.get(word[j:i], model.unknown), best[j][1] + [word[j:i]]) for j in range(i) if word[j:i] in model.scores or j == i - 1), key=lambda x: x[0]))
        assert found[word] == model._ids(best[-1][1])


def test_a_place_without_compatible_piece():
    model = P.Pieces(PATH)
    model.follows = lambda first, second: False
    assert model.decode(array("I", model.learn(["▁therefore"])["▁therefore"]).tolist()) == "therefore"


@pytest.mark.parametrize("more", [False, True])
def test_odd_rows(spark, more):
    df = documents(spark)
    df = clashing(df) if more else df
    want = sorted(((r["doc_id"], array("I", LIBRARY.encode(r["text"] or "")).tobytes(), (r["text"] or "").replace("▁", " ")) for r in df.collect()), key=repr)
    found = sorted(((r["doc_id"], bytes(r["ids"]), r["text"]) for r in P.decode(P.encode(df, PATH), PATH).collect()), key=repr)
    assert found == want


def test_query(spark, sf_dir):
    assert P.encode(documents(spark, []), PATH).collect() == []
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = P.op5_sentence_pieces(spark, sf_dir).collect()
    assert {r["doc_id"]: (r["n_pieces"], r["ids_crc32"]) for r in rows} == {k: (len(ids := LIBRARY.encode(t)), zlib.crc32(array("I", ids).tobytes())) for k, t in texts.items()}
