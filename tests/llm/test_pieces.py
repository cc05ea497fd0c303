import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from texts import odd_documents, odd_texts, words

from clickloom.llm.pieces import DoubleArray, Pieces, decoded, encode
from clickloom.llm.text import Memo, tokenizer_file

MODEL = tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return Pieces(MODEL)


@pytest.fixture(scope="module")
def reference(pieces):
    """The public library's unigram model with the same pieces and scores."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(MODEL, "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = proto.TrainerSpec.UNIGRAM
    for piece, score in zip(model.pieces, pieces.scores, strict=True):
        piece.score = score
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def segmented(pieces, text):
    stems = Memo(lambda stem: pieces.best(stem.replace(b" ", "▁".encode())))
    found = [pieces.best_of_run(run, stems)[0] for run in pieces.runs(text.encode())]
    return [i for ids in found for i in np.frombuffer(ids, "<i4").tolist()]


def test_same_as_the_library(pieces, reference):
    texts = [t for t in odd_texts() if t and len(t) < 2000]
    texts += [" ".join(words(30, seed)) + "." * (seed % 5) for seed in range(40)]
    texts += ["  two  spaces ", "a\nb\n\nc", "don't, stop... (now)!", "x▁y ▁ z", "123 4.5 €"]
    for text in texts:
        expected, found = reference.encode(text), segmented(pieces, text)
        if found != expected:  # only ever another path of the same score
            total = [sum(pieces.scores[i] for i in ids) for ids in (expected, found)]
            assert total[0] == pytest.approx(total[1], abs=1e-3), text
        assert pieces.speak(found) == reference.decode(expected)


def test_brute_force_over_all_segmentations(pieces):
    def every(text):
        if not text:
            return [0.0]
        totals = []
        for end in range(1, len(text) + 1):
            name = text[:end].encode()
            node = 0
            for byte in name:
                child = pieces.trie.base[node] + byte + 1
                if child >= len(pieces.trie.check) or pieces.trie.check[child] != node:
                    node = -1
                    break
                node = child
            if node > 0 and pieces.trie.value[node] >= 0:
                totals += [pieces.scores[pieces.trie.value[node]] + rest for rest in every(text[end:])]
        return totals

    for text in ["▁the", "▁anders", "▁einver", "▁a.b"]:
        assert pieces.best(text.encode())[1] == pytest.approx(max(every(text)))


def test_double_array():
    words_ = {b"a": 1, b"ab": 2, b"abc": 3, b"b": 4, b"\xff\x00": 5, b"": 0}
    trie = DoubleArray({word: value for word, value in words_.items() if word})

    def value(word):
        node = 0
        for byte in word:
            child = trie.base[node] + byte + 1
            if child >= len(trie.check) or trie.check[child] != node:
                return -1
            node = child
        return trie.value[node]

    assert [value(w) for w in (b"a", b"ab", b"abc", b"b", b"\xff\x00", b"\xff", b"c", b"abcd")] == [
        1, 2, 3, 4, 5, -1, -1, -1,
    ]


def test_round_trip(spark):
    docs = odd_documents(spark)
    found = encode(docs, MODEL, with_decoded=True, most_known=10)
    names = {"ids", "n_pieces", "n_byte_pieces", "log_score", "decoded"}
    assert set(docs.columns) | names == set(found.columns)
    rows = found.withColumn("said", decoded(F.col("ids"), MODEL)).collect()
    for row in rows:
        # The marker itself cannot be told from a space.
        assert row["said"] == row["decoded"] == (row["text"] or "").replace("▁", " ")
        assert row["n_pieces"] == len(row["ids"])
        assert row["n_byte_pieces"] > 0 or not any(c in (row["text"] or "") for c in "\n\t\x0b")


def test_decoding_odd_ids(spark):
    frame = spark.createDataFrame([([],), (None,), ([0, 1, 2],), ([259 + 6],), ([3 + 0xC3],)], "ids array<int>")
    found = [row[0] for row in frame.select(decoded(F.col("ids"), MODEL)).collect()]
    assert found[:2] == ["", None]
    assert found[2] == "⁇ " and found[4] == "�"


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert encode(docs, MODEL).collect() == []
