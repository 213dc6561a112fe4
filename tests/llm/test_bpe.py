"""Byte-level BPE against the tiktoken library, with the tree cut finely."""

import hashlib
import random

import pyarrow as pa
import pytest
import tiktoken

from granary.llm import bpe

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vocabulary():
    path, pattern = bpe.default_vocabulary()
    return bpe.load_ranks(path), pattern


@pytest.fixture(scope="module")
def reference(vocabulary):
    ranks, pattern = vocabulary
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(7)
    alphabets = ["ab ", "aé ñ", "they're I'll 'd's ", " \n\t x", "0123456789.", "#$%&|<>", "日本語テキスト", "🙂👩‍👩‍👧", "the and that hen on "]
    yield from ["", " ", "a", "<|endoftext|>", "x" * 5000, "ab" * 3000, " " * 900 + "a", "don't" * 300, "\n \n  \n", "é" * 700 + "'" * 300]
    for _ in range(400):
        yield "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(1, 300)))
    for a in alphabets:
        yield "".join(rng.choice(a) for _ in range(2500))


@pytest.mark.parametrize("leaf,piece", [(4096, 64), (7, 2), (2, 5), (33, 16)])
def test_ids_do_not_depend_on_the_tree(vocabulary, reference, leaf, piece):
    codec = bpe.Codec(*vocabulary, leaf=leaf, piece=piece)
    for text in texts():
        ids = codec.encode(text)
        assert ids == reference.encode_ordinary(text), text[:80]
        assert codec.decode(ids) == text.encode()


def test_report_equals_the_library(spark, reference):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ours = {r["doc_id"]: r for r in bpe.report(docs).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(ours) == len(rows)
    for r in rows:
        ids = reference.encode_ordinary(r["text"] or "")
        got = ours[r["doc_id"]]
        assert got["n_tokens"] == len(ids)
        assert got["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_edge_rows_and_round_trip(spark):
    rows = [(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "a b", "y"), (3, "word " * 20_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __ids string")
    got = {(r["doc_id"], r["n_tokens"] == 0) for r in bpe.report(docs).collect()}
    assert got == {(1, True), (2, True), (None, False), (3, False)}
    docs = docs.drop("__ids")
    back = bpe.decoded(bpe.encoded(docs, ["doc_id"]), ["doc_id"]).collect()
    assert sorted(bytes(r["__bytes"]) for r in back) == sorted((t or "").encode() for _, t, _ in rows)
    assert bpe.report(docs.limit(0)).count() == 0


def test_a_task_leaves_no_pieces_in_its_worker(spark):
    docs = spark.createDataFrame([(i, f"unheardof{i} words{i}") for i in range(40)], "doc_id long, text string")

    def left(batches):
        rows = sum(b.num_rows for b in batches)
        yield pa.RecordBatch.from_pydict({"n": [rows], "kept": [len(bpe.codec(*bpe.default_vocabulary()).kept)]})

    # Both steps run in one worker each: the second finds the table that the first has left.
    assert bpe.encoded(docs.coalesce(1), ["doc_id"]).count() == 40
    assert {r["kept"] for r in spark.range(8).repartition(8).mapInArrow(left, "n long, kept long").collect()} == {0}
