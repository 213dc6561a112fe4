"""The Merkle manifest against plain recursion, on whole tables and edge rows."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from granary.llm import merkle

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, tree int, root string, idx long"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h("".join(map(field, (row["doc_id"], row["source"], row["lang"], row["n_chars"], text))))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i:i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def path_of(levels, i):
    path = []
    for level in levels[:-1]:
        start = i - i % 8
        path.append(("".join(level[start:i]), "".join(level[i + 1:start + 8])))
        i //= 8
    return path


def by_hand(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r["lang"], []).append((r["doc_id"], leaf_of(r, r["text"]), r))
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    for t in names:
        trees[t].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    built = {t: levels_of([x[1] for x in trees[t]]) for t in names}
    upper = levels_of([built[t][-1][0] for t in names])
    out = []
    for k, t in enumerate(names):
        for i, (key, leaf, r) in enumerate(trees[t]):
            path, text = path_of(built[t], i) + path_of(upper, k), r["text"]
            if key is not None and text is not None and zlib.crc32(str(key).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            fold = leaf_of(r, text)
            for left, right in path:
                fold = h(left + fold + right)
            root = upper[-1][0]
            out.append((key, leaf, built[t][-1][0], root, h("".join(a + b for a, b in path)), fold, fold == root))
    return sorted(out, key=str)


def ours(docs):
    return sorted((tuple(r) for r in merkle.report(docs).collect()), key=str)


def edge_rows():
    rows = [(i, f"Text {i} Grüße" if i % 2 else f"all lower {i}", ["en", "de", None, "fr"][min(i % 7, 3)], "s", i, "n", 1, "r", 5)
            for i in range(700)]
    rows += [(9000, None, "lone", None, None, "n", 1, "r", 5), (None, "A", "en", "s", 1, "n", 1, "r", 5), (None, "A", "en", "s", 1, "n", 1, "r", 5),
             (None, "B", "en", "s", 1, "n", 1, "r", 5), (7, "Again", "de", "s", 2, "n", 1, "r", 5), (7, "Again", "de", "s", 2, "n", 1, "r", 5),
             (8000, "", "", "", 0, "n", 1, "r", 5), (8001, "Long " * 300_000, "en", "s", 0, "n", 1, "r", 5)]
    return rows


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert ours(docs) == by_hand([r.asDict() for r in docs.collect()])


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_edge_rows_at_any_block_size(spark, levels, monkeypatch):
    docs = spark.createDataFrame(edge_rows(), SCHEMA).repartition(5)
    later = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    rows = merkle.manifest(docs, found={"text": merkle.ascii_lower(F.col("text"))}, where=later, levels=levels)
    got = rows.select("key", "leaf", "subroot", "root", merkle.folded(F.coalesce("found", "leaf"), F.col("path")).alias("fold")).collect()
    want = [(k, a, b, c, f) for k, a, b, c, _, f, _ in by_hand([r.asDict() for r in docs.collect()])]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_one_row_and_no_row(spark):
    one = spark.createDataFrame([(5, "X", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    (row,) = merkle.report(one).collect()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == h("")
    assert merkle.report(one.where("doc_id < 0")).collect() == []


def test_a_proof_fails_where_text_changed(spark):
    docs = spark.createDataFrame(edge_rows()[:100], SCHEMA)
    for r, (key, *_) in zip(sorted(merkle.report(docs).collect(), key=lambda r: r.doc_id), edge_rows()[:100]):
        assert r.verified == (zlib.crc32(str(key).encode()) % 3 != 0 or key % 2 == 0)
