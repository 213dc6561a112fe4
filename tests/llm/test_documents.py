"""The text operators on whole small tables and on edge rows, against brute force."""

import base64
import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from granary.llm import common, fingerprints, licenses, mixing, ngram_join, quality, queries, substring_dedup, toxicity, warc
from tests.compare import differences, duck, plain

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 700}" for i in range(20_000))
EDGE = [(1, None, None), (2, "", "a"), (3, "one", "a"), (3, "one", "a"), (4, " \t\n", "b"), (5, LONG, "b"), (6, LONG, "b"), (None, "x y z " * 30, "c")]


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(*r, 7, "z") for r in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_words int, node string").repartition(3)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_check_sql(spark, name):
    ours = queries.QUERIES[name](spark, SF).toPandas()
    assert differences(plain(ours), plain(duck(SF).execute(queries.ORACLE_SQL[name]).fetchdf())) is None


def dedup_by_hand(texts):
    lists = {i: words(t) for i, t in texts.items()}
    first = {}
    for i in sorted(lists):
        for k in range(len(lists[i]) - 49):
            first.setdefault(tuple(lists[i][k:k + 50]), i)
    out = {}
    for i, w in lists.items():
        gone = {q for k in range(len(w) - 49) if first[tuple(w[k:k + 50])] < i for q in range(k, k + 50)}
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for q, x in enumerate(w) if q not in gone).encode()).hexdigest())
    return out


@pytest.mark.parametrize("crowd", [200, 1])
def test_substring_dedup(docs, texts, crowd, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CROWD", crowd)
    got = {r[0]: tuple(r[1:4]) for r in substring_dedup.report(docs).collect()}
    assert got == dedup_by_hand(texts)


def test_texts_under_one_id_do_not_meet(spark):
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(None, f"{i} {passage} {i}") for i in range(3000)] + [(1, passage), (1, f"a {passage}")]
    got = substring_dedup.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == 3002 and {r.n_removed for r in got if r.doc_id is None} == {0} and {r.n_removed for r in got if r.doc_id == 1} == {70}


def test_crowded_segments_are_not_cut_into_all_their_windows(spark, monkeypatch):
    """Texts of their own around one passage: windows that reach into them leave the crowd at once."""
    passage = " ".join(f"p{i}" for i in range(120))
    of = lambda i: " ".join([*(f"a{i}x{k}" for k in range(60)), passage, *(f"b{i}x{k}" for k in range(60))])
    texts = {i: of(i) for i in range(200)}
    parts, write = [], substring_dedup.written

    def counted(df, name):
        out = write(df, name)
        if name == "dedup-parts":
            parts.append(out.count())
        return out

    monkeypatch.setattr(substring_dedup, "CROWD", 20)
    monkeypatch.setattr(substring_dedup, "written", counted)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r[0]: tuple(r[1:4]) for r in substring_dedup.report(docs).collect()}
    assert got == dedup_by_hand(texts)
    assert parts and sum(parts) < 40 * len(texts), parts


def test_matching_statistics_of_foreign_queries():
    rng = np.random.default_rng(5)
    indexed = [rng.integers(1, 4, 80).astype(np.uint64) for _ in range(4)]
    index = substring_dedup.FMIndex(indexed, np.arange(4), depth=6)
    query = rng.integers(1, 5, 120).astype(np.uint64)
    (stat, doc), = index.matches([query])
    for i in range(len(query)):
        best = max(k for k in range(7) if k == 0 or any(
            np.array_equal(s[j:j + k], query[i:i + k]) for s in indexed for j in range(len(s) - k + 1) if i + k <= len(query)))
        assert stat[i] == best
        if best == 6:
            assert doc[i] == min(d for d, s in enumerate(indexed) for j in range(75) if np.array_equal(s[j:j + 6], query[i:i + 6]))


def test_a_link_may_run_through_a_row_without_an_id(spark):
    words = lambda first: " ".join([f"x{i}" for i in range(first)] + [f"w{i}" for i in range(first, 200)])
    rows = [(1, words(0)), (None, words(9)), (2, words(18)), (None, "alone and far away from all")]
    got = sorted(map(str, (r.component_id for r in ngram_join.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect())))
    assert got == ["1", "1", "1", "None"]


def test_many_rows_without_an_id(spark):
    passage = " ".join(f"p{i}" for i in range(80))
    rows = [(None, f"{passage} {i}") for i in range(400)] + [(1, passage)]
    got = ngram_join.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 401 and {r.component_id for r in got} == {1}


def join_by_hand(texts):
    sets = {}
    for i, t in texts.items():
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k:k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    parent, common, where = {i: i for i in sets}, defaultdict(int), defaultdict(list)
    for i in sorted(sets):
        for s in sets[i]:
            for j in where[s]:
                common[j, i] += 1
            where[s].append(i)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), n in common.items():
        if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_ngram_join(spark, docs, texts):
    got = {r[0]: (r[1], r[2]) for r in ngram_join.joined(docs).collect()}
    assert got == join_by_hand(texts)
    # Near copies in a chain: neighbours link, the ends do not.
    base = [f"w{i}" for i in range(200)]
    chain = [(100 - k, " ".join(f"v{i}" if i < 6 * k else w for i, w in enumerate(base))) for k in range(8)]
    got = {r[0]: (r[1], r[2]) for r in ngram_join.joined(spark.createDataFrame(chain, "doc_id long, text string")).collect()}
    assert got == join_by_hand(dict(chain)) and len({c for _, c in got.values()}) == 1


def block_rows(tokens, texts):
    """Sorted rows of the last turn: every text in every block, each a component of its own."""
    sets = {bytes([k]) * 16: ngram_join.shingle_set(t) for k, t in enumerate(texts)}
    rows = sorted((t, len(s), node) for t in tokens for node, s in sets.items())
    return pa.RecordBatch.from_pydict({
        "token": pa.array([t for t, *_ in rows], pa.int64()), "node": pa.array([x for *_, x in rows], pa.binary()),
        "n": pa.array([n for _, n, _ in rows], pa.int64()), "comp": pa.array([x for *_, x in rows], pa.binary()),
        "brief": pa.array([ngram_join.brief(sets[x]) for *_, x in rows], pa.binary()),
        "firsts": pa.array([sorted(tokens)] * len(rows), pa.list_(pa.int64()))})


def test_a_pair_is_given_by_one_block():
    """Texts that share many blocks met once in each of them."""
    base = [f"w{i}" for i in range(300)]
    rows = block_rows(range(-5, 25), [" ".join(base), " ".join(base[:-3]), " ".join(base[2:])])
    got = [r for b in ngram_join.block_candidates(None)(iter([rows])) for r in b.to_pylist()]
    assert len(got) == 3 and {r["token"] for r in got} == {-5}
    # Blocks beyond those that travel with a class give their pairs again; none is lost.
    cut = rows.set_column(5, "firsts", pa.array([[7]] * len(rows), pa.list_(pa.int64())))
    got = [r for b in ngram_join.block_candidates(None)(iter([cut])) for r in b.to_pylist()]
    assert {r["token"] for r in got} == set(range(-5, 8)) and len({(r["a"], r["b"]) for r in got}) == 3


def test_long_texts_are_told_apart_beside_a_short_one():
    """The block's smallest text sets the width of the search, at which long texts are all bits."""
    texts = ["a b c d e", *(" ".join(f"{k}x{i}" for i in range(7000)) for k in "pq")]
    assert not list(ngram_join.block_candidates(None)(iter([block_rows([1], texts)])))


def test_one_per_group_keeps_one_row_a_component(spark):
    base = [f"w{i}" for i in range(100)]
    near = " ".join([*base[:-1], "other"])
    rows = [(1, " ".join(base), "a"), (1, " ".join(base), "a"), (None, near, "b"), (None, near, "b"), (7, "something else entirely in here", "c"), (1, "its own text under a shared id", "d"),
            (None, "no id and no copy at all", "e"), (None, "v " + " ".join(f"u{i}" for i in range(90)), "f"), (None, " ".join(f"u{i}" for i in range(90)), "f"), (8, "", "g"), (9, None, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = ngram_join.one_per_group(docs)
    assert got.columns == docs.columns
    assert sorted(r["source"] for r in got.collect()) == list("acdefgh")
    assert ngram_join.one_per_group(docs.limit(0)).count() == 0


def test_fingerprints(docs, texts):
    rows = {r["doc_id"]: r for r in fingerprints.report(docs).collect()}
    ids = sorted(texts)

    def shingles(t):
        w = words(t)
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}

    errors = []
    for i, nxt in zip(ids, ids[1:] + ids[:1]):
        t, n = texts[i], len(texts[i])
        edited = t[:n - n // 2] + texts[nxt][:n // 2]
        assert rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and rows[i]["n_chars"] == n
        a, b = shingles(t), shingles(edited)
        errors.append(rows[i]["near_edited"] - len(a & b) / len(a | b))
    assert np.abs(errors).max() < 0.25 and abs(np.mean(errors)) < 0.02
    by_text = defaultdict(set)
    for i in ids:
        by_text[texts[i]].add(rows[i]["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())


def test_licenses(spark, docs, texts):
    for r in licenses.report(docs).collect():
        w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[r["doc_id"]] or "")) if x]
        found = sorted((i, label) for phrase, label in licenses.BASE for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split())
        starts = [i for i, _ in found]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(found), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in found})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    rows = [(1, "Redistribution and use in source and binary forms, with or without modification"), (2, "use in binary source forms"), (3, None)]
    got = {r["doc_id"]: r["labels"] for r in licenses.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "bsd", 2: "", 3: ""}


def test_every_file_with_a_mandatory_phrase_is_labelled(spark):
    """The rarest held words of the long MIT template lie outside its mandatory phrase."""
    phrase = "permission is hereby granted free of charge to any person obtaining a"
    rows = [(k, phrase + " thing of its own") for k in range(6)] + [(9, "associated documentation files"), (10, "for any person and a charge")]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k][0] == "mit" and got[k][1] >= 12 / 20 for k in range(6)) and got[9] == got[10] == ("", 0.0)
    # In each template, where its other words are rarer.
    for t in licenses.TEMPLATES:
        found = licenses.anchors(5, {w: 1 + 2 * (w in t.words[slice(*t.mandatory)]) for w in t.words}, (t,))[0]
        assert len(found) >= 2 and all(t.mandatory[0] <= p < t.mandatory[1] for p in found)


def warc_by_hand(rows):
    digest = lambda html: base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()
    largest = {}
    for page, html in rows:
        largest[html or ""] = max(largest.get(html or "", -1), page)
    return sorted((page, len((html or "").encode()), digest(html), *(("response", None) if largest[html or ""] == page else ("revisit", largest[html or ""])))
                  for page, html in rows)


def test_warc_of_the_whole_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = warc_by_hand([(r.page_id, r.html) for r in pages.collect()])
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, warc.report(pages).select(columns).collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("bound", [0, 100_000])
def test_warc_edges(spark, bound, monkeypatch):
    monkeypatch.setattr(warc, "join_small", lambda big, small, keys: common.join_small(big, small, keys, bound=bound))
    rows = [(i, "u", "same" if i % 3 else f"own {i}", "x", 1) for i in range(60)] + [(90, None, None, "x", 1), (91, "", "", "x", 1),
            (92, "u", "long " * 400_000, "x", 1), (93, "u", "long " * 400_000, "x", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha string, again int").repartition(4)
    got = warc.report(pages).collect()
    assert sorted(map(tuple, got), key=str) == sorted(warc_by_hand([(r[0], r[2]) for r in rows]), key=str)


def test_archives_are_read_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "SPAN", 1000)
    pages = spark.createDataFrame([(i, "u", hashlib.sha512(str(i).encode()).hexdigest() * 4) for i in range(200)], "page_id long, url string, html string")
    folder = common.new_folder(spark, "warc")
    index = warc.write_archives(pages, folder)
    records = warc.read_archives(index, folder, span=1000)
    assert records.rdd.getNumPartitions() > 8 and records.count() == 200


def test_warc(spark):
    rows = [(1, "u", "same"), (2, None, "same"), (3, "v", None), (4, "w", ""), (5, "x", "a\r\n\r\nb é"), (5, "x", "a\r\n\r\nb é")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(tuple(r) for r in warc.report(pages).collect())
    d = {h: warc.base32_sha1((h or "").encode()) for _, _, h in rows}
    assert got == sorted([(1, 4, d["same"], "revisit", 2), (2, 4, d["same"], "response", None), (3, 0, d[""], "revisit", 4), (4, 0, d[""], "response", None),
                          (5, 9, d["a\r\n\r\nb é"], "response", None), (5, 9, d["a\r\n\r\nb é"], "response", None)], key=lambda r: r[:2])
    assert warc.report(pages.limit(0)).count() == 0


def test_toxicity(spark):
    rows = [(i, f"ordinary word{i % 13} text{i % 7} " * 5 + ("vile " if i % 4 == 0 else "kind ")) for i in range(600)] + [(1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.report(docs, labels).collect()}
    held = [r for i, r in got.items() if r["held_out"] and i < 600]
    assert len(held) > 100 and all((r["predicted"] == 1) == (r["doc_id"] % 4 == 0) for r in held)
    assert got[1000]["score"] == got[1001]["score"] and got[1000]["predicted"] == 0
    assert {r["score"] for r in toxicity.report(docs, labels.where("toxic = 0")).collect()} == {0.5}


def test_toxicity_counts_every_labelled_row(spark):
    """One toxic row in ten: no ordinary row is left out for that, and unlabelled texts count in the shared backoff."""
    rows = [(i, f"plain w{i} w{i} " + ("vile" if i % 10 == 0 else "kind")) for i in range(300)]
    docs = spark.createDataFrame(rows + [(1000, "w0 other")], "doc_id long, text string")
    marks = toxicity.training_marks(spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(300)], "doc_id long, toxic int"))
    trained = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 != 1]
    words = toxicity.counted_words(docs, marks)
    got = {r["word"]: r for r in words.collect()}
    of = lambda w: got[int(toxicity.hashes_of(w).view(np.int64)[0])]
    assert (of("plain")["b0"], of("plain")["b1"]) == (sum(i % 10 > 0 for i in trained), sum(i % 10 == 0 for i in trained))
    assert of("plain")["n"] == 300 and of("w0")["n"] == 3 and of("other")["n"] == 1 and of("other")["b0"] == of("other")["b1"] == 0
    sums = toxicity.totals(words)
    assert sums["b0"] + sums["b1"] == 4 * len(trained) and sums["n"] == 1202


def test_toxicity_pair_below_the_discount_in_one_class_is_not_absent(spark):
    words = spark.createDataFrame([(5, 55, 50, 5, 50, 5), (6, 900_000, 100_000, 10_000, 100_000, 10_000)], "word long, n long, c0 long, c1 long, b0 long, b1 long")
    pair = "array<struct<word:long,c0:double,c1:double,b0:double,b1:double>>"
    contexts = spark.createDataFrame([(9, 100.0, 100.0, 85.0, 100.0, [(5, 45.0, 25.0, 45.0, 25.0)])], f"before long, nb0 double, nb1 double, fb0 double, fb1 double, pairs {pair}")
    model = toxicity.evident(words, contexts, toxicity.totals(words), "b", [0], 0.0)
    assert len(model.pairs.keys) == 1 and abs(model.pairs.values[0, 0]) < 1.0


def test_toxicity_rare_pairs_and_small_differences_give_evidence(spark):
    """No pair has to be seen a number of times, and no difference of the classes has to be of a size."""
    words = spark.createDataFrame([(5, 40, 20, 20, 20, 20), (6, 900, 440, 460, 440, 460)], "word long, n long, c0 long, c1 long, b0 long, b1 long")
    pair = "array<struct<word:long,c0:long,c1:long,b0:long,b1:long>>"
    rows = [(9, 8, 8, 2, 2, [(5, 0, 2, 0, 2), (6, 8, 6, 8, 6)])]
    contexts = spark.createDataFrame(rows, f"before long, nb0 long, nb1 long, fb0 long, fb1 long, pairs {pair}")
    model = toxicity.evident(words, contexts, toxicity.totals(words), "b", [0], 2.0)
    pairs = dict(zip(model.pairs.keys.tolist(), model.pairs.values[:, 0]))
    of = lambda w: pairs[int(toxicity.joint(np.array([9], np.uint64), np.array([w], np.uint64))[0])]
    assert of(5) > 0.1 and of(6) < 0
    assert len(model.words.keys) == 2 and (model.words.values != 0).all() and np.abs(model.words.values).max() < 0.1
    # The more a difference is doubted, the less it counts, but never nothing.
    doubted = toxicity.evident(words, contexts, toxicity.totals(words), "b", [0], 2.0, 9.0).pairs.values
    assert (np.abs(doubted[:, 1]) < np.abs(doubted[:, 0])).all() and (doubted[:, 1] != 0).all()


def test_toxicity_contexts_hold_all_pairs(spark, monkeypatch):
    """Every pair of the labelled rows, in texts; a busy context has several rows with the sums of the whole."""
    monkeypatch.setattr(toxicity, "BUSY", 8)
    texts = [f"a w{i % 5} a w{i % 5} b{i}" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = toxicity.training_marks(spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int"))
    words = toxicity.counted_words(docs, marks).select("word", "texts.*")
    rows = toxicity.counted_contexts(docs, marks, words, toxicity.totals(words), common.Scratch(spark)).collect()
    got = {(r["before"], p["word"]): (p["b0"], p["b1"]) for r in rows for p in r["pairs"]}
    want = {}
    for i in (i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1):
        h = toxicity.hashes_of(texts[i])
        for key in set(zip([1, *h[:-1].view(np.int64).tolist()], h.view(np.int64).tolist())):
            want.setdefault(key, [0, 0])[i % 2] += 1
    assert got == {k: tuple(v) for k, v in want.items()} and sum(len(r["pairs"]) for r in rows) == len(want)
    a = int(toxicity.hashes_of("a").view(np.int64)[0])
    assert len([r for r in rows if r["before"] == a]) > 1
    for r in rows:
        own = [v for (before, _), v in got.items() if before == r["before"]]
        assert [r["nb0"], r["nb1"], r["fb0"], r["fb1"]] == [sum(v[0] for v in own), sum(v[1] for v in own), sum(v[0] > 0 for v in own), sum(v[1] > 0 for v in own)]


def test_toxicity_scores_alike_however_terms_reach_the_texts(spark, monkeypatch):
    """The driver and the tasks hold ``HOT`` terms at most; the joined ones add the same."""
    rows = [(i, f"ordinary word{i % 13} text{i % 7} only{i} " + ("vile you" if i % 4 == 0 else "kind")) for i in range(300)]
    docs = spark.createDataFrame([*rows, (3, "vile again"), (None, "vile"), (1000, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = toxicity.fitted(docs, labels)
    gathered, real = [], toxicity._gathered
    monkeypatch.setattr(toxicity, "_gathered", lambda terms: gathered.append(real(terms)) or gathered[-1])
    scores = []
    for hot, passes in ((10**6, 1), (20, 2), (0, 4)):
        monkeypatch.setattr(toxicity, "HOT", hot)
        monkeypatch.setattr(toxicity, "PASSES", passes)
        scores.append(sorted(map(str, toxicity.scored(docs, model).collect())))
    assert scores[0] == scores[1] == scores[2] and len(scores[0]) == 303
    assert len(gathered[0][0]) > 300 and len(gathered[1][0]) <= 20 and len(gathered[2][0]) == 0
    # Against the sum of the terms of a text, one by one.
    terms = dict(zip(*(np.concatenate([getattr(t, x).ravel() for t in (model.words, model.pairs)]).tolist() for x in ("keys", "values"))))
    h = toxicity.hashes_of(rows[4][1])
    sums = sum(terms.get(k, 0.0) for k in [*h.tolist(), *toxicity.pairs_of(h).tolist()])
    x = model.scale * (sums - model.middle * len(h)) / np.sqrt(len(h)) + model.shift
    score = [r["score"] for r in toxicity.scored(docs, model).where("doc_id = 4").collect()]
    assert score == pytest.approx([1 / (1 + np.exp(-x))], abs=1e-9)


def test_workers_hold_few_rows_at_a_time():
    batches = [pa.RecordBatch.from_pydict({"a": list(range(lo, hi))}) for lo, hi in ((0, 1300), (1300, 1300), (1300, 1301))]
    parts = list(common.in_parts(iter(batches)))
    assert [p.num_rows for p in parts] == [512, 512, 276, 1]
    assert [a for p in parts for a in p.column(0).to_pylist()] == list(range(1301))


@pytest.mark.parametrize("values", [[], [7], [7, 7], [3, 1, 3, 2, 3, 1], [0, 2**64 - 1, 2**64 - 1]])
def test_repeated_values_are_those_met_twice(values):
    once, counts = np.unique(np.array(values, np.uint64), return_counts=True)
    got = ngram_join.repeated(np.array(values, np.uint64))
    assert got[0].tolist() == once[counts > 1].tolist() and got[1].tolist() == counts[counts > 1].tolist()


@pytest.mark.parametrize("report", [quality.report, licenses.report, mixing.report, fingerprints.report, ngram_join.joined, substring_dedup.report])
def test_edge_rows(edge, report):
    rows = report(edge).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in EDGE)
    assert report(edge.limit(0)).count() == 0
