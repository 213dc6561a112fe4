"""Substring dedup with a compressed FM-index per shard.

A window is ``WINDOW`` consecutive words. Windows are dealt to shards by content: each window
belongs to the smallest of the hashes of its ``GRAM``-word grams (its minimizer), so that equal
windows always meet in one shard. Consecutive windows with one minimizer travel as one segment.

1. One pass hashes words and finds each text's class (a digest of its word sequence) and its
   minimizers. Copies of a text form one class with its smallest id; minimizers that only one
   class has are dropped, since none of their windows can occur elsewhere.
2. The segments of shared minimizers are cut out in a second pass, one copy per class, and equal
   segments are grouped before they are shuffled any further, so that copied passages arrive
   once. Where a minimizer has more than ``CROWD`` different segments, as at the ends of a passage that many
   documents share, these are dealt again by the minimizers of longer grams: a gram that reaches into a
   document's own words leaves the crowd, so few windows are dealt again and again. Equal parts
   are grouped, and so on while a minimizer still has too many forms, down to single windows. What is
   found of the parts is put together again, so a document has one row a segment throughout.
3. Each shard builds an FM-index of its segments: the suffix array of the concatenation, sorted
   as far as ``WINDOW`` words, the Burrows-Wheeler transform as a wavelet matrix of bit vectors
   with sampled ranks, and the smallest document of each interval. Segments are streamed
   against it from their last word to their first: backward search keeps, for each position, the
   longest match up to the window length (its matching statistic) and its interval. Positions
   whose match reaches the threshold are reported with the smallest document that holds it.
4. Back at the documents, a window is a repeat if that document is smaller than its own. Windows
   are united to intervals of words, and those words are removed from the text.

A shard's input is bounded: shards are filled by hash, and their number follows the words.
Copies need no index: windows of a copy all start in the smallest document of its class.

Defined results: null text has no words; texts under ``WINDOW`` words lose nothing; of several
rows with one id, none counts as earlier than the other; rows without an id come before all
others. Removal is judged on the input alone. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import text_of, written
from granary.llm.shingles import finished, rolling_hashes, word_hashes

WINDOW = 50
GRAM = 20
#: Different pieces of one shard's key above which they are taken apart.
CROWD = 200
#: Words of the grams whose minimizers part them, one length after the other, up to the window itself.
GRAMS = (GRAM, 32, 41, 46, WINDOW)
#: Words of segments that one index holds, about.
SHARD_WORDS = 400_000
BLOCK = 8


# Texts.

def words_in(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def sequence_digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def minimizers(hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """The minimizer of each window of a text."""
    grams = rolling_hashes(hashes, gram)
    span = window - gram + 1
    if len(grams) < span:
        return np.empty(0, np.uint64)
    # Sliding minimum by doubling: two overlapping runs of a power of two cover the span.
    run, low = 1, grams
    while run * 2 <= span:
        low = np.minimum(low[:-run], low[run:])
        run *= 2
    n = len(grams) - span + 1
    return np.minimum(low[:n], low[span - run:span - run + n])


def segments_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and end of each run of equal minimizers."""
    if not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])


# The index of one shard.

class BitVector:
    """Bits with the number of ones before each block; rank looks at one block."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.zeros = len(bits) - int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    """Symbols below ``1 << depth``, one bit vector a level from the highest bit."""

    def __init__(self, symbols: np.ndarray, depth: int):
        self.levels, self.depth = [], depth
        for k in range(depth - 1, -1, -1):
            bits = (symbols >> k) & 1
            self.levels.append(BitVector(bits.astype(np.uint8)))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])

    def ranks(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each symbol before lo and before hi."""
        start = np.zeros(len(symbols), np.int64)
        for k, level in zip(range(self.depth - 1, -1, -1), self.levels):
            one = ((symbols >> k) & 1).astype(bool)
            a, b, c = level.rank(lo), level.rank(hi), level.rank(start)
            lo = np.where(one, level.zeros + a, lo - a)
            hi = np.where(one, level.zeros + b, hi - b)
            start = np.where(one, level.zeros + c, start - c)
        return lo - start, hi - start


class FMIndex:
    """FM-index of several word sequences, each with the number of its document.

    Suffixes are sorted by their first ``depth`` words; sequences end in a symbol of their own
    that no query holds.
    """

    def __init__(self, sequences: list[np.ndarray], documents: np.ndarray, depth: int = WINDOW):
        self.depth = depth
        self.alphabet = np.unique(np.concatenate(sequences)) if sequences else np.empty(0, np.uint64)
        text = np.zeros(sum(map(len, sequences)) + len(sequences), np.int64)
        owner = np.zeros(len(text), np.int64)
        room = np.zeros(len(text), np.int64)
        at = 0
        for s, d in zip(sequences, documents):
            text[at:at + len(s)] = np.searchsorted(self.alphabet, s) + 1
            owner[at:at + len(s) + 1] = d
            room[at:at + len(s) + 1] = np.arange(len(s), -1, -1)
            at += len(s) + 1
        order, rank = self._sorted(text, depth)
        n = len(text)
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(self.alphabet) + 1))])
        self.bwt = WaveletMatrix(text[order - 1], max(1, int(len(self.alphabet)).bit_length()))
        # Borders of intervals whose suffixes agree in ``depth`` words, and their smallest document.
        new = np.concatenate([[True], rank[order][1:] != rank[order][:-1]])
        group = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        self.group, self.starts, self.ends = group, starts, np.concatenate([starts[1:], [n]])
        whole = np.where(room[order] >= depth, owner[order], np.iinfo(np.int64).max)
        self.least = np.minimum.reduceat(whole, starts) if n else whole
        self.size = n

    @staticmethod
    def _sorted(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffix order by the first ``depth`` words at least, by doubling; equal prefixes share a rank.

        The last step adds just the words that are missing, so that ranks mean ``depth`` words.
        """
        n, rank, known = len(text), text.copy(), 1
        while known < depth:
            step = min(known, depth - known)
            later = np.zeros(n, np.int64)
            later[:max(0, n - step)] = rank[step:] + 1
            key = rank * (int(rank.max(initial=0)) + 2) + later
            rank = np.unique(key, return_inverse=True)[1].reshape(-1)
            known += step
        return np.argsort(rank, kind="stable"), rank

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """Symbol of each word; 0 for words that the index does not hold."""
        if not len(self.alphabet):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.alphabet, words), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == words, at + 1, 0)

    def extend(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward step: intervals of the patterns with one word put in front."""
        a, b = self.bwt.ranks(symbols, lo, hi)
        first = self.counts[symbols]
        return first + a, first + b

    def matches(self, queries: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query and position: matching statistic up to ``depth``, and the smallest document
        of the matches that reach it (the largest integer where none does).

        All queries advance together from their ends. A match that grows beyond ``depth`` words is
        cut back to the interval of its first ``depth``. Where a word cannot be put in front, shorter
        matches are tried by searching the remaining words anew.
        """
        none = np.iinfo(np.int64).max
        coded = [self.symbols(q) for q in queries]
        length = np.array([len(q) for q in coded])
        offset = np.concatenate([[0], np.cumsum(length)])
        flat = np.concatenate(coded) if coded else np.empty(0, np.int64)
        stat, doc = np.zeros(len(flat), np.int64), np.full(len(flat), none)
        lo, hi, have = np.zeros(len(coded), np.int64), np.full(len(coded), self.size), np.zeros(len(coded), np.int64)
        for back in range(int(length.max(initial=0))):
            live = np.flatnonzero(length > back)
            place = offset[live] + length[live] - 1 - back
            c = flat[place]
            a, b = self.extend(c, lo[live], hi[live])
            found = (b > a) & (c > 0)
            grown = have[live] + 1
            for k in np.flatnonzero(~found):
                a[k], b[k], grown[k] = self._shortened(flat, place[k], int(have[live[k]]))
            over = (grown > self.depth)
            if over.any():
                g = self.group[a[over]]
                a[over], b[over], grown[over] = self.starts[g], self.ends[g], self.depth
            lo[live], hi[live], have[live] = a, b, grown
            stat[place] = grown
            full = grown == self.depth
            doc[place[full]] = self.least[self.group[a[full]]]
        return [(stat[i:j], doc[i:j]) for i, j in zip(offset[:-1], offset[1:])]

    def _shortened(self, flat: np.ndarray, place: int, have: int) -> tuple[int, int, int]:
        """Longest match that starts at ``place`` and is not longer than ``have`` words."""
        low, high, best = 0, have, (0, self.size, 0)
        while low < high:
            size = (low + high + 1) // 2
            a, b = np.array([0]), np.array([self.size])
            for c in flat[place:place + size][::-1]:
                a, b = self.extend(np.array([c]), a, b) if c else (a, a)
                if b[0] <= a[0]:
                    break
            if b[0] > a[0]:
                low, best = size, (int(a[0]), int(b[0]), size)
            else:
                high = size - 1
        return best


def repeats(sequences: list[np.ndarray], documents: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """Smallest document that holds each window of each sequence of a shard, among all of them."""
    index = FMIndex(sequences, documents, window)
    return [doc[:len(s) - window + 1] for s, (_, doc) in zip(sequences, index.matches(sequences))]


# The job.

def _signed(docs: DataFrame) -> DataFrame:
    """(doc_id, node, n_words, keys) per row: digest of the word sequence, and the minimizers of its segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, keys = [], [], []
            for text in batch.column(1).to_pylist():
                words = words_in(text)
                nodes.append(sequence_digest(words))
                sizes.append(len(words))
                own = minimizers(word_hashes(words))
                begin, _ = segments_of(own)
                keys.append(own[begin].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()),
                                              pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "node", "n_words", "keys"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, "doc_id bigint, node binary, n_words bigint, keys array<bigint>")


def _cut(rows: DataFrame) -> DataFrame:
    """(text, rep, node, shared) -> segments of the shared minimizers: (node, rep, first, seg, words, key).

    ``words`` holds the word hashes of a segment, ``seg`` its digest; ``first`` is its first
    window in the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("node", "rep", "first", "seg", "words", "key")}
            for text, rep, node, shared in zip(*(c.to_pylist() for c in batch.columns)):
                hashes = word_hashes(words_in(text))
                keys = minimizers(hashes).view(np.int64)
                begin, end = segments_of(keys)
                wanted = set(shared or [])
                for a, b in zip(begin, end):
                    if int(keys[a]) in wanted:
                        own = hashes[a:b + WINDOW - 1].tobytes()
                        for k, v in zip(out, (node, rep, int(a), piece_name(own), own, int(keys[a]))):
                            out[k].append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["node"], pa.binary()), pa.array(out["rep"], pa.int64()), pa.array(out["first"], pa.int64()), pa.array(out["seg"], pa.binary()),
                 pa.array(out["words"], pa.binary()), pa.array(out["key"], pa.int64())], names=list(out))

    return rows.mapInArrow(run, "node binary, rep bigint, first bigint, seg binary, words binary, key bigint")


def piece_name(words: bytes) -> bytes:
    return hashlib.blake2b(words, digest_size=16).digest()


def _parts(level: int):
    """(seg, words, rep) -> the runs of windows with one minimizer of ``GRAMS[level]`` words:
    (parent, place, seg, words, rep, shard). At the last level every window is a run."""
    gram = GRAMS[level]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("parent", "place", "seg", "words", "rep", "shard")}
            for parent, words, rep in zip(*(c.to_pylist() for c in batch.columns)):
                hashes = np.frombuffer(words, np.uint64)
                keys = minimizers(hashes, WINDOW, gram)
                begin, end = (np.arange(len(keys)), np.arange(1, len(keys) + 1)) if gram == WINDOW else segments_of(keys)
                # The hash of a gram does not tell its length.
                shards = finished(keys + np.uint64(gram)).view(np.int64)
                for place, (a, b) in enumerate(zip(begin, end)):
                    own = hashes[a:b + WINDOW - 1].tobytes()
                    for k, v in zip(out, (parent, place, piece_name(own), own, rep, int(shards[a]))):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("parent", pa.binary()), ("place", pa.int32()), ("seg", pa.binary()), ("words", pa.binary()),
                                                                    ("rep", pa.int64()), ("shard", pa.int64())]))

    return run


def _found(pieces: DataFrame, level: int = 0) -> DataFrame:
    """(seg, docs) for different pieces (seg, words, rep, shard): the smallest document of each window.

    Shards of up to ``CROWD`` pieces are indexed; the pieces of others are taken apart first.
    """
    crowded = written(pieces.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD).select("shard"), "dedup-crowded")
    if crowded.isEmpty():
        few = pieces
    else:
        few = pieces.join(crowded, "shard", "left_anti")
    dealt = few.select("shard", "seg", "words", "rep").repartition("shard").sortWithinPartitions("shard", "seg")
    found = dealt.mapInArrow(_search, "seg binary, docs array<bigint>")
    if not crowded.isEmpty():
        many = pieces.join(crowded, "shard", "left_semi").select("seg", "words", "rep")
        if level == len(GRAMS) - 1:  # single windows: the smallest document of all equal ones is known
            found = found.unionByName(many.select("seg", F.array("rep").alias("docs")))
        else:
            parts = written(many.mapInArrow(_parts(level + 1), "parent binary, place int, seg binary, words binary, rep bigint, shard bigint"), "dedup-parts")
            different = written(parts.groupBy("seg").agg(F.min("rep").alias("rep"), *[F.first(c).alias(c) for c in ("words", "shard")]), "dedup-different")
            whole = parts.select("parent", "place", "seg").join(_found(different, level + 1), "seg").groupBy("parent").agg(
                F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "docs"))), lambda p: p["docs"])).alias("docs"))
            found = found.unionByName(whole.select(F.col("parent").alias("seg"), "docs"))
    return written(found, "dedup-found")


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, seg, words, rep) sorted by shard -> (seg, docs): the smallest document of each window.

    Whole shards are put into one index until it holds about ``SHARD_WORDS`` words.
    """
    held: list[tuple[bytes, np.ndarray, int]] = []
    size, last = 0, None

    def searched() -> pa.RecordBatch:
        found = repeats([w for _, w, _ in held], np.array([d for *_, d in held], np.int64))
        return pa.RecordBatch.from_arrays([pa.array([s for s, *_ in held], pa.binary()), pa.array(found, pa.list_(pa.int64()))], names=["seg", "docs"])

    for batch in batches:
        for shard, seg, words, rep in zip(*(c.to_pylist() for c in batch.columns)):
            if shard != last and size >= SHARD_WORDS:
                yield searched()
                held, size = [], 0
            last = shard
            own = np.frombuffer(words, np.uint64)
            held.append((seg, own, rep))
            size += len(own)
    if held:
        yield searched()


def _removed(rows: DataFrame) -> DataFrame:
    """(doc_id, text, copy, spans) -> the report; spans are (first window, window count) that repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, digests = [], [], []
            for text, copy, spans in zip(*(c.to_pylist() for c in batch.columns[1:])):
                words = words_in(text)
                cover = np.zeros(len(words) + 1, np.int64)
                if copy and len(words) >= WINDOW:
                    words_kept: list[bytes] = []
                else:
                    for s in spans or []:
                        cover[s["first"]] += 1
                        cover[s["first"] + s["count"] + WINDOW - 1] -= 1
                    keep = np.cumsum(cover)[:-1] == 0
                    words_kept = words if keep.all() else [w for w, k in zip(words, keep) if k]
                sizes.append(len(words))
                gone.append(len(words) - len(words_kept))
                digests.append(hashlib.sha256(b" ".join(words_kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())],
                                             names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def _intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, rep, first, docs) -> runs of windows whose smallest document is before their own."""
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("node", "first", "count")}
        for node, rep, first, docs in zip(*(c.to_pylist() for c in batch.columns)):
            hit = np.array(docs, np.int64) < rep
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
            for a, b in zip(edge[::2], edge[1::2]):
                out["node"].append(node)
                out["first"].append(first + int(a))
                out["count"].append(int(b - a))
        yield pa.RecordBatch.from_arrays([pa.array(out["node"], pa.binary()), pa.array(out["first"], pa.int64()), pa.array(out["count"], pa.int64())], names=list(out))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: words, words removed, digest of the words kept."""
    lowest = -(1 << 62)
    docs = docs.select("doc_id", F.coalesce("doc_id", F.lit(lowest)).alias("id"), text_of().alias("text"))
    signed = written(_signed(docs.select(F.col("id").alias("doc_id"), "text")), "dedup-signed")
    long = signed.where(F.col("n_words") >= WINDOW)
    classes = written(long.groupBy("node").agg(F.min("doc_id").alias("rep")), "dedup-classes")
    reps = long.join(classes.withColumnRenamed("rep", "doc_id"), ["node", "doc_id"], "left_semi").dropDuplicates(["node"])
    own = reps.select("node", F.explode("keys").alias("key"))
    counts = own.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
    counts = written(counts.where(F.col("lo") != F.col("hi")).select("key"), "dedup-keys")
    keys = own.distinct()
    shared = keys.join(counts, "key").groupBy("node").agg(F.collect_list("key").alias("shared"))
    shared = written(shared.join(classes, "node"), "dedup-shared")
    # One text per class with a shared minimizer: rows of its smallest id, told apart by digest, so that
    # many texts under one id (or without one) do not meet each other.
    chosen = shared.withColumn("id", F.col("rep"))
    own = _with_digest(docs).join(chosen, ["id", "node"]).select("text", "rep", "node", "shared")
    segments = written(_cut(own), "dedup-segments")
    different = segments.groupBy("seg").agg(F.min("rep").alias("rep"), F.first("words").alias("words"), F.first("key").alias("shard"))
    found = _found(written(different, "dedup-different"))
    # Only segments with a window of an earlier document matter to a class.
    hits = segments.select("node", "rep", "first", "seg").join(found, "seg").where(F.array_min("docs") < F.col("rep"))
    spans = hits.select("node", "rep", "first", "docs").mapInArrow(_intervals, "node binary, first bigint, count bigint")
    spans = spans.groupBy("node").agg(F.collect_list(F.struct("first", "count")).alias("spans"))
    marks = classes.join(spans, "node", "left")
    # Rows of a class: its smallest id keeps what is not covered, the others lose every word.
    first = marks.where(F.col("spans").isNotNull()).select("node", F.col("rep").alias("id"), "spans")
    heads = signed.select(F.col("doc_id").alias("id"), "node").distinct()
    of_first = heads.join(first, ["node", "id"]).select("id", "node", "spans")
    lead = classes.select(F.col("rep").alias("id"), F.col("node").alias("lead"))
    texts = _with_digest(docs)
    out = texts.join(lead, (texts["id"] == lead["id"]) & (texts["node"] == lead["lead"]), "left").drop(lead["id"])
    of_first = of_first.select(F.col("id").alias("i"), F.col("node").alias("m"), "spans")
    out = out.join(of_first, (out["id"] == of_first["i"]) & (out["node"] == of_first["m"]), "left")
    return _removed(out.select("doc_id", "text", F.col("lead").isNull().alias("copy"), "spans"))


def _with_digest(docs: DataFrame) -> DataFrame:
    """Adds ``node``, the digest of each row's word sequence."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = pa.array([sequence_digest(words_in(t)) for t in batch.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, nodes], names=["doc_id", "id", "text", "node"])
    return docs.select("doc_id", "id", "text").mapInArrow(run, "doc_id bigint, id bigint, text string, node binary")
