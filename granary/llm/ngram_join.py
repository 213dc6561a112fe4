"""N-gram Jaccard join by signature trees, and the components of its links.

A document's set is its distinct shingles of four words, as 64-bit hashes. Documents with equal
sets form one class; only classes are joined. Two of them link if
``100 * |intersection| >= 85 * |union|``.

1. One pass finds each document's class (a 128-bit digest of its set) and, over all documents,
   shingles that are frequent. A second pass puts each set in a fixed order, frequent shingles
   last, and keeps the head in which two linked sets must share a shingle (prefix filter), and
   two bitmaps of the set. The order only decides how many candidates there are, never the result.
2. Classes meet in blocks, one per shared head shingle; shingles of one class fall away.
3. Seeding: each class is verified against one partner, the hub it shares most blocks
   with outside its component. Near copies become one component after a few verified pairs
   each, instead of all pairs of their group.
4. The rest is exact: blocks of one component, and all but one of the blocks with the same
   classes, are let go; in each other block a signature tree is built over the classes in order of size.
   Its nodes hold OR- and AND-combined bitmaps, size ranges and component ranges. A dual traversal
   descends into pairs of nodes; it prunes a pair if the sizes or the largest possible overlap
   rule out a link, or if both lie in one component already. Blocks see the brief bitmap only;
   pairs that remain meet the full bitmaps, once each, and then their full sets. First come a few turns in which each component of a block gives one plausible
   pair, so that large groups of near copies grow together; blocks without a plausible pair are
   done with at the first turn. The last turn gives every pair that is left.

Nothing is dropped: every pair of classes that links shares a block and is either in one component
already or verified. Components are found by min-label rounds with pointer jumping, each round a
written table.

Defined results: null or blank text has an empty set, no class and no link: it is a component of
its own. Fewer than four words are one shingle. Rows with one id and different texts are joined
by their texts. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.llm.common import Scratch, in_parts, text_of, written
from granary.llm.shingles import finished, multiplier, window_hashes, word_hashes

WIDTH = 4
PERCENT = 85
#: Shingles that are put last in the order: the most frequent, at most this many.
FREQUENT = 500_000
#: Shingles counted together before those met once are let go.
COUNTED = 2_000_000
SEEDINGS = 1
#: Rounds in which a component is verified against one plausible partner a block, before the exact rest.
ROUNDS = 2
LEAF = 32
FAN = 4
#: Smallest open blocks of a class that travel with it in the last turn, so that a pair is given by one block.
FIRST_BLOCKS = 32
#: Hash classes of the prefilter on ids; its table never has more rows.
FILTER_CLASSES = 1 << 20


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    hashes = word_hashes(words)
    if len(words) < WIDTH:
        if not words:
            return hashes
        whole = np.array([len(words)], np.uint64)
        for i in range(len(hashes)):
            whole += hashes[i:i + 1] * multiplier(WIDTH + 1 + i)
        return finished(whole)
    return np.unique(window_hashes(hashes, WIDTH))


def digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def prefix_length(n: int) -> int:
    """So many first shingles of a set of n hold one of any set it links with."""
    return n - -(-PERCENT * n // 100) + 1


def linked(a: int, b: int, common: int) -> bool:
    return 100 * common >= PERCENT * (a + b - common)


def bitmap(own: np.ndarray, each: int = 4, least: int = 256, most: int = 262_144) -> bytes:
    """At least ``each`` bits for each shingle: a power of two from ``least`` to ``most``.

    With four bits so few shingles hide behind another's bit that the bound on the overlap stays
    sharp.
    """
    bits = min(max(least, each << int(len(own) - 1).bit_length()), most)
    out = np.zeros(bits, np.uint8)
    out[(own >> np.uint64(40)) & np.uint64(bits - 1)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def brief(own: np.ndarray) -> bytes:
    """The bitmap that goes into blocks, one copy for each head shingle: as sharp as the full one for
    short texts, one bit a shingle for long ones, which is enough to tell unlike texts apart."""
    return bitmap(own, 1, 1024, 8192)


def repeated(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values met twice or more, ascending, and how often. Sorts in place: no copy as long as the input is made."""
    values.sort()
    same = values[1:] == values[:-1]
    first, last = same.copy(), same.copy()
    first[1:] &= ~same[:-1]
    last[:-1] &= ~same[1:]
    at = np.flatnonzero(first)
    return values[at], np.flatnonzero(last) - at + 2


# Passes over the texts.

def classes_and_frequencies(docs: DataFrame) -> DataFrame:
    """Rows of two kinds: (doc_id, n, node) per document, (token, count) per repeated shingle of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0

        def tokens():
            values = np.concatenate(kept)
            kept.clear()
            values, counts = repeated(values)
            none = pa.nulls(len(values), pa.int64())
            return pa.RecordBatch.from_arrays(
                [none, none, pa.nulls(len(values), pa.binary()), pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))],
                names=["doc_id", "n", "node", "token", "count"])

        for batch in in_parts(batches):
            sizes, nodes = [], []
            for text in batch.column(1).to_pylist():
                own = shingle_set(text)
                sizes.append(len(own))
                nodes.append(digest(own))
                kept.append(own)
                size += len(own)
                if size >= COUNTED:
                    yield tokens()
                    size = 0
            none = pa.nulls(len(sizes), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), none, none],
                                             names=["doc_id", "n", "node", "token", "count"])
        if kept:
            yield tokens()

    source = docs.select("doc_id", text_of().alias("text"))
    return source.mapInArrow(run, "doc_id bigint, n bigint, node binary, token bigint, count bigint")


def frequent_tokens(found: DataFrame, scratch: Scratch) -> np.ndarray:
    """At most ``FREQUENT`` tokens, those with the largest counts, for the order of shingles."""
    counts = found.where(F.col("token").isNotNull()).groupBy("token").agg(F.sum("count").alias("c")).where(F.col("c") >= 8)
    # Counts fall into at most 64 levels; whole levels are taken from the top.
    level = F.floor(F.log2(F.col("c").cast("double"))).cast("int").alias("level")
    counts = scratch.written(counts.select("token", level), "join-counts")
    per = sorted(((r["level"], r["n"]) for r in counts.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    total, least = 0, 64
    for lv, n in per:
        if total + n > FREQUENT:
            break
        total, least = total + n, lv
    rows = counts.where(F.col("level") >= least).select("token")
    return np.sort(rows.toArrow().column("token").to_numpy().view(np.uint64))


def heads(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(node, n, head, sig, brief) per document with a set. ``frequent`` is bounded by ``FREQUENT``."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = shared.value
        for batch in in_parts(batches):
            nodes, sizes, firsts, sigs, briefs = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                own = shingle_set(text)
                if not len(own):
                    continue
                late = np.zeros(len(own), bool)
                if len(last):
                    late = last[np.minimum(np.searchsorted(last, own), len(last) - 1)] == own
                ordered = np.concatenate([own[~late], own[late]])[:prefix_length(len(own))]
                nodes.append(digest(own))
                sizes.append(len(own))
                firsts.append(ordered.view(np.int64))
                sigs.append(bitmap(own))
                briefs.append(brief(own))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(firsts, pa.list_(pa.int64())),
                                              pa.array(sigs, pa.binary()), pa.array(briefs, pa.binary())], names=["node", "n", "head", "sig", "brief"])

    source = docs.select("doc_id", text_of().alias("text"))
    return source.mapInArrow(run, "node binary, n bigint, head array<bigint>, sig binary, brief binary")


def _wanted(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is in ``ids``: a bounded prefilter by hash class, then the join."""
    kind = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_CLASSES)).cast("int")
    classes = ids.select(kind("doc_id").alias("kind")).distinct()
    some = docs.withColumn("kind", kind("doc_id")).join(F.broadcast(classes), "kind", "left_semi").drop("kind")
    return some.join(ids, "doc_id", "left_semi")


def sets_of(docs: DataFrame, members: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, own) for the given nodes: their sets, from the text of one document each.

    A node none of whose rows has an id is looked for among all rows without one.
    """
    reps = scratch.written(members.join(nodes, "node", "left_semi"), "join-wanted")
    ids = reps.where(F.col("rep").isNotNull()).select(F.col("rep").alias("doc_id")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            sets = [shingle_set(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(map(digest, sets), pa.binary()), pa.array((s.tobytes() for s in sets), pa.binary())], names=["node", "own"])

    texts = docs.select("doc_id", text_of().alias("text"))
    found = _wanted(texts, ids).mapInArrow(run, "node binary, own binary")
    nameless = reps.where(F.col("rep").isNull()).select("node")
    if not nameless.isEmpty():
        more = texts.where(F.col("doc_id").isNull()).mapInArrow(run, "node binary, own binary")
        found = found.unionByName(more.join(nameless, "node", "left_semi"))
    return found.dropDuplicates(["node"])


def plausible(pairs: DataFrame, attributes: DataFrame) -> DataFrame:
    """Pairs (a, b) that sizes and bitmaps do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            keep = []
            for m, n, x, y in zip(*(c.to_pylist() for c in batch.columns[2:])):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                width = min(len(p), len(q))
                differ = int(np.bitwise_count(_fold(p, width) ^ _fold(q, width)).sum())
                keep.append(linked(m, n, min((m + n - differ) // 2, m, n)))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    left, right = (attributes.select(F.col("node").alias(k), F.col("n").alias("n" + k), F.col("sig").alias("s" + k)) for k in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "sa", "sb")
    return both.mapInArrow(run, "a binary, b binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes whose full sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                keep.append(linked(len(p), len(q), len(np.intersect1d(p, q, assume_unique=True))))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"])

    left = sets.select(F.col("node").alias("b"), F.col("own").alias("y"))
    right = sets.select(F.col("node").alias("a"), F.col("own").alias("x"))
    both = pairs.join(left, "b").join(right, "a").select("a", "b", "x", "y")
    return both.mapInArrow(run, "a binary, b binary")


# Components.

def components(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp) and new links (a, b) -> labels in which linked nodes share the smallest label.

    Works on the graph of labels: a round hooks each label to the smallest neighbouring one and
    follows pointers; it ends when no label changes.
    """
    a, b = (labels.select(F.col("node").alias(x), F.col("comp").alias("c" + x)) for x in "ab")
    edges = links.join(a, "a").join(b, "b").where(F.col("ca") != F.col("cb")).select("ca", "cb")
    edges = scratch.written(edges.union(edges.select("cb", "ca")).distinct(), "join-edges")
    up = scratch.written(edges.groupBy(F.col("ca").alias("c")).agg(F.least(F.min("cb"), F.first("ca")).alias("to")), "join-labels")
    if up.isEmpty():
        return labels
    while True:
        target = up.select(F.col("c").alias("to"), F.col("to").alias("further"))
        jumped = up.join(target, "to", "left").select("c", F.coalesce("further", "to").alias("to"))
        near = edges.join(jumped.select(F.col("c").alias("cb"), "to"), "cb").groupBy(F.col("ca").alias("c")).agg(F.min("to").alias("low"))
        # A smaller label seen next door also hooks the label it replaces.
        moved = jumped.join(near, "c")
        hooks = moved.groupBy(F.col("to").alias("c")).agg(F.min("low").alias("hook"))
        following = scratch.written(moved.join(hooks, "c", "left").select(
            "c", F.least("to", "low", F.coalesce("hook", "to")).alias("new"), F.col("to").alias("old")), "join-labels")
        before = up.select("c", F.col("to").alias("was"))
        changed = following.join(before, "c").where(F.col("new") != F.col("was"))
        done = changed.isEmpty()
        up = following.select("c", F.col("new").alias("to"))
        if done:
            break
    final = up.select(F.col("c").alias("comp"), "to")
    return scratch.written(labels.join(final, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "join-components")


# Signature trees.

class Node:
    """Records lo..hi of a block in order of size: OR and AND of their bitmaps, sizes, components."""

    __slots__ = ("lo", "hi", "any", "every", "small", "large", "comp", "children")

    def __init__(self, lo, hi, any_, every, small, large, comp, children=()):
        self.lo, self.hi, self.any, self.every, self.small, self.large, self.comp, self.children = lo, hi, any_, every, small, large, comp, children


def _fold(bits: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (rows of uint64) folded to ``width`` words: bit numbers modulo a smaller power of two."""
    while bits.shape[-1] > width:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


def build_tree(bits: np.ndarray, sizes: np.ndarray, comps: np.ndarray) -> Node:
    level = []
    for lo in range(0, len(sizes), LEAF):
        hi = min(lo + LEAF, len(sizes))
        part = bits[lo:hi]
        comp = comps[lo] if (comps[lo:hi] == comps[lo]).all() else -1
        level.append(Node(lo, hi, np.bitwise_or.reduce(part), np.bitwise_and.reduce(part), sizes[lo], sizes[hi - 1], comp))
    while len(level) > 1:
        up = []
        for i in range(0, len(level), FAN):
            c = level[i:i + FAN]
            comp = c[0].comp if all(x.comp == c[0].comp for x in c) else -1
            up.append(Node(c[0].lo, c[-1].hi, np.bitwise_or.reduce([x.any for x in c]), np.bitwise_and.reduce([x.every for x in c]),
                           c[0].small, c[-1].large, comp, c))
        level = up
    return level[0]


def _apart(x: Node, y: Node) -> bool:
    """No record of x can link with one of y; x does not come after y in order of size."""
    if x.comp >= 0 and x.comp == y.comp:
        return True
    if 100 * int(x.large) < PERCENT * int(y.small):
        return True
    # Bits that all records of one side have and none of the other are shingles not shared.
    only_x, only_y = (int(np.bitwise_count(p & ~q).sum()) for p, q in ((x.every, y.any), (y.every, x.any)))
    common = min(int(x.large) - only_x, int(y.large) - only_y)
    return not linked(int(x.small), int(y.small), min(common, int(x.small), int(y.small))) and common < int(x.small)


def candidate_pairs(bits: np.ndarray, sizes: np.ndarray, comps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index pairs of a block, sorted by size, that may link and lie in different components, with the bound on their similarity."""
    root = build_tree(bits, sizes, comps)
    stack = [(root, root)]
    while stack:
        x, y = stack.pop()
        if _apart(x, y):
            continue
        if x.children or y.children:
            if x is y:
                stack += [(c, d) for i, c in enumerate(x.children) for d in x.children[i:]]
            elif len(x.children) >= len(y.children):
                stack += [(c, y) for c in x.children]
            else:
                stack += [(x, d) for d in y.children]
            continue
        i, j = np.meshgrid(np.arange(x.lo, x.hi), np.arange(y.lo, y.hi), indexing="ij")
        i, j = i.ravel(), j.ravel()
        ok = (i < j) & (comps[i] != comps[j])
        i, j = i[ok], j[ok]
        if len(i):
            differ = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
            total = sizes[i] + sizes[j]
            most = np.minimum((total - differ) // 2, np.minimum(sizes[i], sizes[j]))
            ok = 100 * most >= PERCENT * (total - most)
            if ok.any():
                yield i[ok], j[ok], (most / np.maximum(total - most, 1))[ok]


def sharper(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], sigs: list[np.ndarray], sizes: np.ndarray,
            width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The pairs that bitmaps as wide as the two of them allow do not rule out either.

    A block is searched at the width of its smallest text, at which long texts are all bits.
    """
    widths = np.array([len(s) for s in sigs])
    for i, j, key in found:
        keep, own = np.ones(len(i), bool), np.minimum(widths[i], widths[j])
        for w in np.unique(own[own > width]):
            at = np.flatnonzero(own == w)
            rows, place = np.unique(np.concatenate([i[at], j[at]]), return_inverse=True)
            bits = np.stack([_fold(sigs[r], w) for r in rows])
            differ = np.bitwise_count(bits[place[:len(at)]] ^ bits[place[len(at):]]).sum(axis=1, dtype=np.int64)
            total = sizes[i[at]] + sizes[j[at]]
            most = np.minimum((total - differ) // 2, np.minimum(sizes[i[at]], sizes[j[at]]))
            keep[at] = 100 * most >= PERCENT * (total - most)
        if keep.any():
            yield i[keep], j[keep], key[keep]


def given_first(found: Iterator[tuple[np.ndarray, ...]], firsts: list[np.ndarray], token: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs that no smaller block known of both holds: the smallest block they share always gives them."""
    smaller = [set(f[f < token].tolist()) for f in firsts]
    for i, j, *_ in found:
        keep = np.array([smaller[x].isdisjoint(smaller[y]) for x, y in zip(i, j)], bool)
        if keep.any():
            yield i[keep], j[keep]


def one_partner(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], comps: np.ndarray, turn: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of all candidate pairs one for each component: the most similar one, in later turns one drawn by a hash."""
    best, left, right = np.full(int(comps.max()) + 1, -1.0), *np.zeros((2, int(comps.max()) + 1), np.int64)
    for i, j, key in found:
        if turn:
            key = (finished((i.astype(np.uint64) << np.uint64(32)) + j.astype(np.uint64) + multiplier(turn)) >> np.uint64(11)).astype(float)
        for own in (comps[i], comps[j]):
            order = np.lexsort((key, own))
            last = order[np.append(own[order][1:] != own[order][:-1], True)]
            last = last[key[last] > best[own[last]]]
            best[own[last]], left[own[last]], right[own[last]] = key[last], i[last], j[last]
    if (best >= 0).any():
        yield left[best >= 0], right[best >= 0]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of equal tokens in sorted batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        token = batch.column(0).to_numpy()
        if not len(token):
            continue
        cuts = [0, *(np.flatnonzero(token[1:] != token[:-1]) + 1), len(token)]
        for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            part = batch.slice(lo, hi - lo)
            if held and (k or held[-1].column(0)[0].as_py() != part.column(0)[0].as_py()):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def block_candidates(turn: int | None):
    """(token, node, n, comp, brief, firsts) sorted by token and size -> candidate pairs (token, a, b).

    In a turn each component of a block gives one pair; a block that gives none has no plausible
    pair and is done with. Without a turn (None) all pairs are given, each by the smallest of the
    blocks that its classes share as far as ``firsts``, their smallest blocks, tell.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            nodes = block.column("node").to_pylist()
            comp_names = block.column("comp").to_pylist()
            numbers = {c: i for i, c in enumerate(dict.fromkeys(comp_names))}
            if len(numbers) < 2:
                continue
            comps = np.array([numbers[c] for c in comp_names])
            sizes = block.column("n").to_numpy()
            sigs = [np.frombuffer(s, np.uint64) for s in block.column("brief").to_pylist()]
            width = min(map(len, sigs))
            bits = np.stack([_fold(s, width) for s in sigs])
            token = block.column("token")[0].as_py()
            found = sharper(candidate_pairs(bits, sizes, comps), sigs, sizes, width)
            if turn is None:
                firsts = [np.array(f, np.int64) for f in block.column("firsts").to_pylist()]
            for i, j in given_first(found, firsts, token) if turn is None else one_partner(found, comps, turn):
                yield pa.RecordBatch.from_arrays([pa.array([token] * len(i), pa.int64()), pa.array([nodes[k] for k in i], pa.binary()),
                                                  pa.array([nodes[k] for k in j], pa.binary())], names=["token", "a", "b"])

    return run


# The join.

def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def open_blocks(rows: DataFrame) -> DataFrame:
    """(token, node, comp) rows of the blocks that bitmaps are needed for.

    Blocks that lie in one component by now have nothing to add. Of blocks that hold the same
    classes one is enough: two long texts share thousands of shingles, which all say the same.
    Blocks are told apart by their size and two sums of hashes of their classes.
    """
    sums = [F.sum(F.xxhash64("node", F.lit(k)).cast("decimal(20,0)")).alias(f"h{k}") for k in (0, 1)]
    blocks = rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size"), *sums)
    chosen = blocks.where(F.col("lo") != F.col("hi")).groupBy("size", "h0", "h1").agg(F.min("token").alias("token"))
    return rows.join(chosen.select("token"), "token", "left_semi").select("token", "node", "comp")


def joined(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``."""
    docs = docs.select("doc_id", "text")
    scratch, early = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    found = scratch.written(classes_and_frequencies(docs), "join-classes")
    rows = found.where(F.col("node").isNotNull())
    members = scratch.written(rows.where(F.col("n") > 0).groupBy("node").agg(F.min("doc_id").alias("rep")), "join-members")
    signed = early.written(heads(docs, frequent_tokens(found, early)).dropDuplicates(["node"]), "join-heads")
    postings = signed.select("node", F.explode("head").alias("token"))
    postings = postings.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("token"))).where(F.col("df") > 1)
    postings = scratch.written(postings.select("token", "node"), "join-postings")
    labels = scratch.written(postings.select("node").distinct().select("node", F.col("node").alias("comp")), "join-alone")
    attributes = signed.join(labels.select("node"), "node", "left_semi").select("node", "n", "sig", "brief")
    attributes = scratch.written(attributes, "join-attributes")
    early.release()  # heads are the largest of all tables, and postings and attributes hold what is needed of them
    for seeding in range(SEEDINGS):
        # The hub of a block is drawn anew each time; a class is tried with its most frequent hub.
        own = postings.join(labels, "node")
        rank = F.struct(F.xxhash64("comp", F.lit(seeding)).alias("h"), F.col("comp"), F.col("node"))
        hubs = own.withColumn("hub", F.min(rank).over(Window.partitionBy("token")))
        votes = hubs.where(F.col("hub.comp") != F.col("comp")).groupBy("node", F.col("hub.node").alias("hub")).agg(F.count(F.lit(1)).alias("votes"))
        best = votes.groupBy("node").agg(F.max(F.struct("votes", "hub")).alias("best"))
        pairs = _ordered(best.select(F.col("node").alias("a"), F.col("best.hub").alias("b")))
        labels = _linked_labels(docs, members, labels, attributes, pairs, scratch)
    blocks = scratch.written(open_blocks(postings.join(labels, "node")), "join-mixed").drop("comp")
    for turn in [*range(ROUNDS), None]:
        rows_of = blocks.join(labels, "node").join(attributes.select("node", "n", "brief"), "node").select("token", "node", "n", "comp", "brief")
        if turn is None:
            # A class has at most its head of open blocks.
            firsts = blocks.groupBy("node").agg(F.slice(F.array_sort(F.collect_list("token")), 1, FIRST_BLOCKS).alias("firsts"))
            rows_of = rows_of.join(firsts, "node").select(*rows_of.columns, "firsts")
        rows_of = rows_of.repartition("token").sortWithinPartitions("token", "n", "node")
        given = scratch.written(rows_of.mapInArrow(block_candidates(turn), "token bigint, a binary, b binary").distinct(), "join-candidates")
        if given.isEmpty():
            break
        labels = _linked_labels(docs, members, labels, attributes, _ordered(given), scratch)
        # Blocks without a plausible pair are done with, as are those that are one component by now.
        left = blocks.join(given.select("token").distinct(), "token", "left_semi")
        if turn is not None:
            blocks = scratch.written(open_blocks(left.join(labels, "node")), "join-mixed").drop("comp")
    # The label of a component is the smallest id in it.
    reps = members.join(labels, "node", "left").select("node", "rep", F.coalesce("comp", "node").alias("comp"))
    lowest = reps.groupBy("comp").agg(F.min("rep").alias("component_id"))
    of_node = scratch.written(reps.join(lowest, "comp").select("node", "component_id"), "join-result")
    # Copies of one text may be a third of all rows: their class is looked up under salted keys.
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(16)))
    spread = of_node.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
    out = salted.join(spread, ["node", "salt"], "left")
    out = written(out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")), "join-rows")
    scratch.release()
    return out


def _linked_labels(docs: DataFrame, members: DataFrame, labels: DataFrame, attributes: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """Labels after the links among the pairs: full bitmaps first, then full sets."""
    pairs = scratch.written(plausible(pairs, attributes), "join-pairs")
    if pairs.isEmpty():
        return labels
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    links = scratch.written(verified(pairs, sets_of(docs, members, nodes, scratch)), "join-links")
    return components(labels, links, scratch)


def one_per_group(docs: DataFrame) -> DataFrame:
    """One row of each component, with the columns of the input: that of the smallest id.

    Rows meet under a key of their own, so that repeated rows, rows that share an id and rows
    without an id are told apart. Null ids come last; further ties go to the smallest digest of
    the text, then to the smallest key. Rows without a set have no copies and all stay.
    """
    scratch = Scratch(docs.sparkSession)
    keyed = docs.withColumn("__key", F.monotonically_increasing_id())
    keyed = scratch.written(keyed, "group-rows")
    groups = joined(keyed.select(F.col("__key").alias("doc_id"), "text")).select(F.col("doc_id").alias("__key"), F.col("component_id").alias("__group"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.sha2(text_of(), 256).alias("digest"), F.col("__key").alias("key"))
    ranked = keyed.select("__key", order.alias("rank")).join(groups, "__key")
    # A minimum per group is aggregated before the shuffle, so a large group does not land in one task.
    kept = ranked.groupBy("__group").agg(F.min("rank").alias("first")).select(F.col("first.key").alias("__key"))
    out = written(keyed.join(kept, "__key", "left_semi").select(*docs.columns), "group-kept")
    scratch.release()
    return out
