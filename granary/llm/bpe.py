"""Byte-level BPE by a monoid tree: encode halves, join neighbours.

A text is a tree over its characters. Leaves are encoded alone; a node joins the encodings of
its halves by encoding a window around the boundary again:

* Between pieces (matches of the split pattern). Matching restarts at the end of each match and
  never looks back, so what follows a place where both scans start a match is the same in both.
  On the left, a match is settled if it and the text that decided its end lie before the cut;
  the pattern looks past a match by one character, or by two in a contraction, so all but the
  last ``TAIL`` matches are settled. The window starts there and takes in more pieces of the
  right half, growing, until its scan starts a match where the right half's own scan does;
  from there on the right half's pieces stand.
* Inside a piece longer than a leaf, between tokens. Tokens are the merges' result if every
  neighbouring pair is the encoding of its own bytes. The window takes tokens from both sides,
  doubling, until the pairs across its two rims are such encodings; tokens outside stand.

The encoding of a text is thus the fold of an associative join and does not depend on where the
tree is cut; tests cut it at random. Decoding concatenates bytes up the same tree. Rows are
encoded where they lie, some rows at a time. Words repeat, so each worker keeps the ids of
pieces it has met in a table of bounded size; ``encoded`` empties it after each task, as the
worker may go on to other steps of a job.

Defined results: null is the empty text, which has no ids. Rows are encoded one by one; other
columns pass through or are ignored. The vocabulary file's path is a parameter.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from granary.llm.common import in_parts, text_of

#: Characters of a leaf; pieces up to this many bytes are merged directly.
LEAF = 4096
PIECE = 64
#: Matches left of a cut that the text after it can still change, at most.
TAIL = 4
#: Pieces whose ids a worker keeps.
KEPT = 200_000
KEPT_BYTES = 64


class Codec:
    """Ranks and split pattern of a byte-level vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF, piece: int = PIECE):
        import regex
        self.ranks, self.split, self.leaf, self.piece = ranks, regex.compile(pattern), leaf, piece
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.kept: dict[str, list[int]] = {}

    # Tokens of one piece.

    def merged(self, data: bytes) -> list[int]:
        """Merges the neighbouring pair of lowest rank, the leftmost of equals, until none is left."""
        ranks = self.ranks
        parts = [data[i:i + 1] for i in range(len(data))]
        none = len(ranks)
        pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs:
            low = min(pairs)
            if low == none:
                break
            i = pairs.index(low)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
        return [ranks[p] for p in parts]

    def stable(self, left: int, right: int) -> bool:
        """The two tokens are the encoding of their own bytes."""
        return self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]

    def joined_tokens(self, left: list[int], right: list[int]) -> list[int]:
        """Tokens of the concatenated bytes of two encodings."""
        if not left or not right:
            return left + right
        width = 1
        while True:
            a, b = left[-width:], right[:width]
            middle = self.merged(b"".join(map(self.bytes_of.__getitem__, a + b)))
            whole_left, whole_right = width >= len(left), width >= len(right)
            if (whole_left or self.stable(left[-width - 1], middle[0])) and (whole_right or self.stable(middle[-1], right[width])):
                return left[:-width] + middle + right[width:]
            if whole_left and whole_right:
                return middle
            width *= 2

    def tokens(self, data: bytes) -> list[int]:
        """Result of the merges: halves of a long run of bytes are encoded and joined."""
        if len(data) <= self.piece:
            return self.merged(data)
        half = len(data) // 2
        return self.joined_tokens(self.tokens(data[:half]), self.tokens(data[half:]))

    def ids_of(self, piece: str) -> list[int]:
        ids = self.kept.get(piece)
        if ids is None:
            data = piece.encode("utf-8")
            rank = self.ranks.get(data)  # a whole piece that is a token needs no merges
            ids = [rank] if rank is not None else self.tokens(data)
            if len(piece) <= KEPT_BYTES:
                if len(self.kept) >= KEPT:
                    self.kept.clear()
                self.kept[piece] = ids
        return ids

    # Pieces of a text.

    def joined_pieces(self, left: list[str], right: list[str]) -> list[str]:
        """Pieces of the concatenated text of two piece lists."""
        if not left or not right:
            return left + right
        cut = max(0, len(left) - TAIL)
        head, window, taken, step = left[:cut], "".join(left[cut:]), 0, 1
        inner = len(window)
        while True:
            grown = right[taken:taken + step]
            window, taken, step = window + "".join(grown), taken + len(grown), step * 2
            pieces = self.split.findall(window)
            # Ends of matches in the window, beside those of the right half's own pieces.
            ends, at = set(), inner
            for p in right[:taken]:
                at += len(p)
                ends.add(at)
            at, kept = 0, []
            # The last matches of the window may still change, unless nothing follows it.
            sure = len(pieces) if taken == len(right) else len(pieces) - TAIL
            for p in pieces[:max(sure, 0)]:
                at += len(p)
                kept.append(p)
                if at in ends:
                    index, place = 0, inner
                    while place < at:
                        place += len(right[index])
                        index += 1
                    return head + kept + right[index:]
            if taken == len(right):
                return head + pieces

    def pieces(self, text: str) -> list[str]:
        if len(text) <= self.leaf:
            return self.split.findall(text)
        half = len(text) // 2
        return self.joined_pieces(self.pieces(text[:half]), self.pieces(text[half:]))

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for ids in map(self.ids_of, self.pieces(text)):
            out += ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the ids, concatenated up the tree."""
        if len(ids) <= self.leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@cache
def codec(path: str, pattern: str) -> Codec:
    """One codec per worker and vocabulary."""
    return Codec(load_ranks(path), pattern)


def default_vocabulary() -> tuple[str, str]:
    """Path of the vocabulary file on this machine, and its split pattern."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encoded(docs: DataFrame, keep: list[str], vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """The kept columns with ``__ids`` (array of int) of each row's text."""
    path, pattern = vocabulary or default_vocabulary()
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("__ids", T.ArrayType(T.IntegerType(), False))])
    source = docs.select(*keep, text_of().alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in in_parts(batches):
            ids = pa.array([own.encode(t) for t in batch.column(len(keep)).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], ids], names=[*keep, "__ids"])
        own.kept.clear()  # the worker stays, and its next task may be of another step

    return source.mapInArrow(run, schema)


def decoded(rows: DataFrame, keep: list[str], vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """The kept columns with ``__bytes`` that the ids in ``__ids`` stand for; null ids are none."""
    path, pattern = vocabulary or default_vocabulary()
    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField("__bytes", T.BinaryType())])
    source = rows.select(*keep, "__ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = codec(path, pattern).decode
        for batch in in_parts(batches):
            data = pa.array([decode(i or []) for i in batch.column(len(keep)).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], data], names=[*keep, "__bytes"])

    return source.mapInArrow(run, schema)


REPORT = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def report(docs: DataFrame, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """One row per document: number and digest of its ids, digest of what they decode to."""
    path, pattern = vocabulary or default_vocabulary()
    source = docs.select("doc_id", text_of().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        digest = lambda data: hashlib.sha256(data).hexdigest()
        for batch in in_parts(batches):
            counts, ids_digests, text_digests = [], [], []
            for text in batch.column(1).to_pylist():
                ids = own.encode(text)
                counts.append(len(ids))
                ids_digests.append(digest(",".join(map(str, ids)).encode()))
                text_digests.append(digest(own.decode(ids)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(ids_digests, pa.string()), pa.array(text_digests, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return source.mapInArrow(run, REPORT)
