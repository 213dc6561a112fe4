"""Document fingerprints by one-permutation MinHash.

Every shingle of five words (a shorter text is one shingle) is hashed once. The top bits of the
hash name one of 128 bins, each bin keeps its smallest hash. An empty bin takes the value of the
first filled bin on a walk of its own through all bins (optimal densification: each empty bin
draws its donors independently, and alike in all documents). Of each value, hashed once more with
the bin number so that one donor does not agree by chance in many bins at once, the four low bits
are stored, 128 of them packed into eight longs. Two fingerprints agree by chance in 1/16 of the
bins, which the likeness takes out: ``(agreeing - 1/16) / (1 - 1/16)``, kept within 0 and 1.

All of it happens inside one row: sort the hashes, keep the first of each bin, pack. Only the
search for the next document shuffles: ids are ranged into blocks to find their successors,
and each text moves once by its own id and at most half of it once more by that of the one before.

Defined results: null text is empty; a text without words has an empty fingerprint, which is
like another empty one (1) and unlike all others (0). Equal texts have equal fingerprints. Of
several rows with the next id the smallest text (for fingerprints: the smallest fingerprint)
is the next document; rows without an id have none, so that their edited text is their first
half and their likeness to the next is 0. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.llm.common import text_of, words_of, written

SHINGLE = 5
BINS = 128
BITS = 4
#: Bit that the bin number starts at; the sign bit is not used.
SHIFT = 63 - BINS.bit_length() + 1
PER_LONG = 64 // BITS
#: Donors that are tried one by one before the whole walk is laid out.
TRIES = 12


def _mixed(x: int) -> int:
    """A 64-bit finaliser (splitmix64): the walk of a bin is drawn by rule."""
    x = (x + 0x9E3779B97F4A7C15) % (1 << 64)
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) % (1 << 64)
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) % (1 << 64)
    return x ^ (x >> 31)


def donors(bin_: int) -> tuple[int, int]:
    """Start and odd step of a bin's walk, which meets each of the ``BINS`` bins once."""
    return _mixed(2 * bin_) % BINS, _mixed(2 * bin_ + 1) % BINS | 1


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def with_fingerprints(df: DataFrame, texts: dict[str, str]) -> DataFrame:
    """Adds a packed fingerprint (array of longs, null without words) per text column.

    ``texts`` maps the name of a text column to the name of the new column.
    """
    start, step = (F.array(*[F.lit(donors(i)[k]) for i in range(BINS)]) for k in (0, 1))
    for text, out in texts.items():
        w, s, m, d = (f"__print_{x}" for x in "wsmd")
        keep = [c for c in df.columns if c not in (w, s, m, d)]
        df = df.select(*keep, words_of(text_of(text)).alias(w))
        full = F.slice(F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, SHINGLE)])), F.lit(1), F.greatest(F.size(w) - (SHINGLE - 1), F.lit(0)))
        hashes = F.when(F.size(w) >= SHINGLE, full).when(F.size(w) > 0, F.array(F.xxhash64(F.col(w)))).otherwise(F.array().cast("array<bigint>"))
        df = df.select(*keep, F.sort_array(F.transform(hashes, lambda h: h.bitwiseAND(F.lit((1 << 63) - 1)))).alias(s))
        bin_of = lambda h: F.shiftright(h, SHIFT).cast("int")
        df = df.select(*keep, F.filter(s, lambda h, j: F.coalesce(bin_of(h) != bin_of(F.get(s, j - 1)), F.lit(True))).alias(m))
        # Which bins are filled, as two longs; a bin's place among the minima is a bit count.
        half = BINS // 2
        mask = lambda low: F.aggregate(m, F.lit(0).cast("long"), lambda a, h: a.bitwiseOR(
            F.when((bin_of(h) < half) if low else (bin_of(h) >= half), _bit(bin_of(h) % half)).otherwise(F.lit(0).cast("long"))))
        lo, hi = "__print_lo", "__print_hi"
        df = df.select(*keep, m, mask(True).alias(lo), mask(False).alias(hi))

        def own(i: Column) -> Column:
            word = F.when(i < half, F.col(lo)).otherwise(F.col(hi))
            bit = _bit(i % half)
            under = F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), i % half))
            below = F.bit_count(word.bitwiseAND(under)) + F.when(i < half, F.lit(0)).otherwise(F.bit_count(F.col(lo)))
            return F.when(word.bitwiseAND(bit) != 0, F.get(m, below))

        df = df.select(*keep, F.when(F.size(m) == BINS, F.col(m)).when(F.size(m) > 0, F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), own)).alias(d))
        at = lambda i, t: F.get(d, (F.get(start, i) + F.get(step, i) * t) % BINS)
        walk = lambda i: F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda t: at(i, t)), lambda x: x.isNotNull()), F.lit(0))
        low = F.transform(d, lambda v, i: F.xxhash64(F.coalesce(v, *[at(i, F.lit(t)) for t in range(TRIES)], walk(i)), i).bitwiseAND(F.lit((1 << BITS) - 1)))
        df = df.select(*keep, low.alias(d))
        packed = F.transform(F.sequence(F.lit(0), F.lit(BINS // PER_LONG - 1)), lambda k: F.aggregate(
            F.slice(d, k * PER_LONG + 1, F.lit(PER_LONG)), F.lit(0).cast("long"), lambda a, v: F.shiftleft(a, BITS).bitwiseOR(v)))
        df = df.select(*keep, F.when(F.col(d).isNotNull(), packed).alias(out))
    return df


def as_text(packed: str) -> Column:
    """128 hexadecimal digits, one per bin; empty without words."""
    return F.coalesce(F.array_join(F.transform(packed, lambda x: F.lpad(F.lower(F.hex(x)), PER_LONG * BITS // 4, "0")), ""), F.lit(""))


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of two packed fingerprints."""
    ones = F.lit(int("1" * PER_LONG, 16))

    def unequal(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        for k in (1, 2):
            z = z.bitwiseOR(F.shiftrightunsigned(z, k))
        return F.bit_count(z.bitwiseAND(ones))

    differ = F.aggregate(F.zip_with(a, b, unequal), F.lit(0), lambda s, x: s + x)
    chance = 1 / (1 << BITS)
    agree = (F.lit(float(BINS)) - differ) / BINS
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (agree - chance) / (1 - chance)))
    return F.when(F.col(a).isNull() & F.col(b).isNull(), F.lit(1.0)).otherwise(F.coalesce(value, F.lit(0.0)))


def successors(ids: DataFrame) -> DataFrame:
    """(doc_id, n_chars) -> (doc_id, next_id, prev_id, prev_chars), cyclic in ascending order.

    Ids are ranged into blocks, whose numbers are written with them. A block finds its own
    successors; one row per block links it to the next.
    """
    ranged = ids.where(F.col("doc_id").isNotNull()).repartitionByRange("doc_id").withColumn("block", F.spark_partition_id())
    ranged = written(ranged.groupBy("block", "doc_id").agg(F.max("n_chars").alias("n_chars")), "next-blocks")
    row = F.struct("doc_id", "n_chars")
    ends = ranged.groupBy("block").agg(F.min(row).alias("first"), F.max(row).alias("last"))
    line = Window.orderBy("block")
    every = Window.partitionBy()
    ends = ends.select("block", F.coalesce(F.lead("first").over(line), F.min("first").over(every)).alias("after"),
                       F.coalesce(F.lag("last").over(line), F.max("last").over(every)).alias("before"))
    own = Window.partitionBy("block").orderBy("doc_id")
    linked = ranged.withColumn("next", F.lead(row).over(own)).withColumn("prev", F.lag(row).over(own)).join(ends, "block")
    after, before = F.coalesce("next", "after"), F.coalesce("prev", "before")
    return linked.select("doc_id", after["doc_id"].alias("next_id"), before["doc_id"].alias("prev_id"), before["n_chars"].alias("prev_chars"))


def report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses."""
    docs = docs.select("doc_id", text_of().alias("text"))
    links = written(successors(docs.select("doc_id", F.length("text").alias("n_chars"))), "next-links")
    # Both uses of this join read one shuffle of the texts.
    linked = docs.join(links, "doc_id", "left")
    heads = linked.groupBy(F.col("prev_id").alias("doc_id")).agg(F.min(F.expr("left(text, prev_chars div 2)")).alias("head"))
    both = linked.select("doc_id", "next_id", "text").join(heads, "doc_id", "left")
    n = F.length("text")
    cut = F.floor(n / 2).cast("int")
    edited = F.concat(F.expr("left(text, length(text) - length(text) div 2)"), F.coalesce(F.substring(F.col("head"), F.lit(1), cut), F.lit("")))
    both = both.select("doc_id", "next_id", "text", n.cast("long").alias("n_chars"), edited.alias("edited"))
    both = both.withColumn("edited_sha256", F.sha2("edited", 256))
    prints = with_fingerprints(both, {"text": "print", "edited": "edited_print"}).drop("text", "edited")
    prints = written(prints, "fingerprints")
    nexts = prints.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("next_id")).agg(
        F.min(as_text("print")).alias("key"), F.min_by("print", as_text("print")).alias("next_print"))
    out = prints.join(nexts, "next_id", "left")
    near_next = F.when(F.col("next_id").isNull(), F.lit(0.0)).otherwise(likeness("print", "next_print"))
    return out.select("doc_id", "n_chars", "edited_sha256", as_text("print").alias("fingerprint"),
                      as_text("edited_print").alias("edited_fingerprint"), likeness("print", "edited_print").alias("near_edited"), near_next.alias("near_next"))
