"""Merkle manifest of a table: one tree a group, one over the groups, a proof for every row.

A row's leaf is the SHA-256 of its fields; per tree (language) leaves ascend by their key, and
every ``FANOUT`` consecutive nodes become the hash of their digests until one is left, the
tree's subroot. Subroots, ordered by tree, become the root in the same way.

Method: concatenated-level strings. An aligned block of ``FANOUT ** LEVELS`` nodes is one row
that keeps every level as one string of hex digests. Parents are hashes of fixed-width
substrings of the level below; a node's siblings are the two substrings that flank it within
its run. The blocks' tops are the nodes of the next round, and the same code runs on them until
a tree has one block. Proofs come down the same way: a block hands its own proof to its rows.

Scale: text is read once, to make leaves; everything after moves digests only. Places within a
tree come from a range partitioning and counts per partition, so a tree that holds most rows,
or a key that repeats, is never one task. A block is bounded by its size. Block tables are
written in the shared folder, so a lost executor costs a reread.

Defined cases: a null field hashes as ``-``; a null tree is a tree of its own, before all
others; null keys come first in their tree; equal keys are ordered by leaf, and equal leaves
are interchangeable. A tree of one row has its leaf as subroot, a table of one tree that
subroot as root. An empty table has no rows. Columns other than the fields are not read.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import ascii_lower, written

#: Nodes that one parent covers, and levels that one block keeps.
FANOUT = 8
LEVELS = 3
#: Characters of a digest.
DIGEST = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def hashed(text: Column) -> Column:
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    """A value with its length in front, so that neighbouring fields cannot run together."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return hashed(F.concat(*[field(v) for v in values]))


def leaves(docs: DataFrame, fields: Sequence[str] = FIELDS, tree: str = "lang", key: str = "doc_id",
           found: Mapping[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """Rows of (key, tree, node, found): each row's leaf, and the leaf of what is found later.

    ``found`` names the fields that differ then; ``where`` the rows they differ in (null: no).
    Elsewhere the column ``found`` is null, meaning unchanged.
    """
    values = [F.col(c) for c in fields]
    later = leaf([(found or {}).get(c, F.col(c)) for c in fields])
    changed = F.when(F.lit(False) if where is None else where, later)
    # A null tree becomes the smallest name; every other name keeps its order behind a prefix.
    name = F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit(""))
    return docs.select(F.col(key).alias("key"), name.alias("tree"), leaf(values).alias("node"), changed.alias("found"))


def numbered(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds ``idx``, a row's place in its tree from 0, and ``n``, the tree's number of rows.

    Rows are partitioned by ranges of the whole order, so one tree or one key spreads over many
    partitions; a place is the count of the partitions before plus the place in its own.
    """
    total = ["tree", *order, "tie"]
    ranged = nodes.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*total)
    table = written(ranged.withColumn("part", F.spark_partition_id()), "merkle-ranges")
    trees = Window.partitionBy("tree")
    before = F.sum("rows").over(trees.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = table.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("rows")).select(
        "tree", "part", F.coalesce(before, F.lit(0)).alias("before"), F.sum("rows").over(trees).alias("n"))
    place = F.row_number().over(Window.partitionBy("tree", "part").orderBy(*order, "tie")) - 1
    return (table.withColumn("place", place).join(parts, ["tree", "part"])
            .withColumn("idx", F.col("before") + F.col("place")).drop("tie", "part", "before", "place"))


def parents(level: Column, fanout: int) -> Column:
    """The level above as one string: the hash of each run of digests."""
    run = fanout * DIGEST
    runs = F.sequence(F.lit(0), F.ceil(F.length(level) / F.lit(run)).cast("int") - 1)
    return F.array_join(F.transform(runs, lambda i: hashed(F.substring(level, i * run + 1, F.lit(run)))), "")


def blocks(nodes: DataFrame, carried: Sequence[str], fanout: int, levels: int) -> DataFrame:
    """One row per aligned block: its nodes in order, each level as a string, and its top.

    A tree of several blocks goes up all levels in each of them; the only block of a tree
    stops at one node. ``level<k>`` is null beyond that.
    """
    size = fanout ** levels
    rows = F.array_sort(F.collect_list(F.struct("idx", "node", *carried)))
    out = nodes.groupBy("tree", F.expr(f"idx div {size}").alias("block")).agg(rows.alias("rows"), F.max("n").alias("n"))
    out = out.withColumn("level0", F.array_join(F.transform("rows", lambda r: r["node"]), ""))
    for k in range(levels):
        below = F.col(f"level{k}")
        more = (F.col("n") > size) | (F.length(below) > DIGEST)
        out = out.withColumn(f"level{k + 1}", F.when(more, parents(below, fanout)))
    top = F.coalesce(*[F.col(f"level{k}") for k in range(levels, -1, -1)])
    return out.withColumn("top", top)


def rounds(nodes: DataFrame, carried: Sequence[str], fanout: int, levels: int) -> list[DataFrame]:
    """Written block tables, the lowest first; the last holds only trees of one block."""
    size, tables = fanout ** levels, []
    while True:
        tables.append(written(blocks(nodes, carried if not tables else (), fanout, levels), "merkle-blocks"))
        open_trees = tables[-1].where(F.col("n") > size)
        if open_trees.isEmpty():
            return tables
        nodes = open_trees.select("tree", F.col("block").alias("idx"), F.col("top").alias("node"),
                                  F.ceil(F.col("n") / size).alias("n"))


def subroots(tables: list[DataFrame], size: int) -> DataFrame:
    """(tree, node) for each tree, from the round in which it came down to one block."""
    done = [t.where(F.col("n") <= size).select("tree", F.col("top").alias("node")) for t in tables]
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def siblings(idx: Column, fanout: int, levels: int) -> Column:
    """Per level that exists, the digests left and right of a node's line within its run."""
    found, place = [], idx % (fanout ** levels)
    for k in range(levels):
        level, own = F.col(f"level{k}"), F.floor(place / (fanout ** k)).cast("int")
        before = own % fanout
        left = F.substring(level, (own - before) * DIGEST + 1, before * DIGEST)
        right = F.substring(level, (own + 1) * DIGEST + 1, (fanout - 1 - before) * DIGEST)
        found.append(F.when(F.col(f"level{k + 1}").isNotNull(), F.struct(left.alias("left"), right.alias("right"))))
    return F.array_compact(F.array(*found))


def proofs(tables: list[DataFrame], above: DataFrame, kept: Sequence[str], fanout: int, levels: int) -> DataFrame:
    """The lowest nodes with their whole path.

    ``above`` holds per tree the path of its subroot and the columns ``kept``, which every row
    of the tree receives. Each round joins blocks with the path of their top, one row each.
    """
    size, handed = fanout ** levels, None
    for table in reversed(tables):
        ends = table.where(F.col("n") <= size).join(above, "tree")
        if handed is not None:
            ends = ends.unionByName(table.where(F.col("n") > size).join(handed, ["tree", "block"]))
        rows = ends.withColumn("rows", F.transform("rows", lambda r: F.struct(
            r.alias("row"), siblings(r["idx"], fanout, levels).alias("own"))))
        rows = rows.select("tree", "path", *kept, F.explode("rows").alias("r"))
        rows = rows.select("tree", "r.row.*", F.concat("r.own", "path").alias("path"), *kept)
        handed = rows.select("tree", F.col("idx").alias("block"), "path", *kept)
    return rows


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, tree: str = "lang", key: str = "doc_id",
             found: Mapping[str, Column] | None = None, where: Column | None = None,
             fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """One row per row of ``docs``: key, tree, leaf, found, path, subroot, root.

    ``path`` lists (left, right) digests from the leaf's run up to the root's;
    see :func:`leaves` for the other arguments. ``levels`` changes no result.
    """
    size = fanout ** levels
    low = numbered(written(leaves(docs, fields, tree, key, found, where), "merkle-leaves"), ["key", "node"])
    tables = rounds(low, ["key", "found"], fanout, levels)
    tops = subroots(tables, size).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node")
    upper = rounds(numbered(tops, ["name"]), ["name"], fanout, levels)
    none = F.array().cast("array<struct<left:string,right:string>>")
    root = subroots(upper, size).select("tree", none.alias("path"), F.col("node").alias("root"))
    above = proofs(upper, root, ["root"], fanout, levels).select(
        F.col("name").alias("tree"), "path", F.col("node").alias("subroot"), "root")
    return proofs(tables, above, ["subroot", "root"], fanout, levels).select(
        "key", "tree", F.col("node").alias("leaf"), "found", "path", "subroot", "root")


def folded(node: Column, path: Column) -> Column:
    """The root that a leaf leads to along a path."""
    return F.aggregate(path, node, lambda acc, s: hashed(F.concat(s["left"], acc, s["right"])))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Checked against a copy in which A-Z of the text is lower-cased in every document whose
    CRC-32 of the decimal id is a multiple of 3 (a null id: no).
    """
    later = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    rows = manifest(docs, found={"text": ascii_lower(F.col("text"))}, where=later)
    told = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    checked = rows.withColumn("folded_root", folded(F.coalesce("found", "leaf"), F.col("path")))
    return checked.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", hashed(told).alias("proof_sha256"),
                          "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: CRC-32 (reflected polynomial 3988292384) of a decimal id, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
    lambda c: CAST(ascii(c) AS BIGINT))), lambda acc, byte: list_reduce(list_prepend(xor(acc, byte),
    list_transform(range(8), lambda i: CAST(i AS BIGINT))),
    lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT)"""


def _field_sql(value: str) -> str:
    text = f"CAST({value} AS VARCHAR)"
    return f"COALESCE(CAST(strlen({text}) AS VARCHAR) || ':' || {text}, '-')"


def report_sql() -> str:
    """The same rows: levels by recursion, one row per node."""
    def climbed(name: str, nodes: str) -> str:
        return f"""{name} AS (
  SELECT tree, 0 AS lvl, idx, node FROM {nodes}
  UNION ALL
  SELECT tree, lvl + 1, idx // {FANOUT}, sha256(string_agg(node, '' ORDER BY idx))
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {name}) WHERE n > 1
  GROUP BY tree, lvl, idx // {FANOUT}
)"""
    def flanks(name: str, levels: str) -> str:
        return f"""{name} AS (
  SELECT a.tree, a.lvl, a.idx, COALESCE(string_agg(b.node, '' ORDER BY b.idx) FILTER (WHERE b.idx < a.idx), '') AS l,
         COALESCE(string_agg(b.node, '' ORDER BY b.idx) FILTER (WHERE b.idx > a.idx), '') AS r
  FROM (SELECT *, max(lvl) OVER (PARTITION BY tree) AS h FROM {levels}) a
  JOIN {levels} b ON b.tree = a.tree AND b.lvl = a.lvl AND b.idx // {FANOUT} = a.idx // {FANOUT}
  WHERE a.lvl < a.h GROUP BY a.tree, a.lvl, a.idx
)"""
    plain = " || ".join(_field_sql(c) for c in FIELDS)
    later = " || ".join(_field_sql(f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
                                   if c == "text" else c) for c in FIELDS)
    return f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, COALESCE('=' || lang, '') AS tree, sha256({plain}) AS node,
         CASE WHEN ({_CRC}) % 3 = 0 THEN sha256({later}) ELSE sha256({plain}) END AS found FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, node) - 1 AS idx FROM hashed
), {climbed("up", "leaves")}, tops AS (
  SELECT '' AS tree, tree AS name, row_number() OVER (ORDER BY tree) - 1 AS idx, node
  FROM (SELECT *, max(lvl) OVER (PARTITION BY tree) AS h FROM up) WHERE lvl = h
), {climbed("over", "tops")}, {flanks("low", "up")}, {flanks("high", "over")}, steps AS (
  SELECT a.doc_id, a.node AS leaf, a.found, a.tree, a.idx, t.node AS subroot,
         list_concat(COALESCE((SELECT list({{'l': l, 'r': r}} ORDER BY lvl) FROM low s
                               WHERE s.tree = a.tree AND s.idx = a.idx // CAST(pow({FANOUT}, s.lvl) AS BIGINT)), []),
                     COALESCE((SELECT list({{'l': l, 'r': r}} ORDER BY lvl) FROM high s
                               WHERE s.idx = t.idx // CAST(pow({FANOUT}, s.lvl) AS BIGINT)), [])) AS path
  FROM leaves a JOIN tops t ON t.name = a.tree
), walk AS (
  SELECT doc_id, leaf, subroot, tree, idx, path, 1 AS step, found AS acc FROM steps
  UNION ALL
  SELECT doc_id, leaf, subroot, tree, idx, path, step + 1, sha256(path[step].l || acc || path[step].r)
  FROM walk WHERE step <= len(path)
)
SELECT doc_id, leaf, subroot, root, sha256(list_aggregate(list_concat([''], list_transform(path, lambda s: s.l || s.r)),
       'string_agg', '')) AS proof_sha256, acc AS folded_root, acc = root AS verified
FROM walk, (SELECT node AS root FROM over ORDER BY lvl DESC LIMIT 1) WHERE step = len(path) + 1"""
