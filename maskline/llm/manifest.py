"""Merkle manifest of a dataset: a digest for every row, folded eight at a time to one root for each tree and one for all.

Trees are kept as blocks of 8^4 leaves, one table row each; the digests of the blocks are the leaves of the next tier, and so on,
so that no task ever sees more than a block and the path above it. Inside a task a parent retains a copy of its hash state
before each child's slot (SHA midstates). To fold a changed child, the state of its slot is resumed with the replacement and the
siblings to its right alone; what stands to the left is never hashed again.
"""

from __future__ import annotations

from binascii import hexlify
from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskline.plans.session import ship

from .common import stored, tidy

#: Children of a node, and levels of a block, which so has FANOUT ** LEVELS leaves at most.
FANOUT, LEVELS = 8, 4
#: Nodes that one range of the sorted nodes should hold.
NODES_A_RANGE = 1 << 20
#: Rows of a small table (offsets of ranges, paths of blocks: at most some KB each) that may be sent to all tasks; more are joined by a shuffle.
BROADCAST_ROWS = 10_000

#: What a leaf hashes, in this order.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
LEAF = "tree string, doc_id long, leaf binary, now binary"


def height(nodes: int) -> int:
    """Levels above so many nodes until one remains."""
    n = 0
    while nodes > 1:
        nodes, n = -(-nodes // FANOUT), n + 1
    return n


class Level:
    """The parents over a row of nodes (hex digests), each with its hash states before every child's slot."""

    def __init__(self, nodes: list[bytes]) -> None:
        self.children, self.states, self.nodes = nodes, [], []
        for lo in range(0, len(nodes), FANOUT):
            state = sha256()
            for child in nodes[lo : lo + FANOUT]:
                self.states.append(state.copy())
                state.update(child)
            self.nodes.append(state.hexdigest().encode())

    def sides(self, i: int) -> tuple[bytes, bytes]:
        """The siblings left and right of a child, back to back."""
        lo = i - i % FANOUT
        return b"".join(self.children[lo:i]), b"".join(self.children[i + 1 : lo + FANOUT])


def raised(nodes: list[bytes], levels: int) -> list[Level]:
    out = []
    for _ in range(levels):
        out.append(Level(nodes))
        nodes = out[-1].nodes
    return out


def leaves(docs: DataFrame, fields: list[str] = FIELDS, every: int = 3) -> DataFrame:
    """tree, doc_id, leaf, now of each row: its digest, and the one after tampering (else the same).

    A field is `-` if null, else its UTF-8 byte count, `:` and its value. The tree is lang ('' for null, '=' before others, so null
    comes first). Tampering lower-cases the text's A-Z where `every` divides crc32 of the decimal doc_id; a null doc_id or text
    stays. The state after the fields before the text is kept, and resumed for both texts."""
    ship(docs.sparkSession)
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    rows = docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("id"), *(F.col(c).cast("string").cast("binary").alias(f"f{i}") for i, c in enumerate(fields)))

    def field(v: bytes | None) -> bytes:
        return b"-" if v is None else b"%d:%b" % (len(v), v)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, columns, leaf, now = b["id"].to_pylist(), [b[f"f{i}"].to_pylist() for i in range(len(fields))], [], []
            for doc, *head, text in zip(ids, *columns):
                state = sha256(b"".join(map(field, head)))
                whole = state.copy()
                whole.update(field(text))
                leaf.append(whole.digest())
                if text is not None and doc is not None and crc32(b"%d" % doc) % every == 0:
                    state.update(field(text.lower()))  # of bytes: A-Z alone
                    now.append(state.digest())
                else:
                    now.append(leaf[-1])
            yield pa.RecordBatch.from_arrays([b["tree"], b["id"], pa.array(leaf, pa.binary()), pa.array(now, pa.binary())], ["tree", "doc_id", "leaf", "now"])
        tidy()

    return rows.mapInArrow(each, LEAF)


def sent(df: DataFrame) -> DataFrame:
    """df, marked to be sent to all tasks if it was counted as small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with rank, their place in their tree by the given order, from 0; and total, the nodes of their tree.

    Ranges of the sorted rows are numbered inside tasks; a range's base in a tree is a prefix sum over the counts of (range, tree)."""
    rows = stored(rows, "nodes")
    order = [F.col("tree"), *order]
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // NODES_A_RANGE + 1)
    placed = stored(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "ranges")
    placed = placed.withColumn("range", F.shiftright("place", 33))  # the id holds the task's number above 33 bits of row number
    counts = placed.groupBy("range", "tree").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")
    shifts = stored(counts.select("range", "tree", shift.alias("shift"), F.sum("n").over(tree).alias("total")), "shifts")
    return placed.join(sent(shifts), ["range", "tree"]).select("tree", (F.col("place") + F.col("shift")).alias("rank"), "total", *(c for c in rows.columns if c != "tree"))


def packed(nodes: DataFrame, levels: int) -> DataFrame:
    """tree, block, total, nodes: one row for each FANOUT ** levels consecutive nodes of a tree."""
    own = [c for c in nodes.columns if c not in ("tree", "total")]
    rows = nodes.groupBy("tree", F.floor(F.col("rank") / FANOUT**levels).cast("long").alias("block"), "total").agg(F.array_sort(F.collect_list(F.struct("rank", *(c for c in own if c != "rank")))).alias("nodes"))
    return stored(rows, "blocks")


def hexed(nodes: pa.StructArray, name: str) -> list[bytes]:
    return [hexlify(x) for x in nodes.field(name).to_pylist()]


def block_rows(b: pa.RecordBatch, levels: int) -> Iterator[tuple[int, int, pa.StructArray]]:
    """place in the batch, levels of the block, its nodes."""
    total, nodes = b["total"].to_pylist(), b["nodes"]
    for i in range(len(total)):
        yield i, min(levels, height(total[i])), nodes[i].values


def tops(blocks: DataFrame, levels: int) -> DataFrame:
    """tree, rank, total, leaf of the nodes over the blocks."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(raised(hexed(nodes, "leaf"), n)[-1].nodes[0] if n else hexed(nodes, "leaf")[0]) for _, n, nodes in block_rows(b, levels)]
            total = [-(-n // FANOUT**levels) for n in b["total"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["tree"], b["block"], pa.array(total, pa.int64()), pa.array([bytes.fromhex(x.decode()) for x in out], pa.binary())], ["tree", "rank", "total", "leaf"])

    return stored(blocks.mapInArrow(each, "tree string, rank long, total long, leaf binary"), "tops")


PATH = "array<struct<left: binary, right: binary>>"


def sides(blocks: DataFrame, levels: int, keep: str = "leaf binary") -> DataFrame:
    """tree, rank, block, the kept column and path of each node of the blocks: its siblings, level by level up to the node over the block."""
    name = keep.split()[0]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))
        for b in batches:
            trees, numbers = b["tree"].to_pylist(), b["block"].to_pylist()
            for i, n, nodes in block_rows(b, levels):
                up = raised(hexed(nodes, "leaf"), n)
                out = [[dict(zip(("left", "right"), level.sides(j // FANOUT**k))) for k, level in enumerate(up)] for j in range(len(nodes))]
                yield pa.RecordBatch.from_arrays([pa.array([trees[i]] * len(nodes)), nodes.field("rank"), pa.array([numbers[i]] * len(nodes), pa.int64()), nodes.field(name), pa.array(out, kind)], ["tree", "rank", "block", name, "path"])

    return blocks.mapInArrow(each, f"tree string, rank long, block long, {keep}, path {PATH}")


class Forest:
    """Trees over rows (tree, leaf, any others): the blocks of their leaves, the trees' roots, and the ways from blocks to roots."""

    def __init__(self, rows: DataFrame, order: list[Column], levels: int) -> None:
        self.blocks = packed(ranked(rows, order), levels)
        most = self.blocks.agg(F.max("total")).first()[0] or 0
        up, tiers = tops(self.blocks, levels), []
        roots = up.filter("total = 1")
        while most > FANOUT**levels:
            tiers.append(packed(up.filter("total > 1"), levels))
            up, most = tops(tiers[-1], levels), -(-most // FANOUT**levels)
            roots = roots.union(up.filter("total = 1"))
        #: tree, leaf
        self.roots = roots.select("tree", "leaf")
        #: tree, block, over: the path above a block; None where every tree is one block
        self.over = None
        for tier in reversed(tiers):  # the nodes of a tier are the blocks of the one below
            way = self.to_root(sides(tier, levels)).select("tree", F.col("rank").alias("block"), F.col("path").alias("over"))
            self.over = stored(way, "paths")

    def to_root(self, nodes: DataFrame) -> DataFrame:
        """nodes (tree, block, path) of the tier below the known ones, their paths prolonged up to the root."""
        if self.over is None:
            return nodes
        path = F.concat("path", F.coalesce("over", F.array().cast(PATH)))
        return nodes.join(sent(self.over), ["tree", "block"], "left").withColumn("path", path).drop("over")


def proofs(rows: DataFrame, levels: int = LEVELS) -> DataFrame:
    """rows (tree, doc_id, leaf, now: binary digests) -> doc_id, tree, leaf, subroot, root, proof_sha256, folded_root, verified, depth.

    Leaves ascend by doc_id in their tree, null first, rows of one doc_id by their leaf (equal leaves are alike). The trees' roots, by
    the trees' names, are the leaves of one more tree. `now` stands in the leaf's place when the root is folded again. No rows: none."""
    forest = Forest(rows, [F.col("doc_id").asc_nulls_first(), F.col("leaf")], levels)
    top = Forest(forest.roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "leaf"), [F.col("name")], levels)
    ends = top.to_root(sides(top.blocks, levels, "name string")).select(F.col("name").alias("tree"), F.col("path").alias("end"))
    ends = ends.join(forest.roots.withColumnRenamed("leaf", "subroot"), "tree").crossJoin(F.broadcast(top.roots.select(F.col("leaf").alias("root"))))  # one row
    ends = stored(ends, "ends")
    blocks = forest.to_root(forest.blocks.withColumn("path", F.array().cast(PATH)))
    blocks = blocks.join(sent(ends), "tree").withColumn("path", F.concat("path", "end"))
    kinds = [("doc_id", "long"), ("tree", "string"), ("leaf", "string"), ("subroot", "string"), ("root", "string"), ("proof_sha256", "string"), ("folded_root", "string"), ("verified", "boolean"), ("depth", "int")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            trees, paths, subroots, roots = (b[c].to_pylist() for c in ("tree", "path", "subroot", "root"))
            for i, n, nodes in block_rows(b, levels):
                first, replaced = hexed(nodes, "leaf"), hexed(nodes, "now")
                up = [(level.states, [level.sides(j) for j in range(len(level.children))]) for level in raised(first, n)]
                over = [(sha256(p["left"]), p["left"] + p["right"], p["right"]) for p in paths[i]]
                proof, folded = [], []
                for j, node in enumerate(replaced):
                    siblings = sha256()
                    for states, beside in up:
                        left, right = beside[j]
                        siblings.update(left + right)
                        state = states[j].copy()
                        state.update(node + right)
                        node = state.hexdigest().encode()
                        j //= FANOUT
                    for before, others, right in over:
                        siblings.update(others)
                        state = before.copy()
                        state.update(node + right)
                        node = state.hexdigest().encode()
                    proof.append(siblings.hexdigest())
                    folded.append(node.decode())
                root, many = roots[i].hex(), len(first)
                out = [nodes.field("doc_id"), [trees[i]] * many, [x.decode() for x in first], [subroots[i].hex()] * many, [root] * many, proof, folded, [x == root for x in folded], pa.array([n + len(over)] * many, pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, list) else x for x in out], [k for k, _ in kinds])
        tidy()

    return blocks.select("tree", "total", "nodes", "path", "subroot", "root").mapInArrow(each, ", ".join(map(" ".join, kinds)))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, its tree's root, the root of all, its proof, and the root folded after tampering: see leaves(), proofs().

    Null fields count as `-`; a null lang is a tree of its own, the first; null doc_ids come first and aren't tampered with. Rows of one
    doc_id stand by their leaves; equal rows are leaves of their own. Other columns are left aside. No documents: no rows."""
    return proofs(leaves(spark.read.parquet(f"{sf_dir}/documents.parquet"))).drop("tree")


#: The decimal doc_id's crc32, bit by bit.
CRC_SQL = "list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(id) + 1), lambda i: ascii(id[i])::UBIGINT)), lambda c, x: list_reduce(list_prepend(xor(c, x), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, _: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::UBIGINT) ELSE y >> 1 END)) "
LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def field_sql(x: str) -> str:
    return f"coalesce(strlen({x}::VARCHAR) || ':' || {x}::VARCHAR, '-')"


OP11_SQL = f"""
WITH RECURSIVE d AS (SELECT *, doc_id::VARCHAR AS id, {' || '.join(field_sql(x) for x in FIELDS[:-1])} AS head FROM documents),
l AS (SELECT doc_id, lang, sha256(head || {field_sql('text')}) AS leaf, CASE WHEN xor({CRC_SQL}, 4294967295::UBIGINT) % 3 = 0 THEN sha256(head || {field_sql(LOWER_SQL)}) ELSE sha256(head || {field_sql('text')}) END AS now FROM d),
r AS (SELECT row_number() OVER () AS key, *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
up AS (
  SELECT lang, 0 AS level, pos, leaf AS node, count(*) OVER (PARTITION BY lang) AS n FROM r
  UNION ALL
  SELECT lang, any_value(level) + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), ceil(any_value(n) / 8)::BIGINT FROM up WHERE n > 1 GROUP BY lang, pos // 8),
s AS (SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
  SELECT 0 AS level, pos, subroot AS node, n FROM s
  UNION ALL
  SELECT any_value(level) + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), ceil(any_value(n) / 8)::BIGINT FROM top WHERE n > 1 GROUP BY pos // 8),
sides AS (
  SELECT coalesce('=' || a.lang, '') AS tree, a.level, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r
  FROM up a JOIN up b ON a.lang IS NOT DISTINCT FROM b.lang AND a.level = b.level AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY ALL),
ends AS (
  SELECT a.level, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r
  FROM top a JOIN top b ON a.level = b.level AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY ALL),
steps AS (
  SELECT key, level, l, r FROM r JOIN sides ON tree = coalesce('=' || r.lang, '') AND sides.pos = r.pos // (8 ** level)::BIGINT
  UNION ALL
  SELECT key, 100 + level, l, r FROM r JOIN s ON r.lang IS NOT DISTINCT FROM s.lang JOIN ends ON ends.pos = s.pos // (8 ** level)::BIGINT),
lists AS (SELECT r.key, any_value(now) AS now, coalesce(list([l, r] ORDER BY level) FILTER (WHERE level IS NOT NULL), []) AS way FROM r LEFT JOIN steps USING (key) GROUP BY ALL),
folds AS (SELECT key, list_reduce(list_prepend([now, ''], way), lambda a, x: [sha256(x[1] || a[1] || x[2]), ''])[1] AS folded_root, sha256(array_to_string(list_transform(way, lambda x: x[1] || x[2]), '')) AS proof_sha256 FROM lists)
SELECT doc_id, leaf, subroot, node AS root, proof_sha256, folded_root, folded_root = node AS verified, len(way)::INT AS depth
FROM r JOIN folds USING (key) JOIN lists USING (key) JOIN s ON r.lang IS NOT DISTINCT FROM s.lang, (SELECT node FROM top WHERE n = 1)
"""
