"""N-gram Jaccard join by signature trees.

Documents are sets of word shingles. A prefix filter deals the sets out to groups that may hold links: shingles have one
order for the whole corpus (frequent ones last, then longest first), and two sets that link share one of the first
n - ceil(t * n) + 1 of both. Inside a group stand signature trees: a leaf has a set's token bitmap and size, a node the
OR of its children's bitmaps and their range of sizes. Two trees are traversed together; a pair of nodes is left if the
largest overlap that their bitmaps and sizes allow is too small. What is left at the leaves may link; the exact sets decide.

Only connectivity is asked for, so a group first gives a spanning forest of its possible links, best ones first; only
groups where one of these fails give all their remaining pairs between different components. No group is expanded
into all pairs; equal sets are one node; large groups are split into blocks by size, which meet in pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_IDS, LAST_ID, Recent, as_bytes, cached, each_group, id_text, keyed, stored, tidy, windows, without, word_hashes
from .counts import Counter
from .graph import components

PERCENT = 85
SHINGLE = 4
#: A shingle is frequent if it comes this often among TOGETHER shingles in a row; so many of them are held by every task.
OFTEN = 8
TOGETHER = 2 << 20
MAX_FREQUENT = 1 << 17
#: Sets of one block of a group; two blocks meet in one task.
BLOCK = 1024
FAN = 16
#: Bits of a signature for each shingle, at least.
BITS = 4
#: Stands for a null doc_id in joins.
NO_ID = -(1 << 63)


class SizedHashes(Recent):
    """word -> 64-bit hash whose low 6 bits are the word's length (63 at most)."""

    def make(self, key: bytes) -> int:
        return xxhash.xxh3_64_intdigest(key) & ~0x3F | min(len(key), 63)


def shingles(text: bytes, size: int, cache: SizedHashes) -> np.ndarray:
    """The different shingles of a text, in order: the first byte falls with the length, the rest is a hash."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words, cache)
    size = min(size, len(words))
    ids, length = windows(h, size), np.zeros(len(h) - size + 1, np.uint64)
    for i in range(size):
        length += h[i : i + len(length)] & np.uint64(0x3F)
    return np.unique((np.uint64(255) - np.minimum(length, np.uint64(255))) << np.uint64(56) | ids >> np.uint64(8))


def set_id(ids: np.ndarray) -> int:
    h = xxhash.xxh3_64_intdigest(ids.tobytes())
    return h - (1 << 64) if h >> 63 else h


def frequent_shingles(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that come often somewhere, sorted, and each one's rank by frequency. Their order is all they decide."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, out = cached(SizedHashes), Counter()
        held, n = [], 0

        def fold() -> None:
            codes, counts = np.unique(np.concatenate(held), return_counts=True)
            out.add(codes[counts >= OFTEN], counts[counts >= OFTEN])

        for b in batches:
            for text in b["text"].to_pylist():
                held.append(shingles(text, size, cache))
                n += len(held[-1])
                if n >= TOGETHER:
                    fold()
                    held, n = [], 0
        if held:
            fold()
        codes, counts = out.result()
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], ["id", "n"])
        tidy()

    top = as_bytes(docs.select("text")).mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").limit(MAX_FREQUENT).toArrow()
    ids = top["id"].to_numpy().view(np.uint64)
    rank = np.arange(len(ids))[::-1]
    order = np.argsort(ids)
    return ids[order], rank[order]


def signature(ids: np.ndarray) -> np.ndarray:
    """The bitmap of a set: a power of two of bits, BITS for each member at least."""
    bits = 64
    while bits < BITS * len(ids):
        bits *= 2
    out = np.zeros(bits, np.uint8)
    out[(ids & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def set_rows(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, text_hash, sid (hash of the set), n, keys (its prefix) and bits (its signature): the last two once a task for equal sets."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, size))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (often, rank), cache, seen = sent.value, cached(SizedHashes), set()
        for b in batches:
            sids, sizes, keys, bits = [], [], [], []
            for text in b["text"].to_pylist():
                ids = shingles(text, size, cache)
                n = len(ids)
                sid = set_id(ids)
                sids.append(sid)
                sizes.append(n)
                if sid in seen or not n:
                    keys.append(None)
                    bits.append(None)
                    continue
                seen.add(sid)
                p = n - (percent * n + 99) // 100 + 1
                if len(often):
                    at = np.searchsorted(often, ids)
                    at[at == len(often)] = 0
                    hit = often[at] == ids
                    prefix = ids[~hit][:p]
                    if len(prefix) < p:
                        late = ids[hit]
                        prefix = np.concatenate([prefix, late[np.argsort(rank[at[hit]])[: p - len(prefix)]]])
                else:
                    prefix = ids[:p]
                keys.append(prefix.view(np.int64))
                bits.append(signature(ids).tobytes())
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["text_hash"], pa.array(sids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.binary())], ["doc_id", "text_hash", "sid", "n", "keys", "bits"])
        tidy()

    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return stored(as_bytes(docs).mapInArrow(each, "doc_id long, text_hash long, sid long, n long, keys array<long>, bits binary"), "sets")


def candidate_groups(sets: DataFrame, percent: int) -> DataFrame:
    """gid, side, sid, n: the blocks (side 0 and 1; alone: 0) whose trees are to be traversed together."""
    rows = sets.filter("keys is not null").select("sid", "n", F.explode("keys").alias("key"))
    by = Window.partitionBy("key").orderBy("n", "sid")
    rows = rows.withColumn("last", F.lag("sid").over(by)).filter("last is null or last <> sid")
    before, after = F.lag("n").over(by), F.lead("n").over(by)
    near = F.coalesce(100 * before >= percent * F.col("n"), F.lit(False))
    rows = rows.select("key", "sid", "n", near.alias("near"), F.coalesce(100 * F.col("n") >= percent * after, F.lit(False)).alias("next")).filter("near or next")
    rows = rows.withColumn("part", F.sum(F.when(F.col("near"), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    rows = stored(rows.select(F.xxhash64("key", "part").alias("gid"), "sid", "n"), "candidates")
    # many keys have the same members: one of them stands for all
    groups = rows.groupBy("gid").agg(F.count("*").alias("size"), F.sum(F.xxhash64("sid").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("sid", F.lit(1))).alias("x"), F.min("n").alias("low"), F.max("n").alias("high"))
    groups = groups.groupBy("size", "s", "x").agg(F.min("gid").alias("gid"))
    rows = rows.join(groups.select("gid", "size"), "gid")
    alone = rows.filter(F.col("size") <= BLOCK).select("gid", F.lit(0).alias("side"), "sid", "n")
    place = F.row_number().over(Window.partitionBy("gid").orderBy("n", "sid"))
    large = rows.filter(F.col("size") > BLOCK).select("gid", "sid", "n", F.floor((place - 1) / BLOCK).alias("block"))
    ranges = large.groupBy("gid", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    other = ranges.select("gid", F.col("block").alias("second"), F.col("low").alias("its_low"))
    meet = ranges.join(other, "gid").filter((F.col("block") <= F.col("second")) & (100 * F.col("high") >= percent * F.col("its_low")))
    meet = meet.select(F.xxhash64("gid", "block", "second").alias("own"), "gid", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("block").alias("block")), F.struct(F.lit(1).alias("side"), F.col("second").alias("block")))).alias("m"))
    meet = meet.select("own", "gid", "m.side", "m.block").groupBy("own", "gid", "block").agg(F.min("side").alias("side"))
    split = large.join(meet, ["gid", "block"]).select(F.col("own").alias("gid"), F.col("side").cast("int"), "sid", "n")
    return stored(alone.union(split), "groups")


class Tree:
    """Levels of nodes over leaves in the given order: bitmaps, size ranges, and by how much sizes exceed set bits."""

    def __init__(self, bits: np.ndarray, n: np.ndarray):
        self.levels = [(bits, n, n, n - np.bitwise_count(bits).sum(1))]
        while len(self.levels[-1][1]) > FAN:
            bits, low, high, slack = self.levels[-1]
            at = np.arange(0, len(low), FAN)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(slack, at)))


def traverse(a: Tree, b: Tree, percent: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of leaves (of one tree with itself: each pair once) that may link, and the largest Jaccard they may have."""
    depth = min(len(a.levels), len(b.levels)) - 1
    x, y = (v.ravel() for v in np.meshgrid(np.arange(len(a.levels[depth][1])), np.arange(len(b.levels[depth][1])), indexing="ij"))
    for level in range(depth, -1, -1):
        if same:
            keep = x < y if level == 0 else x <= y
            x, y = x[keep], y[keep]
        (abits, alow, ahigh, aslack), (bbits, blow, bhigh, bslack) = a.levels[level], b.levels[level]
        keep = (100 * ahigh[x] >= percent * blow[y]) & (100 * bhigh[y] >= percent * alow[x])
        x, y = x[keep], y[keep]
        bound = np.empty(len(x))
        step = max(1, (1 << 21) // max(1, abits.shape[1]))
        for lo in range(0, len(x), step):
            i, j = x[lo : lo + step], y[lo : lo + step]
            shared = np.bitwise_count(abits[i] & bbits[j]).sum(1).astype(np.int64)
            if level:
                bound[lo : lo + step] = shared + np.minimum(aslack[i], bslack[j])
            else:  # members whose bit the other lacks are not shared
                sa, sb = alow[i] - aslack[i] - shared, blow[j] - bslack[j] - shared
                bound[lo : lo + step] = np.minimum(alow[i] - sa, blow[j] - sb)
        if level:
            bound = np.minimum(bound, np.minimum(ahigh[x], bhigh[y]))
        keep = (100 + percent) * bound >= percent * (alow[x] + blow[y])
        x, y, bound = x[keep], y[keep], bound[keep]
        if level == 0:
            return x, y, bound / (a.levels[0][1][x] + b.levels[0][1][y] - bound)
        step = np.arange(FAN)
        x, y = (x[:, None, None] * FAN + step[:, None]), (y[:, None, None] * FAN + step[None, :])
        x, y = (v.ravel() for v in np.broadcast_arrays(x, y))
        keep = (x < len(a.levels[level - 1][1])) & (y < len(b.levels[level - 1][1]))
        x, y = x[keep], y[keep]
    return x, y, np.empty(0)


def by_width(bits: list[bytes], n: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """width in 64-bit words -> places, and bitmaps as rows."""
    widths = np.fromiter((len(x) // 8 for x in bits), np.int64, len(bits))
    out = {}
    for w in np.unique(widths):
        at = np.flatnonzero(widths == w)
        out[int(w)] = at, np.frombuffer(b"".join([bits[i] for i in at]), np.uint64).reshape(len(at), w)
    return out


def folded(bits: np.ndarray) -> np.ndarray:
    half = bits.shape[1] // 2
    if half:
        return bits[:, :half] | bits[:, half:]
    return bits


def possible_links(bits: list[bytes], n: np.ndarray, side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of pairs that may link, the best first. side: where both are there, only pairs of a 0 and a 1."""
    found, classes = [], by_width(bits, n)
    apart = bool(side.any())
    for w, (at, rows) in classes.items():
        for w2 in (w, 2 * w):
            if w2 not in classes:
                continue
            at2, rows2 = classes[w2]
            if w2 > w:
                rows2 = folded(rows2)
            for s, t in ((0, 1), (1, 0)) if apart else ((0, 0),):
                if apart and w2 == w and s == 1:
                    continue
                i, j = (np.flatnonzero(side[at] == s), np.flatnonzero(side[at2] == t)) if apart else (np.arange(len(at)), np.arange(len(at2)))
                if not len(i) or not len(j):
                    continue
                same = w2 == w and not apart
                tree = Tree(rows[i], n[at[i]])
                x, y, share = traverse(tree, tree if same else Tree(rows2[j], n[at2[j]]), percent, same)
                found.append((at[i][x], at2[j][y], share))
    x, y, share = (np.concatenate(v) for v in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    order = np.argsort(-share, kind="stable")
    return x[order], y[order], share[order]


def forest(x: np.ndarray, y: np.ndarray, size: int) -> list[int]:
    """Which pairs, taken in order, connect what wasn't connected yet."""
    parent, out = list(range(size)), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for k, (i, j) in enumerate(zip(x.tolist(), y.tolist())):
        i, j = root(i), root(j)
        if i != j:
            parent[i] = j
            out.append(k)
            if len(out) == size - 1:
                break
    return out


def tree_pairs(groups: DataFrame, sets: DataFrame, percent: int, roots: DataFrame | None = None) -> DataFrame:
    """gid, a, b (a < b). Without roots each group's forest; with them (sid, root) all pairs of different roots."""
    need = stored(groups.select("sid").distinct(), "grouped")
    bits = sets.filter("bits is not null").select("sid", "bits")
    if need.count() <= BROADCAST_IDS:  # else the join below leaves out the others
        bits = bits.join(F.broadcast(need), "sid", "left_semi")
    bits = bits.groupBy("sid").agg(F.first("bits").alias("bits"))
    rows = groups.join(bits, "sid")
    rows = rows.withColumn("root", F.lit(0).cast("long")) if roots is None else rows.join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    rows = rows.select("gid", "side", "sid", "n", "root", "bits").repartition("gid").sortWithinPartitions("gid", "n", "sid")
    whole = roots is not None

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0

        def batch() -> pa.RecordBatch:
            g, a, b = (np.concatenate(v) for v in zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(g), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["gid", "a", "b"])

        for t in each_group(batches, "gid"):
            sid, root = t["sid"].to_numpy(), t["root"].to_numpy()
            x, y, _ = possible_links(t["bits"].to_pylist(), t["n"].to_numpy(), t["side"].to_numpy(), percent)
            if whole:
                keep = root[x] != root[y]
                x, y = x[keep], y[keep]
            else:
                keep = forest(x, y, len(sid))
                x, y = x[keep], y[keep]
            if len(x):
                out.append((np.full(len(x), t["gid"][0].as_py()), sid[x], sid[y]))
                held += len(x)
            if held > 10_000:
                yield batch()
                out, held = [], 0
        if out:
            yield batch()
        tidy()

    return stored(rows.mapInArrow(each, "gid long, a long, b long"), "pairs")


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) with link: whether their exact sets meet the threshold."""
    need = pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))).distinct()
    reps = sets.filter("bits is not null").groupBy("sid").agg(F.min("doc_id").alias("rep")).join(need, "sid")
    reps = stored(reps.select("sid", F.coalesce("rep", F.lit(NO_ID)).alias("rep")), "representatives")
    if reps.count() <= BROADCAST_IDS:
        reps = F.broadcast(reps)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = cached(SizedHashes)
        for b in batches:
            kept = []
            for sid, text in zip(b["sid"].to_pylist(), b["text"].to_pylist()):
                ids = shingles(text, size, cache)
                if set_id(ids) == sid:  # an id may have other texts
                    kept.append((sid, ids.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in kept], pa.int64()), pa.array([x for _, x in kept], pa.binary())], ["sid", "ids"])
        tidy()

    found = as_bytes(docs).withColumn("rep", F.coalesce("doc_id", F.lit(NO_ID))).join(reps, "rep").select("sid", "text")
    exact = stored(found.mapInArrow(each, "sid long, ids binary").groupBy("sid").agg(F.first("ids").alias("ids")), "exact")
    rows = pairs.join(exact.select(F.col("sid").alias("a"), F.col("ids").alias("x")), "a").join(exact.select(F.col("sid").alias("b"), F.col("ids").alias("y")), "b")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            links = []
            for x, y in zip(b["x"].to_pylist(), b["y"].to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                links.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b["a"], b["b"], pa.array(links, pa.bool_())], ["a", "b", "link"])
        tidy()

    return stored(rows.select("a", "b", "x", "y").mapInArrow(decide, "a long, b long, link boolean"), "verified")


def linked(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """docs (doc_id, text) -> doc_id, text_hash, n_shingles, set_id, root, component_id: the smallest doc_id that links reach.

    Two documents link if their sets' Jaccard is percent / 100 or more. A text of fewer words than `size` is one shingle;
    a null or wordless text has none and links with nothing. Equal sets always link. Null doc_ids count as the largest.
    """
    if not 50 <= percent <= 100:  # signatures of sets that differ more in size are not compared
        raise ValueError("percent has to be 50 to 100")
    sets = set_rows(docs, size, percent)
    groups = candidate_groups(sets, percent)
    trees = tree_pairs(groups, sets, percent)
    checked = verified(trees.select("a", "b").distinct(), sets, docs, size, percent)
    links, failed = checked.filter("link").select("a", "b"), checked.filter("not link").select("a", "b")
    roots = components(links)
    again = stored(trees.join(failed, ["a", "b"]).select("gid").distinct(), "groups-with-failures")
    if not again.isEmpty():
        more = tree_pairs(groups.join(again, "gid"), sets, percent, roots.select(F.col("node").alias("sid"), "root"))
        more = more.select("a", "b").distinct().join(failed, ["a", "b"], "left_anti")
        more = verified(stored(more, "more-pairs"), sets, docs, size, percent)
        roots = components(links.union(more.filter("link").select("a", "b")))
    least = sets.filter("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least"))
    least = stored(least.join(roots, least["sid"] == roots["node"], "left").select("sid", "least", F.coalesce("root", "sid").alias("root")), "roots")
    whole = least.groupBy("root").agg(F.min("least").alias("component_id"))
    named = least.join(whole, "root").select("sid", "root", "component_id")
    rows = sets.select("doc_id", "text_hash", "sid", "n").join(named, "sid", "left")
    return rows.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.col("sid").alias("set_id"), "root", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """The rows of docs less all but one of each component: the one of the smallest doc_id stays (nulls last, then by the
    text's hash; of equal rows one). Null and wordless texts all stay. All columns are kept."""
    found = stored(linked(id_text(docs), percent, size).filter("root is not null").select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("its_doc"), "text_hash", "root"), "linked")
    best = found.groupBy("root").agg(F.min(F.struct("its_doc", "text_hash")).alias("best"))
    rest = found.join(best, "root")
    same = F.struct("its_doc", "text_hash") == F.col("best")
    out = without(docs, rest.filter(~same).select("its_doc", "text_hash").distinct())
    twice = stored(rest.filter(same).groupBy("its_doc", "text_hash").count().filter("count > 1").drop("count"), "equal-rows")
    if twice.isEmpty():
        return out
    rows = keyed(out).join(twice, ["its_doc", "text_hash"])
    return without(out, twice).unionByName(rows.dropDuplicates(["its_doc", "text_hash"]).select("whole.*"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of the 4-word shingle Jaccard join at 0.85."""
    return linked(id_text(spark.read.parquet(f"{sf_dir}/documents.parquet"))).select("doc_id", "n_shingles", "component_id")


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (SELECT DISTINCT r, unnest(CASE WHEN len(words) >= 4 THEN list_transform(range(len(words) - 3), lambda i: array_to_string(words[i + 1 : i + 4], ' '))
                                     WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.r <> b.r GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
reach(r, root) AS (SELECT r, r FROM w UNION SELECT e.y, reach.root FROM reach JOIN e ON e.x = reach.r)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM reach JOIN w ON w.r = reach.r JOIN w o ON o.r = reach.root LEFT JOIN n ON n.r = w.r GROUP BY w.r, w.doc_id
"""
