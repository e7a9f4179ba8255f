"""The manifest against a tree built by hand, and against its SQL."""

import hashlib
import os
import zlib

import duckdb
import pytest

from maskline.llm import manifest

SF = "/root/testdata/sf0.001"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, tamper):
    values = [row[c] for c in ("doc_id", "source", "lang", "n_chars", "text")]
    if tamper and row["text"] is not None:
        values[-1] = "".join(c.lower() if "A" <= c <= "Z" else c for c in row["text"])
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climbed(nodes, way=None):
    """The root, and for each leaf the siblings of every level as (left, right)."""
    ways = [[] for _ in nodes]
    under = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(lo, min(lo + 8, len(nodes))) for lo in range(0, len(nodes), 8)]
        for run in runs:
            for i in run:
                for leaf_at in under[i]:
                    ways[leaf_at].append(([nodes[j] for j in run if j < i], [nodes[j] for j in run if j > i]))
        under = [[x for i in run for x in under[i]] for run in runs]
        nodes = [h(*(nodes[i] for i in run)) for run in runs]
    return nodes[0], ways


def by_hand(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r["lang"], []).append(r)
    out, subroots, names = [], [], sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for lang in names:
        t = sorted(trees[lang], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, False)))
        subroots.append(climbed([leaf(r, False) for r in t]) + (t,))
    root, tops = climbed([s[0] for s in subroots])
    for (subroot, ways, t), top in zip(subroots, tops):
        for r, way in zip(t, ways):
            way = way + top
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            node = leaf(r, tampered)
            for left, right in way:
                node = h(*left, node, *right)
            out.append((r["doc_id"], leaf(r, False), subroot, root, h(*(x for left, right in way for x in left + right)), node, node == root))
    return out


NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
KIND = "doc_id long, source string, lang string, n_chars long, text string, tree string, leaf string, rank int, now int"


def found(spark, rows, levels):
    df = spark.createDataFrame([tuple(r.get(c.split()[0]) for c in KIND.split(", ")) for r in rows], KIND)
    return sorted((tuple(r) for r in manifest.proofs(manifest.leaves(df), levels).select(*NAMES).collect()), key=repr)


def rows_of(n, langs):
    rows = [{"doc_id": i * 3 % n, "source": f"s{i % 4}" if i % 5 else None, "lang": langs[i % len(langs)], "n_chars": i if i % 3 else None, "text": None if i % 11 == 0 else "" if i % 7 == 0 else f"Text Ä{i} OF É" * (i % 5 + 1), "tree": "x", "rank": 1} for i in range(n)]
    rows += [dict(rows[5]), dict(rows[5]), dict(rows[6], text="other"), dict(rows[3], doc_id=None), dict(rows[4], doc_id=None, text="LONG " * 300_000)]
    return rows


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_small_blocks_give_the_tree_by_hand(spark, levels):
    """Several tiers of blocks over the leaves of a language and over the languages; nulls, repeated rows, clashing names."""
    rows = rows_of(150, ["b", None, "a", "", "ä", "b"])
    assert found(spark, rows, levels) == sorted(by_hand(rows), key=repr)


def test_many_trees(spark):
    rows = rows_of(100, [f"l{i}" for i in range(40)])
    assert found(spark, rows, 1) == sorted(by_hand(rows), key=repr)


def test_one_row_and_none(spark):
    rows = [{"doc_id": 7, "lang": "x", "text": "Abc"}]
    assert found(spark, rows, 4) == by_hand([{**dict.fromkeys(["source", "n_chars"]), **rows[0]}])
    assert found(spark, [], 4) == []


def test_like_its_sql(spark):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS FROM '{SF}/{f}'")
    rows = con.execute(manifest.OP11_SQL).fetchall()
    names = [c[0] for c in con.description]
    mine = manifest.op11_manifest(spark, SF).select(*names).collect()
    assert sorted(map(tuple, mine)) == sorted(rows) and len({r[names.index("verified")] for r in rows}) == 2
