"""Merkle manifest of a dataset: a tree of digests per source, a tree over the sources, and a proof per document.

A level of a tree is a table of nodes by place. The nodes of one parent are spread into columns by conditional aggregates
(the slot pivot): the columns one after the other hash to the parent, and leaving out the column of a node's own slot
gives its siblings. Proofs go the other way, from the root to the leaves, and grow by one parent at each level.
Digests are kept as bytes and hashed as hex text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tablematch.llm.order import numbered
from tablematch.plans.skew import durable, release

FANOUT = 3


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def text_of(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def field(value: Column) -> Column:
    """A value with its length in bytes, so that neighbouring fields cannot be mistaken; `-` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _slots(fanout: int) -> list[Column]:
    return [F.col(f"s{k}") for k in range(fanout)]


def _parents(nodes: DataFrame, fanout: int) -> DataFrame:
    """The slot pivot of `nodes` (tree, place, digest): (tree, place, n, s0, s1, ...), empty where a slot has no child.
    The root of a tree stands alone at place 0."""
    slot = F.pmod("place", F.lit(fanout))
    columns = [F.coalesce(F.max(F.when(slot == k, F.col("digest"))), F.lit(b"")).alias(f"s{k}") for k in range(fanout)]
    return nodes.groupBy("tree", F.floor(F.col("place") / fanout).alias("place")).agg(F.count(F.lit(1)).alias("n"), *columns)


#: A parent that has no siblings and one child is no parent: its child is the root of the tree.
ROOT = "place = 0 AND n = 1"
NO_STEPS = "array<struct<left:binary,right:binary>>"


def _steps(slot: int, fanout: int) -> Column:
    """The way to the root from `slot` of a parent whose own way is `steps`: what stands left and right of the slot first."""
    slots, none = _slots(fanout), F.lit(b"")
    own = F.struct(F.concat(none, *slots[:slot]).alias("left"), F.concat(none, *slots[slot + 1:]).alias("right"))
    return F.when(F.expr(ROOT), F.col("steps")).otherwise(F.concat(F.array(own), "steps"))


def trees(leaves: DataFrame, fanout: int = FANOUT) -> tuple[DataFrame, DataFrame]:
    """Of leaves (tree, place, digest), placed from 0 in each tree: (tree, root), and one row per parent of leaves, (tree,
    place, n, s0, ..., steps), with its slots and the steps from there to the root.

    While a tree has more than one node, each `fanout` neighbours become their parent; the last ones may be fewer. A tree
    of one leaf is its own root. A step holds the digests left and right of the way. Each level is a written table of a
    third of the rows, grouped and joined by (tree, place), so that no task holds a tree, however large."""
    levels, nodes = [], leaves
    while not levels or not levels[-1].where(f"NOT ({ROOT})").isEmpty():
        levels.append(durable(_parents(nodes, fanout)))
        nodes = levels[-1].where(f"NOT ({ROOT})").select("tree", "place", digest(text_of(F.concat(*_slots(fanout)))).alias("digest"))
    roots = durable(reduce(DataFrame.union, [x.where(ROOT).select("tree", F.col("s0").alias("root")) for x in levels]))
    known = None
    for level in reversed(levels):
        tops = level.where(ROOT).withColumn("steps", F.array().cast(NO_STEPS))
        if known is None:
            known = tops
            continue
        each = F.array(*[F.struct((F.col("place") * fanout + k).alias("place"), _steps(k, fanout).alias("steps")) for k in range(fanout)])
        nodes = known.select("tree", F.explode(F.slice(each, F.lit(1), F.col("n").cast("int"))).alias("node")).select("tree", "node.*")
        known = durable(tops.unionByName(level.where(f"NOT ({ROOT})").join(nodes.hint("merge"), ["tree", "place"])))
        release(level)
    return roots, known


def _on_tree(leaves: DataFrame, known: DataFrame, fanout: int) -> DataFrame:
    """`leaves` (tree, place, ...) with the steps from each leaf to its root; `known` as `trees` returns it."""
    own = leaves.withColumn("_slot", F.pmod("place", F.lit(fanout))).withColumn("place", F.floor(F.col("place") / fanout))
    steps = F.get(F.array(*[_steps(k, fanout) for k in range(fanout)]), F.col("_slot").cast("int"))
    return own.join(known.hint("merge"), ["tree", "place"]).withColumn("steps", steps).drop("_slot", "n", *[f"s{k}" for k in range(fanout)])


def merkle_manifest(
    docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    found: dict[str, Column] | None = None, fanout: int = FANOUT,
) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified): the place of each row of `docs` in a Merkle tree.

    A leaf is the digest of `columns` of the row. The leaves of a group stand in order of id (null first; rows of one id by
    digest), and the roots of the groups in order of their names (null first, bytewise) under `root`. `proof_sha256` is
    the digest of all siblings on the way, `folded_root` the root that they give with the row as it is found now: `found`
    gives the columns that are read anew, otherwise the row counts as unchanged. `verified` tells whether that is `root`.

    Nulls hash as `-`, unlike any text. Rows equal in all columns have one leaf but places of their own, and so proofs of
    their own. An empty table gives an empty result. Columns not named are not read."""
    now = {c: F.col(c) for c in columns} | (found or {})
    changed = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(now[c]) for c in columns], F.lit(False))
    tree = F.coalesce(F.concat(F.lit("1"), F.col(group_col).cast("string")), F.lit("0"))
    rows = durable(docs.select(
        tree.alias("tree"), F.col(id_col).alias("_id"), digest(F.concat(*[field(F.col(c)) for c in columns])).alias("digest"),
        F.when(changed, digest(F.concat(*[field(now[c]) for c in columns]))).alias("changed"),
    ))
    leaves = numbered(rows, ["tree"], ["_id", "digest"], "place")
    release(rows)
    subroots, known = trees(leaves.select("tree", "place", "digest"), fanout)
    tops = numbered(subroots, [], ["tree"], "place").select(F.lit("").alias("tree"), "place", F.col("root").alias("digest"), F.col("tree").alias("group"))
    top, above = trees(tops.select("tree", "place", "digest"), fanout)
    root = top.first()  # one row, or none of an empty table
    groups = durable(_on_tree(tops, above, fanout).select(F.col("group").alias("tree"), F.col("digest").alias("subroot"), F.col("steps").alias("upper")))
    out = _on_tree(leaves, known, fanout).join(groups, "tree").withColumn("steps", F.concat("steps", "upper"))

    def up(node: Column, step: Column) -> Column:
        return F.sha2(F.concat(text_of(step["left"]), node, text_of(step["right"])).cast("binary"), 256)

    siblings = F.transform("steps", lambda s: F.concat(text_of(s["left"]), text_of(s["right"])))
    return out.select(
        F.col("_id").alias(id_col), text_of(F.col("digest")).alias("leaf"), text_of(F.col("subroot")).alias("subroot"), F.lit(root and root["root"].hex()).cast("string").alias("root"),
        F.sha2(F.array_join(siblings, "").cast("binary"), 256).alias("proof_sha256"),
        F.aggregate("steps", text_of(F.coalesce("changed", "digest")), up).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


SQL = """
WITH RECURSIVE d AS (
    SELECT *, doc_id::VARCHAR AS id,
           CASE WHEN list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                    lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], range(8)),
                        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) & 1 = 1
                THEN replace(text, chr(10), '') ELSE text END AS now
    FROM documents
), heads AS (
    SELECT *, coalesce(strlen(id) || ':' || id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
              || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM d
), leaves AS MATERIALIZED (
    SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(now) || ':' || now, '-')) AS found,
           row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS place
    FROM heads
), lower_nodes AS (
    SELECT source, 0 AS level, place, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM leaves
    UNION ALL
    SELECT source, level + 1, place // 3, sha256(string_agg(h, '' ORDER BY place)), any_value((n + 2) // 3) FROM lower_nodes WHERE n > 1 GROUP BY source, level, place // 3
), subroots AS MATERIALIZED (
    SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM lower_nodes WHERE n = 1
), upper_nodes AS (
    SELECT 0 AS level, place, subroot AS h, count(*) OVER () AS n FROM subroots
    UNION ALL
    SELECT level + 1, place // 3, sha256(string_agg(h, '' ORDER BY place)), any_value((n + 2) // 3) FROM upper_nodes WHERE n > 1 GROUP BY level, place // 3
), top AS (
    SELECT h AS root FROM upper_nodes WHERE n = 1
), nodes AS MATERIALIZED (
    SELECT l.source, l.level, l.place, l.n, coalesce(string_agg(s.h, '' ORDER BY s.place) FILTER (WHERE s.place < l.place), '') AS before,
           coalesce(string_agg(s.h, '' ORDER BY s.place) FILTER (WHERE s.place > l.place), '') AS after
    FROM lower_nodes l JOIN lower_nodes s ON s.source IS NOT DISTINCT FROM l.source AND s.level = l.level AND s.place // 3 = l.place // 3
    GROUP BY ALL
), tops AS MATERIALIZED (
    SELECT l.level, l.place, l.n, coalesce(string_agg(s.h, '' ORDER BY s.place) FILTER (WHERE s.place < l.place), '') AS before,
           coalesce(string_agg(s.h, '' ORDER BY s.place) FILTER (WHERE s.place > l.place), '') AS after
    FROM upper_nodes l JOIN upper_nodes s ON s.level = l.level AND s.place // 3 = l.place // 3 GROUP BY ALL
), inside AS (
    SELECT doc_id, source, leaf, 0 AS level, place, found AS fold, '' AS proof, false AS done FROM leaves
    UNION ALL
    SELECT i.doc_id, i.source, i.leaf, i.level + 1, i.place // 3, CASE WHEN n.n = 1 THEN i.fold ELSE sha256(n.before || i.fold || n.after) END,
           CASE WHEN n.n = 1 THEN i.proof ELSE i.proof || n.before || n.after END, n.n = 1
    FROM inside i JOIN nodes n ON n.source IS NOT DISTINCT FROM i.source AND n.level = i.level AND n.place = i.place WHERE NOT i.done
), above AS (
    SELECT i.doc_id, i.leaf, s.subroot, 0 AS level, s.place, i.fold, i.proof, false AS done
    FROM inside i JOIN subroots s ON s.source IS NOT DISTINCT FROM i.source WHERE i.done
    UNION ALL
    SELECT a.doc_id, a.leaf, a.subroot, a.level + 1, a.place // 3, CASE WHEN n.n = 1 THEN a.fold ELSE sha256(n.before || a.fold || n.after) END,
           CASE WHEN n.n = 1 THEN a.proof ELSE a.proof || n.before || n.after END, n.n = 1
    FROM above a JOIN tops n ON n.level = a.level AND n.place = a.place WHERE NOT a.done
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified FROM above, top WHERE done
"""
