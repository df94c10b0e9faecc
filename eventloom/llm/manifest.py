"""Merkle manifest of a dataset: one tree per group of rows, one tree over the groups, and a proof for every row.

A row is a leaf, the digest of its fields. Leaves of a group are numbered in order; the nodes of a level are dealt to parents by
position, and conditional aggregates spread each parent's children into one column per slot. The slot columns laid end to end
hash to the parent; without the column of a child's own slot they are that child's siblings. Levels are built upwards from the
leaves until one node of each group is left, the same is done over the groups, and the siblings are then handed down level by
level: each child gets those of its parent behind its own. A proof is thereby a column of its row, and checking it folds a digest
through the siblings up to the root.

Every level is a shuffle on (group, parent) and an eighth of the one below. No group is sorted in one task: positions come from a
split scan over ranges of the order key. Only the number of levels reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scan import ordered_scan
from ..session import stage
from .common import LOWER, UPPER, read

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SPLIT_ALWAYS = 1 << 62
ID_BITS = (45, 28, 12)


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts laid end to end; nulls add nothing."""
    return F.sha2(F.concat_ws("", *parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*fields: Column) -> Column:
    return digest(*[field(f) for f in fields])


def fold(start: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path: at each level the digest takes its place among its siblings."""
    return F.aggregate(path, start, lambda h, step: digest(step["left"], h, step["right"]))


def proof(path: Column) -> Column:
    """All siblings of a path, level by level from the leaf, left to right, as one string."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


def _slots(fanout: int) -> list[str]:
    return [f"c{s}" for s in range(fanout)]


def _pivot(nodes: DataFrame, fanout: int) -> DataFrame:
    """One row per parent of the groups that have more than one node: its children's digests, a column for each slot."""
    slot = F.pmod("pos", F.lit(fanout))
    spread = [F.max(F.when(slot == s, F.col("hash"))).alias(c) for s, c in enumerate(_slots(fanout))]
    parent = F.floor(F.col("pos") / fanout).alias("parent")
    return nodes.filter("n > 1").groupBy("grp", parent, "n").agg(*spread)


def _parents(pivot: DataFrame, fanout: int) -> DataFrame:
    n = F.ceil(F.col("n") / fanout).alias("n")
    return pivot.select("grp", F.col("parent").alias("pos"), n, digest(*[F.col(c) for c in _slots(fanout)]).alias("hash"))


def climb(nodes: DataFrame, fanout: int = FANOUT) -> tuple[list[DataFrame], DataFrame]:
    """The pivots of all levels, lowest first, and (grp, hash) of each group's root. ``nodes``: grp, pos, n (nodes in grp), hash."""
    levels, tops = [], [nodes.filter("n = 1")]
    widest = nodes.agg(F.max("n")).first()[0] or 0
    while widest > 1:
        levels.append(stage(_pivot(nodes, fanout), "manifest-level"))
        nodes = _parents(levels[-1], fanout)
        tops.append(nodes.filter("n = 1"))
        widest = -(-widest // fanout)
    return levels, reduce(DataFrame.union, [t.select("grp", "hash") for t in tops])


def descend(levels: list[DataFrame], base: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(grp, pos, the columns of ``base``) of every node that has siblings or a parent, the path led up to the root.

    ``base`` holds for each grp the path of its root and whatever else all its nodes are to get. A step of a path is what stands
    left and what stands right of the node.
    """
    carried = [c for c in base.columns if c not in ("grp", "path")]
    above = None
    for pivot in reversed(levels):
        lone = F.col("n") <= fanout  # the parent is the group's root
        known = pivot.filter(lone).join(base, "grp")
        if above is not None:
            upper = above.withColumnRenamed("pos", "parent")
            known = known.union(pivot.filter(~lone).join(upper, ["grp", "parent"]).select(known.columns))
        slots = _slots(fanout)
        children = []
        for s, own in enumerate(slots):
            left, right = (F.concat_ws("", *[F.col(c) for c in part]) for part in (slots[:s], slots[s + 1 :]))
            children.append(F.struct(F.lit(s).alias("slot"), F.col(own).alias("own"), F.struct(left.alias("left"), right.alias("right")).alias("step")))
        known = known.select("grp", "parent", "path", *carried, F.explode(F.array(*children)).alias("c")).filter("c.own IS NOT NULL")
        pos = (F.col("parent") * fanout + F.col("c.slot")).alias("pos")
        above = known.select("grp", pos, F.concat(F.array("c.step"), "path").alias("path"), *carried)
    return above if above is not None else base.withColumn("pos", F.lit(0).cast("long")).limit(0).select("grp", "pos", "path", *carried)


def _numbered(rows: DataFrame, by: list[str], levels: list[Column], order: list[Column]) -> DataFrame:
    return ordered_scan(rows, by, levels, order, count="pos", largest=SPLIT_ALWAYS).withColumn("pos", F.col("pos") - 1)


def manifest(
    rows: DataFrame,
    *,
    fields: Sequence[str] = FIELDS,
    by: str = "lang",
    order: str = "doc_id",
    tampered: Column | None = None,
    text: str = "text",
    fanout: int = FANOUT,
) -> DataFrame:
    """``order``, leaf, subroot, root, path and now_leaf of each row of ``rows``.

    Leaves ascend by ``order`` (an integer) within each value of ``by``; null ids come first, rows of one id stand by their leaves, equal
    rows are leaves of their own with equal digests. Values of ``by`` are ordered by UTF-8 bytes, null first; the empty string is a
    value of its own. While several nodes remain, each ``fanout`` of them become one, a last run of fewer, even of one, too. ``now_leaf``
    is the leaf with ``tampered`` in place of ``text`` where ``tampered`` is not null, else null. Null and empty fields differ in the
    leaf. Other columns are ignored; an empty table gives no rows.
    """
    changed = F.lit(None).cast("string") if tampered is None else tampered
    now = F.when(changed.isNotNull(), leaf(*[changed if f == text else F.col(f) for f in fields]))
    group = F.coalesce(F.concat(F.lit("+"), F.col(by).cast("string")), F.lit(""))  # not null, same order
    leaves = rows.select(group.alias("grp"), F.col(order).alias("id"), leaf(*[F.col(f) for f in fields]).alias("hash"), now.alias("now_leaf"))
    leaves = stage(leaves, "manifest-leaves")

    # ranges of ids; rows without an id, which may be many, by the first digits of their leaves
    no_id = F.lit(-(1 << 62))
    levels = [F.coalesce(F.shiftright(F.col("id").cast("long"), b), no_id) for b in ID_BITS]
    levels.append(F.when(F.col("id").isNull(), F.substring("hash", 1, 4)).otherwise(F.lit("")))
    leaves = _numbered(leaves, ["grp"], levels, [F.col("id").asc_nulls_first(), F.col("hash")])
    leaves = stage(leaves, "manifest-leaves")
    sizes = stage(leaves.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), "manifest-groups")
    # a group may hold most rows: its size is attached to parents, of which there are an eighth, by a join that splits
    nodes = leaves.select("grp", "pos", "hash").join(sizes, "grp")
    pivots, subroots = climb(nodes, fanout)
    subroots = stage(subroots.withColumnRenamed("hash", "subroot"), "manifest-subroots")

    ranked = _numbered(subroots, [], [F.substring("grp", 1, 2), F.substring("grp", 1, 3)], [F.col("grp")])
    tops = ranked.select(F.lit("").alias("grp"), "pos", F.lit(subroots.count()).cast("long").alias("n"), F.col("subroot").alias("hash"))
    tops = stage(tops, "manifest-tops")
    root_pivots, root = climb(tops, fanout)
    none = F.array().cast("array<struct<left:string,right:string>>")
    at_top = root.select("grp", none.alias("path"), F.col("hash").alias("root"))
    if root_pivots:
        paths = descend(root_pivots, at_top, fanout).select("pos", "path", "root")
    else:
        paths = at_top.select(F.lit(0).cast("long").alias("pos"), "path", "root")
    base = stage(ranked.join(paths, "pos").select("grp", "path", "subroot", "root"), "manifest-base")

    # the leaf level: what a row carries beside its digest comes back by position
    lone = base.join(sizes.filter("n = 1"), "grp").select("grp", F.lit(0).cast("long").alias("pos"), "path", "subroot", "root")
    paths = descend(pivots, base, fanout).select(lone.columns).union(lone)
    found = leaves.join(paths, ["grp", "pos"])
    return found.select(F.col("id").alias(order), F.col("hash").alias("leaf"), "subroot", "root", "path", "now_leaf")


def op12_merkle_manifest(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = manifest(docs, tampered=F.when(hit, F.translate("text", UPPER, LOWER)))
    folded = fold(F.coalesce("now_leaf", "leaf"), F.col("path"))
    rows = rows.withColumn("folded_root", folded).withColumn("proof_sha256", F.sha2(proof(F.col("path")).cast("binary"), 256))
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


# crc32 a digit at a time, eight shifts after each; node levels by recursion, upper siblings by position
_SQL = """
WITH RECURSIVE docs AS (
    SELECT doc_id, coalesce('+' || lang, '') AS grp,
        list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
            lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
            lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END) AS crc,
        list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR], lambda v: coalesce(strlen(v) || ':' || v, '-')) AS head,
        text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
    FROM documents
), leaves AS (
    SELECT doc_id, grp, row_number() OVER (PARTITION BY grp ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n,
        sha256(array_to_string(head, '') || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
        CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN sha256(array_to_string(head, '') || coalesce(strlen(low) || ':' || low, '-')) END AS now_leaf
    FROM docs
), nodes AS (
    SELECT 0 AS level, grp, pos, n, leaf AS hash FROM leaves
    UNION ALL
    SELECT level + 1, grp, pos // 8, (max(n) + 7) // 8, sha256(string_agg(hash, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY level, grp, pos // 8
), subroots AS (
    SELECT grp, hash AS subroot, level AS height, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops AS (
    SELECT 0 AS level, pos, n, subroot AS hash FROM subroots
    UNION ALL
    SELECT level + 1, pos // 8, (max(n) + 7) // 8, sha256(string_agg(hash, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 8
), steps AS (
    SELECT l.doc_id, k.level, coalesce(string_agg(s.hash, '' ORDER BY s.pos) FILTER (s.pos < l.pos // (8 ** k.level)::BIGINT), '') AS lefts,
        coalesce(string_agg(s.hash, '' ORDER BY s.pos) FILTER (s.pos > l.pos // (8 ** k.level)::BIGINT), '') AS rights
    FROM leaves l JOIN subroots g USING (grp) JOIN (SELECT unnest(range(20)) AS level) k ON k.level < g.height
    JOIN nodes s ON s.grp = l.grp AND s.level = k.level AND s.pos // 8 = l.pos // (8 ** (k.level + 1))::BIGINT
    GROUP BY l.doc_id, k.level, l.pos
    UNION ALL
    SELECT l.doc_id, g.height + k.level, coalesce(string_agg(s.hash, '' ORDER BY s.pos) FILTER (s.pos < g.pos // (8 ** k.level)::BIGINT), ''),
        coalesce(string_agg(s.hash, '' ORDER BY s.pos) FILTER (s.pos > g.pos // (8 ** k.level)::BIGINT), '')
    FROM leaves l JOIN subroots g USING (grp) JOIN (SELECT DISTINCT level FROM tops WHERE n > 1) k ON true
    JOIN tops s ON s.level = k.level AND s.pos // 8 = g.pos // (8 ** (k.level + 1))::BIGINT
    GROUP BY l.doc_id, g.height, k.level, g.pos
), paths AS (
    SELECT doc_id, sha256(string_agg(lefts || rights, '' ORDER BY level)) AS proof_sha256, list({'l': lefts, 'r': rights} ORDER BY level) AS path
    FROM steps GROUP BY doc_id
), folded AS (
    SELECT l.doc_id, 1 AS turn, coalesce(now_leaf, leaf) AS hash, path FROM leaves l LEFT JOIN paths USING (doc_id)
    UNION ALL
    SELECT doc_id, turn + 1, sha256(path[turn].l || hash || path[turn].r), path FROM folded WHERE turn <= len(path)
)
SELECT l.doc_id, l.leaf, g.subroot, t.hash AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.hash AS folded_root, f.hash = t.hash AS verified
FROM leaves l JOIN subroots g USING (grp) JOIN (SELECT hash FROM tops WHERE n = 1) t ON true LEFT JOIN paths p USING (doc_id)
JOIN (SELECT doc_id, arg_max(hash, turn) AS hash FROM folded GROUP BY doc_id) f USING (doc_id)
"""

QUERIES = {"op12_merkle_manifest": (op12_merkle_manifest, _SQL)}
