"""N-gram Jaccard join by an LSH forest of MinHash signatures.

Every distinct set of word shingles has one path in each of several tries: a sequence of its MinHash values. Two sets are
candidates when their paths agree on a prefix in some trie. The search begins with the longest prefix that still reaches the target
recall for pairs right at the threshold, and shortens it while the links found say that too many are missed: tries are like
repeated catches, so from the links seen in one trie only and in two, the number seen in none is estimated
(capture-recapture). Documents of equal shingle sets are one node, so copies cost nothing.

Candidates that hang together form a group. Inside a group every pair is verified exactly on the shingles. A large group is cut
into tiles of bounded size and each pair of tiles is a unit of work of its own; only counts and a spanning forest of the links
leave it, never pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage
from .common import code_points, lower_ascii, map_columns, mix64, pack, powers, read, word_bounds, word_hashes
from .components import components

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.995
TREES, LEVELS = 32, 8
TILE_SHINGLES, TILE_NODES = 1_000_000, 512
BUNDLE_SHINGLES = 3_000_000

_rng = np.random.default_rng(20240229)
_factor = (_rng.integers(1, 2**31, TREES * LEVELS, np.uint32) * np.uint32(2) + np.uint32(1)).astype(np.uint32)
_offset = _rng.integers(0, 2**32, TREES * LEVELS, np.uint64).astype(np.uint32)


def shingle_set(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``n`` words, A-Z in lower case; a shorter text is one shingle of its words."""
    points = code_points(lower_ascii(text or ""))
    words = word_hashes(points, *word_bounds(points))
    if not len(words):
        return words
    n = min(n, len(words))
    m, weights = len(words) - n + 1, powers(0xD1B54A32D192ED03, n)
    total = np.full(m, n, np.uint64)
    for k in range(n):
        total += words[k : k + m] * weights[k]
    return np.unique(mix64(total))


def node_of(shingles: np.ndarray) -> int | None:
    """One number for a set of shingles: equal for equal sets, distinct but for a chance of 2^-64 for a pair."""
    if not len(shingles):
        return None
    terms = mix64(shingles ^ np.uint64(0xA0761D6478BD642F))
    return int(mix64(np.array([terms.sum(dtype=np.uint64) + np.uint64(len(shingles))], np.uint64)).view(np.int64)[0])


def paths(shingles: np.ndarray) -> np.ndarray:
    """Of each trie the path of a set, 16 bits of a MinHash value for each level."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(TREES * LEVELS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 4096):
        part = low[at : at + 4096, None] * _factor + _offset
        least = np.minimum(least, part.min(axis=0))
    return (mix64(least.astype(np.uint64)) >> np.uint64(48)).astype(">u2").reshape(TREES, LEVELS)


def deepest(threshold: float, recall: float, trees: int = TREES, levels: int = LEVELS) -> int:
    """The longest prefix with which a pair at the threshold is found with probability ``recall``."""
    for depth in range(levels, 1, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    return 1


def _signatures(docs: DataFrame) -> DataFrame:
    def sign(rows):
        sets = [shingle_set(t) for t in rows["text"]]
        return {
            "node": [node_of(s) for s in sets],
            "n_shingles": [len(s) for s in sets],
            "paths": [[pack(p) for p in paths(s)] if len(s) else None for s in sets],
        }

    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("text_hash long, node long, n_shingles int, paths array<binary>")])
    return map_columns(docs.withColumn("text_hash", F.xxhash64("text")), sign, schema)


def _groups(signed: DataFrame, depth: int) -> DataFrame:
    """Nodes that share a prefix of ``depth`` levels with another in some trie, with the label of all that hang together."""
    prefixes = signed.select("node", F.posexplode("paths").alias("trie", "path")).select(
        "node", F.xxhash64("trie", F.expr(f"substring(path, 1, {2 * depth})")).alias("prefix")
    )
    shared = prefixes.groupBy("prefix").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high")
    # a node has a partner in each trie, at most; it keeps the smallest, which is tied to the others once for all nodes that have both
    star = prefixes.join(shared.select("prefix", "low"), "prefix").filter("node <> low")
    partners = stage(star.groupBy("node").agg(F.array_sort(F.collect_set("low")).alias("lows")), "near-partners")
    own = partners.select(F.col("node").alias("a"), F.col("lows")[0].alias("b"))
    ties = partners.select(F.explode(F.slice("lows", 2, TREES)).alias("a"), F.col("lows")[0].alias("b")).distinct()
    return components(own.union(ties)).select("node", F.col("label").alias("grp"))


def _verify(docs: DataFrame, signed: DataFrame, groups: DataFrame, depth: int, threshold: float) -> DataFrame:
    """For each node and unit of work: its root among the links there, links in documents and in texts, and in how few tries."""
    one = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("one")
    members = signed.join(groups, "node").groupBy("node", "grp").agg(one, F.max("n_shingles").alias("n_shingles"), F.count(F.lit(1)).alias("copies"))
    members = stage(members.select("*", "one.doc_id", "one.text_hash").drop("one"), "near-members")
    sizes = members.groupBy("grp").agg(F.sum("n_shingles").alias("s"), F.count(F.lit(1)).alias("n"))
    tiles = F.greatest(F.ceil(F.col("s") / TILE_SHINGLES), F.ceil(F.col("n") / TILE_NODES)).cast("int")
    sizes = stage(sizes.select("grp", "s", tiles.alias("tiles")), "near-groups")
    bundles = 1 + int(sizes.agg(F.sum(F.col("s") * F.col("tiles"))).first()[0] or 0) // BUNDLE_SHINGLES
    members = members.join(sizes.select("grp", "tiles"), "grp").withColumn("tile", F.pmod(F.xxhash64("node"), "tiles").cast("int"))

    # the text of each node by id and hash together: rows without an id, or of one id, do not meet
    wanted = members.select(F.col("doc_id").alias("__id"), "text_hash", "node", "grp", "copies", "tiles", "tile").hint("shuffle_hash")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("text_hash"))
    texts = docs.join(wanted, same).drop("doc_id", "__id", "text_hash")

    def shingle(rows):
        sets = [shingle_set(t) for t in rows["text"]]
        # texts of one id and one hash that differ are told by their nodes
        same = [node_of(s) == n for s, n in zip(sets, rows["node"])]
        return {
            "shingles": [pack(s) if ok else None for s, ok in zip(sets, same)],
            "prefixes": [pack(_prefixes(paths(s), depth)) if ok else None for s, ok in zip(sets, same)],
        }

    kept = "node long, grp long, copies long, tiles int, tile int"
    sets = map_columns(texts, shingle, T.StructType.fromDDL(f"{kept}, shingles binary, prefixes binary")).filter("shingles IS NOT NULL")
    sets = sets.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    sets = sets.withColumns({"left": F.least("tile", "with"), "right": F.greatest("tile", "with")})
    sets = sets.withColumn("bundle", F.pmod(F.xxhash64("grp", "left", "right"), F.lit(bundles)))
    schema = T.StructType.fromDDL("node long, grp long, tiles int, root long, links long, text_links long, once long, twice long")
    return sets.groupBy("bundle").applyInArrow(lambda table: _verify_bundle(table, threshold), schema)


def _prefixes(path: np.ndarray, depth: int) -> np.ndarray:
    total = np.arange(TREES, dtype=np.uint64)
    for k in range(depth):
        total = mix64(total * np.uint64(31) + path[:, k].astype(np.uint64))
    return total


def _verify_bundle(table: pa.Table, threshold: float) -> pa.Table:
    columns = {c: table.column(c).to_numpy() for c in ("node", "grp", "copies", "tiles", "tile", "left", "right")}
    order = np.lexsort((columns["node"], columns["tile"], columns["right"], columns["left"], columns["grp"]))
    columns = {c: v[order] for c, v in columns.items()}
    shingles, prefixes = table.column("shingles"), table.column("prefixes")
    key = np.stack([columns["grp"], columns["left"], columns["right"]])
    cuts = np.flatnonzero(np.any(key[:, 1:] != key[:, :-1], axis=0)) + 1
    out = []
    for part in np.split(np.arange(len(order)), cuts):
        part = part[np.concatenate(([True], columns["node"][part][1:] != columns["node"][part][:-1]))] if len(part) else part
        own = [{c: v[i] for c, v in columns.items()} for i in part[:1]]
        if not own:
            continue
        sets = [np.frombuffer(shingles[int(order[i])].as_py(), np.uint64) for i in part]
        keys = np.stack([np.frombuffer(prefixes[int(order[i])].as_py(), np.uint64) for i in part])
        side = None if own[0]["left"] == own[0]["right"] else columns["tile"][part] == own[0]["left"]
        found = links_within(sets, keys, columns["copies"][part], side, threshold)
        nodes = columns["node"][part]
        out.append((nodes, columns["grp"][part], columns["tiles"][part], nodes[found[0]], *found[1:]))
    names = ("node", "grp", "tiles", "root", "links", "text_links", "once", "twice")
    columns_out = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * len(names)
    types = [pa.int32() if n == "tiles" else pa.int64() for n in names]
    return pa.table([pa.array(c.astype(np.int64)).cast(t) for c, t in zip(columns_out, types)], names=list(names))


def links_within(sets, keys, copies, side, threshold):
    """Of each set: the first set it is linked to (through others), linked documents and sets, and sets linked in one and two tries.

    With ``side`` only pairs of a set on one side and a set on the other count.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    left = np.arange(n) if side is None else np.flatnonzero(side)
    right = np.arange(n) if side is None else np.flatnonzero(~side)
    shared = _shared(sets, left, right)
    jaccard = shared / np.maximum(size[left][:, None] + size[right][None, :] - shared, 1)
    linked = jaccard >= threshold - 1e-12
    if side is None:
        np.fill_diagonal(linked, False)
    a, b = np.nonzero(linked)
    tries = np.zeros(len(a), np.int64)
    for at in range(0, len(a), 65536):
        part = slice(at, at + 65536)
        tries[part] = (keys[left[a[part]]] == keys[right[b[part]]]).sum(1)
    a, b = left[a], right[b]
    if side is not None:  # each pair once in either direction
        a, b, tries = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((tries, tries))
    count = lambda w: np.bincount(a, weights=w, minlength=n).astype(np.int64)
    root = np.arange(n)
    while len(a):
        lower = root.copy()
        np.minimum.at(lower, a, root[b])
        lower = lower[lower]
        if (lower == root).all():
            break
        root = lower
    return root, count(copies[b].astype(float)), count(np.ones(len(b))), count((tries == 1) * 1.0), count((tries == 2) * 1.0)


def _shared(sets, left, right) -> np.ndarray:
    """How many elements each left set shares with each right set."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.concatenate(([True], flat[1:] != flat[:-1]))
    column = np.cumsum(first) - 1
    often = np.bincount(column)
    keep = often[column] > 1
    owner, column = owner[keep], column[keep]
    column = np.unique(column, return_inverse=True)[1] if len(column) else column
    place = np.full((2, len(sets)), -1)
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    total, width = np.zeros((len(left), len(right)), np.float32), 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        low, high = np.searchsorted(column, (at, at + width))
        blocks = []
        for s, m in ((0, len(left)), (1, len(right))):
            block = np.zeros((m, min(width, int(column[high - 1]) - at + 1)), np.float32)
            row = place[s, owner[low:high]]
            block[row[row >= 0], column[low:high][row >= 0] - at] = 1
            blocks.append(block)
        total += blocks[0] @ blocks[1].T
    return total.astype(np.int64)


def near_duplicates(docs: DataFrame, *, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """A row (doc_id, class_id, n_links, n_text_links, n_copies) for each row of ``docs`` (doc_id, text).

    Two documents are linked when the Jaccard similarity of their sets of five-word shingles is at least ``threshold``; a class is
    all documents connected by links, named by its smallest doc_id. ``n_links`` counts the other documents linked to a document,
    ``n_text_links`` the other shingle sets, ``n_copies`` the documents of its own set. Texts of fewer than five words are one
    shingle. Null, empty and blank texts have no shingles: each is a class of its own, without links. Repeated rows are copies.
    Null ids are documents too; a class of null ids alone has a null id.
    """
    return _classes(docs, threshold, recall).select("doc_id", "class_id", "n_links", "n_text_links", "n_copies")


def _classes(docs: DataFrame, threshold: float, recall: float = RECALL) -> DataFrame:
    """The columns of ``near_duplicates``, the hash of each row's text, and id and hash of the first row of its class.

    ``first`` is null for texts without shingles.
    """
    docs = docs.select("doc_id", "text")
    signed = stage(_signatures(docs), "near-signatures")
    shingled = signed.filter("node IS NOT NULL")
    depth = deepest(threshold, recall)
    while True:
        groups = stage(_groups(shingled, depth), "near-labels")
        units = stage(_verify(docs, shingled.drop("paths"), groups, depth, threshold), "near-links")
        seen = units.agg(F.sum("text_links"), F.sum("once"), F.sum("twice")).first()
        links, once, twice = [(x or 0) / 2 for x in seen]
        missed = once * once / (2 * max(twice, 1)) if links else 0.0
        if depth == 1 or links >= recall * (links + missed):
            break
        depth -= 1
    roots = units.filter("tiles = 1").select("node", "root")
    split = units.filter("tiles > 1 AND node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    if split.limit(1).count():  # only these can be linked across units
        roots = roots.union(components(split).select("node", "label"))
    sums = units.groupBy("node").agg(F.sum("links").alias("links"), F.sum("text_links").alias("n_text_links"))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")  # null ids come last
    nodes = shingled.groupBy("node").agg(F.min(row).alias("first"), F.count(F.lit(1)).alias("n_copies"))
    nodes = nodes.join(sums, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    nodes = stage(nodes, "near-nodes")
    classes = nodes.groupBy("root").agg(F.min("first").alias("first"))
    zero = F.lit(0).cast("long")
    nodes = nodes.drop("first").join(classes, "root").select(
        "node",
        "first",
        (F.coalesce("links", zero) + F.col("n_copies") - 1).alias("n_links"),
        F.coalesce("n_text_links", zero).alias("n_text_links"),
        "n_copies",
    )
    joined = signed.select("doc_id", "text_hash", "node").join(nodes, "node", "left")
    alone = F.col("node").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.coalesce("n_links", zero).alias("n_links"),
        F.coalesce("n_text_links", zero).alias("n_text_links"),
        F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"),
        "text_hash",
        "first",
    )


def keep_one(docs: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each class of near duplicates, the one with the smallest id; columns stay as they are.

    Each row is judged by its own text, whatever other rows have its id or none; among several with the smallest id, or without
    ids, a hash of the text decides, and among rows of that id and text the order of their other columns, first to last, nulls first (they must
    be of types that can be ordered). All rows without shingles stay, equal ones too.
    """
    blank = ~F.coalesce("text", F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    classes = stage(_classes(docs, threshold).select("doc_id", "text_hash", "first"), "near-classes")
    chosen = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    kept = classes.filter(F.col("first").isNotNull() & chosen).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash"))
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = docs.filter(~blank).join(kept, same, "left_semi")
    found = found.groupBy("doc_id", "text").agg(F.min(F.struct(F.lit(0).alias("__"), *[F.col(f"`{c}`") for c in rest])).alias("r"))
    found = found.select([F.col(c) if c in ("doc_id", "text") else F.col(f"r.`{c}`").alias(c) for c in docs.columns])
    return docs.filter(blank).unionByName(found)


def op4_near_join(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "documents"))


QUERIES = {"op4_near_join": (op4_near_join, None)}
