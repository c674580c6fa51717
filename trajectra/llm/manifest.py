"""A Merkle manifest of a table: a tree a source over its rows' hashes, a tree over the sources' roots, and proofs by coordinates.

Nodes are told by (key, level, run): the tree, how far above the leaves, and which sixteen consecutive nodes they cover. A
leaf's siblings follow from its index and its tree's size alone, so a proof is a lookup: the coordinates are exploded, joined to the
table of nodes, ordered by level, concatenated and folded. The sixteen leaves of a run have all their coordinates
in common, so a run asks once for them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, discard, materialise
from .ordering import numbered

#: Nodes that one node covers; 4 bits of an index a level.
FAN = 16
#: Nodes that are broadcast at most; see _paths.
MOST_BROADCAST = 16_384
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MOST_LEVELS = 15


def field(column: Column) -> Column:
    """'-' for null, else the UTF-8 byte count, ':' and the value."""
    text = column.cast("string")
    return F.when(column.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(columns: list[Column]) -> Column:
    """SHA-256 of the fields, in their order, as bytes."""
    return F.unhex(F.sha2(F.concat(*[field(c) for c in columns]), 256))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _joined(digests: Column) -> Column:
    return F.array_join(F.transform(digests, _hex), "")


def _parent(digests: Column) -> Column:
    return F.unhex(F.sha2(_joined(digests), 256))


@dataclass
class Tree:
    """runs: (key, run, n, members) with at most FAN leaves each; n is how many leaves the tree has. nodes: (key, level, run, digests)
    for level 1 and above. roots: (key, n, digest)."""

    runs: DataFrame
    nodes: DataFrame
    roots: DataFrame


def _tree(leaves: DataFrame, payload: list[str]) -> Tree:
    """The trees over leaves (key, idx, n, leaf, *payload). A member of a run is a struct of idx, leaf and the payload."""
    members = F.sort_array(F.collect_list(F.struct("idx", "leaf", *payload)))
    grouped = leaves.groupBy("key", F.shiftright("idx", 4).alias("run")).agg(F.first("n").alias("n"), members.alias("members"))
    runs = materialise(grouped, "runs")
    # One leaf alone is its tree's root itself.
    digest = F.when(F.col("n") == 1, F.col("members")[0]["leaf"]).otherwise(_parent(F.col("members.leaf")))
    below = runs.select("key", "n", F.col("run").alias("idx"), digest.alias("digest"))
    most = runs.agg(F.max("n")).first()[0] or 0
    roots, levels, level = below.where(F.col("n") <= FAN), [], 1
    while most > FAN**level:
        # Only trees with more leaves than a node of this level's children cover go on.
        above = below.where(F.col("n") > FAN**level).groupBy("key", F.shiftright("idx", 4).alias("run"))
        above = above.agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("idx", "digest")))["digest"].alias("digests"))
        levels.append(materialise(above.withColumn("level", F.lit(level)), "nodes"))
        below = levels[-1].select("key", "n", F.col("run").alias("idx"), _parent(F.col("digests")).alias("digest"))
        level += 1
        roots = roots.unionByName(below.where(F.col("n") <= FAN**level))
    nodes = None
    for x in levels:
        nodes = x if nodes is None else nodes.unionByName(x)
    if nodes is None:
        nodes = runs.limit(0).select("key", "n", "run", F.array(F.lit(b"")).alias("digests"), F.lit(1).alias("level"))
    return Tree(runs, nodes, roots.select("key", "n", "digest"))


def _paths(tree: Tree) -> DataFrame:
    """(key, run, path) for the runs of trees of more than one run: path has place and digests of each level above, upward.

    A node of level l is asked for by at most FAN^l runs. Of the highest levels as many are broadcast as have MOST_BROADCAST nodes
    together. A tree has nodes of level l only with more than FAN^l leaves, so where more than MOST_BROADCAST nodes lie on a
    level and those above it, none of that level is asked for by more than FAN in MOST_BROADCAST of all runs, whatever
    share of the leaves one tree has; those are joined by a shuffle.
    """
    level = F.explode(F.sequence(F.lit(1), F.size(F.filter(F.sequence(F.lit(1), F.lit(_MOST_LEVELS)), lambda x: F.col("n") > F.pow(F.lit(FAN), x)))))
    asked = tree.runs.where(F.col("n") > FAN).select("key", "run", level.alias("level"))
    asked = asked.withColumn("node", F.expr("shiftright(run, 4 * level)")).withColumn("place", F.expr("cast(shiftright(run, 4 * (level - 1)) & 15 as int)"))
    counts = {r["level"]: r["count"] for r in tree.nodes.groupBy("level").count().collect()}
    first, held = max(counts, default=0) + 1, 0
    while first > 1 and held + counts[first - 1] <= MOST_BROADCAST:
        first -= 1
        held += counts[first]
    nodes = tree.nodes.select("key", "level", F.col("run").alias("node"), "digests")
    by = ["key", "level", "node"]
    found = asked.where(F.col("level") >= first).join(F.broadcast(nodes.where(F.col("level") >= first)), by)
    if first > 1:
        found = found.unionByName(asked.where(F.col("level") < first).join(nodes.where(F.col("level") < first), by))
    path = F.sort_array(F.collect_list(F.struct("level", "place", "digests")))
    return found.groupBy("key", "run").agg(path.alias("path"))


def _sides(place: Column, digests: Column) -> Column:
    """What a node's siblings are, as hex text: those to the left and those to the right."""
    return F.struct(_joined(F.slice(digests, 1, place)).alias("left"), _joined(F.slice(digests, place + 2, F.lit(FAN))).alias("right"))


def _above(path: Column) -> Column:
    return F.coalesce(F.transform(path, lambda x: _sides(x["place"], x["digests"])), F.array().cast("array<struct<left:string,right:string>>"))


def _members(runs: DataFrame) -> DataFrame:
    """Every leaf of runs (members, n, path, ...) as a row: member, and siblings, its sides of each level up to its tree's root."""
    rows = runs.withColumns({"above": _above(F.col("path")), "digests": F.col("members.leaf")}).drop("path")
    rows = rows.select("*", F.posexplode("members").alias("place", "member")).drop("members")
    # A lone leaf has no siblings, and no level of its own.
    first = F.when(F.col("n") > 1, F.array(_sides(F.col("place"), F.col("digests")))).otherwise(F.array().cast("array<struct<left:string,right:string>>"))
    return rows.withColumn("siblings", F.concat(first, "above")).drop("above", "digests", "place")


def fold(leaf: Column, siblings: Column) -> Column:
    """The root that follows from a leaf, as hex text, and its siblings of each level."""
    return F.aggregate(siblings, leaf, lambda done, x: F.sha2(F.concat(x["left"], done, x["right"]), 256))


@dataclass
class Manifest:
    """proofs: (id, leaf, claimed, subroot, siblings) a row, digests as hex text, with the sides of each level up to the root.
    root: hex text, None for an empty table."""

    proofs: DataFrame
    root: str | None


def build_manifest(df: DataFrame, source: Column, leaf: Column, claimed: Column, id_col: str = "doc_id") -> Manifest:
    """The manifest of df: in each source leaves ascend by id_col (null first; equal ids by leaf), sources by their UTF-8 bytes, null first.

    leaf, claimed: a row's hash as bytes, and the hash that will be held against the tree. Rows that repeat are
    leaves of their own. An empty table has no root and no proofs.
    """
    spark = df.sparkSession
    key = F.coalesce(F.concat(F.lit("+"), source.cast("string")), F.lit(""))
    rows = df.select(key.alias("key"), F.col(id_col).alias("id"), leaf.alias("leaf"), F.nullif(claimed, leaf).alias("claimed"))
    # Equal rows are told apart by a number, so that they can lie in several ranges.
    rows = materialise(rows.withColumn("mark", F.monotonically_increasing_id()), "leaves")
    ordered = numbered(rows, ["id", "leaf", "mark"])
    tree = _tree(ordered, ["id", "claimed"])
    sources = materialise(tree.roots.select("key", "n", "digest"), "sources")
    listed = sources.select(F.lit("").alias("key"), F.col("key").alias("source"), F.col("digest").alias("leaf"), F.col("n").alias("size"))
    top = _tree(numbered(listed, ["source"]), ["source", "size"])
    discard(rows, ordered)
    found = top.roots.first()
    if found is None:
        empty = spark.createDataFrame([], "leaf string, claimed string, subroot string, siblings array<struct<left:string,right:string>>")
        return Manifest(df.select(F.col(id_col).alias("id")).limit(0).join(empty, F.lit(True)), None)
    high = _members(top.runs.join(_paths(top), ["key", "run"], "left")).select(F.col("member.source").alias("key"), F.col("member.leaf").alias("subroot"), F.col("member.size").alias("size"), F.col("siblings").alias("top"))
    high = materialise(high.withColumn("runs", F.ceil(F.col("size") / FAN)), "tops")
    runs = tree.runs.join(_paths(tree), ["key", "run"], "left")
    # A source of any share of the rows: those with many runs are broadcast, few as they must be.
    total = high.agg(F.sum("runs")).first()[0]
    runs = attach(runs.select("key", "run", "n", "members", "path"), high.select("key", "runs", "subroot", "top"), ["key"], "runs", int(total))
    rows = _members(runs)
    out = rows.select(
        F.col("member.id").alias("id"),
        _hex(F.col("member.leaf")).alias("leaf"),
        _hex(F.coalesce("member.claimed", "member.leaf")).alias("claimed"),
        _hex(F.col("subroot")).alias("subroot"),
        F.concat("siblings", "top").alias("siblings"),
    )
    return Manifest(out, found["digest"].hex())


def verified_manifest(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")) -> DataFrame:
    """Every row with its leaf, its source's root, the root, the hash of its proof, the root that follows from the leaf as tampered
    with, and whether that is the root.

    Tampered with are rows whose crc32(id as text) 5 divides: their text's A-Z become a-z; null texts and null ids stay. Other columns than those named aren't
    read. Rows that repeat are leaves of their own; an empty table gives none.
    """
    hit = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))
    plain = leaf_hash([F.col(c) for c in columns])
    other = leaf_hash([ascii_lower(F.col(c)) if c == text_col else F.col(c) for c in columns])
    made = build_manifest(documents, F.col(source_col), plain, F.when(hit, other).otherwise(plain), id_col)
    root = F.lit(made.root).cast("string")
    proof = F.sha2(F.array_join(F.transform("siblings", lambda x: F.concat(x["left"], x["right"])), ""), 256)
    rows = made.proofs.select("id", "leaf", "subroot", proof.alias("proof_sha256"), fold(F.col("claimed"), F.col("siblings")).alias("folded_root"))
    return rows.select(F.col("id").alias(id_col), "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
