"""Operator 9, n-gram Jaccard join by a MinHash LSH forest.

Words are runs of letters and digits (any character beyond ASCII counts as one), A-Z lowered; a document is
the set of its five-word shingles (a shorter text is one shingle of all its words). Two documents are linked if
the Jaccard similarity of their sets is at least ``THRESHOLD``.

1. Documents with equal word sequences collapse into one class (128-bit hash), represented by the smallest id.
2. Forest: each representative has ``TREES`` signatures of ``DEPTH`` min-hashes (16 bits each). A tree is the trie of the
   signatures; a node is a prefix. Documents start at their leaves and climb level by level: a document's prefixes are shortened
   one tree after another until the chance that it shares a prefix with a document at the lowest similarity a linked set of
   its size can have reaches ``TARGET_RECALL``. Within a level the thin nodes are shortened first, so nodes with many members keep
   the longer prefix wherever the target allows it. A node reached by any of its members ties all its members to the smallest
   one, never to all others. Sizes up to ``THIN`` count alike: a single partner must not decide which prefixes stay long.
3. Components of these ties are the candidate groups. Their documents' shingle sets are dealt to work units: a group is
   cut into chunks of about ``CHUNK`` rows, and each unordered pair of chunks is one unit, so a group of any
   size spreads over many small tasks.
4. Inside a unit every pair is compared exactly through postings; a unit returns, per document, its number of links
   and the smallest document of its linked part, never the pairs.

Defined results: texts without words, null texts and rows with a null id have no links and are kept; copies
count as links of one another; of repeated rows of one id one is kept; an empty table gives an empty result; other
columns are ignored by :func:`near_duplicates` and kept by :func:`keep_one`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlab.llm.common import written
from postlab.llm.graph import components
from postlab.llm.licenses import words_of

SHINGLE_WORDS, THRESHOLD = 5, 0.8
TREES, DEPTH, TARGET_RECALL = 24, 8, 0.999
CHUNK = 128
SEED = 20
#: Members up to which a node of the trie counts as thin.
THIN = 64
#: Bytes a min-hash takes in a signature.
EDGE = 2
#: Shingles hashed against all permutations at once.
BLOCK = 512


def shingles(words: list[bytes], n: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles."""
    if not words:
        return np.empty(0, np.uint64)
    grams = [b" ".join(words)] if len(words) < n else map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, grams), np.uint64))


def lowest_link(size: int, threshold: float = THRESHOLD) -> float:
    """The lowest similarity of at least ``threshold`` that a set of ``size`` can have with any set: k common of u in all."""
    share = Fraction(str(threshold))
    k = np.arange(max(1, math.ceil(size * share)), size + 1)
    u = k * share.denominator // share.numerator
    return float((k / u)[u >= size].min(initial=1.0))


@lru_cache(65536)
def shortenings(size: int, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, target: float = TARGET_RECALL) -> int:
    """How many times a document of ``size`` shingles gives up the last hash of a prefix: level by level, one tree after another,
    until a pair at its lowest link shares a prefix with the chance ``target``."""
    similarity, steps = lowest_link(size, threshold), 0
    while steps < trees * (depth - 1):
        length, short = depth - steps // trees, steps % trees
        if (1 - similarity ** length) ** (trees - short) * (1 - similarity ** (length - 1)) ** short <= 1 - target:
            break
        steps += 1
    return steps


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 32, n, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, np.uint32)


def signature(grams: np.ndarray, multiply: np.ndarray, add: np.ndarray) -> np.ndarray:
    """Smallest value of the shingles (their upper 32 bits) under each odd-linear permutation of the 32-bit numbers."""
    x = (grams >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(multiply), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(x), BLOCK):
        h = x[at:at + BLOCK, None] * multiply
        h += add
        np.minimum(low, h.min(axis=0), out=low)
    return low


def sketched(docs: DataFrame, id_col: str, text_col: str, threshold: float, trees: int, depth: int, target: float) -> DataFrame:
    """(row_id, text_print, h1, h2, leaves, steps) per row: the signatures of all trees, one after another, and the number of
    :func:`shortenings`; null where there is nothing to compare."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multiply, add = _permutations(trees * depth)
        for batch in batches:
            h1, h2, leaves, steps = [], [], [], []
            for doc, text in zip(batch.column(0), batch.column(2), strict=True):
                words = words_of(text.as_py())
                if not words or not doc.is_valid:
                    h1.append(None), h2.append(None), leaves.append(None), steps.append(None)
                    continue
                whole = xxhash.xxh3_128_intdigest(b" ".join(words))
                h1.append((whole >> 64) - (1 << 63))
                h2.append((whole & ((1 << 64) - 1)) - (1 << 63))
                grams = shingles(words)
                leaves.append(signature(grams, multiply, add).astype(np.uint16).tobytes())
                steps.append(shortenings(len(grams), threshold, trees, depth, target))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()),
                 pa.array(leaves, pa.binary()), pa.array(steps, pa.int32())],
                names=["row_id", "text_print", "h1", "h2", "leaves", "steps"])

    rows = docs.select(F.col(id_col).alias("row_id"), F.xxhash64(text_col).alias("text_print"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, f"row_id {id_type}, text_print long, h1 long, h2 long, leaves binary, steps int")


def _prefix(length) -> F.Column:
    """64-bit name of the trie node that a leaf's prefix of ``length`` hashes leads to."""
    return F.expr(f"xxhash64(tree, {length}, substring(leaf, 1, {EDGE} * {length}))")


def prefix_lengths(leaves: DataFrame, trees: int, depth: int) -> DataFrame:
    """``leaves`` (node, steps, tree, leaf, members) with ``length``, the prefix at which each document stops in each tree.

    ``members`` is the size of the leaf's node at the shortest prefix of all. Of the trees of a document the fattest come first,
    thin ones by their number; trees without a row here are thin. Where a level is climbed in part, the first ones stay."""
    fat = F.greatest(F.lit(0), F.floor(F.log2(F.col("members") / THIN))).cast("int")
    leaves = leaves.withColumn("fat", fat)
    own = Window.partitionBy("node")
    hot = (F.col("fat") > 0).cast("int")
    after = F.sum(hot).over(own.orderBy(F.desc("tree")).rowsBetween(Window.unboundedPreceding, -1))
    thin_rank = F.sum(hot).over(own) + (trees - 1 - F.col("tree")) - F.coalesce(after, F.lit(0))
    rank = F.when(hot > 0, F.row_number().over(own.orderBy(F.desc("fat"), "tree")) - 1).otherwise(thin_rank)
    level = depth - F.floor(F.col("steps") / trees)
    short = (rank >= trees - F.col("steps") % trees).cast("int")
    return leaves.withColumn("length", (level - short).cast("int")).drop("fat")


def forest_ties(classes: DataFrame, threshold: float, trees: int, depth: int, target: float) -> DataFrame:
    """(node, head): each representative and the smallest one of every trie node that it shares with another."""
    # two trees at most differ by one level, so no document goes below this prefix
    least = depth - math.ceil(shortenings(_lowest_size(threshold), threshold, trees, depth, target) / trees)
    leaves = classes.select("node", "steps", "leaves", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    leaves = leaves.select("node", "steps", "tree", F.expr(f"substring(leaves, tree * {EDGE * depth} + 1, {EDGE * depth})").alias("leaf"))
    leaves = leaves.withColumn("key", _prefix(least))
    shared = leaves.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("a"), F.max("node").alias("b"))
    shared = written(shared.filter("a < b").select("key", "members"), "jaccard-shared")
    # the same plan at every size: both sides shuffle by the prefix, however few are shared
    matched = leaves.join(shared.hint("merge"), "key").drop("key")
    matched = written(prefix_lengths(matched, trees, depth), "jaccard-matched")
    climbed = matched.select("node", "tree", "leaf", "length", F.explode(F.sequence(F.lit(least), "length")).alias("at"))
    climbed = climbed.select("node", _prefix("at").alias("key"), (F.col("at") == F.col("length")).alias("reached"))
    heads = climbed.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("last"), F.max("reached").alias("reached"))
    heads = written(heads.filter("reached AND head < last").select("key", "head"), "jaccard-heads")
    return climbed.join(heads, "key").filter("node <> head").select("node", "head").distinct()


def _lowest_size(threshold: float) -> int:
    """A size of sets that can have exactly the threshold."""
    return Fraction(str(threshold)).numerator


def chunked(groups: DataFrame, chunk: int) -> DataFrame:
    """(node, root) -> (node, root, chunk_no, chunks): groups cut into chunks of about ``chunk`` rows."""
    sizes = written(groups.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "group-sizes")
    sizes = sizes.select(F.col("root").alias("size_root"), F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    return (groups.join(sizes, groups.root == sizes.size_root).drop("size_root")
            .withColumn("chunk_no", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")))


def compare_unit(own: np.ndarray, sets: list[np.ndarray], copies: np.ndarray, pair: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (weighted by copies) of each set and the smallest index of its linked part. ``own`` marks the first of two
    chunks; with ``pair`` only sets of different chunks are compared."""
    share = Fraction(str(threshold))
    n, sizes = len(sets), np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    starts = np.append(np.flatnonzero(new), len(flat))
    group = np.empty(len(flat), np.int64)
    group[order] = np.cumsum(new) - 1  # posting list of each shingle, in the sets' own order
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    links, label = np.zeros(n, np.int64), np.arange(n)
    for i in range(n):
        if pair and not own[i]:
            continue
        g = group[bounds[i]:bounds[i + 1]]
        lengths = starts[g + 1] - starts[g]
        at = np.repeat(starts[g] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        common = np.bincount(owner[at], minlength=n)
        near = share.denominator * common >= share.numerator * (sizes + sizes[i] - common)
        near &= ~own if pair else np.arange(n) > i
        j = np.flatnonzero(near & (common > 0))
        if len(j):
            links[i] += copies[j].sum()
            links[j] += copies[i]
            seen = np.unique(np.append(label[j], label[i]))
            if len(seen) > 1:
                label[np.isin(label, seen)] = seen[0]
    return links, label


def verified(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, threshold: float, chunk: int) -> DataFrame:
    """(node, links, other): exact links of the members of each candidate group, unit by unit."""
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("row_id"), F.xxhash64(text_col).alias("p"), F.col(text_col).cast("binary").alias("t"))
    hit = (texts.row_id == members.node) & (texts.p == members.text_print)
    # the same plan at every size: both sides shuffle by id, however few the members are
    found = texts.join(members.hint("merge"), hit).select("node", "root", "copies", "chunk_no", "chunks", "t")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [shingles(words_of(t.as_py())).view(np.int64) for t in batch.column(5)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(grams, pa.list_(pa.int64()))],
                                             names=["node", "root", "copies", "chunk_no", "chunks", "grams"])

    rows = found.mapInArrow(sets, f"node {id_type}, root {id_type}, copies long, chunk_no int, chunks int, grams array<long>")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    rows = rows.select("node", "root", "copies", "grams", "chunk_no", other.alias("other_no"))
    rows = rows.select("node", "root", "copies", "grams", "chunk_no", F.least("chunk_no", "other_no").alias("lo"),
                       F.greatest("chunk_no", "other_no").alias("hi"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node").drop_duplicates("node")
        pair = key[1] != key[2]
        links, label = compare_unit((pdf["chunk_no"] == key[1]).to_numpy(), [g.view(np.uint64) for g in pdf["grams"]],
                                    pdf["copies"].to_numpy(), pair, threshold)
        nodes = pdf["node"].to_numpy()
        return pd.DataFrame({"node": nodes, "links": links, "other": nodes[label]})

    return rows.groupBy("root", "lo", "hi").applyInPandas(run, f"node {id_type}, links long, other {id_type}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                    trees: int = TREES, depth: int = DEPTH, target: float = TARGET_RECALL, chunk: int = CHUNK) -> DataFrame:
    """One row per document: class_id (smallest id linked, directly or not), n_links (documents linked directly), kept."""
    rows = sketched(docs, id_col, text_col, threshold, trees, depth, target)
    rows = written(rows.withColumn("uid", F.monotonically_increasing_id()), "jaccard-rows")

    # 1. equal texts
    classes = rows.filter("leaves IS NOT NULL").groupBy("h1", "h2").agg(
        F.min(F.struct("row_id", "uid", "text_print")).alias("rep"), F.count(F.lit(1)).alias("copies"),
        F.any_value("leaves").alias("leaves"), F.any_value("steps").alias("steps"))
    classes = written(classes.select("h1", "h2", F.col("rep.row_id").alias("node"), F.col("rep.uid").alias("rep_uid"),
                                     F.col("rep.text_print").alias("text_print"), "copies", "leaves", "steps"), "jaccard-classes")
    # 2. trie nodes shared by several representatives
    ties = forest_ties(classes, threshold, trees, depth, target)
    # 3. and 4. candidate groups, compared exactly
    groups = components(ties, "node", "head")
    members = chunked(groups, chunk)
    info = classes.select(F.col("node").alias("info_node"), "copies", "text_print")
    members = written(members.join(info, members.node == info.info_node).drop("info_node"), "jaccard-members")
    units = written(verified(docs, members, id_col, text_col, threshold, chunk), "jaccard-units")
    links = units.groupBy(F.col("node").alias("linked")).agg(F.sum("links").alias("links"))
    labels = components(units.filter("node <> other").select("node", "other"), "node", "other")
    found = (written(links, "jaccard-links").join(labels, F.col("linked") == F.col("node"), "left")
             .select(F.col("linked").alias("found_node"), "links", "root"))
    told = classes.drop("leaves", "steps", "text_print").join(found, F.col("node") == F.col("found_node"), "left")
    told = written(told.select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), "node", "rep_uid", F.coalesce("root", "node").alias("class_id"),
                               (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "jaccard-told")
    out = rows.join(told, (rows.h1 == told.c1) & (rows.h2 == told.c2), "left")
    kept = F.col("class_id").isNull() | ((F.col("uid") == F.col("rep_uid")) & (F.col("class_id") == F.col("node")))
    return out.select(F.col("row_id").alias(id_col), F.coalesce("class_id", "row_id").alias("class_id"),
                      F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), kept.alias("kept"), "text_print")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without all but one document of each class, all columns unchanged."""
    told = near_duplicates(docs, id_col, text_col, **options)
    keep = told.groupBy(F.col(id_col).alias("keep_id"), F.col("text_print").alias("keep_print")).agg(
        F.count_if("kept").alias("keep_n"), F.count(F.lit(1)).alias("all_n"))
    keep = written(keep.filter("keep_n > 0"), "jaccard-keep")
    rows = docs.select(F.struct("*").alias("row_all"), F.col(id_col).alias("row_id"), F.xxhash64(text_col).alias("row_print"))
    hit = F.col("row_id").eqNullSafe(F.col("keep_id")) & (F.col("row_print") == F.col("keep_print"))
    rows = rows.join(keep.hint("merge"), hit)
    once = rows.filter("keep_n < all_n").select("row_id", "row_print", "row_all").dropDuplicates(["row_id", "row_print"])
    return rows.filter("keep_n = all_n").select("row_all").unionByName(once.select("row_all")).select("row_all.*")
