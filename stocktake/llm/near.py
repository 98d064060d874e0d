"""Near-duplicate join: MinHash LSH forest with exact verification.

A document is the set of its runs of five words.  Two documents are linked if
the Jaccard similarity of their sets is 0.8 or more.

* Equal sets form one class before anything else, so copies cost one row each.
* A signature of 128 minima feeds the trees of the forest.  A tree orders the
  documents by a prefix of its own minima; documents that share the prefix sit
  under one node of the trie.  The prefix is shortened until the chance that
  some tree holds a pair at the threshold reaches ``recall``, over all trees.
* Round one takes few trees and deep prefixes.  The documents of a node stand in
  the order of the deeper prefix; each is a candidate with the ``NEXT`` before
  it and with the first, so candidates grow in proportion to documents.  A node
  is first dealt to ``SALTS`` parts, whose first documents then meet, so that a
  node with a third of all documents is no hot task.  Candidates are verified on
  the sets themselves; their links join close copies to classes.  Round one only
  saves work: what it misses is left to round two.
* Round two takes all trees and the short prefix, and every document of a node.
  A node of one class needs nothing more.  A node of up to ``NEXT + 1`` documents
  gives all its pairs between classes, which are verified.  A larger node of
  several classes joins them to one cluster without verification.  So every
  pair under a node ends in one cluster or was compared.
* Inside each cluster all pairs are compared, in blocks spread over tasks.  A
  block gives the number of links of each document and a spanning forest of the
  links, never the pairs.  Components of the forests are the classes, so links
  and classes are exact within a cluster.

Sets hold 40-bit fingerprints of shingles, so a false match within a pair of
thousand-word documents has a chance below one in a million.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, batch_of, fewer, over_batches, text_slices, tidy
from .graph import components
from .textnum import Words, mix, shingles

SHINGLE_WORDS = 5
SIMILARITY = (4, 5)  # 0.8 as a fraction, compared in integers
PERMUTATIONS = 128
TREES = 20
FIRST_TREES = 6
DEEP = 10
RECALL = 0.9995
NEXT = 12
SALTS = 64
#: rows of a block of a cluster, and shingles of all its rows
BLOCK, BLOCK_SHINGLES = 1024, 1_000_000
#: ids that a join may broadcast; more go by a shuffle
BROADCAST_ROWS = 4_000_000
#: nodes of several classes that a join may broadcast; more go by a shuffle
BROADCAST_NODES = 1_000_000

_SIGNED = "rid long, doc_id long, text_hash long, fingerprint binary, n_shingles int, deep array<long>, flat array<long>, next array<int>, members binary"


def depth_for(recall: float, trees: int, similarity: float, deepest: int = DEEP) -> int:
    """Longest prefix at which some tree holds a pair of this similarity with
    the chance ``recall``."""
    for depth in range(deepest, 1, -1):
        if 1 - (1 - similarity**depth) ** trees >= recall:
            return depth
    return 1


def _pack(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return wide.view("<u8").ravel()


def sign(docs: DataFrame, recall: float = RECALL, trees: int = TREES) -> DataFrame:
    """Fingerprint, tree keys and shingle set of each row (doc_id, text).

    A text without words has an empty set; its fingerprint is that of the raw
    text, so equal texts still form a class.  Null and empty texts have a null
    fingerprint and no links.
    """
    flat_depth = depth_for(recall, trees, SIMILARITY[0] / SIMILARITY[1])
    rng = np.random.default_rng(20240501)
    factor = rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1)
    shift = rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)
    order = np.stack([rng.permutation(PERMUTATIONS)[:DEEP] for _ in range(trees)])
    salt = mix(np.arange(1, trees + 1, dtype=np.uint64))
    schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fingerprint", pa.binary()), ("n_shingles", pa.int32()), ("deep", pa.list_(pa.int64())), ("flat", pa.list_(pa.int64())), ("next", pa.list_(pa.int32())), ("members", pa.binary())])

    def keys(minima: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        picked = minima[order].astype(np.uint64)
        node = salt.copy()
        flat = node
        for level in range(DEEP):
            node = mix(node * np.uint64(0x9E3779B97F4A7C15) + picked[:, level])
            if level + 1 == flat_depth:
                flat = node
        deeper = (minima[order[:, min(flat_depth, DEEP - 1)]] >> 1).astype(np.int32)
        return node[:FIRST_TREES].view(np.int64), flat.view(np.int64), deeper

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            rid, ids, hashes = batch.column(0), batch.column(1), batch.column(2)
            for lo, hi, texts in text_slices(batch.column(3)):
                words = Words(texts)
                values, places = shingles(words, SHINGLE_WORDS)
                values &= np.uint64((1 << 40) - 1)
                out: list[list] = [[] for _ in range(6)]
                for i in range(hi - lo):
                    own = np.unique(values[places[i] : places[i + 1]])
                    if len(own):
                        low = mix(own).astype(np.uint32)
                        minima = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
                        for at in range(0, len(low), 4096):
                            np.minimum(minima, (low[None, at : at + 4096] * factor[:, None] + shift[:, None]).min(axis=1), out=minima)
                        deep, flat, deeper = keys(minima)
                        packed = _pack(own)
                        mark = hashlib.blake2b(packed, digest_size=16).digest()
                    else:
                        raw = texts[i]
                        deep = flat = deeper = []
                        packed = b""
                        mark = hashlib.blake2b(b"raw" + raw.encode("utf-8", "surrogatepass"), digest_size=16).digest() if raw else None
                    for column, value in zip(out, (mark, len(own), deep, flat, deeper, packed), strict=True):
                        column.append(value)
                yield batch_of(schema, *(c.slice(lo, hi - lo) for c in (rid, ids, hashes)), *out)

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    return over_batches(rows, run, _SIGNED)


def _ordered_pairs(rows: DataFrame, *group: str) -> DataFrame:
    """(x, y) from rows (*group, child, rid, class, n): each row with the
    ``NEXT`` before it in its group and with the first of the group."""
    item = F.struct("rid", "class", "n")
    order = Window.partitionBy(*group).orderBy("child", "rid")
    before = [F.lag(item, k).over(order) for k in range(1, NEXT + 1)]
    paired = rows.select(item.alias("x"), F.array(F.first(item).over(order), *before).alias("ys"))
    return paired.where("ys[1] IS NOT NULL").select("x", F.explode("ys").alias("y"))


def _fitting(pairs: DataFrame) -> DataFrame:
    """(a, b), a < b, from pairs (x, y) of different classes.  Pairs whose sizes
    alone rule the similarity out are none."""
    fits = SIMILARITY[1] * F.least("x.n", "y.n") >= SIMILARITY[0] * F.greatest("x.n", "y.n")
    pairs = pairs.where((F.col("x.rid") != F.col("y.rid")) & (F.col("x.class") != F.col("y.class")) & fits)
    return pairs.select(F.least("x.rid", "y.rid").alias("a"), F.greatest("x.rid", "y.rid").alias("b")).distinct()


def _candidates(rows: DataFrame) -> DataFrame:
    """(a, b), a < b, from rows (node, child, rid, class, n): those of round one,
    see the module."""
    rows = rows.withColumn("salt", F.pmod(F.hash("node", "rid"), F.lit(SALTS)))
    place = Window.partitionBy("node", "salt").orderBy("child", "rid")
    heads = rows.withColumn("place", F.row_number().over(place)).where("place = 1").drop("place")
    pairs = _ordered_pairs(rows, "node", "salt").union(_ordered_pairs(heads, "node"))
    return _fitting(pairs)


def _picked(table: DataFrame, rids: DataFrame) -> DataFrame:
    """Rows of ``table`` with these rids, which may repeat.  Up to
    ``BROADCAST_ROWS`` distinct ids are broadcast, so that the table's sets need
    no shuffle; more are joined by a shuffle.  Distinct ids are only counted
    where the rows, which are read from work tables, leave it open."""
    few = rids.count() <= BROADCAST_ROWS
    rids = rids.select("rid").distinct()
    return table.join(F.broadcast(rids) if few or rids.count() <= BROADCAST_ROWS else rids, "rid", "left_semi")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of (a, b) whose sets reach the similarity."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = np.zeros(len(left), bool)
            last, own = None, None
            for i, (x, y) in enumerate(zip(left, right, strict=True)):
                n, m = len(x) // 5, len(y) // 5
                if SIMILARITY[1] * min(n, m) < SIMILARITY[0] * max(n, m):
                    continue
                if x is not last:
                    last, own = x, _unpack(x)
                other = _unpack(y)
                place = np.searchsorted(own, other)
                place[place == n] = 0
                shared = int((own[place] == other).sum())
                keep[i] = SIMILARITY[1] * shared >= SIMILARITY[0] * (n + m - shared)
            yield batch_of(schema, batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep)))

    chosen = _picked(sets.select("rid", "members"), pairs.select(F.col("a").alias("rid")).union(pairs.select("b")))
    sides = [chosen.select(F.col("rid").alias(side), F.col("members").alias(f"set_{side}")) for side in "ab"]
    joined = pairs.join(sides[0], "a").join(sides[1], "b")
    return over_batches(joined.select("a", "b", "set_a", "set_b"), run, "a long, b long")


def link_matrix(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Boolean matrix: which of the sorted sets of both sides are linked."""
    sizes = [np.array([len(s) for s in side], np.int64) for side in (left, right)]
    values, place = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    place = place.ravel()
    rows = np.repeat(np.arange(len(left) + len(right)), np.concatenate(sizes))
    common = np.bincount(place, minlength=len(values)) > 1
    renumber = np.cumsum(common) - 1
    rows, place = rows[common[place]], renumber[place[common[place]]]
    width, step = int(common.sum()), 4096
    order = np.argsort(place, kind="stable")
    rows, place = rows[order], place[order]
    shared = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, width, step):
        lo, hi = np.searchsorted(place, (at, at + step))
        one = np.zeros((len(left) + len(right), min(step, width - at)), np.float32)
        one[rows[lo:hi], place[lo:hi] - at] = 1
        shared += one[: len(left)] @ one[len(left) :].T
    inner = np.rint(shared).astype(np.int64)
    return SIMILARITY[1] * inner >= SIMILARITY[0] * (sizes[0][:, None] + sizes[1][None, :] - inner)


def _roots(linked: np.ndarray, inside: bool) -> np.ndarray:
    """Least row of each row's component: rows of the matrix, and behind them
    its columns unless both are the same documents."""
    n, m = linked.shape
    label = np.arange(n if inside else n + m)
    while True:
        left, right = label[:n], label if inside else label[n:]
        new = np.minimum(left, np.where(linked, right[None, :], n + m).min(axis=1))
        if not inside:
            new = np.concatenate([new, np.minimum(right, np.where(linked, new[:, None], n + m).min(axis=0))])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compared(members: DataFrame) -> DataFrame:
    """(rid, links, root) from rows (cluster, rid, copies, members): for each
    block that a row takes part in, documents linked to its set, copies and
    itself counted, and the root of its component in the block.  A cluster is
    cut into blocks of about ``BLOCK`` rows or ``BLOCK_SHINGLES`` shingles,
    whichever are fewer rows; each pair of blocks is one group of bounded size.
    The number of links of every document is asked for, so a cluster of n
    different texts takes n squared comparisons, spread over its pairs of blocks."""
    sizes = members.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.length("members") / 5).alias("m")).where("n > 1")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("m") / BLOCK_SHINGLES)).cast("int")
    rows = members.join(sizes, "cluster").withColumn("blocks", blocks)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rid", "copies", "members")
    schema = pa.schema([("rid", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def compare(group: list[tuple]) -> tuple[list[int], list[int], list[int]]:
        i, j = group[0][1], group[0][2]
        left = sorted((r for r in group if r[3] == i), key=lambda r: r[4])
        right = left if i == j else sorted((r for r in group if r[3] == j), key=lambda r: r[4])
        if not left or not right:
            return [], [], []
        own = [_unpack(r[6]) for r in left]
        linked = link_matrix(own, own if i == j else [_unpack(r[6]) for r in right])
        weight = [np.array([r[5] for r in side], np.int64) for side in (left, right)]
        links, rids = linked @ weight[1], [r[4] for r in left]
        if i != j:
            links, rids = np.concatenate([links, linked.T @ weight[0]]), rids + [r[4] for r in right]
        return rids, links.tolist(), [rids[k] for k in _roots(linked, i == j)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        group: list[tuple] = []
        out: tuple[list[int], list[int], list[int]] = ([], [], [])
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and group[0][:3] != row[:3]:
                    for column, values in zip(out, compare(group), strict=True):
                        column.extend(values)
                    group = []
                group.append(row)
            yield batch_of(schema, *out)
            out = ([], [], [])
        if group:
            yield batch_of(schema, *compare(group))

    dealt = rows.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    return over_batches(dealt, run, "rid long, links long, root long")


def near_duplicates(docs: DataFrame, recall: float = RECALL, trees: int = TREES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, any other columns).

    Result: ``doc_id``; ``class_id``, the least doc_id of its class (its own for
    a document without links); ``n_links``, other rows linked to it, copies
    included; ``keeper``, true for one row of each class, one with
    ``doc_id = class_id``; ``class_size``; ``text_hash``.  Null and empty texts have no links.
    A null doc_id counts as greater than any other.  Rows that repeat a doc_id
    are separate rows.  An empty table gives an empty result.
    """
    work = Workspace(docs.sparkSession, "near")
    signed = work.save(sign(docs, recall, trees), "signed")
    rank = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)), "rid")
    heads = signed.where("fingerprint IS NOT NULL").groupBy("fingerprint").agg(F.min(rank).alias("head"), F.count("*").alias("copies"))
    heads = work.save(fewer(heads.select("fingerprint", F.col("head.rid").alias("rid"), "copies")), "heads")
    keys = signed.where("n_shingles > 0").select("rid", F.col("n_shingles").alias("n"), "deep", "flat", "next")
    keys = work.save(keys.join(heads.select("rid"), "rid", "left_semi"), "keys")
    sets = signed.select("rid", "members")

    deep = keys.select("rid", "n", F.explode("deep").alias("node")).select("node", F.lit(0).alias("child"), "rid", F.col("rid").alias("class"), "n")
    close = work.save(_verified(work.save(fewer(_candidates(deep)), "pairs1"), sets), "close")
    first = components(close, work, "round1")

    classes = keys.join(first, keys.rid == first.node, "left").select("rid", "n", F.coalesce("root", "rid").alias("class"), F.arrays_zip("flat", "next").alias("trees"))
    flat = classes.select("rid", "n", "class", F.explode("trees").alias("t")).select("rid", "n", "class", F.col("t.flat").alias("node"), F.col("t.next").alias("child"))
    # nodes of one class are settled by it; the others are counted with every document
    nodes = flat.groupBy("node").agg(F.count("*").alias("size"), F.min("class").alias("b"), F.max("class").alias("last")).where("b < last")
    nodes = work.save(fewer(nodes.select("node", "size", "b")), "nodes")
    mixed = flat.join(F.broadcast(nodes) if nodes.count() <= BROADCAST_NODES else nodes, "node")
    small = mixed.where(F.col("size") <= NEXT + 1).drop("size", "b")
    wide = work.save(_verified(work.save(fewer(_fitting(_ordered_pairs(small, "node"))), "pairs2"), sets), "wide")
    crowded = mixed.where(F.col("size") > NEXT + 1).select(F.col("class").alias("a"), "b").distinct()
    joined = first.select(F.col("node").alias("a"), F.col("root").alias("b"))
    clusters = components(wide.union(joined).union(crowded), work, "clusters")

    linked = heads.join(clusters.union(clusters.select("root", "root").distinct()).toDF("rid", "cluster"), "rid").select("cluster", "rid", "copies")
    linked = work.save(fewer(linked), "linked")
    compared = work.save(_compared(linked.join(_picked(sets, linked), "rid").select("cluster", "rid", "copies", "members")), "compared")
    links = compared.groupBy("rid").agg(F.sum("links").alias("links"))
    second = components(compared.select(F.col("rid").alias("a"), F.col("root").alias("b")), work, "round2")
    classes = work.save(fewer(heads.join(second, heads.rid == second.node, "left").select("fingerprint", heads.rid, "copies", F.coalesce("root", heads.rid).alias("class"))), "classes")
    named = signed.select("rid", "doc_id")
    best = classes.join(named, "rid").groupBy("class").agg(F.min(rank).alias("best"), F.sum("copies").alias("class_size"))
    classes = classes.join(best, "class").join(links, "rid", "left").select("fingerprint", F.col("best.rid").alias("keeper_rid"), "class_size", (F.col("copies") - 1 + F.coalesce(F.col("links") - F.col("copies"), F.lit(0))).alias("n_links"))
    classes = work.save(fewer(classes.join(named.select(F.col("rid").alias("keeper_rid"), F.col("doc_id").alias("class_id")), "keeper_rid")), "result")
    work.drop("keys", "nodes", "pairs1", "pairs2", "close", "wide", "heads", "classes", "linked", "compared")
    lone = F.col("fingerprint").isNull()
    rows = signed.select("rid", "doc_id", "text_hash", "fingerprint").join(classes, "fingerprint", "left")
    return rows.select(
        "doc_id",
        F.when(lone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.col("rid") == F.col("keeper_rid"), F.lit(True)).alias("keeper"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        "text_hash",
    )


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, less all but one of each class.

    Documents without words to compare (null and empty texts) all stay; of rows
    alike in everything but other columns any one stays; an empty table stays
    empty.  Rows are found again by doc_id and a hash of the text.  Rows alike in both
    are one keeper and its copies, of which any one stays, or have no text to
    compare, and then all stay.  That one is picked by an aggregation that
    combines before its shuffle.
    """
    key = ["doc_id", "text_hash"]
    kept = near_duplicates(docs).where("keeper").groupBy(*key).agg(F.count("*").alias("stay")).toDF("kept_id", "kept_hash", "stay")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.struct(*docs.columns).alias("row"))
    sizes = rows.groupBy(*key).agg(F.count("*").alias("n")).toDF("kept_id", "kept_hash", "n")
    both = F.col("s.kept_id").eqNullSafe(F.col("k.kept_id")) & (F.col("s.kept_hash") == F.col("k.kept_hash"))
    kept = kept.alias("k").join(sizes.alias("s"), both).select("k.kept_id", "k.kept_hash", (F.col("stay") < F.col("n")).alias("surplus"))
    found = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("text_hash") == F.col("kept_hash")))
    alone = found.where("NOT surplus").select("row.*")
    several = found.where("surplus").groupBy(*key).agg(F.first("row").alias("row")).select("row.*")
    return alone.unionByName(several)
