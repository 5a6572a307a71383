"""Similarity join of shingle sets by an R-tree over count vectors.

A shingle falls into one of 8 groups by its first word and one of 256 by its own hash. The counts by group make a set a
point; two sets overlap by no more than the sum of the smaller count in each group, so sets of similarity 0.9 have counts
that differ by a nineteenth of both sizes at most. Points are packed into leaves of an R-tree: dealt by size, then cut
along the widest of size and word groups. The join goes down pairs of nodes from the roots, a level at a time, as equi joins
on the parent, and drops pairs whose boxes lie too far apart. A pair of leaves is one step of a task: word groups first,
then 32 and 256 groups for what is left.

What survives comes as lists of sets that hang together, not as pairs. Each list first checks its members against one of
them on the full sets; then every set outside the largest component of a list is compared with all of the list, in bounded
blocks. So no link between components is lost, and none within one is needed.

Boxes mostly tell sizes apart, as texts of one language have much the same counts, so a point meets the points of like size:
the work grows with the square of the corpus at about a nanosecond a pair. Beyond some 29,000 shingles 256 groups no longer
tell texts of like size apart, so all such pairs come to the check on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .minhash import PART, Stash, components
from .shared import Workspace, bounded, columns, hinted, stash
from .words import batch_words, mix64, window_hashes

WIDTH = 3  # words in a shingle
PERCENT = 90
WORD_GROUPS, GROUPS = 8, 256
#: Counts are held at these bounds, which only makes the bound on overlaps looser: sums then fit 16 bits, counts 8 bits.
MOST_WORD, MOST = 4095, 255
LEAF, DEALT = 4096, 16_384  # points of a leaf at most, and of a task that cuts leaves on average
CHILDREN = 64  # of a node at most, a power of two
ROOTS = 128  # nodes of the top level at most, which the driver pairs
PARTNERS = 16  # leaves that meet one copy of another
STEP = 64  # points that are compared with a leaf at once
BLOCK, MEMBERS, SHINGLES = 128, 256, 1_000_000  # as in the near-duplicates operator: sets of a block, sets it meets in a task, shingles of either


# ---- sets and points ----------------------------------------------------------------------------------------------


def shingle_sets(text: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; the low three bits of a hash are its group by first word."""
    words = batch_words(text, lower=True)
    own = words.hashes()
    hashes, places = window_hashes(own, words.docs, WIDTH)
    n = np.diff(places)
    first = np.repeat(words.docs[:-1] - places[:-1], n) + np.arange(places[-1])
    low = np.uint64(WORD_GROUPS - 1)
    keys = (hashes & ~low) | (mix64(own[first]) & low) if len(hashes) else hashes
    return [np.unique(keys[a:b]) for a, b in zip(places[:-1], places[1:], strict=True)]


def set_key(own: np.ndarray) -> int:
    """A signed 64-bit name of a set; equal sets have equal names."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).astype(np.int64))


def point(own: np.ndarray) -> bytes:
    """Counts by word group (16 bits each), then by group of shingles (8 bits each)."""
    words = np.bincount((own & np.uint64(WORD_GROUPS - 1)).astype(np.int64), minlength=WORD_GROUPS)
    groups = np.bincount((own >> np.uint64(56)).astype(np.int64), minlength=GROUPS)
    return np.minimum(words, MOST_WORD).astype(np.int16).tobytes() + np.minimum(groups, MOST).astype(np.uint8).tobytes()


def point_batches(id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in bounded(batches):
            sets = shingle_sets(x.column(1))
            n = pa.array([len(s) for s in sets], pa.int64())
            nodes = pa.array([set_key(s) if len(s) else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([x.column(0), n, nodes, pa.array([point(s) if len(s) else None for s in sets], pa.binary())], [id_col, "n_shingles", "node", "point"])

    return run


# ---- the tree -----------------------------------------------------------------------------------------------------


def cut(sizes: np.ndarray, counts: np.ndarray, most: int) -> list[np.ndarray]:
    """Places of the points of each leaf: halves along the widest of size and counts, until they are small enough."""
    all_of = np.column_stack([sizes, counts]).astype(np.int64)
    todo, out = [np.arange(len(sizes))], []
    while todo:
        own = todo.pop()
        if len(own) <= most:
            out.append(own)
            continue
        here = all_of[own]
        widest = int(np.subtract(*np.percentile(here, [95, 5], axis=0)).argmax())
        own = own[np.argsort(here[:, widest], kind="stable")]
        todo += [own[len(own) // 2 :], own[: len(own) // 2]]
    return out


BOX = [*(f"lo{i}" for i in range(WORD_GROUPS)), *(f"hi{i}" for i in range(WORD_GROUPS)), "least", "most"]
PAGE = ("nodes", "sizes", "words", "groups")


def leaf_batches(leaf: int, dealt: int):
    """Leaves of what a task was dealt, each as a row: its box and its page of points in the order of sizes."""
    limit = min(CHILDREN * leaf // 2, 4 * dealt)  # of points held at once; dealing by sampled ranges keeps most tasks below

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held, rows = TaskContext.get().partitionId(), 0, [], 0

        def leaves() -> Iterator[pa.RecordBatch]:
            nonlocal made
            node = np.concatenate([x.column("node").to_numpy() for x in held])
            size = np.concatenate([x.column("n_shingles").to_numpy() for x in held])
            raw = np.frombuffer(b"".join(b for x in held for b in x.column("point").to_pylist()), np.uint8).reshape(len(node), -1)
            words, groups = np.ascontiguousarray(raw[:, : 2 * WORD_GROUPS]).view(np.int16), raw[:, 2 * WORD_GROUPS :]
            order = np.lexsort((node, size))
            node, size, words, groups = node[order], size[order], words[order], groups[order]
            for own in cut(size, words, leaf):
                own = np.sort(own)
                box = [*words[own].min(axis=0), *words[own].max(axis=0), size[own[0]], size[own[-1]]]
                cols = [[task << 12 | made], *[[int(v)] for v in box], *[[np.ascontiguousarray(v[own]).tobytes()] for v in (node, size.astype(np.int64), words, groups)]]
                made += 1
                types = [*[pa.int64()] * (1 + len(BOX)), *[pa.binary()] * len(PAGE)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["leaf", *BOX, *PAGE])

        for x in bounded(batches, rows=4096, most_bytes=8 << 20):
            held.append(x)
            rows += x.num_rows
            if rows >= limit:
                yield from leaves()
                held, rows = [], 0
        if rows:
            yield from leaves()

    return run


def grow(points: DataFrame, n: int, leaf: int, dealt: int) -> DataFrame:
    """The leaves of the tree over `n` points (node, n_shingles, point)."""
    spread = points.select("node", "n_shingles", "point").repartitionByRange(max(1, -(-n // dealt)), "n_shingles", "node")
    return spread.mapInArrow(leaf_batches(leaf, dealt), f"leaf long, {', '.join(f'{c} long' for c in BOX)}, {', '.join(f'{c} binary' for c in PAGE)}")


def parents(nodes: DataFrame) -> DataFrame:
    """The level above: nodes of neighbouring numbers in one box. nodes: id, parent and the box."""
    agg = [(F.min if c.startswith("lo") or c == "least" else F.max)(c).alias(c) for c in BOX]
    up = nodes.groupBy(F.col("parent").alias("id")).agg(*agg)
    return up.withColumn("parent", F.shiftright("id", CHILDREN.bit_length() - 1))


def near_boxes(a: str, b: str, percent: int) -> Column:
    """Whether sets in two boxes may be similar enough: sizes alike, and counts no further apart than their difference allows.

    With overlap o and sizes x, y: 100 * o >= percent * (x + y - o), and o <= (x + y - d) / 2 for counts that differ by d,
    so d <= (x + y) * (100 - percent) / (100 + percent).
    """
    at = lambda side, c: F.col(f"{side}.{c}")
    gap = F.lit(0)
    for i in range(WORD_GROUPS):
        gap = gap + F.greatest(F.lit(0), at(a, f"lo{i}") - at(b, f"hi{i}"), at(b, f"lo{i}") - at(a, f"hi{i}"))
    alike = (100 * at(b, "most") >= percent * at(a, "least")) & (100 * at(a, "most") >= percent * at(b, "least"))
    return alike & (gap * (100 + percent) <= (at(a, "most") + at(b, "most")) * (100 - percent))


def leaf_pairs(leaves: DataFrame, percent: int, stash: Stash, roots: int) -> DataFrame:
    """(a, b), a <= b: the pairs of leaves whose boxes are near, found from the roots down."""
    levels = [stash(leaves.select(F.col("leaf").alias("id"), F.shiftright("leaf", CHILDREN.bit_length() - 1).alias("parent"), *BOX), "boxes")]  # numbers are the task's, then its leaves in the order they were cut
    while levels[-1].count() > roots:
        levels.append(stash(parents(levels[-1]), "boxes"))
    spark = leaves.sparkSession
    top = sorted(r.id for r in levels[-1].select("id").collect())  # ROOTS at most
    pairs = spark.createDataFrame([(a, b) for i, a in enumerate(top) for b in top[i:]], "a long, b long")
    one, two = levels[-1].alias("l"), levels[-1].alias("r")
    pairs = pairs.join(one, F.col("a") == F.col("l.id")).join(two, F.col("b") == F.col("r.id")).filter(near_boxes("l", "r", percent)).select("a", "b")
    for level in reversed(levels[:-1]):
        pairs = stash(pairs, "node-pairs")
        one, two = level.alias("l"), level.alias("r")
        down = pairs.join(one, F.col("a") == F.col("l.parent")).join(two, (F.col("b") == F.col("r.parent")) & near_boxes("l", "r", percent) & ((F.col("a") < F.col("b")) | (F.col("l.id") <= F.col("r.id"))))
        pairs = down.select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))
    return stash(pairs, "leaf-pairs")


# ---- pairs of leaves ----------------------------------------------------------------------------------------------


def unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the trees of i and j pairwise; a parent's number is never larger than its child's, and all are roots after."""
    while len(i):
        a, b = parent[i], parent[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up


class Page:
    def __init__(self, row: dict):
        self.nodes, self.sizes = np.frombuffer(row["nodes"], np.int64), np.frombuffer(row["sizes"], np.int64)
        self.words = np.ascontiguousarray(np.frombuffer(row["words"], np.int16).reshape(-1, WORD_GROUPS).T)
        self.groups = np.frombuffer(row["groups"], np.uint8).reshape(-1, GROUPS)
        self.coarse = self.groups.reshape(len(self.nodes), 32, -1).sum(axis=2, dtype=np.int16)


def met(a: Page, b: Page, percent: int) -> np.ndarray:
    """For all points of a and then b, the first point that they hang together with by pairs that may be similar enough.
    One page with itself: a is b."""
    itself = a is b
    n = len(a.nodes)
    parent = np.arange(n if itself else n + len(b.nodes))
    rest, whole = 100 - percent, 100 + percent
    for s in range(0, n, STEP):
        mine = slice(s, min(n, s + STEP))
        sizes = a.sizes[mine]
        lo = int(np.searchsorted(b.sizes, -(-percent * int(sizes[0]) // 100)))
        hi = int(np.searchsorted(b.sizes, 100 * int(sizes[-1]) // percent, side="right"))
        lo = max(lo, s + 1) if itself else lo
        if lo >= hi:
            continue
        apart = np.zeros((len(sizes), hi - lo), np.int16)
        for g in range(WORD_GROUPS):
            apart += np.abs(a.words[g, mine, None] - b.words[g, None, lo:hi])
        most = ((sizes[:, None] + b.sizes[None, lo:hi]) * rest // whole).astype(np.int32)
        i, j = np.nonzero(apart <= most)
        most = most[i, j]
        i, j = i + s, j + lo
        if itself:
            later = i < j
            i, j, most = i[later], j[later], most[later]
        alike = (100 * a.sizes[i] >= percent * b.sizes[j]) & (100 * b.sizes[j] >= percent * a.sizes[i])
        i, j, most = i[alike], j[alike], most[alike]
        for p in range(0, len(i), 16_384):
            x, y, m = i[p : p + 16_384], j[p : p + 16_384], most[p : p + 16_384]
            of = y if itself else y + n
            new = parent[x] != parent[of]
            x, y, m, of = x[new], y[new], m[new], of[new]
            for left, right in ((a.coarse, b.coarse), (a.groups, b.groups)):
                near = np.abs(left[x].astype(np.int16) - right[y]).sum(axis=1, dtype=np.int32) <= m
                x, y, m, of = x[near], y[near], m[near], of[near]
            unite(parent, x, of)
    return parent


def list_batches(percent: int):
    """Sorted leaves to lists (key, node) of points that hang together across a pair of leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mine = None, None
        for x in batches:
            for row in x.to_pylist():
                if row["role"] == 0:
                    at, mine = row["a"], Page(row)
                    continue
                other = mine if row["b"] == at else Page(row)
                first = met(mine, other, percent)
                nodes = mine.nodes if other is mine else np.concatenate([mine.nodes, other.nodes])
                several = np.bincount(first, minlength=len(first))[first] > 1
                if several.any():
                    base = np.uint64(xxhash.xxh3_64_intdigest(f"{at}:{row['b']}".encode()))
                    keys = mix64(first[several].astype(np.uint64) + base).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(nodes[several])], ["key", "node"])

    return run


def candidate_lists(leaves: DataFrame, pairs: DataFrame, percent: int, stash: Stash) -> DataFrame:
    """(key, node): sets of one key may be similar. A leaf is sent once for PARTNERS leaves that it meets."""
    n = stash(pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts")), "partners")
    dealt = pairs.join(n, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    pages = leaves.select("leaf", *PAGE)
    empty = [F.lit(None).cast("binary").alias(c) for c in PAGE]
    left = dealt.select("a", "part").distinct().join(pages, F.col("a") == F.col("leaf")).select("a", "part", F.lit(0).alias("role"), F.lit(None).cast("long").alias("b"), *PAGE)
    right = dealt.filter("a <> b").join(pages, F.col("b") == F.col("leaf")).select("a", "part", F.lit(1).alias("role"), "b", *PAGE)
    itself = dealt.filter("a = b").select("a", "part", F.lit(1).alias("role"), "b", *empty)
    rows = left.unionByName(right).unionByName(itself).repartition("a", "part").sortWithinPartitions("a", "part", "role")
    return rows.mapInArrow(list_batches(percent), "key long, node long")


# ---- full sets ----------------------------------------------------------------------------------------------------


def confirm_batches(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in bounded(batches):
            left, right = x.column("text_a").dictionary_encode(), x.column("text_b").dictionary_encode()
            one, two = shingle_sets(left.dictionary), shingle_sets(right.dictionary)
            keep = []
            for i, j in zip(left.indices.to_pylist(), right.indices.to_pylist(), strict=True):
                both = len(np.intersect1d(one[i], two[j], assume_unique=True))
                keep.append(100 * both >= percent * (len(one[i]) + len(two[j]) - both))
            yield x.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, stash: Stash) -> DataFrame:
    """Those of `pairs` (a, b) whose full sets are similar enough. Members of an `a` with many are dealt into parts, and its
    text is copied to each."""
    pairs = stash(pairs.distinct(), "pairs")
    hot = stash(pairs.groupBy("a").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).filter("parts > 1"), "hot-leaders")
    n_hot = hot.count()
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("b"), F.col("parts"))).otherwise(0).cast("int")
    dealt = pairs.join(hinted(hot, n_hot), "a", "left").select("a", "b", part.alias("part"))
    leaders = texts.toDF("a", "text_a").join(pairs.select("a").distinct(), "a", "left_semi").join(hinted(hot, n_hot), "a", "left")
    leaders = leaders.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    joined = dealt.join(texts.toDF("b", "text_b"), "b").join(leaders, ["a", "part"])
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(confirm_batches(percent), "a long, b long")


def block_batches(percent: int):
    """Sorted blocks and what they meet to links between components, as pairs of components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, index = None, [], None
        for x in bounded(batches):
            links = set()
            rows = zip(x.column("block").to_pylist(), x.column("chunk").to_pylist(), x.column("role").to_pylist(), x.column("component").to_pylist(), shingle_sets(x.column("text")), strict=True)
            for block, chunk, role, component, shingles in rows:
                if (block, chunk) != at:
                    at, own, index = (block, chunk), [], None
                if role == 0:
                    own.append((component, shingles))
                    continue
                if index is None:
                    flat, which = np.concatenate([s for _, s in own]), np.repeat(np.arange(len(own)), [len(s) for _, s in own])
                    order = np.argsort(flat, kind="stable")
                    index = flat[order], which[order], np.array([len(s) for _, s in own]), np.array([c for c, _ in own])
                flat, which, sizes, of = index
                lo, hi = np.searchsorted(flat, shingles), np.searchsorted(flat, shingles, side="right")
                n = hi - lo
                both = np.bincount(which[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())], minlength=len(own))
                near = np.flatnonzero((of != component) & (100 * both >= percent * (sizes + len(shingles) - both)))
                links.update((min(c, component), max(c, component)) for c in of[near].tolist())
            a, b = zip(*links, strict=True) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def across(mixed: DataFrame, sizes: DataFrame, texts: DataFrame, percent: int, stash: Stash) -> DataFrame:
    """Links between components: in every list each set outside the largest component is compared with all of the list. Such
    sets come in blocks by the first of their lists, bounded by sets and shingles; a block is copied to as many tasks as it
    takes for each to meet a bounded number. mixed: (key, node, component, main); sizes: (node, n_shingles)."""
    bound = lambda most: F.greatest(F.ceil(F.count("*") / most), F.ceil(F.sum("n_shingles") / SHINGLES)).cast("int")
    others = mixed.filter("component <> main")
    family = stash(others.groupBy("node").agg(F.min("key").alias("family"), F.any_value("component").alias("component")).join(sizes, "node"), "family")
    parts = stash(family.groupBy("family").agg(bound(BLOCK).alias("parts")), "parts")
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    blocks = stash(family.join(parts, "family").select("node", "component", F.xxhash64("family", part).alias("block")), "blocks")
    lists = stash(others.select("key", "node").join(blocks.select("node", "block"), "node").select("key", "block").distinct(), "block-lists")
    members = mixed.select("key", "node", "component").join(lists, "key").select("block", "node", "component").distinct()
    members = stash(members.join(sizes, "node"), "members")
    chunks = stash(members.groupBy("block").agg(bound(MEMBERS).alias("chunks")), "chunks")
    second = members.join(chunks, "block").select("block", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"), F.lit(1).alias("role"), "node", "component")
    first = blocks.join(chunks, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("role"), "node", "component")
    rows = stash(first.unionByName(second), "block-rows").join(texts, "node")
    rows = rows.repartition("block", "chunk").sortWithinPartitions("block", "chunk", "role")
    return rows.select("block", "chunk", "role", "component", "text").mapInArrow(block_batches(percent), "a long, b long").distinct()


def linked(lists: DataFrame, sizes: DataFrame, texts: DataFrame, percent: int, stash: Stash) -> DataFrame:
    """(node, component) of all sets that are linked with another. lists: (key, node), keys of two nodes or more."""
    leaders = lists.groupBy("key").agg(F.min("node").alias("a"))
    pairs = lists.withColumnRenamed("node", "b").join(leaders, "key").filter("a <> b").select("a", "b")
    labels = components(stash(confirmed(pairs, texts, percent, stash), "links"), stash)
    own = stash(lists.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component")), "lists")
    per = own.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = per.groupBy("key").agg(F.sum("n").alias("n"), F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("most"))
    open_lists = stash(main.filter("n > most and n > 2").select("key", "main"), "open-lists")  # of two, the only pair was checked
    mixed = stash(own.join(open_lists, "key"), "mixed")
    found = stash(across(mixed, sizes, texts, percent, stash), "across")
    merged = components(found, stash).toDF("component", "merged")
    alone = found.select(F.col("a").alias("node")).union(found.select("b")).distinct().join(labels, "node", "left_anti").select("node", F.col("node").alias("component"))
    labels = labels.unionByName(alone).join(merged, "component", "left")
    return stash(labels.select("node", F.coalesce("merged", "component").alias("component")), "labels")


def texts_of(docs: DataFrame, wanted: DataFrame, stash: Stash) -> DataFrame:
    """(node, text) of the wanted sets. docs: first_id, text; wanted: node, first_id. Texts are found by id; where an id is
    null or has several sets, its rows' sets are named anew, and of copies one is taken."""
    ids = stash(wanted.groupBy("first_id").agg(F.count("*").alias("n"), F.any_value("node").alias("node")), "wanted-ids")
    plain, odd = ids.filter("n = 1 and first_id is not null").select("first_id", "node"), ids.filter("n > 1 or first_id is null").select("first_id")
    texts = docs.join(plain.hint("merge"), "first_id").select("node", "text").mapInArrow(own_text_batches, "node long, text string")
    if n_odd := odd.count():
        own = docs.alias("d").join(hinted(odd, n_odd).alias("o"), F.col("d.first_id").eqNullSafe(F.col("o.first_id")), "left_semi")
        rest = wanted.select("node").join(plain.select("node"), "node", "left_anti")
        named = own.select("text").mapInArrow(named_text_batches, "node long, text string").join(rest, "node", "left_semi")
        texts = texts.unionByName(named.groupBy("node").agg(F.any_value("text").alias("text")))
    return stash(texts, "texts")


def own_text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where rows share an id, the text that has the named set, once: rows come in the order of ids."""
    last = None
    for x in bounded(batches):
        keep = []
        for shingles, node in zip(shingle_sets(x.column("text")), x.column("node").to_pylist(), strict=True):
            keep.append(node != last and len(shingles) > 0 and set_key(shingles) == node)
            last = node if keep[-1] else last
        yield x.filter(pa.array(keep, pa.bool_()))


def named_text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in bounded(batches):
        nodes = pa.array([set_key(s) if len(s) else None for s in shingle_sets(x.column("text"))], pa.int64())
        yield pa.RecordBatch.from_arrays([nodes, x.column("text")], ["node", "text"]).filter(nodes.is_valid())


def similar_sets(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF, dealt: int = DEALT, roots: int = ROOTS) -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable by links, its own included).

    Sets are of distinct 3-word shingles of lower-cased (A-Z) words; with fewer words, the whole sequence. Two texts link
    when 100 * intersection >= percent * union. Texts that are null or without words have an empty set and no links. Copies
    share one set and are joined through it. Rows that share an id and have different texts count as linked only by their
    texts. Rows with a null id take part by their text; they name a component only if nothing else does. An empty table
    gives an empty result. Other columns are ignored. Shingles and sets are told apart by 64-bit hashes (shingles by 61 bits
    of the hash and a group by first word).
    """
    id_type = docs.select(id_col).schema[0].dataType
    own = columns(docs, [id_col, text_col])
    rows = stash(own.mapInArrow(point_batches(id_col), f"`{id_col}` {id_type.simpleString()}, n_shingles long, node long, point binary"), "points")
    with Workspace(docs.sparkSession) as work:
        by_set = stash(set_components(own.toDF("first_id", "text"), rows.withColumnRenamed(id_col, "first_id"), percent, leaf, dealt, roots, work), "by-set")
    out = rows.select(id_col, "n_shingles", "node").join(by_set, "node", "left")
    return out.select(id_col, "n_shingles", F.coalesce("component_id", id_col).cast(id_type).alias("component_id"))


def set_components(docs: DataFrame, rows: DataFrame, percent: int, leaf: int, dealt: int, roots: int, stash: Stash) -> DataFrame:
    """(node, component_id) of all sets. docs: first_id, text; rows: first_id, n_shingles, node, point."""
    sets = rows.filter("n_shingles > 0").groupBy("node").agg(F.min("first_id").alias("first_id"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("point").alias("point"))
    sets = stash(sets, "sets")
    leaves = stash(grow(sets, sets.count(), leaf, dealt), "leaves")
    pairs = leaf_pairs(leaves, percent, stash, roots)
    lists = stash(candidate_lists(leaves, pairs, percent, stash), "lists")
    ids, sizes = sets.select("node", "first_id"), sets.select("node", "n_shingles")
    wanted = stash(lists.select("node").distinct().join(ids, "node"), "wanted")
    labels = linked(lists, sizes, texts_of(docs, wanted, stash), percent, stash)
    names = labels.join(ids, "node").groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = stash(labels.join(names, "component").select("node", F.col("component_id").alias("linked_id")), "named")
    return ids.join(named, "node", "left").select("node", F.coalesce("linked_id", "first_id").alias("component_id"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT r, doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
         ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS shingles FROM w),
sized AS (SELECT r, doc_id, len(shingles) AS n FROM s),
flat AS MATERIALIZED (SELECT r, hash(unnest(shingles)) AS h FROM s),
links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.r AS a, y.r AS b, count(*) AS shared FROM flat x JOIN flat y ON x.h = y.h AND x.r <> y.r GROUP BY 1, 2)
  JOIN sized p ON p.r = a JOIN sized q ON q.r = b WHERE 100 * shared >= 90 * (p.n + q.n - shared)),
reach AS (
  SELECT r, r AS other FROM sized UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.other)
SELECT sized.doc_id, CAST(sized.n AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
FROM sized JOIN reach ON reach.r = sized.r JOIN sized o ON o.r = reach.other GROUP BY sized.r, sized.doc_id, sized.n
"""
