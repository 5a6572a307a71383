"""MinHash near-duplicates by a signature-coordinate inverted join, confirmed on full sets.

Each distinct shingle set gets K minimum hashes. Every (coordinate, value) pair has a posting list. Sets of similarity
0.75 or more share at least `match` of K coordinates (all but 4 in a million such pairs at the very threshold, for 22
of 48; far fewer above it), so the lists are merged as a T-occurrence problem: with a set's lists in rising order of
length, two sets that share `match` coordinates meet in their first K - match + 1 lists. Only those are read (values
that occur once lead the order and need no list at all); the long ones are skipped, and pairs that met count their
collisions from the two signatures. Pairs at or above the match threshold are confirmed on the full sets.

Lists may hold thousands of similar sets. Instead of all pairs, each list first checks its members against one leader;
links found make components. A leader with many members is copied to parts of them. Then every set outside the largest
component of a list is compared with all sets of its lists, in blocks bounded by sets and by shingles. So no link between
components is lost, and none within one is needed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, bounded, columns, hinted, stash
from .words import batch_words, mix64, odd_numbers, window_hashes

WIDTH = 5  # words in a shingle
COORDINATES, MATCH = 48, 22
LEAST = 0.75
PART = 500  # members that meet one copy of their leader
BLOCK, MEMBERS, SHINGLES = 128, 256, 1_000_000  # sets of a block, sets that it meets in a task, and shingles of either, at most (on average)
Stash = Callable[[DataFrame, str], DataFrame]


def shingle_sets(text: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = batch_words(text, lower=True)
    hashes, places = window_hashes(words.hashes(), words.docs, WIDTH)
    return [np.unique(hashes[a:b]) for a, b in zip(places[:-1], places[1:], strict=True)]


def set_key(own: np.ndarray) -> int:
    """A signed 64-bit name of a set; equal sets have equal names."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).astype(np.int64))


def signature_batches(id_col: str):
    a = odd_numbers(COORDINATES, 11)
    low = np.uint64(63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in bounded(batches):
            sets = shingle_sets(x.column(1))
            n = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(n)
            keys = [set_key(s) if len(s) else None for s in sets]
            sig = np.zeros((len(full), COORDINATES), np.int64)
            if len(full):
                flat = np.concatenate([sets[i] for i in full])
                at = np.cumsum(n[full]) - n[full]
                for k in range(COORDINATES):
                    h = np.minimum.reduceat(mix32(flat * a[k]), at)
                    sig[:, k] = ((h & ~low) | np.uint64(k)).astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, COORDINATES, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(n), pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(sig.ravel()))], [id_col, "n_shingles", "node", "signature"])

    return run


def mix32(x: np.ndarray) -> np.ndarray:
    """One cheap round that lets high and low bits meet after the multiplication."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x9E3779B97F4A7C15)
    return x


def signed_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    own = columns(docs, [id_col, text_col])
    return own.mapInArrow(signature_batches(id_col), f"`{id_col}` {own.schema[0].dataType.simpleString()}, n_shingles long, node long, signature array<long>")


def prefix_postings(sets: DataFrame, stash: Stash) -> DataFrame:
    """(key, node): the lists in which sets that share `MATCH` coordinates must meet. sets: node, signature."""
    postings = sets.select("node", F.explode("signature").alias("key"))
    lengths = stash(postings.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "lengths")
    shared = postings.join(lengths, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("lists"))
    shared = shared.filter(F.size("lists") >= MATCH)
    return shared.select("node", F.explode(F.slice("lists", F.lit(1), F.size("lists") - (MATCH - 1))).alias("x")).select("x.key", "node")


def confirm_batches(threshold: float):
    percent = round(100 * threshold)

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


def confirmed(pairs: DataFrame, sets: DataFrame, texts: DataFrame, threshold: float, stash: Stash) -> DataFrame:
    """Those of `pairs` (a, b) that share MATCH coordinates and whose full sets are similar enough.

    An `a` may have many pairs: these are dealt into parts of about PART, and what is known of `a` is copied to each.
    """
    pairs = stash(pairs.distinct(), "pairs")
    hot = stash(pairs.groupBy("a").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).filter("parts > 1"), "hot-leaders")
    n_hot = hot.count()
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("b"), F.col("parts"))).otherwise(0).cast("int")
    dealt = pairs.join(hinted(hot, n_hot), "a", "left").select("a", "b", part.alias("part"))

    def of_leaders(rows: DataFrame) -> DataFrame:
        return rows.join(hinted(hot, n_hot), "a", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")

    sig = sets.select("node", "signature")
    leaders = pairs.select("a").distinct()
    met = dealt.join(sig.toDF("b", "sig_b"), "b").join(of_leaders(sig.toDF("a", "sig_a").join(leaders, "a", "left_semi")), ["a", "part"])
    met = stash(met.filter(F.size(F.array_intersect("sig_a", "sig_b")) >= MATCH).select("a", "b", "part"), "met")
    joined = met.join(texts.toDF("b", "text_b"), "b").join(of_leaders(texts.toDF("a", "text_a").join(leaders, "a", "left_semi")), ["a", "part"])
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(confirm_batches(threshold), "a long, b long")


def components(edges: DataFrame, stash: Stash) -> DataFrame:
    """(node, component): the smallest node reachable, for all nodes of `edges` (a, b). Labels spread and jump until none changes."""
    both = stash(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a")), "edges")
    labels = stash(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component")), "labels")
    while True:
        near = both.join(labels.toDF("other", "component"), "other").groupBy("node").agg(F.min("component").alias("near"))
        new = labels.join(near, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        new = stash(new, "labels")
        jump = new.select(F.col("node").alias("component"), F.col("component").alias("next"))
        labels = new.join(jump, "component", "left").select("node", F.coalesce("next", "component").alias("component"), "was")
        labels = stash(labels, "labels")
        changed = labels.filter("component <> was").limit(1).count()
        labels = labels.select("node", "component")
        if not changed:
            return labels


def linked(postings: DataFrame, sets: DataFrame, texts: DataFrame, threshold: float, stash: Stash) -> DataFrame:
    """(node, component) of all sets that are linked with another. postings: (key, node), keys of two nodes or more."""
    leaders = stash(postings.groupBy("key").agg(F.min("node").alias("a")), "leaders")
    pairs = postings.withColumnRenamed("node", "b").join(leaders, "key").filter("a <> b").select("a", "b")
    labels = components(stash(confirmed(pairs, sets, texts, threshold, stash), "links"), stash)
    own = stash(postings.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component")), "lists")
    sizes = own.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(F.sum("n").alias("n"), F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("most"))
    mixed = stash(main.filter("n > most").select("key", "main"), "mixed")
    mixed = stash(own.join(mixed, "key"), "mixed-lists")
    found = stash(across(mixed, leaders, sets, texts, threshold, stash), "across")
    merged = components(found.toDF("a", "b"), stash)
    merged = merged.toDF("component", "merged")
    alone = found.select(F.col("a").alias("node")).union(found.select("b")).distinct().join(labels, "node", "left_anti").select("node", F.col("node").alias("component"))
    labels = labels.unionByName(alone).join(merged, "component", "left")
    return stash(labels.select("node", F.coalesce("merged", "component").alias("component")), "labels")


def across(mixed: DataFrame, leaders: DataFrame, sets: DataFrame, texts: DataFrame, threshold: float, stash: Stash) -> DataFrame:
    """Links between components, as pairs of components: in every list that holds several, each set outside the largest
    component is compared with all sets of the list.

    Such sets are gathered in blocks of alike ones (those with the same smallest leader), and each block meets every set
    of its lists, so texts are sent by block and not by pair. A block has a bounded number of sets and shingles, and it is
    copied to as many tasks as it takes for each to meet a bounded number. mixed: (key, node, component, main).
    """
    others = mixed.filter("component <> main")
    family = others.join(leaders, "key").groupBy("node").agg(F.min("a").alias("family"), F.any_value("component").alias("component"))
    family = stash(family.join(sets.select("node", "n_shingles"), "node"), "family")
    bound = lambda most: F.greatest(F.ceil(F.count("*") / most), F.ceil(F.sum("n_shingles") / SHINGLES)).cast("int")
    parts = stash(family.groupBy("family").agg(bound(BLOCK).alias("parts")), "parts")
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    blocks = stash(family.join(parts, "family").select("node", "component", F.xxhash64("family", part).alias("block")), "blocks")
    lists = stash(others.select("key", "node").join(blocks.select("node", "block"), "node").select("key", "block").distinct(), "block-lists")
    members = mixed.select("key", "node", "component").join(lists, "key").select("block", "node", "component").distinct()
    members = stash(members.join(sets.select("node", "n_shingles"), "node"), "members")
    chunks = stash(members.groupBy("block").agg(bound(MEMBERS).alias("chunks")), "chunks")
    met = members.join(chunks, "block").select("block", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"), F.lit(1).alias("role"), "node", "component")
    first = blocks.join(chunks, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("role"), "node", "component")
    rows = stash(first.unionByName(met), "block-rows").join(texts, "node")
    rows = rows.repartition("block", "chunk").sortWithinPartitions("block", "chunk", "role")
    return rows.select("block", "chunk", "role", "node", "component", "text").mapInArrow(block_batches(threshold), "a long, b long").distinct()


def block_batches(threshold: float):
    percent = round(100 * threshold)

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
                    flat = np.concatenate([s for _, s in own])
                    which = np.repeat(np.arange(len(own)), [len(s) for _, s in own])
                    order = np.argsort(flat, kind="stable")
                    flat, which = flat[order], which[order]
                    n_own, of = np.array([len(s) for _, s in own]), np.array([c for c, _ in own])
                    index = True
                lo, hi = np.searchsorted(flat, shingles), np.searchsorted(flat, shingles, side="right")
                n = hi - lo
                if not n.any():
                    continue
                hits = which[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                both = np.bincount(hits, minlength=len(own))
                near = np.flatnonzero((of != component) & (100 * both >= percent * (n_own + len(shingles) - both)))
                links.update((min(c, component), max(c, component)) for c in of[near].tolist())
            a, b = zip(*links, strict=True) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, threshold: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable by links, its own included), kept (id = component_id).

    Sets are of distinct 5-word shingles of lower-cased (A-Z) words; with fewer words, the whole sequence. Texts that are
    null or without words have an empty set and no links. Copies share one set and are joined through it, however many
    they are. Rows that share an id and have different texts count as linked only by their texts. Rows with a null id
    take part by their text; they name a component only if nothing else does. An empty table gives an empty result.
    Other columns are ignored. Shingles and sets are told apart by 64-bit hashes.
    """
    if threshold < LEAST:
        raise ValueError(f"coordinates are chosen for a similarity of {LEAST} or more")
    id_type = docs.select(id_col).schema[0].dataType
    rows = stash(signed_rows(docs, id_col, text_col), "rows")
    with Workspace(docs.sparkSession) as work:
        by_set = stash(set_components(columns(docs, [id_col, text_col]).toDF("first_id", "text"), rows.withColumnRenamed(id_col, "first_id"), threshold, work), "by-set")
    out = rows.select(id_col, "n_shingles", "node").join(by_set, "node", "left")
    component = F.coalesce("component_id", id_col).cast(id_type)
    return out.select(id_col, "n_shingles", component.alias("component_id"), F.col(id_col).eqNullSafe(component).alias("kept"))


def set_components(docs: DataFrame, rows: DataFrame, threshold: float, stash: Stash) -> DataFrame:
    """(node, component_id) of all sets. docs: first_id, text; rows: first_id, n_shingles, node, signature."""
    sets = rows.filter("n_shingles > 0").groupBy("node").agg(F.min("first_id").alias("first_id"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("signature").alias("signature"))
    sets = stash(sets, "sets")
    postings = stash(prefix_postings(sets.select("node", "signature"), stash), "postings")
    meet = postings.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    postings = stash(postings.join(stash(meet, "meet"), "key"), "postings")
    wanted = stash(postings.select("node").distinct().join(sets.select("node", "first_id"), "node"), "wanted")
    ids = stash(wanted.groupBy("first_id").agg(F.count("*").alias("n"), F.any_value("node").alias("node")), "wanted-ids")
    # The list grows with the corpus, so it is never broadcast: texts and list meet by a shuffle at every size.
    plain, odd = ids.filter("n = 1 and first_id is not null").select("first_id", "node"), ids.filter("n > 1 or first_id is null").select("first_id")
    texts = docs.join(plain.hint("merge"), "first_id").select("node", "text").mapInArrow(own_text_batches, "node long, text string")
    if n_odd := odd.count():  # no id, or one of several sets, leads to these, so their texts are named anew; of copies, one
        own = docs.alias("d").join(hinted(odd, n_odd).alias("o"), F.col("d.first_id").eqNullSafe(F.col("o.first_id")), "left_semi")
        rest = wanted.select("node").join(plain.select("node"), "node", "left_anti")
        named = own.select("text").mapInArrow(named_text_batches, "node long, text string").join(rest, "node", "left_semi")
        texts = texts.unionByName(named.groupBy("node").agg(F.any_value("text").alias("text")))
    texts = stash(texts, "texts")
    labels = linked(postings, sets, texts, threshold, stash)
    named = labels.join(sets.select("node", "first_id"), "node")
    names = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = stash(labels.join(names, "component").select("node", F.col("component_id").alias("linked_id")), "named")
    return sets.select("node", "first_id").join(named, "node", "left").select("node", F.coalesce("linked_id", "first_id").alias("component_id"))


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
    """Texts that have a set, with its name."""
    for x in bounded(batches):
        nodes = pa.array([set_key(s) if len(s) else None for s in shingle_sets(x.column("text"))], pa.int64())
        yield pa.RecordBatch.from_arrays([nodes, x.column("text")], ["node", "text"]).filter(nodes.is_valid())
