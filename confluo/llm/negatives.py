"""Hard negatives by a two-dimensional block matrix multiply in the manner of SUMMA.

Scores of anchors against all rows are one matrix product. Anchors and rows are dealt into blocks by a hash of their place,
so that blocks are equal whatever ids and labels there are; each cell (anchor block, row block) gets the panels of its two
sides, a chunk of the dimensions at a time. A task multiplies the two panels of one chunk to a partial tile of 64-bit
integers; a shuffle brings the partial tiles of a cell together, where they are added and reduced to the best few rows of
each anchor, or of each window below an anchor's positive. What is best in all cells is then picked by rank.

Positives are of the anchor's label, negatives of others, so the first product takes only cells of one group of labels, and
the second all. The work grows with anchors times rows, as every score counts; a task holds one tile at most, and a row is
sent once for `ANCHORS` anchors.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Workspace, columns, stash

#: Anchors and rows of a block on average, and dimensions of a chunk.
ANCHORS, ROWS, CHUNK = 256, 1024, 32
#: Groups of labels at most: so many rows has the table of blocks that is broadcast.
GROUPS = 256
#: Scores stay below this, so that hundredfold they are still exact.
MOST = 2**55
LOW = -(2**62)
WINDOWS = "array<struct<row: bigint, id: bigint, score: bigint>>"
CELL = ("g", "a", "b")


def usable(vector: Column) -> Column:
    """No null and all components finite."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))


def scaled(vector: Column, scale: float, bound: int) -> Column:
    """floor(scale * x) of each component, held between -bound and bound."""
    held = lambda x: F.greatest(F.least(x.cast("double") * scale, F.lit(float(bound))), F.lit(float(-bound)))
    return F.transform(vector, lambda x: F.floor(held(x)).cast("long"))


def panels(anchors: DataFrame, rows: DataFrame, group: Column, chunks: int) -> DataFrame:
    """Each anchor and row (role 0, 1) in each cell it takes part in, a row for each chunk of its dimensions."""
    n_rows, n_anchors = (x.groupBy(group.alias("g")).agg(F.count("*").alias(n)) for x, n in ((rows, "n"), (anchors, "m")))
    blocks = n_rows.join(n_anchors, "g").select("g", F.ceil(F.col("m") / ANCHORS).cast("int").alias("na"), F.ceil(F.col("n") / ROWS).cast("int").alias("nb"))
    all_of, one_of = (lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))), (lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int"))
    own = ("g", "a", "b", "role", "row", "id", "label", "windows", "q")
    left = anchors.withColumn("g", group).join(F.broadcast(blocks), "g").withColumns({"a": one_of("na"), "b": all_of("nb"), "role": F.lit(0)}).select(*own)
    right = rows.withColumn("g", group).join(F.broadcast(blocks), "g").withColumns({"a": all_of("na"), "b": one_of("nb"), "role": F.lit(1), "windows": F.lit(None).cast(WINDOWS)}).select(*own)
    parts = F.transform(F.sequence(F.lit(0), F.lit(chunks - 1)), lambda k: F.struct(k.alias("k"), F.slice("q", k * CHUNK + 1, CHUNK).alias("part")))
    return left.unionByName(right).withColumn("x", F.explode(parts)).select(*CELL, "x.k", *own[3:-1], "x.part")


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed, exact: by floating point where all sums are below 2**53, else in integers."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def matrix(part: pa.ListArray) -> np.ndarray:
    """Rows of CHUNK components; shorter parts end in zeros."""
    n = part.value_lengths().to_numpy(zero_copy_only=False)
    flat = part.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(n), CHUNK), np.int64)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def told(x: pa.RecordBatch, names: tuple[str, ...]) -> pa.StructArray:
    return pa.StructArray.from_arrays([x.column(c) for c in names], list(names))


TOLD_A, TOLD_B = ("row", "id", "label", "windows"), ("row", "id", "label")
PARTIAL = f"g int, a int, b int, k int, anchors array<struct<row: bigint, id: bigint, label: bigint, windows: {WINDOWS}>>, rows array<struct<row: bigint, id: bigint, label: bigint>>, n_rows int, tile binary"


class Cell:
    """The panels of one chunk while their rows come: anchors first."""

    def __init__(self, at: tuple):
        self.at, self.left, self.tiles, self.anchors, self.rows, self.a = at, [], [], [], [], None

    def take(self, x: pa.RecordBatch) -> None:
        role = x.column("role").to_numpy()
        n = int((role == 0).sum())
        if n:
            self.left.append(matrix(x.column("part").slice(0, n)))
            self.anchors.append(told(x.slice(0, n), TOLD_A))
        if n < len(role) and self.left:
            self.a = np.concatenate(self.left) if self.a is None else self.a
            self.tiles.append(product(self.a, matrix(x.column("part").slice(n))))
            self.rows.append(told(x.slice(n), TOLD_B))

    def tile(self, schema: pa.Schema) -> pa.RecordBatch | None:
        if not self.tiles:
            return None
        tile = np.concatenate(self.tiles, axis=1)
        names = ("anchors", "rows")
        own = [pa.concat_arrays(x if self.at[3] == 0 else [x[0].slice(0, 0)]) for x in (self.anchors, self.rows)]  # the first chunk names them for all
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x).cast(schema.field(c).type) for c, x in zip(names, own, strict=True)]
        return pa.RecordBatch.from_arrays([*[pa.array([v], pa.int32()) for v in self.at], *lists, pa.array([tile.shape[1]], pa.int32()), pa.array([tile.tobytes()], pa.binary())], schema=schema)


def runs(x: pa.RecordBatch, names: tuple[str, ...]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The stretches of a batch that have equal keys."""
    keys = np.stack([x.column(c).to_numpy() for c in names])
    at = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), x.num_rows]
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        if hi > lo:
            yield tuple(int(v) for v in keys[:, lo]), x.slice(lo, hi - lo)


def partial_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted panels to the partial tile of each cell and chunk."""
    window = pa.list_(pa.struct([("row", pa.int64()), ("id", pa.int64()), ("score", pa.int64())]))
    three = [("row", pa.int64()), ("id", pa.int64()), ("label", pa.int64())]
    schema = pa.schema([*[(c, pa.int32()) for c in (*CELL, "k")], ("anchors", pa.list_(pa.struct([*three, ("windows", window)]))), ("rows", pa.list_(pa.struct(three))), ("n_rows", pa.int32()), ("tile", pa.binary())])
    now = None
    for x in batches:
        for at, own in runs(x, (*CELL, "k")):
            if now is None or now.at != at:
                if now is not None and (out := now.tile(schema)) is not None:
                    yield out
                now = Cell(at)
            now.take(own)
    if now is not None and (out := now.tile(schema)) is not None:
        yield out


def top(scores: np.ndarray, fits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the first k fitting columns of each row: higher scores first, then earlier columns."""
    held = np.where(fits, scores, LOW)
    if held.shape[1] > k:
        least = np.partition(held, held.shape[1] - k, axis=1)[:, held.shape[1] - k]
        fits = fits & (held >= least[:, None])
    i, j = np.nonzero(fits)
    order = np.lexsort((j, -held[i, j], i))
    i, j = i[order], j[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < k], j[place < k]


def best_of_cells(found: Callable[[np.ndarray, list, list], Iterator[list]], schema: pa.Schema):
    """Add the partial tiles of each cell, and keep what `found` picks of the sums. Columns come in the order of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def picked() -> Iterator[pa.RecordBatch]:
            order = sorted(range(len(rows)), key=lambda j: (rows[j]["id"] is None, rows[j]["id"] or 0, rows[j]["row"]))
            out = list(found(total[:, order], anchors, [rows[j] for j in order]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

        now, total, anchors, rows = None, None, [], []
        for x in batches:
            for n in range(x.num_rows):
                at = tuple(x.column(c)[n].as_py() for c in CELL)
                if at != now:
                    if now is not None:
                        yield from picked()
                    now, total = at, None
                if x.column("k")[n].as_py() == 0:
                    anchors, rows = x.column("anchors")[n].as_py(), x.column("rows")[n].as_py()
                tile = np.frombuffer(x.column("tile")[n].as_buffer(), np.int64).reshape(-1, x.column("n_rows")[n].as_py())
                total = tile if total is None else total + tile
        if now is not None:
            yield from picked()

    return run


def of(rows: list[dict], name: str) -> np.ndarray:
    return np.array([r[name] for r in rows], np.int64)


def best_positives(k: int):
    def found(scores: np.ndarray, anchors: list[dict], rows: list[dict]) -> Iterator[list]:
        fits = (of(anchors, "label")[:, None] == of(rows, "label")[None, :]) & (of(anchors, "row")[:, None] != of(rows, "row")[None, :])
        for i, j in zip(*top(scores, fits, k), strict=True):
            yield anchors[i]["row"], rows[j]["row"], rows[j]["id"], int(scores[i, j])

    return found


def best_negatives(k: int, low: int):
    def found(scores: np.ndarray, anchors: list[dict], rows: list[dict]) -> Iterator[list]:
        other = of(anchors, "label")[:, None] != of(rows, "label")[None, :]
        for p in range(max(len(a["windows"]) for a in anchors)):
            has = np.array([len(a["windows"]) > p for a in anchors])
            most = np.array([a["windows"][p]["score"] if len(a["windows"]) > p else 0 for a in anchors], np.int64)[:, None]
            fits = other & has[:, None] & (low * most <= 100 * scores) & (scores <= most)
            for i, j in zip(*top(scores, fits, k), strict=True):
                positive = anchors[i]["windows"][p]
                yield anchors[i]["row"], anchors[i]["id"], positive["row"], positive["id"], positive["score"], rows[j]["row"], rows[j]["id"], int(scores[i, j])

    return found


def scored(anchors: DataFrame, rows: DataFrame, group: Column, chunks: int, found, names: tuple[str, ...]) -> DataFrame:
    """What `found` picks in the cells of all groups."""
    tiles = panels(anchors, rows, group, chunks).repartition(*CELL, "k").sortWithinPartitions(*CELL, "k", "role", "row").mapInArrow(partial_tiles, PARTIAL)
    summed = tiles.repartition(*CELL).sortWithinPartitions(*CELL, "k")
    return summed.mapInArrow(best_of_cells(found, pa.schema([(n, pa.int64()) for n in names])), ", ".join(f"{n} long" for n in names))


def first_by_score(df: DataFrame, key: tuple[str, ...], k: int) -> DataFrame:
    order = Window.partitionBy(*key).orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, scale: float = 256.0, positives: int = 5, negatives: int = 5, low: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of hard negatives.

    A score is the inner product of two vectors, each component x as floor(scale * x). Higher scores come first, ties by
    smaller id (nulls last). Positives are the first `positives` other rows of an anchor's label; for each, the negatives
    are the first `negatives` rows of other labels with low * positive_score <= 100 * negative_score <= 100 * positive_score.

    Rows with a null label, a null vector or a null or non-finite component take no part. Every other row does, also one
    of several under one id and one without an id, which is no anchor. Where vectors differ in length, missing components
    count as 0. Labels are integers. Components so large that a score could pass 2**55 are held at that bound. An anchor
    without positives, or a positive without negatives, gives no rows; an empty table an empty result. Other columns are
    ignored.
    """
    spark = rows.sparkSession
    label = F.col("label") if label is None else label
    own = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("long").alias("label"), F.col(f"`{vector_col}`").alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    own = own.filter(F.col("label").isNotNull() & usable(F.col("v")))
    dims = own.agg(F.max(F.size("v")).alias("n")).first().n or 1
    chunks = math.ceil(dims / CHUNK)
    own = own.select(F.monotonically_increasing_id().alias("row"), "id", "label", "anchor", scaled(F.col("v"), scale, math.isqrt(MOST // dims)).alias("q"))
    with Workspace(spark) as work:
        own = work(own, "vectors")  # written once, so that `row` is the same for all that read it
        anchors = own.filter("anchor").withColumn("windows", F.lit(None).cast(WINDOWS))
        near = scored(anchors, own, F.pmod(F.xxhash64("label"), F.lit(GROUPS)).cast("int"), chunks, best_positives(positives), ("anchor", "row", "id", "score"))
        windows = first_by_score(near, ("anchor",), positives).groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "row", "id", "score"))).alias("w"))
        windows = windows.select(F.col("anchor").alias("row"), F.transform("w", lambda x: F.struct(x["row"].alias("row"), x["id"].alias("id"), x["score"].alias("score"))).alias("windows"))
        anchors = work(anchors.drop("windows").join(windows, "row"), "anchors")
        names = ("anchor", "anchor_id", "positive", "positive_id", "positive_score", "row", "id", "score")
        hard = first_by_score(scored(anchors, own, F.pmod("row", F.lit(1)).cast("int"), chunks, best_negatives(negatives, low), names), ("anchor", "positive"), negatives)
        return stash(hard.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")


ORACLE_SQL = """
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.r, a.vec_id, b.r AS other_r, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM e a JOIN e b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT r, vec_id, other_r, other, score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, other, other_r) <= 5)
SELECT p.vec_id AS anchor_id, p.other AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.other AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON p.r = n.r AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
WINDOW w AS (PARTITION BY p.r, p.other_r ORDER BY n.score DESC, n.other, n.other_r)
QUALIFY row_number() OVER w <= 5
"""
