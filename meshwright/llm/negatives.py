"""Hard negatives by exact integer inner products of anchors with all rows, in tiles.

Rows are packed into candidate tiles and anchors into anchor tiles of bounded size; each pair of tiles meets once a pass. A task multiplies
the two by Strassen's recursion on 64-bit integers, with zeros where a side is odd or a vector short, so scores are exact. What a pair of tiles yields for
its anchors is a block of heaps: the five best of each, in the order (score falling, id rising). Heaps merge 64 blocks at a time, tile by tile, until one block is left
for each anchor tile. The first pass keeps each anchor's positives, the second one heap for each positive's window of scores. No scores are
stored, no group is larger than two tiles or 64 blocks of heaps, and tiles are dealt by row, so a label that most rows have is no hot key.

Defined cases: rows with a null label, a null vector or a null or non-finite component take no part, nor do they count as anchors; an empty vector scores 0; a shorter
vector counts as filled with zeros; a null id is no anchor and comes last among ties (the largest long stands for it and may not be an id); rows that repeat
an id are rows of their own, and an anchor is left out of its positives by row, not by id; an empty table gives no rows; extra columns, whatever
their names, are dropped. Squared lengths of vectors must stay below 2 ** 50 so that 100 * score and the tie order fit 64 bits: larger ones raise an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, write_table

ANCHOR_ROWS, CANDIDATE_ROWS = 512, 4096
POSITIVES, NEGATIVES = 5, 5
#: Blocks of heaps that a task merges: about 64 * 512 * 25 entries of 16 bytes.
MERGED = 64
#: Sides at and below which tiles are multiplied row by column.
LEAST_SIDE = 16
EMPTY, NO_ID = -(1 << 62), (1 << 63) - 1
LONGEST = 1 << 50
TILE = "tile long, rows binary, ids binary, labels binary, vectors binary, side int, width int"
HEAPS = "a long, c long, scores binary, ids binary"


def strassen(a: np.ndarray, b: np.ndarray, least: int = LEAST_SIDE) -> np.ndarray:
    """a times b by seven products of quarters; odd sides get a row or column of zeros. Additions of 64-bit integers are exact."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= least:
        return a @ b
    if m % 2 or k % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
    if k % 2 or n % 2:
        b = np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2  # noqa: E741
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1 = strassen(a11 + a22, b11 + b22, least)
    p2 = strassen(a21 + a22, b11, least)
    p3 = strassen(a11, b12 - b22, least)
    p4 = strassen(a22, b21 - b11, least)
    p5 = strassen(a11 + a12, b22, least)
    p6 = strassen(a21 - a11, b11 + b12, least)
    p7 = strassen(a12 - a22, b21 + b22, least)
    out = np.empty((2 * i, 2 * l), np.int64)
    out[:i, :l] = p1 + p4 - p5 + p7
    out[:i, l:] = p3 + p5
    out[i:, :l] = p2 + p4
    out[i:, l:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def pack(table: pa.Table) -> pa.Table:
    """Rows of a tile as one row, by rising id, its vectors as the least integers that hold them."""
    ids = table["id"].combine_chunks().fill_null(NO_ID).to_numpy()
    order = np.argsort(ids, kind="stable")
    vectors = table["vector"].combine_chunks()
    wide = vectors.value_lengths().to_numpy()
    width = int(wide.max(initial=0))
    out = np.zeros((len(ids), width))
    out[np.repeat(np.arange(len(ids)), wide), np.arange(int(wide.sum())) - np.repeat(np.cumsum(wide) - wide, wide)] = np.floor(vectors.flatten().to_numpy())
    if ((out * out).sum(1) >= LONGEST).any():
        raise ValueError("a vector is too long for exact scores: its squared length, in 256ths, must be below 2 ** 50")
    kind = np.min_scalar_type(-int(np.abs(out).max(initial=0)) - 1)
    blobs = [x[order].tobytes() for x in (table["row"].to_numpy(), ids, table["label"].to_numpy(), out.astype(kind))]
    columns = [table["tile"][:1], *[pa.array([x], pa.binary()) for x in blobs], pa.array([kind.itemsize], pa.int32()), pa.array([width], pa.int32())]
    return pa.table(columns, names=["tile", "rows", "ids", "labels", "vectors", "side", "width"])


def unpack(tile: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, ids, labels and vectors of a tile."""
    rows, ids, labels = (np.frombuffer(tile[c], np.int64) for c in ("rows", "ids", "labels"))
    return rows, ids, labels, np.frombuffer(tile["vectors"], f"<i{tile['side']}").astype(np.int64).reshape(len(ids), tile["width"])


def scores(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two tiles, the narrower one filled with zeros."""
    width = max(a.shape[1], c.shape[1])
    a, c = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, c))
    return strassen(a, c.T)


def best(score: np.ndarray, fits: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row its best scores among those that fit, and their ids, which rise with the column: heaps of a length, sorted, with EMPTY behind."""
    n = score.shape[1]
    wide = 1 << n.bit_length()
    key = np.where(fits, score * wide + (wide - 1 - np.arange(n)), EMPTY)
    kept = min(most, n)
    if kept < n:
        at = np.argpartition(key, n - kept, axis=1)[:, n - kept :]
        key = np.take_along_axis(key, at, 1)
    key = -np.sort(-key, axis=1)
    found = key > EMPTY
    out, who = np.full((len(score), most), EMPTY), np.full((len(score), most), NO_ID)
    out[:, :kept] = np.where(found, key >> n.bit_length(), EMPTY)
    if n:
        who[:, :kept] = np.where(found, ids[np.where(found, wide - 1 - (key & (wide - 1)), 0)], NO_ID)
    return out, who


def blobs(a: int, c: int, score: np.ndarray, who: np.ndarray) -> pa.Table:
    return pa.table({"a": pa.array([a], pa.int64()), "c": pa.array([c], pa.int64()), "scores": pa.array([score.tobytes()], pa.binary()), "ids": pa.array([who.tobytes()], pa.binary())})


def heaps_of(row: dict, most: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(row[c], np.int64).reshape(-1, most) for c in ("scores", "ids"))


def merge(heaps: DataFrame, blocks: int, most: int) -> DataFrame:
    """One block of heaps for each anchor tile."""

    def merged(table: pa.Table) -> pa.Table:
        held = [heaps_of(r, most) for r in table.to_pylist()]
        score, who = (np.concatenate(x, axis=1) for x in zip(*held))
        order = np.lexsort((who, -score), axis=1)[:, :most]
        return blobs(table["a"][0].as_py(), table["c"][0].as_py() // MERGED, *(np.take_along_axis(x, order, 1) for x in (score, who)))

    while blocks > 1:
        heaps = heaps.groupBy("a", F.floor(F.col("c") / MERGED).alias("part")).applyInArrow(merged, HEAPS)
        blocks = -(-blocks // MERGED)
    return heaps


def positives_of(pair: tuple[dict, dict], most: int) -> tuple[np.ndarray, np.ndarray]:
    """The best other rows of each anchor's label."""
    (rows, _, labels, vectors), (others, ids, theirs, candidates) = map(unpack, pair)
    fits = (labels[:, None] == theirs) & (rows[:, None] != others)
    return best(scores(vectors, candidates), fits, ids, most)


def windows_of(pair: tuple[dict, dict], positives: int, most: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor and positive, in a row of its own, the best rows of other labels whose scores lie within so many hundredths of the positive's."""
    (_, _, labels, vectors), (_, ids, theirs, candidates) = map(unpack, pair)
    score, other = scores(vectors, candidates), labels[:, None] != theirs
    hundredfold = 100 * score
    goals = np.frombuffer(pair[0]["scores"], np.int64).reshape(-1, positives)
    out, who = np.full((len(labels), positives, most), EMPTY), np.full((len(labels), positives, most), NO_ID)
    for k in range(positives):
        goal = np.where(goals[:, k] > EMPTY, goals[:, k], 0)[:, None]
        fits = other & (goals[:, k] > EMPTY)[:, None] & (low * goal <= hundredfold) & (hundredfold <= high * goal)
        out[:, k], who[:, k] = best(score, fits, ids, most)
    return out.reshape(-1, most), who.reshape(-1, most)


def mine(vectors: DataFrame, identity: str = "vec_id", vector: str = "embedding", label: str = "label", anchor: Column | None = None, scale: int = 256, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = 80, high: int = 100, tiles: tuple[int, int] = (ANCHOR_ROWS, CANDIDATE_ROWS)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (all rows, unless a condition says which) and each of its best
    positives the best rows of other labels with low * positive <= 100 * negative <= high * positive. Components are floored after they are scaled."""
    sound = F.col(label).isNotNull() & F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(sound).select(
        F.col(identity).cast("long").alias("id"),
        F.col(label).cast("long").alias("label"),
        F.transform(vector, lambda x: x.cast("double") * scale).alias("vector"),
        F.coalesce(anchor if anchor is not None else F.lit(True), F.lit(False)).alias("anchor"),
    )
    rows = write_table(rows.withColumn("row", F.monotonically_increasing_id()), "vectors", "zstd")
    counted = rows.agg(F.count("*"), F.count_if("anchor")).first()
    n_a, n_c = (max(1, -(-n // most)) for n, most in zip(counted[::-1], tiles))

    def tiled(some: DataFrame, n: int) -> DataFrame:
        return some.withColumn("tile", F.pmod(F.xxhash64("row"), F.lit(n))).groupBy("tile").applyInArrow(pack, TILE)

    asked = write_table(tiled(rows.where("anchor"), n_a), "anchor-tiles", "zstd").withColumnRenamed("tile", "a")
    held = write_table(tiled(rows, n_c), "candidate-tiles", "zstd").withColumnRenamed("tile", "c")
    every = lambda tiles, name, n: tiles.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))

    def passed(asked: DataFrame, work) -> DataFrame:
        def meet(a: pa.Table, c: pa.Table) -> pa.Table:
            pair = a.to_pylist()[0], c.to_pylist()[0]
            return blobs(pair[0]["a"], pair[0]["c"], *work(pair))

        # anchor and candidate tiles without rows are in no pair
        both = every(asked, "c", n_c).join(held.select("c"), "c", "left_semi"), every(held, "a", n_a).join(asked.select("a"), "a", "left_semi")
        return both[0].groupBy("a", "c").cogroup(both[1].groupBy("a", "c")).applyInArrow(meet, HEAPS)

    found = write_table(merge(passed(asked, lambda pair: positives_of(pair, positives)), n_c, positives), "positives", "zstd")
    asked = asked.join(found.select("a", "scores", F.col("ids").alias("positives")), "a")
    windows = merge(passed(asked, lambda pair: windows_of(pair, positives, negatives, low, high)), n_c, negatives)

    def told(a: pa.Table, heaps: pa.Table) -> pa.Table:
        tile, heap = a.to_pylist()[0], heaps.to_pylist()[0]
        score, who = heaps_of(heap, negatives)
        at, rank = np.nonzero(score > EMPTY)
        goal, positive = (np.frombuffer(tile[c], np.int64)[at] for c in ("scores", "positives"))
        anchor = np.frombuffer(tile["ids"], np.int64)[at // positives]
        columns = {"anchor_id": anchor, "positive_id": positive, "negative_id": who[at, rank], "positive_score": goal, "negative_score": score[at, rank]}
        return pa.table({c: pa.array(x, pa.int64(), mask=x == NO_ID) for c, x in columns.items()} | {"rank": pa.array(rank + 1, pa.int32())}).select(["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return asked.groupBy("a").cogroup(windows.groupBy("a")).applyInArrow(told, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def op11_strassen_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows whose vec_id 100 divides, against all rows."""
    rows = read_table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), anchor=F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH held AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score FROM held a JOIN held c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5"""
