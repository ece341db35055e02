"""Whether blocks of tiles and times fill their hull exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .running import ordinals, running_total


def cover_faults(blocks: DataFrame, tile: str = "tile", low: str = "low", high: str = "high", tiles: DataFrame | None = None) -> DataFrame:
    """tile, low, high, n of the spans of the hull (from the first low to the last high of all blocks) that a tile's blocks (half-open) cover n times: 0 is a hole, 2 or more an
    overlap. tiles lists those that must be there. A sweep over the ends of blocks, not over what lies between them: each end adds or takes one, and as every tile's ends add up to nothing,
    one running sum by ranges serves all tiles, however many blocks one of them has. Blocks with a null, or without a length, are left out."""
    sound = blocks.where(F.col(tile).isNotNull() & (F.col(low) < F.col(high))).select(F.col(tile).alias("tile"), F.col(low).alias("low"), F.col(high).alias("high"))
    hull = sound.agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low IS NOT NULL")
    known = sound.select("tile").distinct()
    known = known.unionByName(tiles.select(F.col(tile).cast(dict(known.dtypes)["tile"]).alias("tile"))).distinct() if tiles is not None else known
    # the hull is one row
    whole = known.crossJoin(F.broadcast(hull))
    ends = [rows.select("tile", F.col(c).alias("at"), F.lit(v).cast("long").alias("change")) for rows, c, v in ((sound, "low", 1), (sound, "high", -1), (whole, "low", 0), (whole, "high", 0))]
    changes = ends[0].unionByName(ends[1]).unionByName(ends[2]).unionByName(ends[3]).groupBy("tile", "at").agg(F.sum("change").alias("change"))
    placed = ordinals(running_total(changes, ["tile", "at"], F.col("change"), "before"), ["tile", "at"], "k")
    spans = placed.select("tile", F.col("at").alias("low"), (F.col("before") + F.col("change")).alias("n"), F.col("k") + 1)
    spans = spans.toDF("tile", "low", "n", "next").join(placed.select(F.col("tile").alias("_tile"), F.col("at").alias("high"), F.col("k").alias("next")), "next").where(F.col("tile") == F.col("_tile"))
    return spans.where("n <> 1").select("tile", "low", "high", "n")
