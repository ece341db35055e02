"""Mixing sources to target weights by Poisson replication.

Each source s has a mean repetition rate r_s = w_s * budget / n_s, where w_s are the target weights (they sum to 1),
n_s its documents and budget the documents wanted in all. A document's count is the inverse of the Poisson
distribution with mean r_s at a uniform number that is hashed from (seed, document), so a rerun or a lost executor
draws the same counts. Each copy gets a hashed shuffle key, and a range partitioning on it orders the corpus at random
without one task seeing all rows.

Defined cases: a null source is a source of its own, null texts are kept, repeated rows draw alike, a null id draws from its
text, an empty table gives no rows, a source without a stated weight gets none, extra columns are carried along, and
clashing names are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import clear_name, read_table, write_table

#: Bytes of the distributions up to which they are broadcast; more are joined by a salted shuffle.
MOST_BROADCAST = 32 << 20
SALTS = 64
SEED = "mix-1"
#: Sources are drawn in proportion to documents ** ALPHA where no weights are stated.
ALPHA = 0.5


def uniform(*parts: Column) -> Column:
    """52 bits of MD5 as a number in (0, 1)."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def log_factorial(k: Column) -> Column:
    """ln(k!): of the factorial itself up to 20, else by Stirling's series, whose next term is below the precision of a double there."""
    x = F.greatest(k, F.lit(1)).cast("double")
    series = (x + 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3))) + 1 / (1260 * F.pow(x, F.lit(5))) - 1 / (1680 * F.pow(x, F.lit(7)))
    return F.when(k <= 20, F.ln(F.factorial(F.least(k, F.lit(20))).cast("double"))).otherwise(series)


def rates(docs: DataFrame, source: str, weights: dict[str | None, float] | None, epochs: float, alpha: float) -> DataFrame:
    """One row per source: key, no_source, rate, first, cdf (the distribution at first, first + 1, ... up to where it is 1 in double precision; below
    first it is 0 in that precision, so a source has as many entries as the root of its rate asks for). The corpus is read once."""
    counted = docs.groupBy(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("key"), F.col(source).isNull().alias("no_source")).agg(F.count("*").alias("n"))
    counted = write_table(counted, "source-counts")
    if weights is None:
        weighed = counted.withColumn("weight", F.pow(F.col("n"), F.lit(alpha)))
    else:
        stated = docs.sparkSession.createDataFrame([(k or "", k is None, float(v)) for k, v in weights.items()], "key string, no_source boolean, weight double")
        weighed = counted.join(F.broadcast(stated), ["key", "no_source"])
    all_weight = weighed.agg(F.sum("weight")).first()[0] or 1.0
    all_n = counted.agg(F.sum("n")).first()[0] or 0
    rated = weighed.select("key", "no_source", (F.col("weight") / F.lit(float(all_weight)) * F.lit(float(all_n)) * F.lit(float(epochs)) / F.col("n")).alias("rate"))
    spread = 12 * F.sqrt("rate") + 24
    bounded = rated.withColumn("first", F.greatest(F.floor(F.col("rate") - spread), F.lit(0)).cast("int"))
    steps = bounded.select("*", F.explode(F.sequence("first", F.ceil(F.col("rate") + spread).cast("int"))).alias("k"))
    pmf = F.when(F.col("rate") > 0, F.exp(F.col("k") * F.ln("rate") - F.col("rate") - log_factorial(F.col("k")))).otherwise((F.col("k") == 0).cast("double"))
    running = F.sum("p").over(Window.partitionBy("key", "no_source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    summed = steps.withColumn("p", pmf).withColumn("c", running)
    listed = summed.groupBy("key", "no_source", "rate", "first").agg(F.array_sort(F.collect_list("c")).alias("cdf"))
    return write_table(listed, "source-rates")


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, epochs: float = 1.0, source: str = "source", identity: str = "doc_id", text: str = "text", alpha: float = ALPHA, seed: str = SEED, names: tuple[str, str, str] | None = None) -> DataFrame:
    """docs with each row repeated by its Poisson count, in shuffled order, with the columns copy (from 1), shuffle_key and rate."""
    copy, order, rate = names or [clear_name(docs, c) for c in ("copy", "shuffle_key", "rate")]
    key, none, salt, first, cdf = (clear_name(docs, c) for c in ("_key", "_none", "_salt", "_first", "_cdf"))
    by = rates(docs, source, weights, epochs, alpha).toDF(key, none, rate, first, cdf)
    who = F.coalesce(F.col(identity).cast("string"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    keyed = docs.withColumns({key: F.coalesce(F.col(source).cast("string"), F.lit("")), none: F.col(source).isNull()})
    held = by.agg(F.sum(8 * F.size(cdf) + F.octet_length(key) + 64)).first()[0] or 0
    if held <= MOST_BROADCAST:
        joined = keyed.join(F.broadcast(by), [key, none])
    else:
        salted = by.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn(salt, F.pmod(F.xxhash64(who), F.lit(SALTS)).cast("int")).join(salted, [key, none, salt]).drop(salt)
    drawn = uniform(F.lit(seed), who)
    count = F.col(first) + F.size(F.filter(cdf, lambda c: c <= drawn))
    copies = joined.withColumn(copy, F.explode(F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))))
    keys = copies.withColumn(order, F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), who, F.col(copy).cast("string"))), 1, 15), 16, 10).cast("bigint"))
    return keys.drop(key, none, first, cdf).repartitionByRange(order, F.col(identity), F.col(copy)).sortWithinPartitions(order, identity, copy)


def op8_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each copy of each document in its mixed order: doc_id, source, copy, shuffle_key, rate (9 places), text_md5."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mix_sources(docs)
    return mixed.select("doc_id", "source", "copy", "shuffle_key", F.round("rate", 9).alias("rate"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_md5"))


OP8_SQL = f"""
WITH counted AS (SELECT coalesce(source, '') AS k, source IS NULL AS no_source, count(*) AS n FROM documents GROUP BY 1, 2),
rated AS (SELECT k, no_source, pow(n, {ALPHA}) / sum(pow(n, {ALPHA})) OVER () * sum(n) OVER () / n AS rate FROM counted),
steps AS (SELECT k, no_source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 24)::BIGINT + 1)) AS j FROM rated),
cdf AS (SELECT k, no_source, rate, j, sum(exp(j * ln(rate) - rate - lgamma(j + 1))) OVER (PARTITION BY k, no_source ORDER BY j) AS c FROM steps),
drawn AS (SELECT doc_id, source, text, (('0x' || substr(md5(concat_ws('|', '{SEED}', coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))))), 1, 13))::BIGINT::DOUBLE + 0.5) / {2**52}.0 AS u FROM documents),
counts AS (SELECT d.doc_id, d.source, any_value(d.text) AS text, any_value(c.rate) AS rate, count(*) FILTER (WHERE c.c <= d.u) AS n
  FROM drawn d JOIN cdf c ON coalesce(d.source, '') = c.k AND (d.source IS NULL) = c.no_source GROUP BY d.doc_id, d.source),
copies AS (SELECT *, unnest(range(1, n + 1))::INT AS copy FROM counts)
SELECT doc_id, source, copy, ('0x' || substr(md5(concat_ws('|', '{SEED}', 'order', doc_id::VARCHAR, copy::VARCHAR)), 1, 15))::BIGINT AS shuffle_key, round(rate, 9) AS rate, md5(coalesce(text, '')) AS text_md5
FROM copies
"""
