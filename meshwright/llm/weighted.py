"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A text's terms are its words with their frequencies as weights. For each of SAMPLES samples every term draws r and c from
Gamma(2, 1) and b from (0, 1) by hashes of the term and the sample, so every text draws alike. With t = floor(ln w / r + b) and
ln a = ln c - r (t - b) - r the term of least a is the sample, with its t. Two texts share a sample with the probability
of their generalised Jaccard similarity, the sum of least weights over the sum of greatest ones. The fingerprint holds 16
hashed bits of (term, t) for each sample.

Texts are dealt once by identity; the frequency count, the samples and the signature all follow that partitioning. Each
document's terms are its own, so no key is hot. Successors in ascending order come from a range-partitioned table of identities:
a window inside each range and the least identity of the next range, so no task sees all documents.

Defined cases: a null or empty text has no terms and the fingerprint of zeros (alike with 1 to another such text, with 0 to any
other); rows that repeat an identity and a text are one document in the order and each get its result; other rows of one
identity are ordered by a hash of their text; a null identity sorts first; extra columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read_table, text_or_empty, write_table

SAMPLES = 64
#: Hex digits of each sample in the fingerprint.
DIGITS = 4
#: Cells of the tables that invert the distributions of r and ln c, and the steps within a cell, as powers of two.
CELLS, STEPS = 12, 20


def uniform(bits: Column, shift: int) -> Column:
    """A number within (0, 1) from 32 of the bits."""
    return (F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit(0xFFFFFFFF)) + F.lit(0.5)) * F.lit(2.0**-32)


def gamma_quantiles(p: np.ndarray) -> np.ndarray:
    """Gamma(2, 1) at the shares p, by bisection of its distribution."""
    low, high = np.zeros(len(p)), np.full(len(p), 64.0)
    for _ in range(80):
        middle = (low + high) / 2
        under = 1 - (1 + middle) * np.exp(-middle) < p
        low, high = np.where(under, middle, low), np.where(under, high, middle)
    return high


def constant(table: np.ndarray) -> Column:
    """A table as one literal, which the optimizer folds into an array. An array of literals would put thousands of expressions into each plan."""
    return F.split(F.lit(",".join(map(repr, table.tolist()))), ",").cast("array<double>")


def gamma_draw(bits: Column, shift: int, log: bool = False) -> Column:
    """Gamma(2, 1), or its logarithm, at CELLS + STEPS of the bits: straight lines between the quantiles of the cells' bounds. The first and the
    last cell, where these would cut the tails, have tables of as many cells of their own."""
    cells, form = 1 << CELLS, np.log if log else np.asarray
    bounds = form(gamma_quantiles(np.arange(1, cells) / cells))
    inner, slope = np.r_[0.0, bounds[:-1], 0.0], np.r_[0.0, np.diff(bounds), 0.0]
    fine = (np.arange(cells) + 0.5) / cells**2
    first, last = form(gamma_quantiles(fine)), form(gamma_quantiles(1 - 1 / cells + fine))
    cell = F.shiftrightunsigned(bits, shift + STEPS).bitwiseAND(F.lit(cells - 1)).cast("int")
    step = F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << STEPS) - 1)).cast("int")
    part = F.shiftright(step, STEPS - CELLS)
    line = F.get(constant(inner), cell) + F.get(constant(slope), cell) * ((step + F.lit(0.5)) * F.lit(2.0**-STEPS))
    return F.when(cell == 0, F.get(constant(first), part)).when(cell == cells - 1, F.get(constant(last), part)).otherwise(line)


def with_draws(terms: DataFrame, term: str, sample: str) -> DataFrame:
    """terms with the draws r and log_c and 64 more hashed bits of each term and sample, once for all weights and so that the plan holds the tables once."""
    bits = F.xxhash64(term, sample)
    return terms.withColumns({"r": gamma_draw(bits, 32), "log_c": gamma_draw(bits, 0, log=True), "more": F.xxhash64(sample, term)})


def packed_sample(log_weight: Column) -> Column:
    """ln a in order-preserving bits above, 32 bits of (term, t) below: the least of these is the sample. Null for no weight."""
    r, log_c, more = F.col("r"), F.col("log_c"), F.col("more")
    t = F.floor(log_weight / r + uniform(more, 32))
    # ln a is well within 2^6 of 0 for weights below 2^31; 24 bits of fraction stay
    order = ((log_c - r * (t - uniform(more, 32) + F.lit(1.0))) * F.lit(float(1 << 24))).cast("bigint")
    return F.shiftleft(order, 32).bitwiseOR(more.bitwiseXOR(F.shiftleft(t, 7)).bitwiseAND(F.lit(0xFFFFFFFF)))


def signatures(texts: DataFrame, keys: list[str], columns: list[str], samples: int = SAMPLES) -> DataFrame:
    """keys and a signature for each of the text columns (null where a text has no terms). The draws for a term serve all of them. texts is best
    partitioned by some of the keys."""
    sides = F.array(*columns)
    words = texts.select(*keys, F.posexplode(sides).alias("side", "one")).select(*keys, "side", F.explode(F.split(F.lower("one"), r"\s+")).alias("word")).where("word != ''")
    terms = words.groupBy(*keys, F.xxhash64("word").alias("term")).agg(*[F.sum(F.when(F.col("side") == i, 1).otherwise(0)).alias(f"w{i}") for i in range(len(columns))])
    logged = terms.select(*keys, "term", *[F.when(F.col(f"w{i}") > 0, F.ln(F.col(f"w{i}").cast("double"))).alias(f"l{i}") for i in range(len(columns))])
    # one row per term and sample keeps the generated code small enough to be compiled to machine code
    spread = logged.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    least = with_draws(spread, "term", "sample").groupBy(*keys, "sample").agg(*[F.min(packed_sample(F.col(f"l{i}"))).alias(f"s{i}") for i in range(len(columns))])
    listed = least.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("sample", *[f"s{i}" for i in range(len(columns))]))).alias("all"))
    digits = lambda i: F.array_join(F.transform("all", lambda x: F.lpad(F.lower(F.hex(x[f"s{i}"].bitwiseAND(F.lit(16**DIGITS - 1)))), DIGITS, "0")), "")
    return listed.select(*keys, *[F.nullif(digits(i), F.lit("")).alias(f"signature{i}") for i in range(len(columns))])


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of the samples that two fingerprints have in common."""
    same = [F.when(F.substring(a, DIGITS * s + 1, DIGITS) == F.substring(b, DIGITS * s + 1, DIGITS), 1).otherwise(0) for s in range(samples)]
    nothing = F.lit("0" * DIGITS * samples)
    return F.when(a == b, 1.0).when((a == nothing) | (b == nothing), 0.0).otherwise(sum(same[1:], same[0]) / float(samples))


def successors(ids: DataFrame) -> DataFrame:
    """ids has k, z (unique) and others; adds next_k, next_z in ascending order of k, z, the first after the last. ids is written to the shared folder."""
    ranged = write_table(ids.repartitionByRange("k", "z").withColumn("range", F.spark_partition_id()), "ordered")
    inside = Window.partitionBy("range").orderBy("k", "z")
    within = ranged.withColumns({"next_k": F.lead("k").over(inside), "next_z": F.lead("z").over(inside)})
    # one row per range: as many as the session has shuffle partitions
    heads = ranged.groupBy("range").agg(F.min(F.struct("k", "z")).alias("head"))
    over = Window.orderBy("range")
    first = F.first("head").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    follow = heads.select("range", F.coalesce(F.lead("head").over(over), first).alias("follow"))
    last = within.join(F.broadcast(follow), "range")
    return last.withColumns({"next_z": F.when(F.col("next_k").isNull(), F.col("follow.z")).otherwise(F.col("next_z")), "next_k": F.coalesce("next_k", "follow.k")}).drop("range", "follow")


def edited_fingerprints(docs: DataFrame, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """identity, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row."""
    # k puts null identities first
    keyed = docs.select(F.coalesce(F.col(identity).cast("bigint"), F.lit(-(2**63))).alias("k"), F.xxhash64(text_or_empty(text)).alias("z"), text_or_empty(text).alias("text"))
    told = docs.select(F.col(identity).alias("id"), F.coalesce(F.col(identity).cast("bigint"), F.lit(-(2**63))).alias("k"), F.xxhash64(text_or_empty(text)).alias("z"), F.length(text_or_empty(text)).cast("bigint").alias("n_chars"))
    ids = told.groupBy("k", "z").agg(F.first("id").alias("id"), F.first("n_chars").alias("n_chars"), F.count("*").alias("copies"))
    order = write_table(successors(ids), "successors")
    if not order.where("copies > 1").isEmpty():
        keyed = keyed.dropDuplicates(["k", "z"])
    quarter = F.floor(F.col("n_chars") / 4)
    wanted = order.select(F.col("next_k").alias("k"), F.col("next_z").alias("z"), F.col("k").alias("to_k"), F.col("z").alias("to_z"), quarter.alias("take"))
    heads = keyed.join(wanted, ["k", "z"]).select(F.col("to_k").alias("k"), F.col("to_z").alias("z"), F.expr("substring(text, 1, CAST(take AS INT))").alias("head"))
    own = keyed.join(order.select("k", "z", "n_chars"), ["k", "z"]).join(heads, ["k", "z"])
    both = own.select("k", "z", "text", F.concat(F.expr("substring(text, 1, CAST(n_chars - floor(n_chars / 4) AS INT))"), F.col("head")).alias("edited"))
    sides = signatures(both, ["k", "z"], ["text", "edited"]).withColumnsRenamed({"signature0": "fingerprint", "signature1": "edited_fingerprint"})
    digests = both.select("k", "z", F.sha2("edited", 256).alias("edited_sha256"))
    nothing = F.lit("0" * DIGITS * SAMPLES)
    facts = digests.join(sides, ["k", "z"], "left").select("k", "z", "edited_sha256", F.coalesce("fingerprint", nothing).alias("fingerprint"), F.coalesce("edited_fingerprint", nothing).alias("edited_fingerprint"))
    facts = write_table(facts, "weighted-fingerprints", "zstd")
    after = facts.select(F.col("k").alias("next_k"), F.col("z").alias("next_z"), F.col("fingerprint").alias("next_fingerprint"))
    told = order.join(facts, ["k", "z"]).join(after, ["next_k", "next_z"])
    result = told.select(
        F.col("id").alias(identity),
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        F.sequence(F.lit(1), F.col("copies").cast("int")).alias("rows"),
    )
    return result.withColumn("rows", F.explode("rows")).drop("rows")


def op6_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    return edited_fingerprints(read_table(spark, sf_dir, "documents"))
