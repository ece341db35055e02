"""SimHash fingerprints, their links by deletion variants, and near-duplicate removal.

A 64-bit fingerprint is cut into two halves of 32 bits: of two bits that differ, one half holds at most one. Each half is
indexed under its 32 one-wildcard variants (that bit cleared and named), an equality join on these brings every pair
within two bits together, and the whole fingerprints verify it. Distinct fingerprints are indexed once, whatever the
number of documents that have them. A task verifies the members of a variant, MOST_MEMBERS of them at most. The members of a
fuller one are dealt on by the same rule: the half that its key says nothing about is cut in two again, and its
one-wildcard variants make the key longer. When no bits are left, a key has 128 members at most.

near_duplicates() serves five-word shingles at a Jaccard similarity of 0.8. There whole fingerprints differ in some 10 of
64 bits, too many for selective segments, so it also takes part fingerprints: shingles are dealt to parts by their hash,
and a part's fingerprint is the SimHash of its least few shingles. Equal part fingerprints or whole fingerprints within two
bits propose pairs, and the Jaccard similarity of the whole shingle sets decides. The least SKETCH hashes of two sets only
discard pairs whose estimate is by SKETCH_SLACK below the wanted similarity. Parts that more than SMALL_PART documents share are
first linked through a few members; the documents of those that are not in one component by then go to an exact prefix join.
Texts and sketches move for the documents that take part in pairs only: these are marked in bitmaps, which are broadcast, and the
others stay where they are.

Defined cases: a null or empty text has fingerprint 0, as any text without words; a null id takes part but never names a
component unless its whole component has none; repeated rows each get a row; extra columns are dropped by
fingerprint_components() and kept by drop_near_duplicates(); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import clear_name, read_table, slices, text_or_empty, write_table
from .components import components

SEED = 42
#: Members of a variant that one task verifies; those of fuller ones get longer keys.
MOST_MEMBERS = 2048
PARTS, LEAST = 24, 4
#: Least hashes of a shingle set that go with every document. Sets up to that size are whole in it; for larger ones its estimate, with a standard
#: error of 0.025 at 0.8, discards pairs that lie SKETCH_SLACK (8 errors, a chance of some 1e-12) below.
SKETCH, SKETCH_SLACK = 256, 0.2
#: Members of a part up to which all its pairs are proposed.
SMALL_PART = 40
#: Members of a crowded part that are compared with their neighbours in one window.
RING = 512
#: Members of a prefix shingle that are listed together.
LISTED = 256
#: Bits of the bitmaps that ids are marked in: so many for each row of ids, and at most 16 MB in all. Beyond that more rows move than need be.
MARK_BITS, MOST_MARKS = 64, 1 << 27
BLOCK_BYTES = 8 << 20


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each run of words, or of all words where there are fewer."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(found))
    one = xxhash.xxh64_intdigest
    return np.fromiter((one(joined[i:j], SEED) for i, j in zip(starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist())), np.uint64, len(found) - k + 1)


def simhash(hashes: np.ndarray) -> int:
    """Each bit that over half of the hashes have, as a signed long."""
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        votes += np.unpackbits(hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, identity: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """id, fp (a signed long) of each row."""
    rows = docs.select(F.col(identity).alias("id"), text_or_empty(text).cast("binary").alias("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [simhash(shingle_hashes(t.as_py(), words)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], names=["id", "fp"])

    return rows.mapInArrow(make, f"id {dict(rows.dtypes)['id']}, fp long")


def one_wildcard_variants(members: DataFrame) -> DataFrame:
    """members has fp, key (so far) and which bits the key says nothing about: `width` from `shift` on. These are cut into halves; one row for each
    bit that may differ in one of them, with the key made longer by the rest of that half and the other half still to say."""
    freed = members.withColumn("v", F.explode(F.expr("sequence(0, width - 1)"))).withColumns({"half": F.expr("CAST(width / 2 AS INT)")})
    placed = freed.withColumns({"low": F.expr("shift + IF(v < half, 0, half)"), "bit": F.expr("v % half")})
    known = F.expr("shiftrightunsigned(fp, low) & (shiftleft(1L, half) - 1) & ~shiftleft(1L, bit)")
    return placed.select("fp", F.xxhash64("key", "low", "half", "bit", known).alias("key"), F.expr("shift + IF(v < half, half, 0)").alias("shift"), F.col("half").alias("width"))


def members_of_shared(keyed: DataFrame, key: str, *carried: str) -> DataFrame:
    """key, n and the carried columns of the keys that more than one row has. Keys are counted before rows move, and the join may split a hot one."""
    sized = keyed.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    # sizes of exploded rows are estimated too low for Spark to choose the join
    return write_table(keyed.join(sized.hint("merge"), key).select(key, "n", *carried), "members")


def pairs_within(members: DataFrame, key: str, member: str, most: int) -> DataFrame:
    """Pairs a < b of the members of each key that has at most so many."""
    listed = members.where(F.col("n") <= most).groupBy(key).agg(F.collect_list(member).alias("all"))
    return listed.select("all", F.explode("all").alias("a")).select("a", F.explode("all").alias("b")).where("a < b")


def links_within(members: DataFrame) -> DataFrame:
    """a, b: the fingerprints of each key that differ in at most two bits."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            size, flat = np.asarray(lists.value_lengths(), np.int64), np.asarray(lists.flatten(), np.int64).view(np.uint64)
            begin = np.cumsum(size) - size
            for n in np.unique(size).tolist():
                own = flat[begin[size == n][:, None] + np.arange(n)]
                for rows in np.array_split(own, max(1, own.size // 65_536)):
                    for i in range(n - 1):
                        row, k = np.nonzero(np.bitwise_count(rows[:, i, None] ^ rows[:, i + 1 :]) <= 2)
                        x, y = rows[row, i].view(np.int64), rows[row, i + 1 + k].view(np.int64)
                        if len(x):
                            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return members.groupBy("key").agg(F.collect_list("fp").alias("all")).select("all").mapInArrow(verify, "a long, b long").where("a != b")


def close_links(prints: DataFrame, most: int = MOST_MEMBERS) -> DataFrame:
    """Links a, b between distinct fingerprints (column fp) that join all that differ in at most two bits."""
    level, found = prints.select("fp", F.lit(0).cast("long").alias("key"), F.lit(0).alias("shift"), F.lit(64).alias("width")), None
    while True:
        members = members_of_shared(one_wildcard_variants(level), "key", "fp", "shift", "width")
        # of width 1 no more is to be said; such keys are small
        small = (F.col("n") <= most) | (F.col("width") == 1)
        links = links_within(members.where(small))
        found = links if found is None else found.unionByName(links)
        level = members.where(~small).drop("n")
        if level.isEmpty():
            return found.distinct()


def fingerprint_components(docs: DataFrame, identity: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """identity, fingerprint, component_id of each row: the least identity that links of at most two bits reach."""
    prints = write_table(fingerprints(docs, identity, text, words), "fingerprints")
    distinct = write_table(prints.groupBy("fp").agg(F.min("id").alias("first")), "distinct-fingerprints")
    roots = components(close_links(distinct.select("fp"))).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp").select(F.col("id").alias(identity), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    return fingerprint_components(read_table(spark, sf_dir, "documents"))


def resemblance(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets of hashes."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / (len(x) + len(y) - common) if len(x) or len(y) else 1.0


def estimate(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity by the least SKETCH hashes of the union of two sets, from the least SKETCH of each."""
    union = np.union1d(x, y)[:SKETCH]
    return len(np.intersect1d(np.intersect1d(x, y, assume_unique=True), union, assume_unique=True)) / max(len(union), 1)


def marked(rows: DataFrame, column: str, ids: DataFrame, how: str = "left_semi", most: int = MOST_MARKS) -> DataFrame:
    """The rows whose column may be among ids (of one column, a written table), with all that are; with left_anti the others, none of which is. No row moves."""
    bits = min(most, 1 << (MARK_BITS * max(ids.count(), 512) - 1).bit_length())
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1
    mark, marks = (clear_name(rows, c) for c in ("_mark", "_marks"))
    maps = ids.select(slot(F.col(ids.columns[0])).alias("s")).groupBy(F.bitmap_bucket_number("s").alias(mark)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias(marks))
    own, place = slot(F.col(column)), F.bitmap_bit_position(slot(F.col(column)))
    byte = F.conv(F.hex(F.substring(F.col(marks), (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.join(F.broadcast(maps), (F.bitmap_bucket_number(own) == F.col(mark)) & (F.getbit(byte, (place % 8).cast("int")) == 1), how)


def ends_of(pairs: DataFrame) -> DataFrame:
    """id of both sides of each pair."""
    return pairs.select(F.explode(F.array("a", "b")).alias("id"))


def verified_pairs(pairs: DataFrame, sketches: DataFrame, rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs a, b (a written table) whose whole shingle sets reach the similarity. sketches has id, size, shingles; rows has id, text."""
    kind = dict(pairs.dtypes)["a"]
    sketches = marked(sketches, "id", ends_of(pairs))
    faced = pairs.join(sketches.toDF("a", "m", "left").hint("merge"), "a").join(sketches.toDF("b", "n", "right").hint("merge"), "b").where(F.least("m", "n") >= F.greatest("m", "n") * similarity - 1e-9)

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, whole = [], []
            for m, n, x, y in zip(*(batch.column(c) for c in ("m", "n", "left", "right"))):
                x, y = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                whole.append(max(m.as_py(), n.as_py()) <= SKETCH)
                keep.append(resemblance(x, y) >= similarity if whole[-1] else estimate(x, y) >= similarity - SKETCH_SLACK)
            kept = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(whole, pa.bool_())], names=["a", "b", "whole"])
            yield kept.filter(pa.array(keep, pa.bool_()))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, BLOCK_BYTES):
                sets = [np.unique(shingle_hashes(t.as_py(), words)).astype("<u8").tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["id", "set"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [resemblance(np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")) >= similarity for x, y in zip(batch.column("left"), batch.column("right"))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    screened = write_table(faced.select("a", "b", "m", "n", "left", "right").mapInArrow(screen, f"a {kind}, b {kind}, whole boolean"), "screened")
    # larger sets are made again from the texts, for the documents of the remaining pairs only
    large = screened.where("NOT whole").select("a", "b")
    sets = write_table(marked(rows, "id", ends_of(large)).mapInArrow(hashed, f"id {kind}, set binary"), "whole-sets")
    compared = large.join(sets.toDF("a", "left").hint("merge"), "a").join(sets.toDF("b", "right").hint("merge"), "b")
    decided = compared.select("a", "b", "left", "right").mapInArrow(decide, f"a {kind}, b {kind}")
    return write_table(screened.where("whole").select("a", "b").unionByName(decided).distinct(), "verified")


def prefix_pairs(rooted: DataFrame, rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """a, b: all pairs of the documents in rooted (id, root) that have different roots and may reach the similarity, by prefix and position
    filters: two such sets share one of the first shingles of each, rarest first, with enough shingles after it in both."""
    kind = dict(rooted.dtypes)["id"]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, BLOCK_BYTES):
                sets = [np.unique(shingle_hashes(t.as_py(), words)).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in sets], pa.int32()), pa.array(sets, pa.list_(pa.int64()))], names=["id", "size", "tokens"])

    crowd = marked(rows, "id", rooted.select("id")).join(rooted, "id", "left_semi")
    made = write_table(crowd.mapInArrow(hashed, f"id {kind}, size int, tokens array<long>"), "crowded-sets", "zstd")
    tokens = made.dropDuplicates(["id"]).select("id", "size", F.explode("tokens").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("df"))
    order = Window.partitionBy("id").orderBy("df", "token")
    ranked = tokens.join(often.hint("merge"), "token").withColumn("pos", F.row_number().over(order) - 1)
    prefix = ranked.where((F.col("df") > 1) & (F.col("pos") <= F.col("size") - F.ceil(F.col("size") * similarity - 1e-6)))
    keyed = write_table(prefix.join(rooted, "id").select("token", "root", "id", "size", (F.col("size") - F.col("pos")).alias("rest")), "prefixes")
    mixed = keyed.groupBy("token").agg(F.count("*").alias("n"), F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("token", "n")
    dealt = keyed.join(mixed.hint("merge"), "token").withColumn("list", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / LISTED)))
    lists = dealt.groupBy("token", "root", "list").agg(F.collect_list(F.struct("id", "size", "rest")).alias("all"), F.min("size").alias("least"), F.max("size").alias("most"), F.max("rest").alias("rest")).drop("list")
    lists = write_table(lists, "prefix-lists")
    share = similarity / (1 + similarity)
    may = lambda rest, size, least, most: (rest >= share * size - 1e-6) & (least <= most / similarity + 1e-6)
    x, y = lists.alias("x"), lists.alias("y")
    bound = may(F.least("x.rest", "y.rest"), F.col("x.least") + F.col("y.least"), F.greatest("x.least", "y.least"), F.least("x.most", "y.most"))
    faced = x.join(y.hint("merge"), (F.col("x.token") == F.col("y.token")) & (F.col("x.root") < F.col("y.root")) & bound)
    each = faced.select(F.explode("x.all").alias("a"), F.col("y.all").alias("all")).select("a", F.explode("all").alias("b"))
    close = may(F.least("a.rest", "b.rest"), F.col("a.size") + F.col("b.size"), F.greatest("a.size", "b.size"), F.least("a.size", "b.size"))
    return each.where(close).select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, identity: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """id, component for each distinct identity: the least identity that verified links reach."""
    rows = docs.select(F.col(identity).alias("id"), text_or_empty(text).cast("binary").alias("text"))
    kind = dict(rows.dtypes)["id"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, BLOCK_BYTES):
                whole, size, shingles, digest, parts = [], [], [], [], []
                for t in part.column(1):
                    distinct = np.unique(shingle_hashes(t.as_py(), words))
                    whole.append(simhash(distinct))
                    size.append(len(distinct))
                    shingles.append(distinct[:SKETCH].astype("<u8").tobytes())
                    digest.append(xxhash.xxh128_digest(distinct.astype("<u8").tobytes()))
                    at = (distinct % np.uint64(PARTS)).astype(np.int64)
                    parts.append([xxhash.xxh64_intdigest(own[:LEAST].tobytes(), p) - 2**63 for p in range(PARTS) if len(own := distinct[at == p])])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(whole, pa.int64()), pa.array(size, pa.int32()), pa.array(shingles, pa.binary()), pa.array(digest, pa.binary()), pa.array(parts, pa.list_(pa.int64()))], names=["id", "fp", "size", "shingles", "digest", "parts"])

    made = write_table(rows.mapInArrow(make, f"id {kind}, fp long, size int, shingles binary, digest binary, parts array<long>"), "shingles", "zstd")
    alike = write_table(made.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")), "alike")
    firsts = alike.where("first IS NOT NULL").select(F.col("first").alias("id"), "digest")
    one = write_table(made.select("id", "digest", "fp", "size", "parts").join(firsts, ["id", "digest"], "left_semi").dropDuplicates(["id"]), "one-of-alike", "zstd")
    # the same part fingerprint
    members = members_of_shared(one.select(F.struct("id", "size").alias("id"), F.explode("parts").alias("key")), "key", "id")
    sized = pairs_within(members, "key", "id", SMALL_PART).where(F.least("a.size", "b.size") >= F.greatest("a.size", "b.size") * similarity - 1e-9)
    often = sized.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    # crowded parts: each member with the first and, in hashed order within a salt, with the next ones
    crowded = members.where(F.col("n") > SMALL_PART).select("key", "n", F.col("id.id").alias("id"))
    many = write_table(crowded.join(crowded.groupBy("key").agg(F.min("id").alias("least")).hint("merge"), "key"), "crowded-parts")
    ring = Window.partitionBy("key", "salt").orderBy(F.xxhash64("id", "key"))
    salted = many.withColumn("salt", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / RING)))
    stars = many.select(F.col("least").alias("a"), F.col("id").alias("b"))
    nexts = salted.withColumns({"x": F.lead("id", 1).over(ring), "y": F.lead("id", 2).over(ring)})
    rings = nexts.select(F.col("id").alias("a"), F.explode(F.array("x", "y")).alias("b")).where("b IS NOT NULL")
    # whole fingerprints within two bits, and the same
    prints = one.groupBy("fp").agg(F.min("id").alias("first"))
    same = one.join(prints, "fp").select(F.col("first").alias("a"), F.col("id").alias("b"))
    first = prints.withColumnRenamed("fp", "p")
    linked = close_links(prints.select("fp"))
    bits = linked.join(first.select(F.col("p").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("p").alias("b"), F.col("first").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    pairs = often.unionByName(stars).unionByName(rings).unionByName(same).unionByName(bits).where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sketches = made.select("id", "size", "shingles")
    verified = verified_pairs(write_table(pairs, "pairs"), sketches, rows, words, similarity)
    # a copy may only be close to the document that the others were copied from: try the best linked one of a crowded part
    degree = verified.select("a").unionByName(verified.select(F.col("b").alias("a"))).groupBy("a").agg(F.count("*").alias("degree"))
    hubs = many.join(degree.withColumnRenamed("a", "id"), "id").groupBy("key").agg(F.max_by("id", F.struct("degree", "id")).alias("hub"))
    again = many.join(hubs, "key").where("id != hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct().join(verified, ["a", "b"], "left_anti")
    more = verified_pairs(write_table(again, "more-pairs"), sketches, rows, words, similarity)
    roots = components(verified.unionByName(more).select(F.col("a").cast("long"), F.col("b").cast("long")))
    # crowded parts whose members are not in one component: all pairs across components
    placed = many.select("key", "id").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", F.col("id").cast("long")))
    split = placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("key")
    rooted = write_table(placed.join(split, "key", "left_semi").select("id", "root").distinct(), "crowded")
    if not rooted.isEmpty():
        rest = write_table(prefix_pairs(rooted, rows, words, similarity), "prefix-pairs")
        last = verified_pairs(rest, sketches, rows, words, similarity)
        if not last.isEmpty():
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(last.select(F.col("a").cast("long"), F.col("b").cast("long"))))
    firsts = alike.join(roots.toDF("first", "root"), "first", "left").select("digest", F.coalesce("root", "first").alias("component"))
    return made.select("id", "digest").join(firsts, "digest").select("id", "component")


def drop_near_duplicates(docs: DataFrame, identity: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without the rows that are near copies of a row with a smaller identity; of repeated identities one row stays, rows with none stay."""
    found = write_table(near_duplicates(docs, identity, text, words, similarity), "components")
    gone, c = clear_name(docs, "_gone"), F.col(identity)
    dropped = write_table(found.where("id != component").select(F.col("id").alias(gone)).distinct(), "dropped")
    # most rows stay and are told by the marks
    kept = marked(docs, identity, dropped, "left_anti").unionByName(marked(docs, identity, dropped).join(dropped, c == F.col(gone), "left_anti"))
    if found.where("id IS NOT NULL").groupBy("id").count().where("count > 1").isEmpty():
        return kept
    return kept.where(c.isNull()).unionByName(kept.where(c.isNotNull()).dropDuplicates([identity]))
