"""A Merkle manifest of a dataset: a content-addressed graph of digests, and proofs by descent from its root.

Leaves are digests of rows. Within each group (here: language) they ascend by id and every two consecutive nodes become the digest of both, until one is
left, the group's root; the groups' roots become the root in the same way. climb() builds the tree 2 ** bits leaves at a time and stores what it makes as
records digest -> children, bundled by the node that stands above them. descend() answers leaf requests: from the root, the digits of a rank choose a
child at each level, the children not chosen are the path, and nodes that many requests pass are visited once for all of them. Paths run from the root
down and are reversed when a digest is folded.

Ranks come from a range partitioning and counts per group and partition, so no task sees a whole group; bundles and requests meet in groups of 2 ** bits.

Defined cases: null columns are written as -, a null group is the first one, the empty text is a value of no bytes, null ids come first, rows with equal
ids are ordered by their digests (whole repeats have equal digests, so their order does not matter), an empty table has no rows and no root; texts of any
length are hashed by Spark; extra columns, whatever their names, are dropped.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read_table, write_table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of the tree that one task builds or descends at a time: 1,024 leaves, some 200 KB of records.
BITS = 10
RECORD = "array<struct<digest:string,children:array<string>>>"


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf_digest(columns: Sequence[str] | dict[str, Column]) -> Column:
    """The digest of a row's columns, each written as its length in bytes and its value."""
    columns = columns if isinstance(columns, dict) else {c: F.col(c) for c in columns}
    written = [c.cast("string") for c in columns.values()]
    return F.sha2(F.concat(*[F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in written]), 256)


def ranked(nodes: DataFrame, *order: str) -> DataFrame:
    """nodes (group, ...) with rank (from 0, within the group by the order) and n, the group's nodes. Each partition counts its own groups."""
    placed = nodes.repartitionByRange("group", *order).sortWithinPartitions("group", *order).withColumn("at", F.monotonically_increasing_id())
    placed = write_table(placed, "ordered", "zstd").withColumn("part", F.shiftright("at", 33))
    held = placed.groupBy("group", "part").agg(F.min("at").alias("first"), F.count("*").alias("held"))
    group = Window.partitionBy("group")
    before = F.coalesce(F.sum("held").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = held.select("group", "part", (before - F.col("first")).alias("shift"), F.sum("held").over(group).alias("n"))
    return placed.join(offsets, ["group", "part"]).withColumn("rank", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def levels(n: int, stage: int, bits: int) -> int:
    """Levels that a group of n leaves has in a stage."""
    here = -(-n // (1 << bits * stage))
    return min(bits, (here - 1).bit_length())


def bundle(stage: int, bits: int, kinds: pa.Schema):
    """Build what stands above 2 ** bits neighbours."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        n, line, records = table["n"][0].as_py(), table["digest"].to_pylist(), []
        for _ in range(levels(n, stage, bits)):
            runs = [line[i : i + 2] for i in range(0, len(line), 2)]
            line = [digest(*run) for run in runs]
            records += [{"digest": d, "children": run} for d, run in zip(line, runs)]
        top = {"group": table["group"][0].as_py(), "n": n, "rank": table["rank"][0].as_py() >> bits, "digest": line[0], "records": records}
        return pa.Table.from_pylist([top], kinds)

    return build


def climb(nodes: DataFrame, bits: int = BITS) -> tuple[DataFrame, DataFrame, int]:
    """From nodes (group, n, rank, digest): the tops (group, n, digest), the store (digest, records) and the number of stages."""
    schema = f"group string, n long, rank long, digest string, records {RECORD}"
    kinds = pa.schema([("group", pa.string()), ("n", pa.int64()), ("rank", pa.int64()), ("digest", pa.string()), ("records", pa.list_(pa.struct([("digest", pa.string()), ("children", pa.list_(pa.string()))])))])
    most = nodes.agg(F.max("n")).first()[0] or 0
    nodes, stores, stage = nodes.select("group", "n", "rank", "digest"), [], 0
    while stage == 0 or most > 1:
        made = write_table(nodes.groupBy("group", F.shiftright("rank", bits).alias("page")).applyInArrow(bundle(stage, bits, kinds), schema), "merkle", "zstd")
        stores.append(made.where(F.size("records") > 0).select("digest", "records"))
        nodes = made.select("group", "n", "rank", "digest")
        stage, most = stage + 1, -(-most // (1 << bits))
    store = stores[0]
    for more in stores[1:]:
        store = store.unionByName(more)
    return nodes.select("group", "n", "digest"), store, stage


def chosen(stage: int, bits: int):
    """Let the requests below one node go down its bundle."""

    def choose(wanted: pa.Table, node: pa.Table) -> pa.Table:
        n, at, path, records = (node[c][0].as_py() for c in ("n", "digest", "path", "records"))
        start = node["start"].take(pa.array([0] * len(wanted)))
        children = {r["digest"]: r["children"] for r in records or []}
        depth = levels(n, stage, bits)
        reached, paths = [], []
        for rank in wanted["rank"].to_pylist():
            here, passed = at, []
            for level in reversed(range(depth)):
                odd = rank >> level & 1
                both = children[here]
                here = both[odd]
                passed.append(both[1 - odd] if len(both) == 2 else "")
            reached.append(here)
            paths.append(path + passed)
        wanted = wanted.drop_columns(["page"])
        return wanted.append_column("n", pa.array([n] * len(reached), pa.int64())).append_column("digest", pa.array(reached, pa.string())).append_column("path", pa.array(paths, pa.list_(pa.string()))).append_column("start", start)

    return choose


def descend(tops: DataFrame, requests: DataFrame, store: DataFrame, stages: int, bits: int = BITS) -> DataFrame:
    """requests (group, rank, and columns of their own) with digest, the node that they reach, and path: the siblings from the root down, empty where a
    node has none. tops (group, n, digest, path, start) is where they start; start is told to all that come by. Requests that share a node descend to it as one."""
    tops = tops.join(requests.select("group").distinct(), "group", "left_semi").select("group", "n", F.lit(0).cast("long").alias("page"), "digest", "path", "start")
    for stage in reversed(range(stages)):
        page = F.shiftright("rank", bits)
        asked = requests if stage == 0 else requests.select("group", F.shiftright("rank", bits * stage).alias("rank")).distinct()
        asked = asked.withColumn("page", page)
        opened = tops.join(store, "digest", "left").select("group", "page", "n", "digest", "path", "start", "records")
        kept = ", ".join(f"`{n}` {k}" for n, k in asked.dtypes if n != "page")
        tops = asked.groupBy("group", "page").cogroup(opened.groupBy("group", "page")).applyInArrow(chosen(stage, bits), f"{kept}, n long, digest string, path array<string>, start {dict(tops.dtypes)['start']}")
        if stage:
            tops = tops.withColumnRenamed("rank", "page")
    return tops


@dataclass
class Manifest:
    """leaves: group, rank, n, digest and the columns kept. groups: group, n, digest (its root), path (from the root to it) and start, which tells root,
    subroot, place (the group's rank) and above (the levels above it)."""

    leaves: DataFrame
    groups: DataFrame
    store: DataFrame
    stages: int
    bits: int

    def proofs(self, requests: DataFrame) -> DataFrame:
        """requests (group, rank, ...) with the digest reached, path from the root down and start."""
        return descend(self.groups, requests, self.store, self.stages, self.bits)


def build(leaves: DataFrame, *order: str, bits: int = BITS) -> Manifest:
    """The manifest of leaves (group, digest, and columns to keep), ordered within their groups. group is a string without nulls."""
    leaves = ranked(leaves, *order)
    subroots, store, stages = climb(leaves, bits)
    # the groups themselves are the leaves of the upper tree
    upper = ranked(subroots.select(F.lit("").alias("group"), F.col("group").alias("name"), F.col("n").alias("leaves"), "digest"), "name")
    roots, upper_store, upper_stages = climb(upper, bits)
    store = store.unionByName(upper_store)
    # equal nodes have equal records: content addresses are kept once
    store = write_table(store.groupBy("digest").agg(F.any_value("records").alias("records")), "merkle-store", "zstd")
    top = roots.select("group", "n", "digest", F.expr("CAST(array() AS array<string>)").alias("path"), F.struct(F.col("digest").alias("root")).alias("start"))
    placed = descend(top, upper.select("group", "rank", "name", "leaves"), store, upper_stages, bits)
    start = F.struct("start.root", F.col("digest").alias("subroot"), F.col("rank").alias("place"), F.size("path").alias("above"))
    groups = placed.select(F.col("name").alias("group"), F.col("leaves").alias("n"), "digest", "path", start.alias("start"))
    return Manifest(leaves, write_table(groups, "merkle-groups"), store, stages, bits)


def group_key(c: Column) -> Column:
    """A text that sorts as the column does, nulls first."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def fold(leaf: str, path: list[str], turns: int) -> str:
    """The root that a leaf and its siblings, from the leaf up, lead to; the bits of turns say where the node stands among the two."""
    for sibling in path:
        leaf = digest(sibling, leaf) if turns & 1 else digest(leaf, sibling)
        turns >>= 1
    return leaf


def verify(proved: DataFrame, leaf: str) -> DataFrame:
    """proved (rows of proofs(), with a column that holds the leaf to be checked) with subroot, root, proof_sha256, folded_root and verified."""
    told = proved.select("*", "start.subroot", "start.root", "start.place", "start.above")
    kept = [c for c in told.columns if c not in ("path", "start", "place", "above")]
    kinds = dict(told.dtypes)

    def check(batches):
        for batch in batches:
            proofs, roots = [], []
            for node, path, rank, place, above in zip(*(batch.column(c).to_pylist() for c in (leaf, "path", "rank", "place", "above"))):
                path.reverse()
                proofs.append(digest(*path))
                inside = len(path) - above
                roots.append(fold(node, path, rank | place << inside))
            columns = [*[batch.column(c) for c in kept], pa.array(proofs, pa.string()), pa.array(roots, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "proof_sha256", "folded_root"])

    checked = told.drop("start").mapInArrow(check, ", ".join([*[f"`{c}` {kinds[c]}" for c in kept], "proof_sha256 string", "folded_root string"]))
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document; where 7 divides the CRC-32 of its id, the leaf that is folded
    is that of a document with one more n_chars."""
    docs = read_table(spark, sf_dir, "documents")
    more = {c: F.col(c) for c in FIELDS} | {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    leaves = docs.select("doc_id", group_key(F.col("lang")).alias("group"), leaf_digest(FIELDS).alias("digest"), F.when(tampered, leaf_digest(more)).alias("altered"))
    manifest = build(write_table(leaves, "leaves", "zstd"), "doc_id", "digest")
    asked = manifest.leaves.select("group", "rank", "doc_id", F.col("digest").alias("leaf"), F.coalesce("altered", "digest").alias("shown"))
    checked = verify(manifest.proofs(asked), "shown")
    return checked.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


#: A digit of a decimal number is one byte; CRC-32 goes bit by bit.
CRC_SQL = "xor(list_reduce(list_prepend(4294967295::BIGINT, [ord(c)::BIGINT FOR c IN string_split(doc_id::VARCHAR, '')]), lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"
LEAF_SQL = lambda n: "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", n, "text")) + ")"
#: Nodes climb level by level; sub are the trees of the languages, top the tree over their roots.
OP13_SQL = f"""
WITH RECURSIVE leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {LEAF_SQL('n_chars')} AS leaf, CASE WHEN {CRC_SQL} % 7 = 0 THEN {LEAF_SQL('(n_chars + 1)')} ELSE {LEAF_SQL('n_chars')} END AS shown FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaves),
sub(level, g, pos, n, d) AS (SELECT 0, g, pos, n, leaf FROM placed
  UNION ALL SELECT any_value(level) + 1, g, pos // 2, any_value(n + 1) // 2, sha256(string_agg(d, '' ORDER BY pos)) FROM sub WHERE n > 1 GROUP BY g, pos // 2),
subroots AS (SELECT g, d, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM sub WHERE n = 1),
top(level, pos, n, d) AS (SELECT 0, pos, n, d FROM subroots
  UNION ALL SELECT any_value(level) + 1, pos // 2, any_value(n + 1) // 2, sha256(string_agg(d, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY pos // 2),
steps AS (SELECT g, level, pos, d FROM sub WHERE n > 1 UNION ALL
  SELECT g, depth + level, t.pos, t.d FROM top t, (SELECT g, max(level) AS depth FROM sub GROUP BY g) WHERE t.n > 1),
places AS (SELECT p.g, p.doc_id, p.pos AS first, p.leaf, p.shown, depth, s.pos AS place, s.d AS subroot, (SELECT d FROM top WHERE n = 1) AS root
  FROM placed p JOIN (SELECT g, max(level) AS depth FROM sub GROUP BY g) USING (g) JOIN subroots s USING (g)),
walk(g, first, level, pos, depth, place, node, path) AS (SELECT g, first, 0, CASE depth WHEN 0 THEN place ELSE first END, depth, place, shown, '' FROM places
  UNION ALL SELECT w.g, w.first, w.level + 1, CASE WHEN w.level + 1 = w.depth THEN w.place ELSE w.pos // 2 END, w.depth, w.place,
    sha256(CASE WHEN w.pos % 2 = 1 THEN coalesce(o.d, '') || w.node ELSE w.node || coalesce(o.d, '') END), w.path || coalesce(o.d, '')
  FROM walk w JOIN steps s ON s.g = w.g AND s.level = w.level AND s.pos = w.pos LEFT JOIN steps o ON o.g = w.g AND o.level = w.level AND o.pos = xor(w.pos, 1)),
ends AS (SELECT g, first, node, path FROM walk QUALIFY level = max(level) OVER (PARTITION BY g, first))
SELECT doc_id, leaf, subroot, root, sha256(path) AS proof_sha256, node AS folded_root, node = root AS verified FROM places JOIN ends USING (g, first)"""
