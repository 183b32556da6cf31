"""A trie of conversations by their first turns, built family by family.

A family is the conversations of one base id (``c - c % FAMILY``).  Turns are cut to 16 bytes of a digest where they are read, so texts are not shuffled; a family's
turns come together, the base conversation's first, and are walked in order: the base's first turns are kept, each member is rebuilt on them, and the family's own trie
is summed.  Only the combined nodes of families go on to be merged.  A node is named by the digest of its turns, chained from the root, so a family's walk holds a path's end and
the family's nodes, of which full tables go out early.

Sums over subtrees need no walk over levels.  Each node belongs to its smallest member, so every conversation owns one run at the end of its path, or nothing.  A node's
subtree holds what its members own, less what its owner owns above it: one sum over paths, again family by family, less one running sum along each run.

The ids of conversations that end at a node are listed by family.  Families are ranges of ids, so a node's lists follow one another and are digested as they come.

Defined cases: rows without ``conv_id`` belong to no conversation; null roles and texts are empty; rows of one conversation and turn stand in the order of their content's digest, and
repeated rows are turns of their own; ``%`` keeps the sign, as in SQL; a turnless conversation belongs to the root alone; a conversation with a member's turns all equal to
another's ends at the same node; other columns are ignored; an empty table has no node, not even a root.  One conversation's turns are chained in one task, in constant memory.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueframe.llm.common import BROADCAST_IDS, materialize, release

FAMILY, HEADS = 100, 6
#: The digest of the root.
ROOT = bytes(16)
#: Nodes that a family's table holds before they go out, and digests in one piece of a path.
NODES, PIECE = 50_000, 4096
#: Parents of so many children are broadcast, as long as they are few; their children need no shuffle to one key.
MANY_CHILDREN = 1000

NODE, ENDS, PATH = 0, 1, 2
WALK = "kind int, base long, conv_id long, depth long, digest binary, parent binary, chars long, n long, ids string, path binary"
_WALK = pa.schema([("kind", pa.int32()), ("base", pa.int64()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("digest", pa.binary()), ("parent", pa.binary()), ("chars", pa.int64()), ("n", pa.int64()), ("ids", pa.string()), ("path", pa.binary())])


def turns(conversations: DataFrame) -> DataFrame:
    """``base, conv_id, turn, item, chars``: each turn as 16 bytes that stand for its role and text, and its length in code points."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    item = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32))
    conv = F.col("conv_id").cast("long")
    rows = conversations.where(conv.isNotNull())
    return rows.select((conv - conv % FAMILY).alias("base"), conv.alias("conv_id"), F.col("turn").cast("long").alias("turn"), item.alias("item"), F.length(text).cast("long").alias("chars"))


def heads(conv: int) -> int:
    """How many of the base's first turns a conversation takes over."""
    return zlib.crc32(str(conv).encode()) % HEADS


class _Out:
    """Rows of one schema, handed on in batches."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema, self.rows = schema, []

    def ready(self, least: int = 20_000) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            columns = zip(*self.rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)
            self.rows = []


class _Family:
    """The trie of the family that is being walked."""

    def __init__(self, out: _Out, base: int) -> None:
        self.out, self.base = out, base
        self.head: list[tuple[bytes, int]] = []
        self.nodes: dict[bytes, list] = {}
        self.ends: dict[bytes, list[int]] = {}

    def open(self, conv: int) -> None:
        """A member begins: the root, and of the base's first turns as many as it takes."""
        self.conv, self.seen, self.skip = conv, 0, 0 if conv == self.base else heads(conv)
        self.at, self.depth, self.path, self.first = ROOT, 0, [], 1
        self._count(ROOT, b"", 0, 0)
        for digest, chars in self.head[: self.skip]:
            self._step(digest, chars)

    def turn(self, item: bytes, chars: int) -> None:
        self.seen += 1
        if self.seen > self.skip:
            digest = hashlib.blake2b(self.at + item, digest_size=16).digest()
            if self.conv == self.base and self.seen < HEADS:
                self.head.append((digest, chars))
            self._step(digest, chars)

    def close(self) -> None:
        self._path()
        self.ends.setdefault(self.at, []).append(self.conv)

    def end(self) -> None:
        self._nodes()
        for digest, convs in self.ends.items():
            convs.sort()
            self.out.rows.append((ENDS, self.base, convs[0], None, digest, None, None, None, ",".join(map(str, convs)), None))

    def _step(self, digest: bytes, chars: int) -> None:
        self.depth += 1
        self._count(digest, self.at, self.depth, chars)
        self.at = digest
        self.path.append(digest)
        if len(self.path) == PIECE:
            self._path()

    def _path(self) -> None:
        if self.path or self.first == 1:
            self.out.rows.append((PATH, self.base, self.conv, self.first, None, None, None, None, None, b"".join(self.path)))
            self.first, self.path = self.depth + 1, []

    def _count(self, digest: bytes, parent: bytes, depth: int, chars: int) -> None:
        node = self.nodes.get(digest)
        if node is None:
            if len(self.nodes) >= NODES:
                self._nodes()
            self.nodes[digest] = [self.conv, depth, parent, chars, 1]
        else:
            node[0] = min(node[0], self.conv)
            node[4] += 1

    def _nodes(self) -> None:
        self.out.rows += [(NODE, self.base, conv, depth, digest, parent, chars, n, None, None) for digest, (conv, depth, parent, chars, n) in self.nodes.items()]
        self.nodes = {}


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns -> each family's nodes, its lists of ends and its members' paths."""
    out, family = _Out(_WALK), None
    for batch in batches:
        for base, conv, item, chars in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if family is None or base != family.base:
                if family is not None:
                    family.close()
                    family.end()
                family = _Family(out, base)
                family.open(conv)
            elif conv != family.conv:
                family.close()
                family.open(conv)
            family.turn(item, chars)
            yield from out.ready()
    if family is not None:
        family.close()
        family.end()
    yield from out.ready(1)
    release()


def families(conversations: DataFrame) -> DataFrame:
    """Combined nodes, ends and paths of each family (``WALK``); the base conversation comes first, then its family by id."""
    rows = turns(conversations).repartition("base").sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", F.col("turn").asc_nulls_first(), "item")
    return rows.select("base", "conv_id", "item", "chars").mapInArrow(_walk, WALK)


def merged(walked: DataFrame) -> DataFrame:
    """``digest, parent, depth, chars, n_convs, conv_id, n_children`` of the nodes of all families."""
    nodes = walked.where(F.col("kind") == NODE).groupBy("digest").agg(
        F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("chars").alias("chars"), F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id")
    )
    children = nodes.where(F.col("depth") > 0).groupBy(F.col("parent").alias("digest")).agg(F.count(F.lit(1)).alias("n_children"))
    return nodes.join(children, "digest", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))


SUMS = "digest binary, n_leaves long, saved_tokens long"
_SUMS = pa.schema([("digest", pa.binary()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64())])


def _sum_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's total, then its path -> what the members of a node own, summed in the family."""
    out, table, now, conv, total = _Out(_SUMS), {}, None, None, (0, 0)

    def flush() -> None:
        out.rows += [(digest, *sums) for digest, sums in table.items()]
        table.clear()

    for batch in batches:
        for base, of, depth, leaves, saved, path in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if base != now or len(table) >= NODES:
                flush()
                now = base
                yield from out.ready()
            if path is None:
                conv, total = of, (leaves, saved)
                continue
            if of != conv:
                continue
            for digest in ([ROOT] if depth == 1 else []) + [path[k : k + 16] for k in range(0, len(path), 16)]:
                sums = table.setdefault(digest, [0, 0])
                sums[0] += total[0]
                sums[1] += total[1]
    flush()
    yield from out.ready(1)
    release()


def owned_by_members(walked: DataFrame, nodes: DataFrame) -> DataFrame:
    """``digest, n_leaves, saved_tokens``: of all nodes that a member of the node owns."""
    total = nodes.groupBy("conv_id").agg(F.sum(_leaf()).alias("leaves"), F.sum(_saved()).alias("saved"))
    total = total.select((F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), "conv_id", F.lit(-1).cast("long").alias("depth"), "leaves", "saved", F.lit(None).cast("binary").alias("path"))
    none = F.lit(None).cast("long")
    paths = walked.where(F.col("kind") == PATH).select("base", "conv_id", "depth", none.alias("leaves"), none.alias("saved"), "path")
    rows = paths.unionAll(total).repartition("base").sortWithinPartitions("base", "conv_id", "depth")
    return rows.mapInArrow(_sum_paths, SUMS).groupBy("digest").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))


def _leaf():
    return (F.col("n_children") == 0).cast("long")


def _saved():
    return (F.col("n_convs") - 1) * F.col("chars")


def _digest_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("digest", pa.binary()), ("ends_sha256", pa.string())])
    out, now, listed = _Out(schema), None, None
    for batch in batches:
        for digest, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if digest != now:
                if now is not None:
                    out.rows.append((now, listed.hexdigest()))
                    yield from out.ready()
                now, listed = digest, hashlib.sha256(ids.encode())
            else:
                listed.update(b"," + ids.encode())
    if now is not None:
        out.rows.append((now, listed.hexdigest()))
    yield from out.ready(1)


def ends(walked: DataFrame) -> DataFrame:
    """``digest, ends_sha256`` of the nodes at which conversations end."""
    lists = walked.where(F.col("kind") == ENDS).select("digest", "conv_id", "ids").repartition("digest").sortWithinPartitions("digest", "conv_id")
    return lists.select("digest", "ids").mapInArrow(_digest_lists, "digest binary, ends_sha256 string")


def with_parents(nodes: DataFrame, every: DataFrame) -> DataFrame:
    """``nodes`` with the ``parent_conv_id`` of their parent among ``every``: parents of many children are broadcast if they are few, others meet their children by shuffle."""
    parents = every.where(F.col("n_children") > 0).select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    large = parents.where(F.col("n_children") >= MANY_CHILDREN).drop("n_children")
    if large.count() > BROADCAST_IDS:
        return nodes.join(parents.drop("n_children"), "parent", "left")
    rest = parents.where(F.col("n_children") < MANY_CHILDREN).select("parent", F.col("parent_conv_id").alias("c_other"))
    out = nodes.join(F.broadcast(large), "parent", "left")
    key = F.when(F.col("parent_conv_id").isNull(), F.col("parent")).otherwise(F.col("digest"))
    out = out.withColumn("c_key", key).join(rest.withColumnRenamed("parent", "c_key"), "c_key", "left")
    return out.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "c_other")).drop("c_key", "c_other")


def trie(conversations: DataFrame) -> DataFrame:
    """``digest, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of every node."""
    walked = materialize(families(conversations), "trie-families")
    nodes = materialize(merged(walked), "trie-nodes")
    above = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    rows = nodes.select(
        "digest", "parent", "conv_id", "depth", "n_convs", "n_children", F.coalesce(F.sum(_leaf()).over(above), zero).alias("c_leaves"), F.coalesce(F.sum(_saved()).over(above), zero).alias("c_saved")
    )
    rows = rows.join(owned_by_members(walked, nodes), "digest").join(ends(walked), "digest", "left")
    rows = with_parents(rows, nodes)
    return rows.select(
        "digest", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("n_leaves") - F.col("c_leaves")).alias("n_leaves"), (F.col("saved_tokens") - F.col("c_saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


#: h of a conversation: the CRC-32 of its decimal id, a byte and then a bit at a time, modulo HEADS.
_HEADS_SQL = """xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda s, x: list_reduce(list_concat([xor(s, x)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda b, y: xor(b >> 1, (b & 1) * 3988292384))), 4294967295) % 6"""

OP11_SQL = f"""
WITH own AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, c - c % 100 AS base, {_HEADS_SQL} AS h FROM (SELECT DISTINCT c FROM own)
), rebuilt AS (
  SELECT v.c, o.k, 0 AS side, o.role, o.text FROM convs v JOIN own o ON o.c = v.base AND o.k <= v.h
  UNION ALL
  SELECT v.c, o.k, 1 AS side, o.role, o.text FROM convs v JOIN own o ON o.c = v.c AND o.k > v.h
), numbered AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY side, k) AS depth, sha256(length(role) || ':' || role || text) AS item, length(text) AS chars FROM rebuilt
), paths AS (
  SELECT c, 0 AS depth, '' AS node, NULL AS parent, 0 AS chars FROM convs
  UNION ALL
  SELECT c, depth, sha256(string_agg(item, ',') OVER w) AS node, CASE WHEN depth = 1 THEN '' ELSE sha256(string_agg(item, ',') OVER (PARTITION BY c ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) END AS parent, chars
  FROM numbered WINDOW w AS (PARTITION BY c ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), nodes AS (
  SELECT node, depth, any_value(parent) AS parent, any_value(chars) AS chars, count(*) AS n_convs, min(c) AS conv_id FROM paths GROUP BY node, depth
), children AS (
  SELECT parent AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent
), known AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN children k USING (node)
), below AS (
  SELECT p.node, sum(CASE WHEN v.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((v.n_convs - 1) * v.chars) AS saved_tokens
  FROM known v JOIN paths p ON p.c = v.conv_id AND p.depth <= v.depth GROUP BY p.node
), last AS (
  SELECT c, max(depth) AS depth FROM paths GROUP BY c
), ended AS (
  SELECT p.node, sha256(string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c)) AS ends_sha256 FROM paths p JOIN last USING (c, depth) GROUP BY p.node
)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, CAST(v.n_convs AS BIGINT) AS n_convs, CAST(v.n_children AS BIGINT) AS n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves,
  CAST(b.saved_tokens AS BIGINT) AS saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM known v JOIN below b USING (node) LEFT JOIN ended e USING (node) LEFT JOIN nodes u ON u.node = v.parent
"""


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all ``conversations``."""
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("digest")
