"""A prefix trie of rebuilt conversations, merged family first.

A family is a base conversation and those whose ids it stands for (``c - c % 5``, remainder with the sign of ``c``). Every
turn is digested before anything moves, so texts are never shuffled. The turns of a family meet in one task, in order;
it rebuilds each conversation from the base's first turns and its own, and walks them into the family's small trie, whose
nodes are named by the chain of digests above them. Only the combined nodes of families are shuffled then, and merged by
name. A task streams through its rows and holds the base's first eight digests and one family's trie; a trie that outgrows
``NODES`` is handed over in parts, which the merge adds up again. So a conversation of very many turns needs no memory.

Sums over subtrees need no walk level by level. The smallest member of a node stays the smallest along its own path, so the
nodes that a conversation stands for are a chain down to its end, and chains partition the trie. A node's subtree holds the
whole chains of its members but its own, of which it holds the part below: the sum over its members of their chains' totals,
less what lies above it in its own chain. Chains are summed in chunks of depth, with the chunks' totals carried.

Defined results: rows without ``conv_id`` are left out; null roles and texts are empty; turns of one number are taken in the
order of their digests; repeated rows are turns of their own; an empty table gives an empty result; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import discard, materialize, prepare

#: Conversations of a family, and the modulus of the number of turns taken from its base.
FAMILY, HEADS = 5, 9
#: Nodes of a family's trie that a task holds at most before it hands them over.
NODES = 50_000
#: Depths of a chain that are summed together.
CHUNK = 4096

ROOT = b"\0" * 16
_NONE = hashlib.sha256(b"").hexdigest()


def base_of(conv: Column | str) -> Column:
    conv = F.col(conv) if isinstance(conv, str) else conv
    return conv - conv % FAMILY


def _digested(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """One short row for each turn: base, conversation, turn, digest of role and text, and the text's bytes."""
    d = df.select(df[conv].cast("long").alias("conv"), df[turn].alias("turn"), F.coalesce(df[role].cast("string"), F.lit("")).alias("role"), F.coalesce(df[text].cast("string"), F.lit("")).alias("text")).where("conv is not null")
    digest = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")))
    return d.select(base_of("conv").alias("base"), "conv", "turn", digest.alias("digest"), F.octet_length("text").cast("long").alias("bytes"))


class _Family:
    """The trie of one family: ``name -> [parent, depth, bytes, members, ends]``."""

    def __init__(self, base: int):
        self.base = base
        self.first: list[tuple[bytes, int]] = []
        self.nodes: dict[bytes, list] = {}
        self.conv: int | None = None

    def begin(self, conv: int) -> None:
        self.conv, self.seen = conv, 0
        self.at = (ROOT, None, 0, 0)
        self.heads = zlib.crc32(str(conv).encode()) % HEADS
        self._node()[3].append(conv)
        if conv != self.base:
            for digest, size in self.first[: self.heads]:
                self._down(digest, size)

    def turn(self, digest: bytes, size: int) -> None:
        """The conversation's next own turn."""
        if self.conv == self.base:
            if len(self.first) < HEADS - 1:
                self.first.append((digest, size))
            self._down(digest, size)
        elif self.seen >= self.heads:
            self._down(digest, size)
        self.seen += 1

    def end(self) -> None:
        if self.conv is not None:
            self._node()[4].append(self.conv)

    def _node(self) -> list:
        name, parent, depth, size = self.at
        return self.nodes.setdefault(name, [parent, depth, size, [], []])

    def _down(self, digest: bytes, size: int) -> None:
        above = self.at[0]
        self.at = (hashlib.blake2b(above + digest, digest_size=16).digest(), above, self.at[2] + 1, size)
        self._node()[3].append(self.conv)

    def rows(self) -> Iterator[tuple]:
        for name, node in self.nodes.items():
            yield self.base, name, *node
        self.nodes.clear()


_NODES = "base long, name binary, parent binary, depth long, bytes long, members array<long>, ends array<long>"


def family_nodes(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", most: int = NODES) -> DataFrame:
    """The nodes of every family's trie: who passes (``members``) and who ends there (``ends``), a few ids each."""
    prepare(df.sparkSession)
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = [part.split()[0] for part in _NODES.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, out = None, []
        for b in batches:
            for base, c, digest, size in zip(*(b.column(n).to_pylist() for n in ("base", "conv", "digest", "bytes"))):
                if family is None or base != family.base:
                    if family is not None:
                        family.end()
                        out += family.rows()
                    family = _Family(base)
                if c != family.conv:
                    family.end()
                    family.begin(c)
                family.turn(digest, size)
                if len(family.nodes) > most:
                    out += family.rows()
                if len(out) > 2000:
                    yield batch(out)
                    out = []
        if family is not None:
            family.end()
            out += family.rows()
            yield batch(out)

    d = _digested(df, conv, turn, role, text)
    order = ["base", F.col("conv") != F.col("base"), "conv", F.asc_nulls_first("turn"), "digest"]
    return d.repartition("base").sortWithinPartitions(*order).select("base", "conv", "digest", "bytes").mapInArrow(run, _NODES)


def _above(nodes: DataFrame, value: Column) -> DataFrame:
    """Add ``above`` and ``nth``: sum of ``value`` and number of the nodes higher up in the same chain (``conv_id``)."""
    d = nodes.withColumns({"_v": value, "_chunk": F.floor(F.col("depth") / CHUNK)})
    inside = Window.partitionBy("conv_id", "_chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("conv_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row for each chunk
    zero = lambda c: F.coalesce(c, F.lit(0))
    chunks = d.groupBy("conv_id", "_chunk").agg(F.sum("_v").alias("_t"), F.count("*").alias("_n"))
    chunks = chunks.select("conv_id", "_chunk", zero(F.sum("_t").over(before)).alias("_ct"), zero(F.sum("_n").over(before)).alias("_cn"))
    d = d.withColumns({"above": zero(F.sum("_v").over(inside)), "nth": F.count("*").over(inside)})
    return d.join(chunks, ["conv_id", "_chunk"]).withColumns({"above": F.col("above") + F.col("_ct"), "nth": F.col("nth") + F.col("_cn")}).drop("_v", "_chunk", "_ct", "_cn")


def _end_hashes(family: DataFrame) -> DataFrame:
    """``name, ends_sha256`` of the nodes at which conversations end; ids stream through the hash in order."""
    ends = family.select("name", F.explode("ends").alias("conv"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, digest = None, None
        for b in batches:
            out = []
            for n, c in zip(b.column("name").to_pylist(), b.column("conv").to_pylist()):
                if n != name:
                    if name is not None:
                        out.append((name, digest.hexdigest()))
                    name, digest = n, hashlib.sha256(b"%d" % c)
                else:
                    digest.update(b",%d" % c)
            if out:
                yield pa.record_batch([pa.array([n for n, _ in out], pa.binary()), pa.array([h for _, h in out])], ["name", "ends_sha256"])
        if name is not None:
            yield pa.record_batch([pa.array([name], pa.binary()), pa.array([digest.hexdigest()])], ["name", "ends_sha256"])

    return ends.repartition("name").sortWithinPartitions("name", "conv").mapInArrow(run, "name binary, ends_sha256 string")


def prefix_trie(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", most: int = NODES) -> DataFrame:
    """One row for each node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    family = materialize(family_nodes(df, conv, turn, role, text, most))
    merged = materialize(
        family.groupBy("name").agg(
            F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.max("bytes").alias("bytes"), F.min(F.array_min("members")).alias("conv_id"), F.sum(F.size("members")).cast("long").alias("n_convs")
        )
    )
    children = merged.where("parent is not null").groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    nodes = merged.join(children, "name", "left").fillna(0, ["n_children"])
    nodes = materialize(_above(nodes, (F.col("n_convs") - 1) * F.col("bytes")))
    discard(merged)

    # What each conversation's chain holds as a whole, brought to the families' nodes by their members.
    chain = nodes.groupBy("conv_id").agg(F.sum((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"))
    by_base = chain.groupBy(base_of("conv_id").alias("base")).agg(F.map_from_entries(F.collect_list(F.struct("conv_id", F.struct("saved", "leaves")))).alias("_of"))  # a family's few
    total = lambda f: F.aggregate("members", F.lit(0).cast("long"), lambda s, m: s + F.coalesce(F.try_element_at(F.col("_of"), m)[f], F.lit(0)))
    passed = family.withColumn("_base", F.col("base")).join(by_base.withColumn("_base", F.col("base")), ["base", "_base"], "left")
    sums = passed.select("name", total("saved").alias("saved"), total("leaves").alias("leaves")).groupBy("name").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))

    # Below the first node of a chain the parent is in the same chain.
    tops = nodes.where("nth = 0 and parent is not null").select("name", "parent", F.col("parent").alias("_parent"))
    parents = tops.join(nodes.select(F.col("name").alias("parent"), F.col("name").alias("_parent"), F.col("conv_id").alias("parent_conv_id")), ["parent", "_parent"]).select("name", "parent_conv_id")
    facts = sums.unionByName(parents, True).unionByName(_end_hashes(family), True).groupBy("name").agg(*(F.max(c).alias(c) for c in ("saved", "leaves", "parent_conv_id", "ends_sha256")))
    return nodes.join(facts, "name").select(
        "conv_id", "depth", F.when(F.col("parent").isNull(), F.lit(None).cast("long")).when(F.col("nth") > 0, F.col("conv_id")).otherwise(F.col("parent_conv_id")).alias("parent_conv_id"),
        "n_convs", "n_children", F.col("leaves").alias("n_leaves"), (F.col("saved") - F.col("above")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_NONE)).alias("ends_sha256"),
    )


#: The same rows by definition: every rebuilt conversation's prefixes, and every node's ancestors.
ORACLE = """WITH o AS (SELECT conv_id, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS dg, strlen(coalesce(text, '')) AS b, turn FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, dg, b, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, dg) AS k FROM o),
s AS (SELECT conv_id, conv_id - conv_id % 5 AS base, CAST(conv_id AS VARCHAR) AS s FROM (SELECT DISTINCT conv_id FROM t)),
c AS (SELECT conv_id, base, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, len(s) + 1), lambda i: [CAST(ascii(substr(s, i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384::BIGINT * (a & 1)) END), 4294967295::BIGINT) % 9 AS h FROM s),
n AS (SELECT c.*, (SELECT count(*) FROM t WHERE t.conv_id = c.base AND t.k <= c.h) AS nb FROM c),
p AS (SELECT n.conv_id, t.k AS d, dg, b FROM n JOIN t ON t.conv_id = n.base AND t.k <= h UNION ALL SELECT n.conv_id, nb + k - h, dg, b FROM n JOIN t ON t.conv_id = n.conv_id AND k > h),
q AS (SELECT conv_id, d, b, string_agg(dg, '') OVER w AS name, coalesce(string_agg(dg, '') OVER (PARTITION BY conv_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS up, count(*) OVER (PARTITION BY conv_id) AS len FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT conv_id, 0, 0, '', NULL, (SELECT count(*) FROM p WHERE p.conv_id = c.conv_id) FROM c),
v AS (SELECT name, any_value(up) AS up, any_value(d) AS d, any_value(b) AS b, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = len), '') AS ends FROM q GROUP BY name),
ch AS (SELECT up AS name, count(*) AS n FROM v WHERE up IS NOT NULL GROUP BY up),
sub AS (SELECT a.name, sum((v.n_convs - 1) * v.b) AS saved, count(*) FILTER (v.name NOT IN (SELECT name FROM ch)) AS leaves FROM v JOIN q a ON a.conv_id = v.conv_id AND a.d <= v.d GROUP BY a.name)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, v.n_convs, coalesce(ch.n, 0) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(v.ends) AS ends_sha256
FROM v JOIN sub USING (name) LEFT JOIN ch USING (name) LEFT JOIN v u ON u.name = v.up"""
