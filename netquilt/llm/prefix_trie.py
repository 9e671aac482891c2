"""A trie of the turns that conversations begin with, rolled up in bands of depths.

A node is a distinct sequence of first turns. It is known by a hash of the
sequence, and named by the smallest conversation that begins with it and its
depth. Sums over subtrees are taken in three moves: every node adds its value
to its ancestors inside its band of ``BAND`` depths, no further; the nodes on
top of the bands, a trie of their own that is ``BAND`` times less deep, are
rolled up the same way; what a completed band top has goes to its ancestors in
the band above. So the rounds grow with the logarithm of the depth, and a node
gives at most ``BAND`` rows a round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Depths in a band.
BAND = 32
#: Turns of a conversation whose running hash is taken in one task.
SLICE = 1 << 16
#: Turns that a rebuilt conversation takes from the first of its five at most, and how many share a first.
HEAD, FIVE = 8, 5
#: Bytes of conversation ids handed on at once.
CHUNK = 1 << 20
NOTHING = hashlib.sha256(b"").hexdigest()


def ordered(conversations: DataFrame) -> DataFrame:
    """``c, n, a, b, bytes``: every turn's place in its conversation from 1, a hash of role and text in two numbers, bytes of the text.

    Turns are sorted over all conversations at once and cut into ranges, so a
    conversation of any length is numbered by many tasks. At most one
    conversation goes on from one range into the next.
    """
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("c"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("tie")
    )
    order = ["c", "turn", "role", "text", "tie"]  # nulls come first
    hashed = [F.xxhash64(F.lit(k), "role", "text").alias(name) for k, name in ((1, "a"), (2, "b"))]
    sized = F.octet_length("text").cast("long").alias("bytes")
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("c", *hashed, sized, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    placed = materialise(placed, "turns")
    ahead = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("c", "part").count().withColumn("before", F.sum("count").over(ahead)).where("before > 0").select("c", "part", "before")  # a row a range at most
    local = placed.withColumn("local", F.row_number().over(Window.partitionBy("c", "part").orderBy("at")))
    n = F.col("local") + F.coalesce("before", F.lit(0).cast("long"))
    return local.join(F.broadcast(before), ["c", "part"], "left").select("c", n.alias("n"), "a", "b", "bytes")


def as_they_are(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``c, d, a, b, bytes`` and ``c, length`` of the conversations themselves."""
    return turns.withColumnRenamed("n", "d"), turns.groupBy("c").agg(F.max("n").alias("length"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``c, d, a, b, bytes`` and ``c, length`` of conversations that share heads.

    Conversation c gets the first h turns of conversation c - c % 5 (all if it
    has fewer, none if there is none), then its own turns after its first h,
    where h is the CRC-32 of c's digits modulo 9.
    """
    turns = materialise(turns, "ordered")
    own = turns.groupBy("c").agg(F.max("n").alias("own"))
    first = own.where(F.col("c") % FIVE == 0).select(F.col("c").alias("first"), F.col("own").alias("there"))
    h = F.when(F.col("c") % FIVE == 0, 0).otherwise(F.crc32(F.col("c").cast("string")) % (HEAD + 1))
    convs = own.withColumn("first", F.col("c") - F.col("c") % FIVE).withColumn("h", h).join(first, "first", "left")
    taken = F.least("h", F.coalesce("there", F.lit(0).cast("long")))
    convs = materialise(convs.select("c", "first", "h", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")), "lengths")
    tails = turns.join(convs.select("c", "h", "taken"), "c").where("n > h").select("c", (F.col("n") - F.col("h") + F.col("taken")).alias("d"), "a", "b", "bytes")
    heads = turns.where((F.col("c") % FIVE == 0) & (F.col("n") <= HEAD)).withColumnRenamed("c", "first")
    heads = heads.join(convs.where("taken > 0").select("c", "first", "taken"), "first").where("n <= taken").select("c", F.col("n").alias("d"), "a", "b", "bytes")
    return tails.unionAll(heads), convs.select("c", "length")


def halves(value: Column) -> list[Column]:
    return [F.shiftrightunsigned(value, 32), value.bitwiseAND(F.lit(0xFFFFFFFF))]


KEY = ["k1", "k2", "k3", "k4"]


def keyed(path: DataFrame, deepest: int) -> DataFrame:
    """``c, d, k1.., bytes``: sums of hashes of each turn with its place, up to and with it, tell sequences apart.

    Long conversations are summed in slices of ``SLICE`` turns, and the totals
    of the slices before are added.
    """
    marks = [*halves(F.xxhash64("d", "a", "b")), *halves(F.xxhash64("d", "b", "a"))]
    rows = path.select("c", "d", "bytes", F.expr(f"(d - 1) div {SLICE}").alias("slice"), *(m.alias(k) for m, k in zip(marks, KEY, strict=True)))
    w = Window.partitionBy("c", "slice").orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.select("c", "d", "bytes", "slice", *(F.sum(k).over(w).alias(k) for k in KEY))
    if deepest > SLICE:
        ahead = Window.partitionBy("c").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        total = rows.join(rows.where("slice > 0").select("c").distinct(), "c", "left_semi").groupBy("c", "slice").agg(*(F.sum(k).alias(k) for k in KEY))
        before = total.select("c", "slice", *(F.sum(k).over(ahead).alias(f"b{k}") for k in KEY)).where("slice > 0")
        later = out.where("slice > 0").join(before, ["c", "slice"]).select("c", "d", "bytes", "slice", *((F.col(k) + F.col(f"b{k}")).alias(k) for k in KEY))
        out = out.where("slice = 0").unionAll(later)
    return out.drop("slice")


def owned(path: DataFrame, convs: DataFrame) -> DataFrame:
    """``c, d, owner, n_convs, bytes``: for every conversation and depth from 0, who names the node and how many begin with it."""
    shape = convs.agg(F.max("length"), F.min("c"), F.count("*")).first()
    deepest, smallest, many = (shape[0] or 0, shape[1], shape[2])
    steps = materialise(keyed(path, deepest), "steps")
    nodes = materialise(steps.groupBy("d", *KEY).agg(F.min("c").alias("owner"), F.count("*").alias("n_convs")), "nodes")
    found = steps.join(nodes.hint("merge"), ["d", *KEY]).select("c", "d", "owner", "n_convs", "bytes")
    root = convs.select("c", F.lit(0).cast("long").alias("d"), F.lit(smallest).cast("long").alias("owner"), F.lit(many).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("bytes"))
    return materialise(found.unionAll(root), "owned")


def lineages(path: DataFrame, unit: int) -> DataFrame:
    """``c, d, band, top, line``: each node at a multiple of ``unit`` with the owners above it in its band, its own last.

    A node on top of a band appears once in that band and once, as ``top``,
    below the band above.
    """
    rows = path.where(F.col("d") % unit == 0).select("c", "d", "owner", F.expr(f"d div {unit * BAND}").alias("band"), F.lit(False).alias("top"))
    tops = rows.where((F.col("d") % (unit * BAND) == 0) & (F.col("d") > 0)).withColumn("band", F.col("band") - 1).withColumn("top", F.lit(True))
    w = Window.partitionBy("c", "band").orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.unionAll(tops).withColumn("line", F.collect_list("owner").over(w)).where("owner = c").drop("owner")


def given(nodes: DataFrame, values: DataFrame, unit: int, sums: list[str]) -> DataFrame:
    """``c, d`` and the sums of what ``values`` of the nodes below give to each owner in the lines of ``nodes``."""
    rows = nodes.join(values, ["c", "d"]).select("band", F.posexplode("line").alias("at", "owner"), *sums)
    return rows.select(F.col("owner").alias("c"), ((F.col("band") * BAND + F.col("at")) * unit).alias("d"), *sums)


def rolled_up(path: DataFrame, values: DataFrame, sums: list[str], deepest: int, unit: int = 1, lines: DataFrame | None = None) -> DataFrame:
    """``c, d`` and the sums over the whole subtree of every node whose depth is a multiple of ``unit``."""
    lines = materialise(lineages(path, unit), "lines") if lines is None else lines
    add = [F.sum(s).alias(s) for s in sums]
    inside = given(lines.where("not top"), values, unit, sums).groupBy("c", "d").agg(*add)
    if deepest < unit * BAND:
        return inside
    inside = materialise(inside, "bands")
    tops = materialise(rolled_up(path, inside.where(F.col("d") % (unit * BAND) == 0), sums, deepest, unit * BAND), "tops")
    above = lines.where("top").withColumn("line", F.expr("slice(line, 1, size(line) - 1)"))
    return inside.unionAll(given(above, tops, unit, sums)).groupBy("c", "d").agg(*add)


def hashed_ends(ends: DataFrame) -> DataFrame:
    """``c, d, ends_sha256`` from ``ends(owner, d, c)``: the hash of each node's ids in order, joined by commas.

    Ids are sorted and cut into ranges over all nodes, so those of one node may
    lie in many; a range turns them into digits, and a node's digits stream
    through one hash, chunk by chunk.
    """

    def digits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, held, size = None, 0, [], 0

        def chunk() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"owner": pa.array([at[0]], pa.int64()), "d": pa.array([at[1]], pa.int64()), "first": pa.array([first], pa.int64()), "ids": pa.array([",".join(held)], pa.string())})

        for batch in batches:
            for owner, d, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if held and ((owner, d) != at or size > CHUNK):
                    yield chunk()
                    held, size = [], 0
                if not held:
                    at, first = (owner, d), c
                held.append(str(c))
                size += len(held[-1]) + 1
        if held:
            yield chunk()

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha, out = None, hashlib.sha256(), []

        def made() -> pa.RecordBatch:
            cols = zip(*out, strict=True) if out else ([], [], [])
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["c", "d", "ends_sha256"])

        for batch in batches:
            for owner, d, _, ids in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (owner, d) != at:
                    if at:
                        out.append((*at, sha.hexdigest()))
                    at, sha = (owner, d), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield made()
            out = []
        if at:
            out.append((*at, sha.hexdigest()))
            yield made()

    order = ["owner", "d", "c"]
    chunks = ends.repartitionByRange(*order).sortWithinPartitions(*order).select(*order).mapInArrow(digits, "owner long, d long, first long, ids string")
    return chunks.repartition("owner", "d").sortWithinPartitions("owner", "d", "first").mapInArrow(streamed, "c long, d long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, rebuild: bool = False) -> DataFrame:
    """One row for each node of the trie of ``conversations(conv_id, turn, role, text)``.

    ``conv_id`` is the smallest member, ``depth`` the number of turns,
    ``parent_conv_id`` the parent's conv_id, ``n_convs`` counts members,
    ``n_children`` children, ``n_leaves`` the childless nodes of the subtree,
    ``saved_tokens`` sums (n_convs - 1) times the bytes of the last text over
    the subtree, and ``ends_sha256`` hashes the conversations that end there.
    With ``rebuild`` conversations share heads as ``rebuilt`` says.

    Turns go by ``turn``, null first; ties go by role, then text, and equal rows
    are a turn each. A null role or text is empty; rows without a conv_id are
    in no conversation; an empty table has no nodes; texts count whole; extra
    columns are ignored.
    """
    path, convs = (rebuilt if rebuild else as_they_are)(ordered(conversations))
    convs = materialise(convs, "convs")
    deepest = convs.agg(F.max("length")).first()[0] or 0
    path = owned(path, convs)
    lines = materialise(lineages(path, 1), "lines")
    parents = lines.where("size(line) > 1").select("c", "d", F.element_at("line", -2).alias("parent_conv_id"))
    children = parents.groupBy(F.col("parent_conv_id").alias("c"), (F.col("d") - 1).alias("d")).agg(F.count("*").alias("n_children"))
    nodes = path.where("owner = c").select("c", "d", "n_convs", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    nodes = nodes.join(children, ["c", "d"], "left").join(parents, ["c", "d"], "left")
    nodes = materialise(nodes.withColumn("n_leaves", F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long")), "valued")
    sums = rolled_up(path, nodes.select("c", "d", "n_leaves", "saved_tokens"), ["n_leaves", "saved_tokens"], deepest, lines=lines)
    ends = path.groupBy("c").agg(F.max(F.struct("d", "owner")).alias("e")).select("e.owner", "e.d", "c")
    found = nodes.drop("n_leaves", "saved_tokens").join(sums, ["c", "d"]).join(hashed_ends(materialise(ends, "ends")), ["c", "d"], "left")
    return found.select(
        F.col("c").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256")
    )


# Fixed values in it: the sixteen steps of CRC-32 over half bytes.
ORACLE = """
WITH RECURSIVE t AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, c - c % 5 AS f, CAST(c AS VARCHAR) AS s FROM (SELECT DISTINCT c FROM t)),
crc(c, s, i, v) AS (
  SELECT c, s, 0, 4294967295::BIGINT FROM ids
  UNION ALL
  SELECT c, s, i + 1, xor(v >> 4, [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108][
    (xor(v, (ascii(s[i // 2 + 1]) >> (4 * (i % 2)))) & 15) + 1]::BIGINT)
  FROM crc WHERE i < 2 * length(s)),
h AS (SELECT ids.c, f, CASE WHEN ids.c = f THEN 0 ELSE xor(v, 4294967295::BIGINT) % 9 END AS h FROM ids JOIN crc ON ids.c = crc.c AND i = 2 * length(ids.s)),
g AS (SELECT h.c, f, h, least(h, (SELECT count(*) FROM t WHERE t.c = f)) AS k FROM h),
p AS (
  SELECT g.c, n - h + k AS d, r, x FROM g JOIN t ON t.c = g.c WHERE n > h
  UNION ALL
  SELECT g.c, n, r, x FROM g JOIN t ON t.c = f WHERE g.c <> f AND n <= h),
q AS (SELECT c, d, x, list((r, x)) OVER (PARTITION BY c ORDER BY d) AS key FROM p UNION ALL SELECT c, 0, '', [] FROM g),
o AS (SELECT c, d, x, min(c) OVER (PARTITION BY d, key) AS owner, count(*) OVER (PARTITION BY d, key) AS n FROM q),
nodes AS (
  SELECT o.c, o.d, a.owner AS parent, o.n, (o.n - 1) * octet_length(encode(o.x)) AS saved FROM o LEFT JOIN o AS a ON a.c = o.c AND a.d = o.d - 1 WHERE o.owner = o.c),
kids AS (SELECT parent AS c, d - 1 AS d, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY ALL),
sums AS (
  SELECT a.owner AS c, a.d, count(*) FILTER (kids.n IS NULL) AS leaves, sum(saved) AS saved
  FROM nodes JOIN o AS a ON a.c = nodes.c AND a.d <= nodes.d LEFT JOIN kids ON kids.c = nodes.c AND kids.d = nodes.d GROUP BY ALL),
last AS (SELECT c, max(d) AS d FROM o GROUP BY c),
ends AS (SELECT owner AS c, d, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS who FROM o JOIN last USING (c, d) GROUP BY ALL)
SELECT nodes.c AS conv_id, nodes.d AS depth, parent AS parent_conv_id, nodes.n AS n_convs, coalesce(kids.n, 0) AS n_children, leaves AS n_leaves, CAST(sums.saved AS BIGINT) AS saved_tokens, sha256(coalesce(who, '')) AS ends_sha256
FROM nodes JOIN sums USING (c, d) LEFT JOIN kids USING (c, d) LEFT JOIN ends USING (c, d)
"""
