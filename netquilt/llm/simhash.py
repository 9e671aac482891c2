"""SimHash near-duplicates by segment popcounts and a grid join.

A 64-bit fingerprint is embedded as 32 bit counts, one for each segment of two
bits. The Manhattan distance of two embeddings never exceeds the Hamming
distance of the fingerprints, so it is a lower bound. The 32 axes form six
groups; embeddings within Manhattan distance 3 differ in at most three of the
groups, so they share the grid cell of at least one of the twenty choices of
three groups. Fingerprints that share a cell are tested with the lower bound
and then exactly.

Only distinct fingerprints enter the grid, and a cell gives a spanning forest
of its links, never all its pairs. Cells are counted first; one of over ``MAX_CELL``
fingerprints never meets in a task: its rows go straight to blocks whose pairs
are dealt to tasks of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialise

MAX_DISTANCE = 3
SHINGLE = 3
SEED = 42
GROUPS = 6
MAX_CELL = 20_000
BLOCK = 8_192
_UPPER = bytes(range(65, 91))
_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())
_EVEN = 0x5555555555555555


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of a whole text as a signed 64-bit integer; 0 without words.

    A-Z are lower-cased, words end at ASCII white space, and a bit is set if
    over half of the shingles' XXH64 values have it.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[-n:].tolist()
    digest = xxhash.xxh64_digest
    votes, step = np.zeros(64, np.int64), 65_536
    for at in range(0, n, step):
        made = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + step], stops[at : at + step], strict=True)])
        bits = np.unpackbits(np.frombuffer(made, np.uint8).reshape(-1, 8), axis=1)
        votes += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)`` for each row of ``docs``."""
    return map_rows(docs, ["doc_id", "text"], "doc_id long, fp long", lambda rows: [(i, fingerprint(t)) for i, t in rows])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def grid_masks(max_distance: int = MAX_DISTANCE, groups: int = GROUPS) -> list[int]:
    """Bit masks of the axes that make up a cell, for each choice of groups.

    With ``groups`` groups and at most ``max_distance`` units of difference,
    ``groups - max_distance`` groups at least are equal.
    """
    cuts = [32 * g // groups * 2 for g in range(groups + 1)]
    spans = [((1 << cuts[g + 1]) - 1) ^ ((1 << cuts[g]) - 1) for g in range(groups)]
    return [_signed(sum(chosen)) for chosen in combinations(spans, groups - max_distance)]


def cells(fps: DataFrame) -> DataFrame:
    """``(cell, fp)``: twenty grid cells of each fingerprint.

    The embedding is packed: each pair of bits holds its own count, made with
    bit operations since a sum may overflow. A cell is a hash of the choice and
    the kept axes; a clash of hashes only adds candidates.
    """
    low, high = F.col("fp").bitwiseAND(F.lit(_EVEN)), F.shiftrightunsigned("fp", 1).bitwiseAND(F.lit(_EVEN))
    counts = F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low.bitwiseXOR(high))
    keys = [F.xxhash64(F.lit(i), F.col("packed").bitwiseAND(F.lit(m))) for i, m in enumerate(grid_masks())]
    return fps.select("fp", counts.alias("packed")).select(F.explode(F.array(*keys)).alias("cell"), "fp")


def _packed(v: np.ndarray) -> np.ndarray:
    return v - ((v >> np.uint64(1)) & np.uint64(_EVEN))


def lower_bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of the segment popcounts of ``a`` and ``b``."""
    x, y, total = _packed(a), _packed(b), np.zeros(np.broadcast(a, b).shape, np.uint8)
    for shift in range(0, 64, 2):
        p, q = ((v >> np.uint64(shift)) & np.uint64(3) for v in (x, y))
        total += np.where(p > q, p - q, q - p).astype(np.uint8)
    return total


def _linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mask of the pairs that link: the bound first, the exact distance on what is left."""
    out = np.zeros(np.broadcast(a, b).shape, bool)
    near = lower_bound(a, b) <= MAX_DISTANCE
    x, y = (np.broadcast_to(v, out.shape)[near] for v in (a, b))
    out[near] = np.bitwise_count(x ^ y) <= MAX_DISTANCE
    return out


def _forest(left: np.ndarray, right: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside ``left``, or between ``left`` and ``right``."""
    heads, tails = [], []
    both = left if right is None else np.concatenate([left, right])
    side = np.zeros(len(both), bool) if right is None else np.arange(len(both)) >= len(left)
    rest = np.arange(len(both))
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            u = queue.pop()
            open_ = np.ones(len(rest), bool) if right is None else side[rest] != side[u]
            hit = open_.copy()
            hit[open_] = _linked(both[rest[open_]], both[u])
            found = rest[hit]
            if len(found):
                heads.append(np.full(len(found), both[u]))
                tails.append(both[found])
                queue.extend(found.tolist())
                rest = rest[~hit]
    empty = np.empty(0, np.uint64)
    return (np.concatenate(heads), np.concatenate(tails)) if heads else (empty, empty)


def _cell_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each cell from rows sorted by cell."""

    def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v.astype(np.uint64).view(np.int64)) for v in (a, b)], names=["a", "b"])

    def solve(cell: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        edge = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        size = np.diff(np.r_[edge, len(cell)])
        small = np.repeat((size > 1) & (size <= 16), size)
        pos = np.flatnonzero(small)
        for k in range(1, 16):
            pos = pos[(pos + k < len(cell))]
            pos = pos[cell[pos] == cell[pos + k]]
            if not len(pos):
                break
            hit = pos[_linked(fp[pos], fp[pos + k])]
            if len(hit):
                yield out(fp[hit], fp[hit + k])
        for e, n in zip(edge[size > 16], size[size > 16], strict=True):
            a, b = _forest(np.unique(fp[e : e + n]))
            if len(a):
                yield out(a, b)

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        cell, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        if not len(cell):
            continue
        cut = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on in the next batch
        if cut:
            held.append((cell[:cut], fp[:cut]))
            yield from solve(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held = []
        held.append((cell[cut:], fp[cut:]))
    if held:
        yield from solve(*(np.concatenate(x) for x in zip(*held, strict=True)))


def links(fps: DataFrame) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints that span every group of linked ones.

    ``fps`` has one column ``fp`` without repeats.
    """
    rows = cells(materialise(fps, "distinct"))
    # counted before the shuffle as far as possible, so a large cell's rows don't meet for it
    sizes = rows.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > MAX_CELL)
    large = materialise(sizes.select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "large-cells")
    some = not large.isEmpty()
    rest = rows.join(large, "cell", "left_anti") if some else rows
    near = rest.repartition("cell").sortWithinPartitions("cell").mapInArrow(_cell_links, "a long, b long")
    if not some:
        return near
    # each member goes to the pairs that its block is part of: their number is the blocks', not the members'
    pairs = (
        rows.join(large, "cell")
        .select("cell", "fp", F.pmod(F.xxhash64("fp"), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "fp")
    )

    def across(key: tuple, t: pa.Table) -> pa.Table:
        fp, block = t.column("fp").to_numpy().view(np.uint64), t.column("block").to_numpy()
        i, j = key[1].as_py(), key[2].as_py()
        a, b = _forest(fp) if i == j else _forest(fp[block == i], fp[block == j])
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return near.unionByName(pairs.groupBy("cell", "i", "j").applyInArrow(across, "a long, b long"))


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` of each node of ``edges(a, b)``; the root is the smallest node reachable.

    Alternates two star contractions: neighbours above a node move to the
    least neighbour, then all move to the least below. Minima are combined
    before the shuffle, and the joins let Spark split a hub's rows.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    now, seen = materialise(now, "edges"), None
    for _ in range(max_rounds):
        check = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()
        if tuple(check) == seen or not check[0]:
            break
        seen = tuple(check)
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        above = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        below = above.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = above.join(below, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now = materialise(moved.unionAll(below.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionAll(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` and the signed ``fp`` for each row of ``docs``.

    Fingerprints of at most three differing bits link, equal ones included;
    ``component_id`` is the smallest doc_id reachable. Null and empty texts have
    fingerprint zero and link like others. Repeated rows stay, each with its
    component; rows with a null doc_id take part, but a component that has no
    other rows gets a null ``component_id``. Extra columns are ignored; an
    empty table gives an empty result.
    """
    each = materialise(fingerprints(docs), "fingerprints")
    fps = each.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    roots = connected(links(fps.select("fp")))
    rooted = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    lowest = rooted.where("root is not null").groupBy("root").agg(F.min("first").alias("lowest"))
    # copies and linked fingerprints only; any other document is its own component
    shared = (
        rooted.where("n > 1 or root is not null")
        .join(lowest, "root", "left")
        .select("fp", F.coalesce("lowest", "first").alias("component"), F.lit(True).alias("shared"))
    )
    return each.join(shared, "fp", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("shared"), F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
        "fp",
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component of near copies; see ``near_copies.keep_one``."""
    from . import near_copies

    return near_copies.keep_one(docs)
