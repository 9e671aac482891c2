"""A traffic matrix with its files, zones and statistics; the work is done by Spark jobs."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquilt.operators import matrix, stats, zones
from netquilt.sources import readers
from netquilt.sources.stored import stored
from netquilt.sources.versions import Versions

log = logging.getLogger("netquilt")
LINKS = "src long, dst long, packets long"
Reader = Callable[[SparkSession, list[str]], DataFrame]
#: How the links of files are read, by the end of their names.
READERS: dict[str, Reader] = {
    ".parquet": lambda spark, files: spark.read.parquet(*files),
    ".coo": readers.read_coo,
    ".tar": lambda spark, files: readers.read_tar(spark, files, strict=True),
}
#: Stored parts of a sum that are read together before they are stored as one.
PARTS = 8


@dataclass
class TrafficMatrix:
    """Sum of the window files read so far: Parquet links, binary dumps and archives of them.

    ``update`` remembers each file by the path that the file system itself gives
    it, so none counts twice however it is spelt. The links of each update are
    combined and stored; what was read before isn't read again. Zone statistics
    always come from the links themselves. ``readers`` reads files of other
    endings, or these in another way.

    With a ``folder`` the sum and the list of files live there and are committed
    together: another process goes on from the last commit, and an update that
    is cut off, at any point, has changed nothing.
    """

    spark: SparkSession
    zone_table: DataFrame | None = None
    complement: bool = True
    files: set[str] = field(default_factory=set)
    parts: list[DataFrame] = field(default_factory=list)
    readers: dict[str, Reader] = field(default_factory=lambda: dict(READERS))
    folder: str | None = None
    #: Files that the last update met and left out.
    skipped: list[str] = field(default_factory=list)
    _known: dict[str, int] | None = None
    _sum: DataFrame | None = None

    def __post_init__(self) -> None:
        self._versions = Versions(self.spark, self.folder) if self.folder else None
        self._load()

    def _load(self) -> None:
        if self._versions:
            self._number, self._state = self._versions.latest()
            self.parts = [self.spark.read.schema(LINKS).parquet(p) for p in self._state.get("links", [])]
            self._sum = self._known = None

    @property
    def edges(self) -> DataFrame:
        """The sum; of several stored parts it is stored once."""
        if not self.parts:
            return self.spark.createDataFrame([], LINKS)
        if self._sum is None:
            self._sum = self.parts[0] if len(self.parts) == 1 else stored(matrix.add(*self.parts), "sum")
            if not self._versions:
                self.parts = [self._sum]
        return self._sum

    def processed(self) -> DataFrame:
        """``path`` of each file that the sum holds."""
        if self._versions and self._state.get("files"):
            return self.spark.read.schema("path string").parquet(*self._state["files"])
        return self.spark.createDataFrame([(f,) for f in sorted(self.files)], "path string")

    def update(self, *where: str, recursive: bool = False, skip_unknown: bool = False) -> float:
        """Add files, or the files of folders; ``recursive`` goes into folders below. Returns the seconds until the sum is stored.

        A file whose ending has no reader is an error, or with ``skip_unknown``
        is left out, not remembered and listed in ``skipped``. A file or a
        member of an archive that can't be read is an error too. After an error
        nothing has changed.
        """
        began = time.perf_counter()
        self.skipped = []
        listed = readers.paths(self.spark, list(where), recursive=recursive).distinct() if where else self.spark.createDataFrame([], "path string")
        new = sorted(r[0] for r in listed.join(self.processed(), "path", "left_anti").collect())
        by_end = {end: [x for x in new if x.endswith(end)] for end in self.readers}
        self.skipped = sorted(set(new) - {x for mine in by_end.values() for x in mine})
        if self.skipped and not skip_unknown:
            raise ValueError(f"no reader for {self.skipped[0]}" + f" and {len(self.skipped) - 1} more" * (len(self.skipped) > 1))
        read = [self.readers[end](self.spark, mine).select(*matrix.EDGES) for end, mine in by_end.items() if mine]
        if read:
            taken = sorted(set(new) - set(self.skipped))
            self._add(matrix.add(*read), taken)  # partial sums are combined before the shuffle
        if self.skipped:
            log.warning("left out %d files without a reader, %s first", len(self.skipped), self.skipped[0])
        return time.perf_counter() - began

    def _add(self, links: DataFrame, taken: list[str]) -> None:
        if not self._versions:
            self.parts = [*([self._sum] if self._sum is not None else self.parts), stored(links, "links")]
            self.files |= set(taken)
            self._known = self._sum = None
            self.edges  # noqa: B018
            return
        held, paths = self._state.get("links", []), self._state.get("files", [])
        mine, names = self._versions.fresh("links"), self._versions.fresh("files")
        files = self.spark.createDataFrame([(f,) for f in taken], "path string")
        if len(held) + 1 >= PARTS:
            links, held = matrix.add(*self.parts, links), []
            files, paths = self.processed().unionAll(files), []
        links.write.parquet(mine)
        files.write.parquet(names)
        self._versions.commit(self._number + 1, {"links": [*held, mine], "files": [*paths, names]})
        self._load()

    def clear(self) -> None:
        self.files, self.parts, self._known, self._sum = set(), [], None, None
        if self._versions:
            self._versions.commit(self._number + 1, {})
            self._load()

    def analyze(self, count_multiplicities: bool = False) -> DataFrame:
        """Long ``(zone_src, zone_dst, metric, value)``; zones are null for the whole matrix."""
        none = F.lit(None).cast("int")
        parts = [(stats.quantities(self.edges), stats.QUANTITIES)]
        if count_multiplicities:
            parts.append((stats.multiplicities(self.edges), stats.MULTIPLICITIES))
        rows = [stats.unpivot(w.withColumn("zone_src", none).withColumn("zone_dst", none), ("zone_src", "zone_dst"), m) for w, m in parts]
        if self.zone_table is not None:
            rows.append(stats.unpivot(zones.pair_quantities(self.edges, self.zone_table, self.complement), ("zone_src", "zone_dst")))
            if count_multiplicities:
                labelled = zones.label(self.edges, self.zone_table, self.complement)
                rows.append(stats.unpivot(stats.multiplicities(labelled, ("zone_src", "zone_dst")), ("zone_src", "zone_dst"), stats.MULTIPLICITIES))
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        return out

    def value(self, metric: str) -> int:
        """One of the nine quantities; they are computed together, once for each sum."""
        if self._known is None:
            self._known = stats.quantities(self.edges).first().asDict()
        return self._known[metric]


def process_files(spark: SparkSession, name: str, paths: list[str], zone_table: DataFrame | None = None) -> DataFrame:
    """Sum window files, analyze them and time it: the long statistics rows of window ``name``.

    Adds ``update_time``, ``analyze_time`` and the packets handled a second in
    each, and says so in the log ``netquilt``.
    """
    m = TrafficMatrix(spark, zone_table)
    update = m.update(*paths)
    began = time.perf_counter()
    found = m.analyze().withColumn("value", F.col("value").cast("double")).collect()  # a few numbers for each pair of zones
    analyze = time.perf_counter() - began
    n = next(r["value"] for r in found if r["metric"] == "n_packets" and r["zone_src"] is None)
    timed = [("update_time", update), ("analyze_time", analyze), ("update_rate", n / update), ("analyze_rate", n / analyze)]
    log.info("%s: %d files, %d packets, update %.3f s, analyze %.3f s", name, m.processed().count(), n, update, analyze)
    table = [(name, r["zone_src"], r["zone_dst"], r["metric"], r["value"]) for r in found] + [(name, None, None, k, v) for k, v in timed]
    return spark.createDataFrame(table, "window string, zone_src int, zone_dst int, metric string, value double")
