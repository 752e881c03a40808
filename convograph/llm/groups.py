"""Connected groups of pairwise matches by low-diameter decomposition."""
from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import Cuts


def matches(pairs: DataFrame, least: float = 0.88) -> DataFrame:
    """Rows that state a match: both ids present (null and empty are absent) and different, and
    a score that is a number (not NaN) of at least ``least``."""
    return pairs.where(
        (F.col("a_id") != F.col("b_id")) & (F.col("a_id") != "") & (F.col("b_id") != "")
        & ~F.isnan("score") & (F.col("score") >= least)
    ).select(F.col("a_id").alias("u"), F.col("b_id").alias("v"))


def decompose(links: DataFrame, level: int, beta: float, cuts: Cuts) -> DataFrame:
    """One low-diameter decomposition: (v, centre) for each vertex of the symmetric ``links``.

    Each vertex draws a shift from an exponential distribution with rate ``beta``, seeded by a hash of its id and the level so that a lost
    task draws it again. Its own cluster starts growing that much before the last start, one link per unit of time, and a vertex belongs to
    the cluster that reaches it first. A vertex reached at time t is reached over a link from one reached at t - 1, so round t only joins
    the links with the vertices of round t - 1, adds those that start by themselves, and takes away who was reached before: each link
    is sent over once, each round writes its own vertices only, and with the last start all are reached. Shifts of a few vertices are large
    and most are small, so the rounds before the last few are small as well. Messages to a vertex are reduced before the shuffle; a
    hub's links make one hot key on the side that the adaptive skew join splits."""
    u = (F.pmod(F.xxhash64("v", F.lit(level)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    shift = cuts.cut(links.select("v").distinct().select("v", (-F.log(u) / beta).alias("shift")))
    most = shift.agg(F.max("shift")).first()[0]
    starts = shift.select("v", (F.lit(most) - F.col("shift")).alias("at"))
    reached: list[DataFrame] = []
    for t in range(int(most) + 1):
        new = starts.where((F.col("at") >= t) & (F.col("at") < t + 1)).select("v", F.struct("at", F.col("v").alias("centre")).alias("best"))
        if reached:
            front = reached[-1].select(F.col("v").alias("u"), "best")
            new = new.union(links.join(front, "u").select("v", F.struct((F.col("best.at") + 1).alias("at"), F.col("best.centre").alias("centre")).alias("best")))
        new = new.groupBy("v").agg(F.min("best").alias("best"))
        if reached:
            new = new.join(cuts.read(reached).select("v"), "v", "left_anti")
        reached.append(cuts.cut(new))
    out = cuts.cut(cuts.read(reached).select("v", F.col("best.centre").alias("centre")))
    cuts.drop(shift, *reached)
    return out


def finish(links: DataFrame) -> DataFrame:
    """(v, centre) of a contracted graph small enough for one task: union by size over its links."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        up: dict[str, str] = {}
        size: dict[str, int] = {}

        def root(x: str) -> str:
            while (y := up.setdefault(x, x)) != x:
                up[x] = up[y]
                x = up[x]
            return x

        for batch in batches:
            for x, y in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
                x, y = root(x), root(y)
                if x != y:
                    if size.get(x, 1) < size.get(y, 1):
                        x, y = y, x
                    up[y] = x
                    size[x] = size.get(x, 1) + size.get(y, 1)
        ids = list(up)
        for at in range(0, max(1, len(ids)), 50_000):
            part = ids[at:at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([root(x) for x in part], pa.string())], names=["v", "centre"])

    return links.where("u < v").select("u", "v").coalesce(1).mapInArrow(run, "v string, centre string")


def group_matches(pairs: DataFrame, least: float = 0.88, beta: float = 0.7, last_links: int = 200_000, levels: int = 1) -> DataFrame:
    """(node_id, group_id): each node in a match with another node and the smallest id of all it
    is linked with directly or through others.

    Levels of decomposition: clusters contract to super-vertices, only links between clusters
    stay for the next level, and assignments are composed. A link is cut with probability of
    at most 1 - exp(-beta), so levels grow with the logarithm of the links whatever the shape,
    also along chains; nothing is gathered on the driver. Once a graph that went through ``levels`` levels has at most ``last_links`` links (some 30 MB), one task
    joins what is left, which gives the same groups. Repeated and swapped pairs
    count once, another row of a pair does not undo a match, and no pairs give no rows."""
    cuts = Cuts(pairs.sparkSession, "groups")
    m = matches(pairs, least)
    links = cuts.cut(m.union(m.select("v", "u")).distinct())
    owner, level = cuts.cut(links.select(F.col("v").alias("node_id"), F.col("v").alias("at")).distinct()), 0
    while left := links.count() // 2:
        last = level >= levels and left <= last_links
        centres = cuts.cut(finish(links)) if last else decompose(links, level, beta, cuts)
        moved = cuts.cut(
            owner.join(centres.withColumnRenamed("v", "at"), "at", "left")
            .select("node_id", F.coalesce("centre", "at").alias("at"))
        )
        if last:
            cuts.drop(owner, links, centres)
            owner = moved
            break
        between = cuts.cut(
            links.join(centres.select(F.col("v").alias("u"), F.col("centre").alias("cu")), "u")
            .join(centres.select("v", F.col("centre").alias("cv")), "v").where("cu <> cv")
            .select(F.col("cu").alias("u"), F.col("cv").alias("v")).distinct()
        )
        cuts.drop(owner, links, centres)
        owner, links, level = moved, between, level + 1
    names = owner.groupBy("at").agg(F.min("node_id").alias("group_id"))
    return cuts.finish(owner.join(names, "at").select("node_id", "group_id"))
