"""History of changing attributes, kept up snapshot by snapshot through a Merkle comparison."""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import Cuts
from .ranking import SLICE, on_keys, prefixed, running_before, slice_hot

SUBJECT = ["chat_id", "source_id", "relationship_name"]
FACT = [*SUBJECT, "target_id", "valid_from"]


def plain_name(name: Column) -> Column:
    """Case, outer blanks and the separator do not tell relationship names apart."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), r"[\s\p{Z}_-]+", "_"))


def resolve_facts(edges: DataFrame, kinds: DataFrame) -> DataFrame:
    """One row for each fact of a single-valued relationship: of its rows the one with
    the latest ``updated_at`` (then ``edge_no``), with an end not after the start read as open.

    Rows without chat, subject, relationship, target or start say nothing and are left out.
    ``kinds`` is the fixed list of relationships, so it is broadcast."""
    k = (
        kinds.where("single_value and relationship_name is not null")
        .select(plain_name(F.col("relationship_name")).alias("__plain"), F.col("relationship_name").alias("__kind"))
        .dropDuplicates(["__plain"])
    )
    e = (
        edges.select("chat_id", "source_id", "target_id", plain_name(F.col("relationship_name")).alias("__plain"),
                     F.unix_micros("valid_at").alias("valid_from"), F.unix_micros("invalid_at").alias("__end"),
                     F.unix_micros("created_at").alias("created"), F.unix_micros("updated_at").alias("updated"), "edge_no")
        .dropna(subset=["chat_id", "source_id", "target_id", "__plain", "valid_from"])
        .join(F.broadcast(k), "__plain").withColumn("relationship_name", F.col("__kind"))
    )
    last = F.max_by(F.struct("__end", "created", "edge_no"), F.struct("updated", "edge_no"))
    return (
        e.groupBy(*FACT).agg(last.alias("__last"))
        .select(*FACT, F.when(F.col("__last.__end") > F.col("valid_from"), F.col("__last.__end")).alias("valid_to"),
                F.col("__last.created").alias("created"), F.col("__last.edge_no").alias("edge_no"))
    )


def versions(facts: DataFrame, hot_rows: int = 500_000) -> DataFrame:
    """The periods of each subject's facts: of facts with one start the one created last
    (then the largest ``edge_no``) counts; each holds until its end or the next start, and
    touching periods of one target are one version.

    A subject with more than ``hot_rows`` starts is worked on in slices of time; what a slice
    needs of its neighbours is their first start and last period, one small row each."""
    starts = (
        facts.groupBy(*SUBJECT, "valid_from")
        .agg(F.max_by(F.struct("target_id", "valid_to"), F.struct("created", "edge_no")).alias("__f"))
        .select(*SUBJECT, "valid_from", "__f.*")
    )
    f, hot = slice_hot(starts, SUBJECT, "valid_from", hot_rows)
    w = Window.partitionBy(*SUBJECT, SLICE).orderBy("valid_from")
    follows, before = F.lead("valid_from").over(w), F.lag(F.struct("target_id", F.col("valid_to").alias("to"))).over(w)
    if hot:
        line = Window.partitionBy(*SUBJECT).orderBy(SLICE)
        ends = (
            f.groupBy(*SUBJECT, SLICE)
            .agg(F.min("valid_from").alias("__first"), F.max_by(F.struct("target_id", F.col("valid_to").alias("to")), "valid_from").alias("__last"))
            .withColumn("__then", F.lead("__first").over(line))
            .withColumn("__last", F.struct("__last.target_id", F.least("__last.to", "__then").alias("to")))
            .select(*SUBJECT, SLICE, "__then", F.lag("__last").over(line).alias("__prior"))
        )
        f = f.join(prefixed(ends, [*SUBJECT, SLICE]), on_keys([*SUBJECT, SLICE])).drop(*[f"__b_{k}" for k in [*SUBJECT, SLICE]])
        follows, before = F.coalesce(follows, "__then"), F.coalesce(before, "__prior")
    f = f.withColumn("__next", follows).withColumn("valid_to", F.least("valid_to", "__next")).withColumn("__before", before)
    same = (F.col("__before.target_id") == F.col("target_id")) & (F.col("__before.to") == F.col("valid_from"))
    f = f.withColumn("__new", F.when(same, 0).otherwise(1)).withColumn("__v", F.sum("__new").over(w))
    if hot:
        f = (
            f.join(running_before(f, SUBJECT, F.col("__new"), "__earlier"), on_keys([*SUBJECT, SLICE]))
            .withColumn("__v", F.col("__v") + F.col("__earlier")).drop(*[f"__b_{k}" for k in [*SUBJECT, SLICE]])
        )
    return (
        f.groupBy(*SUBJECT, "__v")
        .agg(F.first("target_id").alias("target_id"), F.min("valid_from").alias("valid_from_us"),
             F.max(F.coalesce("valid_to", F.lit(2**63 - 1))).alias("__to"))
        .select(*SUBJECT, F.col("__v").cast("long").alias("version_no"), "target_id", "valid_from_us",
                F.when(F.col("__to") == 2**63 - 1, F.lit(-1)).otherwise(F.col("__to")).cast("long").alias("valid_to_us"))
    )


def bucket_of(fan: int, depth: int) -> Column:
    return F.pmod(F.xxhash64(*SUBJECT), F.lit(fan**depth))


def depth_for(subjects: int, fan: int, subjects_a_leaf: int = 1000) -> int:
    """Levels of a tree whose leaves hold about ``subjects_a_leaf`` subjects each: with more subjects it has more leaves, so that a
    change still touches few of the rows."""
    return max(1, math.ceil(math.log(max(1, subjects / subjects_a_leaf), fan)))


def leaf_hashes(facts: DataFrame, fan: int, depth: int) -> DataFrame:
    """The lowest level of a snapshot's Merkle tree: a subject's bucket is a hash
    of its key, and a bucket's hash does not depend on the order of its rows. The table has
    at most fan ** depth rows whatever the size of the snapshot, and partial aggregation
    keeps a hot bucket from gathering in one task."""
    row = F.xxhash64(*FACT, "valid_to", "created", "edge_no")
    return (
        facts.groupBy(bucket_of(fan, depth).alias("bucket"))
        .agg(F.bit_xor(row).alias("__x"), F.sum(F.shiftrightunsigned(row, 20)).alias("__s"), F.count(F.lit(1)).alias("__n"))
        .select("bucket", F.xxhash64("__x", "__s", "__n").alias("hash"))
    )


def changed_buckets(old: DataFrame, new: DataFrame, fan: int, depth: int) -> DataFrame:
    """Leaf buckets that differ between two trees, found from the root down: a level
    is compared only below the branches that differed on the level above."""

    def level(leaves: DataFrame, up: int) -> DataFrame:
        at = leaves
        for _ in range(up):
            at = (at.groupBy(F.floor(F.col("bucket") / fan).cast("long").alias("bucket"))
                  .agg(F.sort_array(F.collect_list(F.struct("bucket", "hash"))).alias("__c"))
                  .select("bucket", F.xxhash64("__c").alias("hash")))
        return at

    differing = None
    for up in range(depth, -1, -1):
        a, b = level(old, up), level(new, up)
        if differing is not None:
            inside = lambda x: x.join(F.broadcast(differing), F.floor(F.col("bucket") / fan) == F.col("__at"), "left_semi")  # noqa: B023, E731
            a, b = inside(a), inside(b)
        differing = (
            a.withColumnRenamed("hash", "__h").join(b, "bucket", "full_outer")
            .where(~F.col("__h").eqNullSafe(F.col("hash"))).select(F.col("bucket").alias("__at"))
        )
    return differing.withColumnRenamed("__at", "bucket")


STATE = [*FACT, "valid_to", "created", "edge_no"]
VERSION = [*SUBJECT, "version_no", "target_id", "valid_from_us", "valid_to_us"]


@dataclass
class History:
    """What is kept between snapshots: the facts of the last one in ``folders`` folders of neighbouring buckets, its leaf hashes, and the log, tables
    of versions that are only ever added to. Of a subject the rows with the highest ``seq`` count; one row without a version
    number tells that its facts are gone."""

    facts: DataFrame
    leaves: DataFrame
    log: list[DataFrame]
    fan: int
    depth: int
    folders: int

    def versions(self, cuts: Cuts) -> DataFrame:
        """The history as of the last snapshot."""
        log = cuts.read(self.log)
        if len(self.log) == 1:
            return log.select(*VERSION)
        last = log.groupBy(*SUBJECT).agg(F.max("seq").alias("__seq"))
        return log.join(prefixed(last, SUBJECT), on_keys(SUBJECT) & (F.col("seq") == F.col("__seq"))).where("version_no is not null").select(*VERSION)


def advance(state: History | None, snapshot: DataFrame, cuts: Cuts, fan: int = 16, depth: int | None = None, folders: int = 16) -> History:
    """The history after one more snapshot (facts as ``resolve_facts`` gives them).

    The snapshot is written once, by folder, and hashed into leaves, which are compared with those of the last one from the root down. Only in
    leaves that differ are rows of either side read and diffed, and only the subjects found there get new versions, added to the
    log as a table of their own; nothing written before is read for it or written again. Folders without a difference are not read at all. The first
    snapshot starts the log; the tree's depth follows its number of subjects unless given, and stays, as the number of ``folders`` does."""
    if state:
        fan, depth, folders = state.fan, state.depth, state.folders
    elif depth is None:
        depth = depth_for(snapshot.agg(F.approx_count_distinct(F.xxhash64(*SUBJECT))).first()[0], fan)
    branch = F.floor(F.col("bucket") * folders / fan**depth).cast("int")
    now = cuts.cut(snapshot.select(*STATE, bucket_of(fan, depth).alias("bucket")).withColumn("branch", branch), by="branch")
    leaves = cuts.cut(leaf_hashes(now, fan, depth))
    if state is None:
        return History(now, leaves, [cuts.cut(versions(now).withColumn("seq", F.lit(0)))], fan, depth, folders)
    buckets = cuts.cut(changed_buckets(state.leaves, leaves, fan, depth))
    branches = [r.branch for r in buckets.select(branch.alias("branch")).distinct().collect()]  # folders at most
    if not branches:
        return History(now, leaves, state.log, fan, depth, folders)
    within = lambda x: x.where(F.col("branch").isin(branches)).join(F.broadcast(buckets), "bucket", "left_semi")
    side = lambda x, n: within(x).select(*STATE, F.lit(n).alias("__side"))
    # a row of both sides is unchanged; one of either side marks its subject
    subjects = cuts.cut(
        side(state.facts, 1).union(side(now, 2)).groupBy(*STATE)
        .agg(F.sum("__side").alias("__s")).where("__s <> 3").select(*SUBJECT).distinct()
    )
    anew = versions(within(now).join(subjects, SUBJECT, "left_semi"))
    gone = subjects.join(within(now), SUBJECT, "left_anti").select(*SUBJECT, *[F.lit(None).cast(anew.schema[c].dataType).alias(c) for c in VERSION[len(SUBJECT):]])
    part = cuts.cut(anew.unionByName(gone).withColumn("seq", F.lit(len(state.log))))
    cuts.drop(buckets, subjects)
    return History(now, leaves, [*state.log, part], fan, depth, folders)


def keep_history(edges: DataFrame, kinds: DataFrame, snapshots: int = 3, fan: int = 16, depth: int | None = None) -> DataFrame:
    """The versions of every single-valued relationship, built from periodic snapshots.

    A snapshot holds the facts as known at one time: the rows up to a quantile of
    ``updated_at``, the last one all rows. ``advance`` takes the history from each to the next, as a scheduled run
    would; the result does not depend on the number of snapshots.

    Columns: chat_id, source_id, relationship_name, version_no from 1, target_id,
    valid_from_us, valid_to_us (-1 if open). An empty table gives no rows; further
    columns of the inputs are ignored; repeated rows change nothing."""
    cuts = Cuts(edges.sparkSession, "history")
    rows = edges.select("chat_id", "source_id", "target_id", "relationship_name", "valid_at", "invalid_at",
                        "created_at", "updated_at", "edge_no")
    grid = [i / snapshots for i in range(1, snapshots)]
    times = (rows.agg(F.percentile_approx(F.unix_micros("updated_at"), grid, 1000)).first()[0] if grid else None) or []
    subjects = rows.agg(F.approx_count_distinct(F.xxhash64("chat_id", "source_id"))).first()[0]
    depth = depth or depth_for(subjects, fan)
    folders = min(4096, max(1, subjects // 50_000))  # of many subjects each, as small files cost more than they spare
    state = None
    for upto in [*sorted(set(times)), None]:
        # rows without updated_at are as old as can be: max_by ranks a null lowest as well
        known = rows if upto is None else rows.where(F.unix_micros("updated_at").isNull() | (F.unix_micros("updated_at") <= upto))
        before, state = state, advance(state, resolve_facts(known, kinds), cuts, fan, depth, folders)
        if before:
            cuts.drop(before.facts, before.leaves)
    cuts.drop(state.facts, state.leaves)
    return state.versions(cuts)
