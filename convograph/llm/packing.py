"""Filling containers of fixed capacity by swap-based local search."""
from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import Cuts
from .tokens import RANKS, count_tokens


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices of items by bin: in falling size each goes where it leaves the least room."""
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []  # (room, bin), sorted
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_right(rooms, (sizes[i], -1))
        if at == len(rooms):
            bins.append([i])
            room, b = capacity - sizes[i], len(bins) - 1
        else:
            room, b = rooms.pop(at)
            bins[b].append(i)
            room -= sizes[i]
        rooms.insert(bisect_right(rooms, (room, b)), (room, b))
    return bins


def best_pair(keys: list[int], most: int) -> tuple[int, int] | None:
    """Places of the two of the sorted sizes ``keys`` whose sum is largest without exceeding ``most``, by two pointers."""
    i, j, best, at = 0, len(keys) - 1, -1, None
    while i < j:
        total = keys[i] + keys[j]
        if total > most:
            j -= 1
        else:
            if total > best:
                best, at = total, (i, j)
            i += 1
    return at


def improve(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Local search: the fullest bin with room takes from a less full one by a move, by an exchange of one for
    one or of two for one, over all items of both, whichever fills it most; each step raises the sum of squared fills, a whole
    number, so the search ends, and a bin that gave its last item is gone. It ends when no bin can take anything."""
    fill = [sum(sizes[i] for i in b) for b in bins]
    done: set[int] = set()
    while True:
        open_ = sorted((b for b in range(len(bins)) if bins[b] and fill[b] < capacity and b not in done), key=lambda b: (-fill[b], b))
        if len(open_) < 2:
            break
        to, givers = open_[0], open_[1:]
        room, best = capacity - fill[to], (0, None)
        outs = sorted({sizes[i]: i for i in bins[to]}.items())  # of equal sizes one stands for all
        for a in givers[::-1]:  # the emptiest first
            if best[0] == room:
                break
            own = sorted(bins[a], key=lambda i: sizes[i])
            keys = [sizes[i] for i in own]
            for lost, out in [(0, None), *outs]:
                # a gain d must keep to the capacity and raise fill[to]**2 + fill[a]**2
                at = bisect_right(keys, lost + room) - 1
                if at >= 0 and (d := keys[at] - lost) > best[0] and fill[to] + d > fill[a]:
                    best = (d, (a, [own[at]], out))
                if out is not None and len(keys) > 1 and best[0] < room and (pair := best_pair(keys, lost + room)):
                    d = keys[pair[0]] + keys[pair[1]] - lost
                    if d > best[0] and fill[to] + d > fill[a]:
                        best = (d, (a, [own[k] for k in pair], out))
        if best[1] is None:
            done.add(to)
            continue
        d, (a, taken, out) = best
        bins[a] = [i for i in bins[a] if i not in taken] + ([out] if out is not None else [])
        bins[to] = [i for i in bins[to] if i != out] + taken
        fill[a] -= d
        fill[to] += d
        done.discard(a)
    return [b for b in bins if b]


ITEM = "doc_id long, piece_no long, n_tokens long"


def _packer(capacity: int, level: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[["doc_id", "piece_no", "n_tokens"]].sort_values(["doc_id", "piece_no", "n_tokens"], ignore_index=True)
        sizes = rows["n_tokens"].tolist()
        bins = improve(best_fit(sizes, capacity), sizes, capacity)
        name, ready = [""] * len(sizes), [False] * len(sizes)
        for b, items in enumerate(bins):
            full = sum(sizes[i] for i in items) >= 0.98 * capacity
            for i in items:
                name[i], ready[i] = f"{level}-{key[0]}-{b}", full
        return rows.assign(container=name, ready=ready)

    return run


def pack(documents: DataFrame, capacity: int = 2048, shard_items: int = 2000, path: str = RANKS) -> DataFrame:
    """(doc_id, piece_no, first_token, n_tokens, container): every token of every text in a container of ``capacity``.

    A text longer than a container is cut into full pieces, each its own container, and a rest; no other text is split. Items
    are dealt to shards of about ``shard_items`` by a hash, each packed by one task: best fit, then local search over the bins
    with room. The items of bins that stay under 98 % full are dealt again with others' to as many shards as they need, as long as the
    number of such bins falls, or until they fit one shard; then every bin stays as it is. A shard never grows beyond its size, so a
    task holds a bounded number of items, and only bins that local search cannot fill in any mixture keep room. Texts without tokens take
    no container; equal doc_ids stay items of their own only if the rows differ in size."""
    cuts = Cuts(documents.sparkSession, "packing")
    sized = cuts.cut(count_tokens(documents.where("doc_id is not null and text is not null"), "text", "n", "doc_id", path=path).where("n > 0"))
    pieces = sized.select("doc_id", F.posexplode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / capacity))).alias("piece_no", "k"), "n").select(
        "doc_id", F.col("piece_no").cast("long").alias("piece_no"), F.least(F.lit(capacity), F.col("n") - F.col("k") * capacity).cast("long").alias("n_tokens"))
    whole = pieces.where(F.col("n_tokens") == capacity).withColumn("container", F.concat_ws("-", F.lit("w"), "doc_id", "piece_no"))
    rest = pieces.where(F.col("n_tokens") < capacity)
    filled = [whole]
    n, level, before = rest.count(), 0, None
    while n:
        shards = max(1, round(n / shard_items))
        dealt = rest.select("*", F.pmod(F.xxhash64("doc_id", "piece_no", F.lit(level)), F.lit(shards)).alias("shard"))
        # tasks by their work, a few shards each, as the rows are too few bytes to tell
        dealt = dealt.repartition(min(20_000, -(-shards // 3)), "shard")
        packed = cuts.cut(dealt.groupBy("shard").applyInPandas(_packer(capacity, level), ITEM + ", container string, ready boolean"))
        left = packed.where("not ready").agg(F.count_distinct("container").alias("bins"), F.count(F.lit(1)).alias("items")).first()
        if shards == 1 or before is not None and left.bins >= before:
            filled.append(packed.drop("ready"))
            break
        filled.append(packed.where("ready").drop("ready"))
        rest, n, level, before = packed.where("not ready").select("doc_id", "piece_no", "n_tokens"), left.items, level + 1, left.bins
    out = filled[0]
    for f in filled[1:]:
        out = out.unionByName(f)
    return out.select("doc_id", "piece_no", (F.col("piece_no") * capacity).alias("first_token"), "n_tokens", "container")


def fill_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, tokens, the share of unused space, and the least number of containers that could hold them."""
    per = packed.groupBy("container").agg(F.sum("n_tokens").alias("n"))
    total = F.sum("n")
    return per.agg(F.count(F.lit(1)).alias("containers"), total.alias("n_tokens"), F.round(1 - total / (F.count(F.lit(1)) * capacity), 6).alias("unused"),
                   F.ceil(total / capacity).alias("least_containers"), F.max("n").alias("fullest"))


def packing_faults(packed: DataFrame, documents: DataFrame, capacity: int = 2048, path: str = RANKS) -> DataFrame:
    """(fault, n): containers above capacity, documents whose pieces do not cover their tokens once, and documents split though they fit
    a container; all 0 if the packing is right."""
    own = count_tokens(documents.where("doc_id is not null"), "text", "size", "doc_id", path=path).where("size > 0").groupBy("doc_id").agg(F.sum("size").alias("size"), F.max("size").alias("longest"))
    doc = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max("piece_no").alias("last")).join(own, "doc_id", "full_outer")
    over = packed.groupBy("container").agg(F.sum("n_tokens").alias("n")).agg(F.count_if(F.col("n") > capacity).alias("n")).select(F.lit("over_capacity").alias("fault"), "n")
    wrong = lambda name, c: doc.agg(F.count_if(c).alias("n")).select(F.lit(name).alias("fault"), "n")
    return over.unionByName(wrong("tokens_not_once", ~F.col("n").eqNullSafe(F.col("size")))).unionByName(wrong("split_needlessly", (F.col("last") > 0) & (F.col("longest") <= capacity)))
