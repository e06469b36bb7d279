"""Similar k-mer sets and their single-linkage clusters, by an index of sketches and exact verification."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import MASH_K, MASH_THRESHOLD, SKETCH
from ..functions.scores import mash_distance, mash_jaccard
from . import sets
from .lineage import cut, drop

#: Least tokens of a set that the index holds, and the chance with which a pair at the threshold may be missed.
KEYS, MISS = 64, 1e-9


def surely_shared(size: int, share: float) -> int:
    """How many of ``size`` drawn tokens two sets share at least, but for a chance of MISS, where ``share`` of all are."""
    below, c = 0.0, 0
    while c < size:
        below += math.comb(size, c) * share**c * (1 - share) ** (size - c)
        if below > MISS:
            break
        c += 1
    return c


def heads(tokens: DataFrame, size: int = SKETCH) -> DataFrame:
    """One row (id, n, f1, f2, sketch) for each set that isn't empty."""
    return sets.heads(tokens, size)


def classes(known: DataFrame) -> DataFrame:
    """(id, rep) of heads: equal sets are one class, told by its smallest id."""
    found = known.select("id", "n", "f1", "f2")
    reps = found.groupBy("n", "f1", "f2").agg(F.min("id").alias("rep"))
    return found.join(reps, ["n", "f1", "f2"]).select("id", "rep")


def representatives(known: DataFrame, member: DataFrame) -> DataFrame:
    """(id, n, keys) of one set of each class."""
    return known.select("id", "n", F.col("sketch").alias("keys")).join(member.where("id = rep").select("id"), "id")


def index(reps: DataFrame, t: float) -> DataFrame:
    """(id, n, token): the tokens by which sets (id, n, keys) meet, and that others have, too.

    Of the least KEYS tokens of the union of two sets, those in both are among the least KEYS of each. With a Jaccard
    similarity of ``t`` that is surely_shared(KEYS, t) of them but for a chance of MISS (for fewer tokens than KEYS: t of
    them, for sure); so a pair meets in one of all but so many of a set's rarest ones."""
    c = F.lit(surely_shared(KEYS, t))
    shared = F.when(F.col("n") < KEYS, F.least(F.ceil(F.lit(t) * F.col("n") - 1e-9), c)).otherwise(c)
    held = reps.select("id", "n", F.explode("keys").alias("token"))
    often = held.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")  # rarer ones come first and meet nothing
    ranked = held.join(often, "token").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ts"))  # KEYS at most
    first = F.slice("ts", F.lit(1), F.greatest(F.size("ts") - F.greatest(shared, F.lit(1)) + 1, F.lit(0)).cast("int"))
    return ranked.select("id", "n", F.explode(first).alias("t")).select("id", "n", F.col("t.token").alias("token"))


def verified(tokens: DataFrame, reps: DataFrame, pairs: DataFrame, t: float) -> DataFrame:
    """(a, b, jaccard) of the pairs (a, b) of at least ``t``, exactly; the keys of reps (id, n, keys) rule out most others before
    sets are made again for the rest."""
    x, y = (reps.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("keys").alias(f"s{c}")) for c in "ab")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, KEYS)
    may = F.size(F.array_intersect(union, F.array_intersect("sa", "sb"))) >= F.when(F.size(union) < KEYS, 0).otherwise(surely_shared(KEYS, t))
    pairs = cut(pairs)  # of known size, so that few pairs are broadcast and no set is shuffled for them
    near = pairs.join(x, "a").join(y, "b").where(F.least("na", "nb") >= F.lit(t - 1e-9) * F.greatest("na", "nb")).where(may).select("a", "b", "na", "nb")
    near = cut(near)
    drop(pairs)
    both = near.join(sets.shared(tokens, near.select("a", "b")), ["a", "b"])
    return both.select("a", "b", (F.col("i") / (F.col("na") + F.col("nb") - F.col("i"))).alias("jaccard"))


def _sides(held: DataFrame, *more: str) -> list[DataFrame]:
    return [held.select("token", F.col("id").alias(c), F.col("n").alias(f"n{c}"), *[F.col(m).alias(f"{m}{c}") for m in more]) for c in "ab"]


def similar_pairs(tokens: DataFrame, threshold: float, k: int) -> DataFrame:
    """(a, b, jaccard, distance) of all pairs of sets (of sets.kmers or sets.shingles) closer than a Mash distance. Classes of
    equal sets meet once; their pairs are spread over the members at the end, since all pairs are asked for."""
    t = mash_jaccard(threshold, k)
    known = cut(heads(tokens, KEYS))
    member = cut(classes(known))
    reps = cut(representatives(known, member))
    drop(known)
    x, y = _sides(cut(index(reps, t)))
    pairs = x.join(y, "token").where("a < b").where(F.least("na", "nb") >= F.lit(t - 1e-9) * F.greatest("na", "nb")).select("a", "b").distinct()
    near = cut(verified(tokens, reps, pairs, t))
    u, v = (member.select(F.col("rep").alias(c), F.col("id").alias(f"m{c}")) for c in "ab")
    spread = near.join(u, "a").join(v, "b").select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b"), "jaccard")
    same = u.join(v.withColumnRenamed("b", "a"), "a").where("ma < mb").select(F.col("ma").alias("a"), F.col("mb").alias("b"), F.lit(1.0).alias("jaccard"))
    return spread.unionByName(same).withColumn("distance", mash_distance(F.col("jaccard"), k)).where(F.col("distance") < threshold)


def linked(tokens: DataFrame, threshold: float, k: int) -> DataFrame:
    """(id, root) of the sets that aren't empty: single linkage below a Mash distance.

    All holders of a token are compared with one of them first; only holders that are still apart then are compared with
    each other, so that a large group of near copies takes as many comparisons as it has members."""
    t = mash_jaccard(threshold, k)
    known = cut(heads(tokens, KEYS))
    member = cut(classes(known))
    reps = cut(representatives(known, member))
    drop(known)
    held = cut(index(reps, t))

    def near(pairs: DataFrame) -> DataFrame:
        return cut(verified(tokens, reps, pairs.distinct(), t).withColumn("distance", mash_distance(F.col("jaccard"), k)).where(F.col("distance") < threshold).select("a", "b"))

    hubs = held.groupBy("token").agg(F.min("id").alias("a"))
    edges = near(held.join(hubs, "token").select("a", F.col("id").alias("b")).where("a <> b"))
    nodes = member.where("id = rep").select("id")
    roots = connected(nodes, edges)
    apart = held.join(roots, "id")
    mixed = apart.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
    x, y = _sides(apart.join(mixed, "token"), "root")
    size = F.least("na", "nb") >= F.lit(t - 1e-9) * F.greatest("na", "nb")
    rest = x.join(y, "token").where("roota < rootb").where(size).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = near(rest)
    if more.limit(1).count():
        roots = connected(nodes, edges.unionByName(more))
    return member.join(roots.select(F.col("id").alias("rep"), "root"), "rep").select("id", "root")


def connected(nodes: DataFrame, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, root): the smallest id reachable, by star contraction of the edges; nodes without one are their own root.

    A round hangs each node's larger neighbours, then its smaller ones, on its smallest; edges only get fewer. It ends when
    every node hangs on a root."""
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    for _ in range(rounds):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p")).select("p.*")
        past, e = e, cut(small.where("u <> v").distinct())
        drop(past)
        hung = e.groupBy("u").agg(F.count("*").alias("n")).join(e.select(F.col("v").alias("u")).distinct().withColumn("root", F.lit(1)), "u", "left")
        if not hung.where("n > 1 or root = 1").limit(1).count():
            return nodes.join(e, nodes["id"] == e["u"], "left").select("id", F.coalesce("v", "id").alias("root"))
    raise RuntimeError("labels did not settle")


def cluster_labels(roots: DataFrame) -> DataFrame:
    """CL-0000 and on, in the order of roots: places within ranges of roots, and where each range begins."""
    ranged = roots.select("root").distinct().repartitionByRange("root").sortWithinPartitions("root")
    placed = cut(ranged.select("root", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    starts = placed.groupBy("part").agg(F.min("at").alias("first"), F.count("*").alias("n"))  # a row for each partition
    starts = starts.withColumn("begin", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = placed.join(F.broadcast(starts), "part").select("root", (F.col("at") - F.col("first") + F.col("begin")).cast("long").alias("k"))
    return roots.join(numbered, "root").select("id", F.format_string("CL-%04d", "k").alias("cluster_id"))


def sketch(tokens: DataFrame) -> DataFrame:
    """(id, sketch): the SKETCH least tokens of each set that isn't empty (all of a smaller one)."""
    return heads(tokens).select("id", "sketch")


def sketch_jaccard(x: Column, y: Column, size: int = SKETCH) -> Column:
    """Jaccard estimate of two bottom sketches: common ones among the least of their union."""
    union = F.slice(F.array_sort(F.array_union(x, y)), 1, size)
    return F.size(F.array_intersect(union, F.array_intersect(x, y))) / F.size(union)


def cluster(sequences: DataFrame, threshold: float = MASH_THRESHOLD, k: int = MASH_K) -> DataFrame:
    """(id, cluster_id): single linkage of sequences (id, sequence) closer than a Mash distance; a sequence without a k-mer is
    alone."""
    roots = linked(sets.kmers(sequences, k), threshold, k)
    return cluster_labels(sequences.select("id").join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root")))
