"""Filling fixed-capacity containers with items (problem 6).

The histogram of lengths is gathered (its size is bounded by the capacity, not by the rows). On the driver, shallow
combinations of few lengths that fill a window below the capacity are enumerated, non-negative least squares finds how
often to repeat each so that the histogram is used up, the counts are rounded down and the residual counts are packed
greedily, largest first. The recipe says, for the k-th item of each length class, which container takes it; items get
their k by a ranking that is spread over salts, so a class that holds a third of all rows is not one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Most classes of length; with no more distinct lengths than this every class is one length.
CLASSES = 192
#: A combination fills at least this share of the capacity.
WINDOW = 0.985
#: Combinations kept for each leading class.
COMBINATIONS = 10
#: Most lengths that the driver gathers and sends to the tasks for a pack. Above this capacity lengths are counted in
#: units of several tokens, rounded up, so that what is gathered stays bounded and containers are never overfull.
MOST_LENGTHS = 1 << 16
#: Items that one salt of the ranking takes, roughly.
ROWS_PER_SALT = 500_000


def nnls(a: np.ndarray, b: np.ndarray, most_steps: int | None = None) -> np.ndarray:
    """Non-negative least squares by the active-set method of Lawson and Hanson."""
    columns = a.shape[1]
    gram, target = a.T @ a, a.T @ b
    x = np.zeros(columns)
    passive = np.zeros(columns, bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(most_steps or 4 * a.shape[0] + 50):
        gradient = target - gram @ x
        gradient[passive] = -np.inf
        k = int(gradient.argmax()) if columns else -1
        if k < 0 or gradient[k] <= tolerance:
            break
        passive[k] = True
        while True:
            at = np.flatnonzero(passive)
            solved = np.linalg.lstsq(gram[np.ix_(at, at)], target[at], rcond=None)[0]
            if solved.min(initial=1) > 0:
                x[:] = 0
                x[at] = solved
                break
            low = solved <= 0
            ratio = x[at][low] / np.maximum(x[at][low] - solved[low], 1e-300)
            x[at] += ratio.min() * (solved - x[at])
            passive[at[x[at] <= 1e-12]] = False
            x[~passive] = 0
            if not passive.any():
                break
    return x


@dataclass(frozen=True)
class Recipe:
    """edges: largest length of each class. patterns: (count of containers, ((class, items of it), ...))."""

    edges: list[int]
    patterns: list[tuple[int, tuple[tuple[int, int], ...]]]


def class_edges(lengths: np.ndarray, counts: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """Upper edges of length classes with about equal shares of the total length."""
    if len(lengths) <= classes:
        return lengths
    mass = np.cumsum(lengths * counts.astype(float))
    cuts = np.searchsorted(mass, np.linspace(0, mass[-1], classes + 1)[1:])
    return lengths[np.unique(np.minimum(cuts, len(lengths) - 1))]


def combinations(edges: np.ndarray, counts: np.ndarray, capacity: int) -> list[dict[int, int]]:
    """Multisets of up to three classes whose lengths fill the window below the capacity."""
    found: list[dict[int, int]] = []
    for a in range(len(edges) - 1, -1, -1):
        best: list[tuple[int, dict[int, int]]] = []
        most = int(min(capacity // edges[a], max(1, counts[a])))
        for times in sorted({most, max(1, most - 1), max(1, most // 2), 1}):
            rest = capacity - times * int(edges[a])
            best.append((rest, {a: times}))
            second = np.flatnonzero(edges[: a + 1] <= rest)
            for b in second[:: max(1, len(second) // 48)][::-1]:
                left = rest - int(edges[b])
                c = int(np.searchsorted(edges[: a + 1], left, side="right")) - 1
                pattern = {a: times}
                pattern[int(b)] = pattern.get(int(b), 0) + 1
                if c >= 0:
                    more = left // int(edges[c])
                    pattern[c] = pattern.get(c, 0) + more
                    left -= more * int(edges[c])
                best.append((left, pattern))
        best.sort(key=lambda x: (x[0], sorted(x[1].items())))
        kept = [p for left, p in best[:COMBINATIONS] if left <= (1 - WINDOW) * capacity] or [best[0][1]]
        found.extend(p for k, p in enumerate(kept) if p not in kept[:k])
    return found


def recipe(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> Recipe:
    """How to fill containers with ``counts`` items of each of the ``lengths`` (ascending, at most the capacity)."""
    if not len(lengths):
        return Recipe([], [])
    edges = class_edges(lengths, counts)
    of = np.searchsorted(edges, lengths)
    left = np.bincount(of, counts, len(edges)).astype(np.int64)
    candidates = combinations(edges, left, capacity)
    a = np.zeros((len(edges), len(candidates)))
    for k, pattern in enumerate(candidates):
        for c, times in pattern.items():
            a[c, k] = times
    # Rows are weighed by length, so that unpacked length, not unpacked items, is made small.
    weight = edges / float(capacity)
    repeats = nnls(a * weight[:, None], left * weight)
    patterns: list[tuple[int, tuple[tuple[int, int], ...]]] = []
    for k in np.argsort(-repeats, kind="stable"):
        count = int(min(np.floor(repeats[k] + 1e-9), min(left[c] // n for c, n in candidates[k].items())))
        if count > 0:
            patterns.append((count, tuple(sorted(candidates[k].items()))))
            for c, n in candidates[k].items():
                left[c] -= count * n
    while left.any():
        room, pattern = capacity, {}
        for c in range(len(edges) - 1, -1, -1):
            n = int(min(left[c], room // int(edges[c])))
            if n:
                pattern[c] = n
                room -= n * int(edges[c])
        count = int(min(left[c] // n for c, n in pattern.items()))
        patterns.append((count, tuple(sorted(pattern.items()))))
        for c, n in pattern.items():
            left[c] -= count * n
    return Recipe([int(e) for e in edges], patterns)


def token_counts(documents: DataFrame) -> DataFrame:
    """``doc_id, tokens``: one token for each UTF-8 byte and one end token; null and empty texts are left out."""
    return documents.filter(F.octet_length("text") > 0).select("doc_id", (F.octet_length("text") + 1).cast("long").alias("tokens"))


def pack(sized: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """``pack_name, container_id, doc_id, piece_i, n_pieces, first_token, tokens``: where every item goes.

    ``sized``: ``doc_id, tokens`` with distinct ids. An item above the capacity is divided into full containers and a
    last piece that is packed like an item; no other item is divided. Null and non-positive sizes take no place. An
    empty table gives no rows.
    """
    spark = sized.sparkSession
    if not capacities or min(capacities.values()) < 1:
        raise ValueError("capacities must be positive")
    units = {name: -(-capacity // MOST_LENGTHS) for name, capacity in capacities.items()}
    sized = sized.select("doc_id", F.col("tokens").cast("long").alias("tokens")).filter("tokens > 0")
    packs = F.array(*(F.struct(F.lit(k).alias("pack_name"), F.lit(v).cast("long").alias("capacity"), F.lit(units[k]).cast("long").alias("unit")) for k, v in capacities.items()))
    by_pack = sized.select("doc_id", "tokens", F.explode(packs).alias("p")).select("doc_id", "tokens", "p.*")
    by_pack = by_pack.withColumn("n_pieces", F.ceil(F.col("tokens") / F.col("capacity")).cast("int"))
    last = F.col("tokens") - (F.col("n_pieces") - 1) * F.col("capacity")
    # Lengths in units; one that fills a container but for less than a unit counts as a full one.
    rounded = F.least(F.ceil(last / F.col("unit")), F.floor(F.col("capacity") / F.col("unit"))).cast("long")
    # At most MOST_LENGTHS rows of each pack.
    histogram = by_pack.groupBy("pack_name", rounded.alias("length")).count().collect()
    classes, ranges, salts = [], [], {}
    for name, capacity in capacities.items():
        rows = sorted((r["length"], r["count"]) for r in histogram if r["pack_name"] == name)
        lengths, counts = np.array([a for a, _ in rows], np.int64), np.array([b for _, b in rows], np.int64)
        found = recipe(lengths, counts, capacity // units[name])
        salts[name] = int(max(8, counts.sum() // ROWS_PER_SALT)) if rows else 1
        classes += [(name, int(n), int(c)) for n, c in zip(lengths, np.searchsorted(found.edges, lengths))] if rows else []
        at = dict.fromkeys(range(len(found.edges)), 0)
        container = 0
        for count, pattern in found.patterns:
            for c, n in pattern:
                ranges.append((name, c, at[c], at[c] + count * n, container, count))
                at[c] += count * n
            container += count

    # Both are bounded: MOST_LENGTHS lengths and, for each pack, the parts of its patterns, of which every class has few.
    class_of = F.broadcast(spark.createDataFrame(classes, "pack_name string, length long, class int"))
    parts = spark.createDataFrame(ranges, "pack_name string, class int, low long, high long, base long, count long")
    ranges_of = F.broadcast(parts.groupBy("pack_name", "class").agg(F.array_sort(F.collect_list(F.struct("low", "base", "count"))).alias("ranges")))
    items = by_pack.withColumn("length", rounded).join(class_of, ["pack_name", "length"])
    salt = F.lit(1)
    for name, n in salts.items():
        salt = F.when(F.col("pack_name") == name, n).otherwise(salt)
    items = items.withColumn("salt", F.pmod(F.xxhash64("doc_id"), salt).cast("int"))
    # The counts of (class, salt) come from the same rows as the ranks; their number is classes times salts.
    offsets = items.groupBy("pack_name", "class", "salt").count()
    before = W.partitionBy("pack_name", "class").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = offsets.select("pack_name", "class", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = W.partitionBy("pack_name", "class", "salt").orderBy("doc_id")
    ranked = items.withColumn("rank", F.row_number().over(within) - 1).join(offsets, ["pack_name", "class", "salt"]).withColumn("rank", F.col("rank") + F.col("offset"))
    # The ranges of a class follow each other from 0, so the last that begins at or before a rank holds it.
    begun = F.size(F.filter("ranges", lambda r: r["low"] <= F.col("rank")))
    placed = ranked.join(ranges_of, ["pack_name", "class"]).withColumn("r", F.element_at("ranges", begun))
    container = F.col("r.base") + (F.col("rank") - F.col("r.low")) % F.col("r.count")
    end = placed.select("pack_name", container.alias("container_id"), "doc_id", (F.col("n_pieces") - 1).alias("piece_i"), "n_pieces", ((F.col("n_pieces") - 1) * F.col("capacity")).alias("first_token"), last.alias("tokens"))
    # The full containers of a divided item hold nothing else and need no number.
    divided = by_pack.filter("n_pieces > 1").select("pack_name", "doc_id", "capacity", "n_pieces", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 2)).alias("piece_i"))
    full = divided.select("pack_name", F.lit(None).cast("long").alias("container_id"), "doc_id", "piece_i", "n_pieces", (F.col("piece_i") * F.col("capacity")).alias("first_token"), F.col("capacity").alias("tokens"))
    return end.unionByName(full)


def fill_report(packed: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """``pack_name, containers, items, pieces, tokens, fill``: how full the containers are, all together.

    Full containers of a divided item, which hold it alone, have a null ``container_id`` and count one each.
    """
    capacity = F.lit(None).cast("long")
    for name, n in capacities.items():
        capacity = F.when(F.col("pack_name") == name, n).otherwise(capacity)
    shared = packed.filter("container_id is not null").groupBy("pack_name").agg(F.max("container_id").alias("last"))
    totals = packed.groupBy("pack_name").agg(F.count_if(F.col("container_id").isNull()).alias("alone"), F.count_if(F.col("piece_i") == 0).alias("items"), F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("tokens"))
    joined = totals.join(shared, "pack_name", "left").withColumn("containers", F.col("alone") + F.coalesce(F.col("last") + 1, F.lit(0)))
    return joined.select("pack_name", "containers", "items", "pieces", "tokens", F.round(F.col("tokens") / (F.col("containers") * capacity), 6).alias("fill"))
