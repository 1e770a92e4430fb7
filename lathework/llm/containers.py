"""Filling containers of fixed capacity with items, planned on the histogram of lengths.

The plan looks at counts per length only: best fit decreasing, whole groups of
equal containers at a time. Its work depends on the capacity, not on the number
of items. Then every item takes the slot of its rank among the items of its
length. Ranks are counted in small hash buckets, so no length, however common,
is one task's work.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lathework.session import written


def plan_containers(capacity: int, counts: dict[int, int]) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best fit decreasing over ``counts`` (items by size, 0 < size <= capacity): (number of equal containers, [(size, items of it in each)])."""
    groups: dict[int, list[tuple[int, tuple]]] = {}  # free space -> groups of containers, newest last
    spaces: list[int] = []  # free spaces in use, sorted

    def put(free: int, n: int, slots: tuple) -> None:
        if free not in groups:
            groups[free] = []
            insort(spaces, free)
        groups[free].append((n, slots))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            k = bisect_left(spaces, size)
            if k == len(spaces):
                each = min(capacity // size, left)
                n = left // each
                put(capacity - each * size, n, ((size, each),))
                left -= n * each
                continue
            free = spaces[k]
            n, slots = groups[free].pop()
            if not groups[free]:
                del groups[free]
                spaces.pop(k)
            each = min(free // size, max(1, left // n))
            used = min(n, left // each)
            put(free - each * size, used, (*slots, (size, each)))
            if used < n:
                put(free, n - used, slots)
            left -= used * each
    return [(n, list(slots)) for free in sorted(groups) for n, slots in groups[free]]


def slots_of(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """The plan of one spec as ranges of ranks: for each size, ranks ``first_rank`` .. go to containers from ``first_container``, ``each`` to a container."""
    spec, capacity = key
    rows, taken, container = [], {}, 1
    for n, slots in plan_containers(int(capacity), dict(zip(pdf["size"].astype(int), pdf["n"].astype(int)))):
        offset = place = 0
        for size, each in slots:
            first = taken.get(size, 0)
            taken[size] = first + n * each
            rows.append((spec, size, first, first + n * each, container, each, offset, place))
            offset += each * size
            place += each
        container += n
    return pd.DataFrame(rows, columns=["spec_id", "size", "first_rank", "end_rank", "first_container", "each", "offset", "place"])


#: Sum of the capacities up to which the sizes' counts are broadcast, as they have at most so many rows.
MOST_SIZES = 1_000_000
SLOTS = "spec_id int, size long, first_rank long, end_rank long, first_container long, each long, offset long, place long"


def pieces(items: DataFrame, specs: DataFrame) -> DataFrame:
    """Every item once per spec it is in scope of, cut into whole capacities and a rest where it alone exceeds the capacity.

    ``items``: item_id, size, scope; ``specs``: spec_id, capacity, scope (null: all items).
    """
    specs = specs.where("capacity > 0").dropDuplicates(["spec_id"])
    in_scope = items.join(F.broadcast(specs.withColumnRenamed("scope", "spec_scope")), F.col("spec_scope").isNull() | (F.col("spec_scope") == F.col("scope")))  # fixed small table
    parts = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / F.col("capacity")) - 1)
    return in_scope.select("spec_id", "capacity", "item_id", F.col("size").alias("whole"), F.explode(parts).alias("piece")).select(
        "spec_id", "capacity", "item_id", "piece", (F.col("piece") * F.col("capacity")).alias("token_start"), F.least("capacity", F.col("whole") - F.col("piece") * F.col("capacity")).alias("size")
    )


def fill_containers(items: DataFrame, specs: DataFrame, *, per_bucket: int = 50_000) -> DataFrame:
    """A container and place for every item: ``spec_id, container_no, place, item_id, piece, token_start, size, offset``.

    ``items`` (item_id, size, scope) are non-empty; null or zero sizes give no rows, repeated
    rows of an item count once (the largest size). Only an item larger than the capacity is split; ``piece``
    counts from 0, ``token_start`` is where the piece begins in the item and ``offset`` where it lies in its
    container. ``per_bucket`` bounds the items ranked in one group. Empty tables give no rows.
    """
    once = items.where("size > 0 and item_id is not null").groupBy("item_id").agg(F.max("size").cast("long").alias("size"), F.max_by("scope", "size").alias("scope"))
    specs = specs.select(F.col("spec_id").cast("int").alias("spec_id"), F.col("capacity").cast("long").alias("capacity"), "scope")
    cut = written(pieces(once, specs), "containers-pieces")
    histogram = cut.groupBy("spec_id", "capacity", "size").agg(F.count("*").alias("n"))
    plan = histogram.groupBy("spec_id", "capacity").applyInPandas(slots_of, SLOTS)  # a group has at most ``capacity`` rows
    keys = ["spec_id", "size", "bucket"]
    buckets = histogram.select("spec_id", "size", F.ceil(F.col("n") / per_bucket).cast("int").alias("buckets"))
    space = specs.where("capacity > 0").agg(F.sum("capacity").alias("s")).first().s or 0
    if space <= MOST_SIZES:  # there are at most as many sizes as the capacities' sum, so the common ones need no shuffle
        buckets = F.broadcast(buckets)
    placed = cut.join(buckets, ["spec_id", "size"]).withColumn("bucket", F.pmod(F.xxhash64("item_id", "piece"), F.col("buckets")).cast("int"))
    sizes = placed.groupBy(*keys).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("spec_id", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stretches = sizes.withColumn("before", before)
    # of the plan, each bucket of items gets the ranges of ranks that lie in its stretch
    meets = (F.col("first_rank") < F.col("before") + F.col("n")) & (F.col("before") < F.col("end_rank"))
    ranges = stretches.join(plan, ["spec_id", "size"]).where(meets).groupBy(*keys).agg(
        F.first("before").alias("before"), F.array_sort(F.collect_list(F.struct("first_rank", "end_rank", "first_container", "each", "offset", "place"))).alias("ranges")
    )
    ranked = placed.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("item_id", "piece")) - 1)
    slotted = ranked.join(ranges, keys).withColumn("rank", F.col("r") + F.col("before"))
    slot = F.filter("ranges", lambda x: (x["first_rank"] <= F.col("rank")) & (F.col("rank") < x["end_rank"]))[0]
    found = slotted.withColumn("slot", slot).withColumn("i", F.col("rank") - F.col("slot.first_rank"))
    nth = F.expr("i % slot.each")
    return found.select(
        "spec_id", (F.col("slot.first_container") + F.expr("i div slot.each")).alias("container_no"), (F.col("slot.place") + nth + 1).alias("place"),
        "item_id", "piece", "token_start", "size", (F.col("slot.offset") + nth * F.col("size")).alias("offset"),
    )


def fill_report(filled: DataFrame, specs: DataFrame) -> DataFrame:
    """``spec_id, capacity, n_items, n_tokens, n_containers, least_containers, fill``.

    ``fill`` is the share of the containers' space that is used; no packing needs less than ``least_containers``,
    the tokens by the capacity or the items larger than half of it.
    """
    half = F.count_if(F.col("size") * 2 > F.col("capacity"))
    used = filled.join(F.broadcast(specs.select("spec_id", "capacity")), "spec_id").groupBy("spec_id", "capacity").agg(  # fixed small table
        F.count("*").alias("n_items"), F.sum("size").alias("n_tokens"), F.max("container_no").alias("n_containers"), half.alias("large")
    )
    least = F.greatest(F.ceil(F.col("n_tokens") / F.col("capacity")), F.col("large")).alias("least_containers")
    return used.select("spec_id", "capacity", "n_items", "n_tokens", "n_containers", least, (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity"))).alias("fill"))


def rules_report(filled: DataFrame, specs: DataFrame) -> DataFrame:
    """What must hold of a filling: ``spec_id, n_items, n_overfull, n_split, n_gaps``.

    Items placed, containers over capacity, items in several pieces though they fit, and items whose pieces do not
    make up one stretch from 0.
    """
    specs = F.broadcast(specs.select("spec_id", "capacity"))  # fixed small table
    items = filled.groupBy("spec_id", "item_id").agg(F.count("*").alias("pieces"), F.sum("size").alias("tokens"), F.max(F.col("token_start") + F.col("size")).alias("stop"), F.min("token_start").alias("start"))
    by_item = items.join(specs, "spec_id").groupBy("spec_id").agg(
        F.count("*").alias("n_items"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity"))).alias("n_split"), F.count_if((F.col("start") != 0) | (F.col("stop") != F.col("tokens"))).alias("n_gaps")
    )
    boxes = filled.groupBy("spec_id", "container_no").agg(F.sum("size").alias("used"), F.max(F.col("offset") + F.col("size")).alias("top")).join(specs, "spec_id")
    by_box = boxes.groupBy("spec_id").agg(F.count_if((F.col("used") > F.col("capacity")) | (F.col("top") != F.col("used"))).alias("n_overfull"))
    return by_item.join(by_box, "spec_id").select("spec_id", "n_items", "n_overfull", "n_split", "n_gaps")
