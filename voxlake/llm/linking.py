"""Exact links among items that share keys, without emitting the pairs of a group.

Items are posted under keys; two items can be linked only if they share one.

1. A key's posting list is dropped if it has one item, or if another key has the
   same items (a count and a hash of the members tell, aggregated before the shuffle).
   Where linked items share several keys, items that share fewer with any others go too.
2. A list of more than `bound` items is dealt into blocks, each with two pivots of
   the whole list. Inside a list or block, sketches are compared only for pairs not
   yet connected, and only a spanning forest leaves the task. Near copies of one
   text, however many, become one component here at a cost in proportion to their number.
3. Of the lists that were dealt, those whose items are all in one component are done.
   In the others two items of different components may still have to meet. The items
   outside the largest component (the probes) meet all others, block by block, at a
   cost in proportion to the list while they are at most `bound`. Lists with more of them
   first get finer keys (if the caller has them; no pair is lost by them).
4. The components of the sketches' graph are cells. Small cells are confirmed on
   whole texts in one room. In a large cell every item first meets the least item
   it was connected to; then 3. is done again with texts, for lists whose items
   aren't in one confirmed component: lists under keys of the whole texts, if the caller
   has such keys (the long ones are dealt as in 2. first), else the first ones. Rooms are
   bounded by items and by bytes.
5. Components of the confirmed links are the classes.

A pair that shares a key is compared in every case, whatever the sizes, unless its
items are connected already; so the classes don't depend on the bounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_groups, components, materialize, release

EDGE = "a long, b long"
#: Items of a room, if the caller names no other number.
BOUND = 200


def forest(n: int, hits: Callable[[int, np.ndarray], np.ndarray], classes: np.ndarray | None = None, probes: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Edges that connect 0..n-1 as the links do; hits(i, others) tells which others i is linked to.

    classes: what is connected already. probes: only pairs with a probe are asked for. Connected pairs never are.
    """
    own = np.arange(n) if classes is None else np.unique(classes, return_inverse=True)[1]
    ask = np.ones(n, bool) if probes is None else probes
    for i in np.flatnonzero(ask):
        open_ = own != own[i]
        open_[:i] &= ~ask[:i]  # two probes meet once
        others = np.flatnonzero(open_)
        if not len(others):
            continue
        hit = others[hits(i, others)]
        if len(hit):
            tops, at = np.unique(own[hit], return_index=True)
            for j in hit[at]:
                yield int(i), int(j)
            own[np.isin(own, tops)] = own[i]


def sharing_lists(postings: DataFrame, least: int = 1) -> DataFrame:
    """(key, item, n): the lists of two different items or more, one for each set of items. A row of postings is a different (key, item) each.

    least: items that share fewer of their keys with others are left out.
    """
    member = F.xxhash64("item")
    facts = postings.groupBy("key").agg(F.count("*").alias("n"), F.min("item").alias("a"), F.max("item").alias("b"), F.bit_xor(member).alias("x")).where("a <> b")
    keys = materialize(facts.groupBy("n", "a", "b", "x").agg(F.min("key").alias("key"), F.count("*").alias("c")).select("key", "n", "c"), "keys")
    lists = postings.join(keys, "key").select("key", "item", "n", "c")
    if least > 1:  # an item has as many rows as it has keys at most
        lists = lists.withColumn("c", F.sum("c").over(Window.partitionBy("item"))).where(F.col("c") >= least)
    lists = materialize(lists.select("key", "item", "n"), "lists")
    release(keys)
    return lists


def dealt(lists: DataFrame, bound: int, room_bytes: int | None = None) -> DataFrame:
    """(key, item): long lists as blocks of about `bound` items, the least and the greatest item of the list in each block.

    room_bytes: what the texts of a block may have together; lists then has the bytes of a list as w.
    """
    blocks = F.ceil(F.col("n") / bound)
    if room_bytes is not None:
        blocks = F.greatest(blocks, F.ceil(F.col("w") / room_bytes))
    block = F.when(F.col("n") > bound, F.xxhash64("key", F.pmod(F.xxhash64("item", "key"), blocks))).otherwise(F.col("key"))
    rows = lists.select(block.alias("key"), "item")
    ends = lists.where(F.col("n") > bound).groupBy("key").agg(*(F.first(c).alias(c) for c in ("n", "w") if c in lists.columns), F.min("item").alias("a"), F.max("item").alias("b"))
    number = F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1)).alias("o")
    ends = ends.select("key", number, F.array("a", "b").alias("ends")).select(F.xxhash64("key", "o").alias("key"), F.explode("ends").alias("item"))
    return rows.unionByName(ends)


def crossing(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, item, label, weight, probe, u, n, uw, w): lists with items of different labels. Probes are the items outside the list's commonest label."""
    rows = lists.join(labels, "item").select("key", "item", "label", "weight")
    per = rows.groupBy("key", "label").agg(F.count("*").alias("c"), F.sum("weight").alias("cw"))
    top = F.max(F.struct("c", "label", "cw"))
    facts = per.groupBy("key").agg(top.alias("top"), F.sum("c").alias("n"), F.sum("cw").alias("w"), F.count("*").alias("k")).where("k > 1")
    facts = materialize(facts.select("key", F.col("top.label").alias("commonest"), (F.col("n") - F.col("top.c")).alias("u"), (F.col("w") - F.col("top.cw")).alias("uw"), "n", "w"), "facts")
    return materialize(rows.join(facts, "key").withColumn("probe", F.col("label") != F.col("commonest")).drop("commonest"), "crossing")


def refined(crossed: DataFrame, labels: DataFrame, finer: Callable[[DataFrame], DataFrame] | None, bound: int) -> DataFrame:
    """crossing()'s lists, those with more than `bound` probes under finer keys."""
    many = F.col("u") > bound  # and so n too
    hot = crossed.where(many).select("key", "item")
    if finer is None or not hot.limit(1).count():
        return crossed
    keys = materialize(finer(hot).distinct(), "finer", texts=True)
    again = crossing(sharing_lists(keys).select("key", "item"), labels)
    release(keys)
    return crossed.where(~many).unionByName(again)


def rooms(crossed: DataFrame, bound: int, room_bytes: int) -> DataFrame:
    """(key, item, label, probe): every probe meets every item of its list, in rooms of about `bound` items and `room_bytes`."""
    fits = (F.col("n") <= bound) & (F.col("w") <= room_bytes)
    small = crossed.where(fits).select("key", "item", "label", "probe")
    parts = lambda n, w: F.greatest(F.lit(1).cast("long"), F.ceil(F.col(n) * 2 / bound), F.ceil(F.col(w) * 2 / room_bytes)).cast("long")
    long = crossed.where(~fits).withColumns({"mu": parts("u", "uw"), "mn": parts("n", "w"), "h": F.xxhash64("item", "key")})
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.col(m) - 1))
    asking = long.where("probe").withColumns({"ub": F.pmod("h", "mu"), "nb": every("mn")})
    asked = long.withColumns({"nb": F.pmod("h", "mn"), "ub": every("mu"), "probe": F.lit(False)})
    room = lambda d: d.select(F.xxhash64("key", "ub", "nb").alias("key"), "item", "label", "probe")
    return small.unionByName(room(asking)).unionByName(room(asked))


def least_first(t: pa.Table, value: str) -> tuple[np.ndarray, list, np.ndarray | None, np.ndarray | None]:
    """Items of a room in rising order with their values, labels and probes, so that equal edges of different rooms are one."""
    items = t.column("item").to_numpy()
    order = np.argsort(items, kind="stable")
    values = t.column(value).to_pylist()
    more = [t.column(c).to_numpy(zero_copy_only=False)[order] if c in t.column_names else None for c in ("label", "probe")]
    return items[order], [values[i] for i in order], *more


def linked(df: DataFrame, value: str, hits_of: Callable) -> DataFrame:
    """The edges of each room's forest, the smaller item first. hits_of(values, probes) gives forest()'s hits."""

    def each(_key, t):
        if t.num_rows > 1:
            items, values, labels, probes = least_first(t, value)
            for i, j in forest(len(items), hits_of(values, probes), labels, probes):
                if items[i] != items[j]:
                    yield int(min(items[i], items[j])), int(max(items[i], items[j]))

    return by_groups(df, each, EDGE)


def link_items(
    postings: DataFrame, sketches: DataFrame, texts_of: Callable[[DataFrame], DataFrame], *, near: Callable, confirm: Callable,
    finer: Callable[[DataFrame], DataFrame] | None = None, prefixes: Callable[[DataFrame], DataFrame] | None = None, least: int = 1, bound: int = BOUND, cell_bound: int = BOUND, room_bytes: int = 1 << 25,
) -> DataFrame:
    """(node, comp) for the items that are linked to another one.

    postings: (key, item), distinct; sketches: (item, sketch, weight), weight being the bytes of the item's text;
    texts_of(items) gives (item, text) of the asked items. near(sketches, probes) and confirm(texts, probes) give hits
    for forest(): pairs worth confirming, and links on whole texts. finer(rows (key, item) of long lists) gives (key, item)
    such that two items that share a long list and are linked share a finer key or a list that isn't long. prefixes(rows (item, room, text)) gives
    distinct (key, item) such that two items of a room that are linked share a key. least: items that are near share as many keys.
    """
    lists = sharing_lists(postings, least)
    drawn = sketches.select("item", "sketch")
    edges = materialize(linked(dealt(lists, bound).join(drawn, "item"), "sketch", near), "edges")
    cells = components(edges)
    long = lists.where(F.col("n") > bound)
    if long.limit(1).count():
        held = materialize(own_labels(long, cells, sketches), "labels")
        again = refined(crossing(long.select("key", "item"), held), held, finer, bound)
        met = linked(rooms(again, bound, 1 << 62).join(drawn, "item"), "sketch", near)
        first, edges = edges, materialize(edges.unionByName(met), "edges")
        release(first, held, cells)
        cells = components(edges)
    members = cells.select(F.col("node").alias("item"), "comp").join(sketches.select("item", "weight"), "item")
    sizes = materialize(members.groupBy("comp").agg(F.count("*").alias("size"), F.sum("weight").alias("bytes")), "sizes")
    sized = materialize(members.join(sizes, "comp"), "cells")
    is_small = (F.col("size") <= cell_bound) & (F.col("bytes") <= room_bytes)
    small = sized.where(is_small).select(F.xxhash64("comp").alias("key"), "item")
    large = sized.where(~is_small).select("item", "comp", "weight")
    if not large.limit(1).count():
        out = components(linked(small.join(texts_of(small.select("item")), "item"), "text", confirm))
        release(lists, edges, cells, sizes, sized)
        return out
    texts = materialize(texts_of(sized.select("item")), "texts", texts=True)
    done = materialize(linked(small.join(texts, "item"), "text", confirm), "done")
    # Every item of a large cell and the least item that the sketches connected it to.
    star = edges.join(large.select(F.col("item").alias("b"), F.col("weight")), "b").groupBy("b").agg(F.min("a").alias("a"), F.first("weight").alias("weight"))
    rays = star.groupBy("a").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    parts = F.greatest(F.ceil(F.col("n") / bound), F.ceil(F.col("w") / room_bytes)).cast("long")
    rays = materialize(rays.select("a", parts.alias("m")), "rays")
    leaf = star.join(rays, "a").select(F.xxhash64("a", F.pmod(F.xxhash64("b"), "m")).alias("key"), F.col("b").alias("item"), F.lit(False).alias("probe"))
    root = rays.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("o")).select(F.xxhash64("a", "o").alias("key"), F.col("a").alias("item"), F.lit(True).alias("probe"))
    direct = materialize(linked(leaf.unionByName(root).join(texts, "item"), "text", confirm), "direct")
    held = materialize(own_labels(large, components(direct), sketches), "labels")
    if prefixes is None:
        in_cell = lists.join(large.select("item", "comp"), "item").select(F.xxhash64("comp", "key").alias("key"), "item")
    else:
        split = large.join(held, "item").groupBy("comp").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("comp")
        asked = large.join(split, "comp").select("item", F.col("comp").alias("room")).join(texts, "item").select("item", "room", "text")
        posted = materialize(prefixes(materialize(asked, "room-texts", texts=True)), "posted", texts=True)
        shared = sharing_lists(posted)
        # Near copies of one text become one component at a cost in proportion to their number, as in the sketches' lists.
        weighed = shared.where(F.col("n") > bound).join(held.select("item", "weight"), "item")
        weights = weighed.groupBy("key").agg(F.sum("weight").alias("w"))
        blocks = dealt(materialize(weighed.join(weights, "key").select("key", "item", "n", "w"), "weighed"), bound, room_bytes)
        direct = materialize(direct.unionByName(linked(blocks.join(texts, "item"), "text", confirm)), "direct")
        held = materialize(own_labels(large, components(direct), sketches), "labels")
        in_cell = shared.select("key", "item")
    across = materialize(linked(rooms(crossing(in_cell, held), bound, room_bytes).join(texts, "item"), "text", confirm), "across")
    out = components(done.unionByName(direct).unionByName(across))
    release(lists, edges, cells, sizes, sized, texts, done, rays, direct, held, across)
    return out


def own_labels(items: DataFrame, comps: DataFrame, sketches: DataFrame) -> DataFrame:
    """(item, label, weight): the component of each item, or the item itself."""
    asked = items.select("item").distinct().join(sketches.select("item", "weight"), "item")
    return asked.join(comps, asked.item == comps.node, "left").select("item", F.coalesce("comp", "item").alias("label"), "weight")
