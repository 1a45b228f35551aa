"""Leader clustering: greedy deduplication of records in order, and the first leaders.

A group's rows in order are cut into chunks. A chunk's result depends on the leaders of
earlier chunks that reach it, so chunks form a graph. A work list goes over it: all
chunks of a window are swept side by side from the leaders known so far, then only
those whose leaders-in-reach have changed since. A chunk is settled once all before it
are, and most are after one or two rounds. Windows grow by a factor, so that the leaders
of the first chunks clear what they cover before many chunks find leaders of their own:
a group of like rows takes as many windows as the logarithm of its chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from ..sources.paths import kept
from .datasets import numbered

#: Growth of the windows for whole groups, and where only the first leaders are wanted.
WIDE, NARROW = 8, 2


def _euclidean(point, points):
    return (((points - point) ** 2).sum(axis=1)) ** 0.5


def _sweep(order, points, labels, seeds, cut_off: float, distance, most: int | None = None):
    """Leads and clusters of rows in order, after the leaders ``seeds`` (order, points, labels).

    Goes from leader to leader: each covers the later rows that are near, so a row's
    cluster ends up as its last near leader. Stops after ``most`` leaders.
    """
    import numpy as np

    n = len(order)
    covered, cluster, leads = np.zeros(n, dtype=bool), np.array(labels, dtype=object), np.zeros(n, dtype=bool)

    def cover(at, point, label, first: int) -> None:
        last = int(np.searchsorted(order, at + cut_off, side="right"))
        if last > first:
            near = first + np.flatnonzero(distance(point, points[first:last]) < cut_off)
            covered[near] = True
            cluster[near] = label

    for at, point, label in zip(*seeds, strict=True):
        cover(at, point, label, 0)
    k = found = 0
    while most is None or found < most:
        # the next row that no leader covers
        while k < n:
            ahead = covered[k : k + 1024]
            step = int(np.argmin(ahead))
            if not ahead[step]:
                k += step
                break
            k += len(ahead)
        if k >= n:
            break
        leads[k] = True
        found += 1
        cover(order[k], points[k], labels[k], k + 1)
        k += 1
    return leads, cluster


def _chunks(records: DataFrame, group: str, order: str, label: str, coordinates: list[str], chunk_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """(_g, _chunk, _order, _label, _x; _g, _chunk, _low where some group has several chunks)."""
    picked = records.select(F.col(group).alias("_g"), F.col(order).cast("double").alias("_order"), F.col(label).alias("_label"), F.array(*(F.col(c).cast("double") for c in coordinates)).alias("_x"))
    large = kept(picked.groupBy(F.col("_g").alias("_h")).agg(F.count("*").alias("_n")).filter(F.col("_n") > chunk_rows).select("_h"), "large-groups")
    if large.isEmpty():
        return picked.withColumn("_chunk", F.lit(0)), None
    among = F.col("_g").eqNullSafe(F.col("_h"))
    ranked = numbered(picked.join(large, among, "left_semi"), [F.col("_order"), F.col("_label")], by="_g")
    cut = ranked.withColumn("_chunk", F.floor((F.col("_n") - 1) / chunk_rows).cast("int")).drop("_n")
    rows = kept(cut.unionByName(picked.join(large, among, "left_anti").withColumn("_chunk", F.lit(0))), "chunks")
    return rows, kept(rows.groupBy("_g", "_chunk").agg(F.min("_order").alias("_low")), "chunk-heads")


def _at(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """``rows`` joined by group and chunk with ``keys``, whose other columns come along."""
    named = keys.withColumnsRenamed({"_g": "_kg", "_chunk": "_kc"})
    return rows.join(named, F.col("_g").eqNullSafe(F.col("_kg")) & (F.col("_chunk") == F.col("_kc")), how).drop("_kg", "_kc")


def _swept(chunks: DataFrame, seeds: DataFrame | None, cut_off: float, distance, most: int | None) -> DataFrame:
    """The rows of the chunks with cluster and lead, after the leaders ``seeds``."""
    kinds = dict(chunks.dtypes)
    columns = ["_g", "_chunk", "_order", "_label", "_x"]

    def run(rows, seen=None):
        import numpy as np

        if not len(rows):
            return rows.assign(cluster=rows["_label"], lead=False)[[*columns, "cluster", "lead"]]
        rows = rows.sort_values(["_order", "_label"], kind="stable")
        width = len(rows["_x"].iloc[0])
        stacked = lambda f: np.array(f["_x"].tolist(), dtype=float).reshape(len(f), width)
        before = ([], [], [])
        if seen is not None and len(seen):
            seen = seen.sort_values(["_order", "_label"], kind="stable")
            before = (seen["_order"].tolist(), stacked(seen), seen["_label"].tolist())
        leads, cluster = _sweep(rows["_order"].to_numpy(), stacked(rows), rows["_label"].to_numpy(), before, cut_off, distance, most)
        return rows.assign(cluster=cluster, lead=leads)[[*columns, "cluster", "lead"]]

    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + f", cluster {kinds['_label']}, lead boolean"
    alone = chunks.select(*columns).groupBy("_g", "_chunk")
    if seeds is None:
        return alone.applyInPandas(lambda rows: run(rows), schema)
    return alone.cogroup(seeds.groupBy("_g", "_chunk")).applyInPandas(lambda rows, seen: run(rows, seen), schema)


def _in_reach(leaders: DataFrame, heads: DataFrame, cut_off: float) -> DataFrame:
    """_g, _chunk, _order, _label, _x: for each chunk the leaders of earlier ones that can be near its rows.

    A leader reaches a later chunk if the chunk begins within ``cut_off`` of it in order,
    so both meet in a cell of that size or in neighbouring ones.
    """
    cell = lambda c: F.floor(F.col(c) / cut_off)
    spread = leaders.select("_g", F.col("_chunk").alias("_from"), "_order", "_label", "_x", F.explode(F.array(cell("_order"), cell("_order") + 1)).alias("_cell"))
    later = heads.select(F.col("_g").alias("_h"), "_chunk", "_low", cell("_low").alias("_there"))
    met = spread.join(later, F.col("_g").eqNullSafe(F.col("_h")) & (F.col("_cell") == F.col("_there")))
    return met.filter((F.col("_chunk") > F.col("_from")) & (F.col("_low") - F.col("_order") <= cut_off)).select("_g", "_chunk", "_order", "_label", "_x")


def _settled(chunks: DataFrame, heads: DataFrame, fixed: DataFrame | None, cut_off: float, distance, most: int | None) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """Sweeps the chunks of ``heads`` until none changes, after the settled leaders ``fixed``.

    Gives the swept tables of all rounds, the round that counts for each chunk
    (_g, _chunk, _round), and the leaders.
    """
    tables: list[DataFrame] = []
    state = leaders = None
    while True:
        known = [t for t in (fixed, leaders) if t is not None]
        seeds = None
        if known and cut_off > 0:
            every = known[0] if len(known) == 1 else known[0].unionByName(known[1])
            seeds = kept(_in_reach(every, heads, cut_off), "seeds")
            mark = seeds.groupBy("_g", "_chunk").agg(F.count("*").alias("_k"), F.sum(F.xxhash64("_order", "_label").cast("decimal(38,0)")).alias("_s"))
            now = _at(heads.select("_g", "_chunk"), mark, "left")
        else:
            now = heads.select("_g", "_chunk", F.lit(None).cast("long").alias("_k"), F.lit(None).cast("decimal(38,0)").alias("_s"))
        if state is not None:
            used = state.select("_g", "_chunk", F.col("_k").alias("_uk"), F.col("_s").alias("_us"))
            now = _at(now, used, "inner").filter(~(F.col("_k").eqNullSafe(F.col("_uk")) & F.col("_s").eqNullSafe(F.col("_us")))).drop("_uk", "_us")
        now = kept(now.withColumn("_round", F.lit(len(tables))), "work-list")
        if now.isEmpty():
            return tables, state.select("_g", "_chunk", "_round"), leaders
        keys = now.select("_g", "_chunk")
        swept = kept(_swept(_at(chunks, keys, "left_semi"), None if seeds is None else _at(seeds, keys, "left_semi"), cut_off, distance, most), "swept")
        tables.append(swept)
        new = swept.filter("lead").select("_g", "_chunk", "_order", "_label", "_x")
        if state is None:
            state, leaders = now, kept(new, "leaders")
        else:
            state = kept(_at(state, keys, "left_anti").unionByName(now), "chunk-rounds")
            leaders = kept(_at(leaders, keys, "left_anti").unionByName(new), "leaders")


def _windows(heads: DataFrame, factor: int):
    """First and last chunk of windows whose lengths grow by ``factor``."""
    last = heads.agg(F.max("_chunk")).first()[0]
    low, length = 0, 1
    while low <= last:
        yield low, low + length - 1
        low, length = low + length, length * factor


def _between(first: int, last: int) -> Column:
    return F.col("_chunk").between(first, last)


def dedupe_greedy(records: DataFrame, group: str, order: str, label: str, coordinates: list[str], cut_off: float, distance=None, chunk_rows: int = 50_000) -> DataFrame:
    """group, label, cluster, is_leader: leader clustering in order of ``order`` (then label).

    A row is a leader when no earlier leader of its group is nearer than
    ``cut_off``; ``cluster`` is the label of the last such leader, or its own.
    ``distance`` (a point, an array of points) gives distances over ``coordinates``,
    Euclidean where left out; it must not be less than the difference in ``order``, so
    rows can't meet beyond ``cut_off`` in it. Labels must be unique in a group. The
    result is that of one sweep over each whole group.
    """
    if order not in coordinates:
        raise ValueError("the order column must be one of the coordinates")
    ship(records.sparkSession)
    chunks, heads = _chunks(records, group, order, label, coordinates, chunk_rows)
    final = lambda rows: rows.select(F.col("_g").alias(group), F.col("_label").alias(label), "cluster", F.col("lead").alias("is_leader"))
    if heads is None:
        return final(_swept(chunks, None, cut_off, distance or _euclidean, None))
    out = settled = None
    for first, last in _windows(heads, WIDE):
        tables, state, leaders = _settled(chunks.filter(_between(first, last)), heads.filter(_between(first, last)), settled, cut_off, distance or _euclidean, None)
        settled = leaders if settled is None else settled.unionByName(leaders)
        for turn, swept in enumerate(tables):
            rows = final(_at(swept, state.filter(F.col("_round") == turn), "left_semi"))
            out = rows if out is None else out.unionByName(rows)
    return out


def select_refine(records: DataFrame, group: str, order: str, label: str, coordinates: list[str], cut_off: float, top_n: int = 10, distance=None, chunk_rows: int = 50_000) -> DataFrame:
    """The rows of the first ``top_n`` leaders of each group (see ``dedupe_greedy``).

    Windows of chunks are swept in turn, each only in the groups that still lack leaders,
    and no chunk further than ``top_n`` leaders need.
    """
    if order not in coordinates:
        raise ValueError("the order column must be one of the coordinates")
    ship(records.sparkSession)
    chunks, heads = _chunks(records, group, order, label, coordinates, chunk_rows)
    if heads is None:
        found = _swept(chunks, None, cut_off, distance or _euclidean, top_n).filter("lead").select("_g", "_order", "_label")
    else:
        found, open_ = None, heads
        for first, last in _windows(heads, NARROW):
            now = kept(open_.filter(_between(first, last)), "window")
            if now.isEmpty():
                break
            _, _, leaders = _settled(_at(chunks, now.select("_g", "_chunk"), "left_semi"), now, found, cut_off, distance or _euclidean, top_n)
            found = leaders if found is None else kept(found.unionByName(leaders), "found")
            full = kept(found.groupBy("_g").agg(F.count("*").alias("_k")).filter(F.col("_k") >= top_n).select(F.col("_g").alias("_h")), "full-groups")
            open_ = heads.join(full, F.col("_g").eqNullSafe(F.col("_h")), "left_anti")
    # few leaders a group were found, so the window is over few rows
    first = found.withColumn("_k", F.row_number().over(Window.partitionBy("_g").orderBy("_order", "_label"))).filter(F.col("_k") <= top_n)
    names = kept(first.select("_g", "_label"), "leaders")
    return records.join(names, F.col(group).eqNullSafe(F.col("_g")) & (F.col(label) == F.col("_label")), "left_semi")
