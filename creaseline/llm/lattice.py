"""Near-duplicate embeddings by hashing to the E8 lattice (operator 13)."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creaseline.llm.common import components, cut, written

THRESHOLD = 0.9
#: Hash tables, eight-dimensional projections per table, cells probed beside a vector's own one, and the length of
#: a lattice unit.  Two vectors with a cosine of 0.9 share a cell of one table with probability 0.29 (simulated), so
#: that 14 tables find them with 0.99; more similar ones more often.  Vectors at a right angle share none of the
#: tables' cells but with 1e-4.
TABLES, BLOCKS, PROBES, UNIT = 14, 3, 8, 2.0
SEED = 8
#: Rows of a cell that one task compares at a time; larger cells are cut into blocks that meet pairwise.
BLOCK_ROWS = 1024


def _least_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or all of +-1/2 with an even number of minus signs."""
    found = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            found.append(v)
    halves = [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8)]
    return np.array(found + [h for h in halves if (h < 0).sum() % 2 == 0])


NEIGHBOURS = _least_vectors()


def _nearest_even(y: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: where rounding gives an odd one, the worst entry goes the other way."""
    r = np.rint(y)
    away = y - r
    worst = np.abs(away).argmax(axis=-1)[..., None]
    step = np.where(np.take_along_axis(away, worst, -1) >= 0, 1.0, -1.0)
    other = r.copy()
    np.put_along_axis(other, worst, np.take_along_axis(r, worst, -1) + step, -1)
    return np.where((r.sum(axis=-1, keepdims=True) % 2) != 0, other, r)


def nearest_point(y: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the union of the even integer points and their shift by one half."""
    whole, half = _nearest_even(y), _nearest_even(y - 0.5) + 0.5
    closer = ((y - whole) ** 2).sum(axis=-1, keepdims=True) <= ((y - half) ** 2).sum(axis=-1, keepdims=True)
    return np.where(closer, whole, half)


def cells_of(units: np.ndarray) -> np.ndarray:
    """(vectors x TABLES x 1 + PROBES) hashed cells of unit vectors: the own cell, then the nearest neighbouring ones.

    A table projects on BLOCKS times eight random directions and takes the lattice point of each; a probe moves one
    of them to a neighbouring point, the probes being the moves that stay nearest to the projection.
    """
    n, d = units.shape
    random = np.random.default_rng([SEED, d])
    directions = random.standard_normal((d, TABLES * BLOCKS * 8)) / UNIT
    weights = random.integers(1, 2**62, (TABLES, BLOCKS, 8), dtype=np.int64) * 2 + 1
    salts = random.integers(0, 2**62, TABLES, dtype=np.int64)
    y = (units @ directions).reshape(n, TABLES, BLOCKS, 8)
    points = nearest_point(y)
    own = ((2 * points).astype(np.int64) * weights).sum(axis=(2, 3)) + salts
    # |r - v|^2 - |r|^2 of every move v, and what it adds to the hash.
    costs = 2.0 - 2.0 * ((y - points) @ NEIGHBOURS.T)
    moves = (2 * NEIGHBOURS).astype(np.int64) @ weights.transpose(0, 2, 1)
    costs = costs.reshape(n, TABLES, -1)
    best = np.argpartition(costs, PROBES, axis=-1)[..., :PROBES]
    block, move = np.divmod(best, len(NEIGHBOURS))
    added = moves[np.arange(TABLES)[None, :, None], move, block]
    return np.concatenate([own[..., None], own[..., None] + added], axis=-1)


def usable(vector: Column) -> Column:
    """The vector has entries, all of them finite numbers and not all of them zero."""
    good = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vector.isNotNull() & F.coalesce(good, F.lit(False)) & F.coalesce(F.exists(vector, lambda c: c != 0), F.lit(False))


def _units(lists: pa.Array) -> np.ndarray:
    """Unit vectors, as doubles, of equally long lists."""
    rows = np.asarray(lists.flatten()).astype(np.float64).reshape(len(lists), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _hashed(batches):
    for batch in batches:
        lengths = np.asarray(batch.column(1).value_lengths())
        for d in np.unique(lengths):
            part = batch.take(pa.array(np.nonzero(lengths == d)[0]))
            for start in range(0, part.num_rows, 512):
                some = part.slice(start, 512)
                units = _units(some.column(1))
                cells = cells_of(units).reshape(len(units), -1)
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0),
                        pa.array(np.full(len(units), d, dtype=np.int32)),
                        some.column(2),
                        pa.array([u.tobytes() for u in units], pa.binary()),
                        pa.array(list(cells), pa.list_(pa.int64())),
                    ],
                    names=["a", "d", "w", "unit", "cells"],
                )


def _first_meeting(x: np.ndarray, y: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Pairs (rows of x and y, cells of both) whose first common cell is `key`: the least one of the first table with any."""
    alive = np.arange(len(x))
    owned = np.zeros(len(x), dtype=bool)
    none = np.iinfo(np.int64).max
    x, y = x.reshape(-1, TABLES, 1 + PROBES), y.reshape(-1, TABLES, 1 + PROBES)
    for t in range(TABLES):
        if not len(alive):
            break
        p, q = x[alive, t], y[alive, t]
        least = np.full(len(alive), none)
        for k in range(1 + PROBES):
            common = (p[:, k : k + 1] == q).any(axis=1)
            least = np.where(common, np.minimum(least, p[:, k]), least)
        owned[alive] = least == key[alive]
        alive = alive[least == none]
    return owned


def _pairs_within(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j of row numbers inside the given runs."""
    left = np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    partners = np.repeat(starts + sizes, sizes) - left - 1
    i = np.repeat(left, partners)
    j = i + 1 + np.arange(partners.sum()) - np.repeat(np.cumsum(partners) - partners, partners)
    return i, j


def _least_reachable(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n rows the least row that links (i, j) reach."""
    labels = np.arange(n)
    while True:
        lower = labels.copy()
        np.minimum.at(lower, i, labels[j])
        np.minimum.at(lower, j, labels[i])
        lower = lower[lower]
        if (lower == labels).all():
            return labels
        labels = lower


def _compared(threshold: float):
    """Task that takes rows sorted by unit of work (d, key, p, q) and verifies the pairs of each unit.

    Yields per row of a unit with links: its vector, how many rows its partners stand for, and a linked vector
    towards the least one that the unit's links reach, so the output grows with the rows and not with the pairs.
    """

    def work(table: pa.Table):
        n = table.num_rows
        column = lambda c: np.asarray(table.column(c).combine_chunks())
        key, p, q, side, a, w, d = (column(c) for c in ("key", "p", "q", "side", "a", "w", "d"))
        length = int(d[0])
        units = np.frombuffer(b"".join(table.column("unit").to_pylist()), dtype=np.float64).reshape(n, length)
        cells = np.asarray(table.column("cells").combine_chunks().flatten()).reshape(n, -1)
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])])
        starts = np.nonzero(new)[0]
        sizes = np.diff(np.append(starts, n))
        found_i, found_j = [], []
        few = (sizes <= 24) & (p[starts] == q[starts])
        i, j = _pairs_within(starts[few], sizes[few])
        for at in range(0, len(i), 20_000):
            u, v = i[at : at + 20_000], j[at : at + 20_000]
            near = np.einsum("ij,ij->i", units[u], units[v]) >= threshold
            found_i.append(u[near])
            found_j.append(v[near])
        for start, size in zip(starts[~few], sizes[~few]):
            own = slice(start, start + size)
            rows = np.arange(start, start + size)
            same = p[start] == q[start]
            left = rows if same else rows[side[own] == 0]
            right = rows if same else rows[side[own] == 1]
            u, v = np.nonzero(units[left] @ units[right].T >= threshold)
            u, v = left[u], right[v]
            if same:
                u, v = u[u < v], v[u < v]
            found_i.append(u)
            found_j.append(v)
        i, j = np.concatenate(found_i), np.concatenate(found_j)
        keep = np.zeros(len(i), dtype=bool)
        for at in range(0, len(i), 50_000):
            u, v = i[at : at + 50_000], j[at : at + 50_000]
            keep[at : at + 50_000] = _first_meeting(cells[u], cells[v], key[u])
        i, j = i[keep], j[keep]
        if not len(i):
            return
        counts = np.bincount(i, w[j], n) + np.bincount(j, w[i], n)
        root = _least_reachable(n, i, j)
        rows = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_pydict(
            {"a": pa.array(a[rows]), "links": pa.array(counts[rows].astype(np.int64)), "b": pa.array(a[root[rows]])}
        )

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            # Rows of the last unit wait for the next batch; a change of the length of vectors ends a table, too.
            ids = [np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("d", "key", "p", "q")]
            changed = np.zeros(batch.num_rows, dtype=bool)
            for v in ids:
                changed[1:] |= v[1:] != v[:-1]
            if held:
                last = held[-1]
                changed[0] = any(last.column(last.schema.get_field_index(c))[-1].as_py() != batch.column(batch.schema.get_field_index(c))[0].as_py() for c in ("d", "key", "p", "q"))
            borders = np.nonzero(changed)[0]
            if not len(borders):
                held.append(batch)
                continue
            lengths = np.nonzero(np.concatenate([[False], ids[0][1:] != ids[0][:-1]]))[0]
            stops = sorted({int(borders[0]), *map(int, lengths), int(borders[-1])})
            at = 0
            for stop in stops:
                held.append(batch.slice(at, stop - at))
                at = stop
                if sum(b.num_rows for b in held):
                    yield from work(pa.Table.from_batches(held))
                held = []
            held = [batch.slice(at)]
        if held:
            yield from work(pa.Table.from_batches(held))

    return run


def near_vectors(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of `embeddings`: vec_id, n_links, component_id, kept.

    Vectors with a cosine of `threshold` or more (in doubles) are linked; pairs are those that share a cell of a
    table, each verified and counted in the first one.  n_links counts the other rows linked with a row, component_id
    is the smallest vec_id that links reach, and the row with that id is kept.

    Equal vectors are one node of the search, with the number of their rows as its weight.  A cell with many vectors
    is cut into blocks of BLOCK_ROWS that meet pairwise in tasks of bounded size, and a task returns counts and a
    spanning set of links, never the pairs.

    Null, empty and zero vectors, and those with null or non-finite entries, are linked with nothing; neither are
    vectors of different lengths.  Rows that repeat a vec_id are rows of their own (both kept if it is the smallest
    reached).  Rows without vec_id take the smallest id that they reach, null if none, and then are kept.  Other
    columns are ignored.  Empty in, empty out.
    """
    rows = embeddings.select("vec_id", F.when(usable(F.col("embedding")), F.col("embedding")).alias("v"))
    classes = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("low"), F.count("*").alias("w"))
    classes = written(classes.withColumn("a", F.monotonically_increasing_id()), "classes")
    nodes = written(classes.select("a", "v", "w").mapInArrow(_hashed, "a long, d int, w long, unit binary, cells array<long>"), "nodes")
    # Cells of vectors of different lengths never meet: the length is part of the key.
    cells = nodes.select("a", "d", F.explode(F.array_distinct("cells")).alias("key"))
    shared = cells.groupBy("d", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = cells.join(shared, ["d", "key"]).withColumn("parts", F.ceil(F.col("n") / BLOCK_ROWS).cast("int"))
    met = met.withColumn("own", F.pmod(F.xxhash64("a", "key"), F.col("parts")).cast("int"))
    units = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    units = units.select(
        "a", "d", "key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") > F.col("other")).cast("int").alias("side")
    )
    order = ["d", "key", "p", "q"]
    work = units.join(nodes.select("a", "w", "unit", "cells"), "a").repartition(*order).sortWithinPartitions(*order)
    found = cut(work.mapInArrow(_compared(threshold), "a long, links long, b long"))
    counts = found.groupBy("a").agg(F.sum("links").alias("links"))
    labels = components(found.select("a", "b"))
    members = classes.select("a", "v", "low", "w").join(counts, "a", "left").join(labels.withColumnRenamed("node", "a"), "a", "left")
    members = members.withColumn("c", F.coalesce("component", "a"))
    least = members.groupBy("c").agg(F.min("low").alias("component_id"))
    own = members.join(least, "c").select("v", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("links"), "component_id")
    out = rows.join(own, "v", "left")
    component = F.coalesce("component_id", "vec_id")
    kept = F.coalesce(component == F.col("vec_id"), component.isNull())
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), kept.alias("kept"))
