"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors are put in the order of the grid cells that their leading principal components fall in, cells
being as wide as the farthest that two linked vectors can lie apart. The ordered sequence of each label is cut into
blocks; a tree over them is joined with itself level by level, leaving out intervals whose boxes lie too
far apart. A box spans the components and the length of what they leave over, which bounds distances too. What is left of two
FAN-blocks goes to one task, a vector once; there the recursion goes on to LEAF vectors, which are compared exactly. A task
returns each vector's number of links and a spanning forest, never its pairs; equal vectors are joined as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from .util import Staged, connected_components, parts

#: Vectors that the axes are fitted on at most (those of least hash; any axes give right results), leading components, vectors of a block and of a leaf, and blocks under a node of the tree.
SAMPLE, AXES, BLOCK, LEAF, FAN = 20_000, 6, 512, 128, 8
_SIDES = AXES + 1
_BLOCKS = ", ".join(["block long", "label string", *[f"{e}{i} double" for i in range(_SIDES) for e in ("lo", "hi")], "reps binary", "weights binary", "vectors binary"])
_BOX = [f"{e}{i}" for i in range(_SIDES) for e in ("lo", "hi")]


def axes_of(rows: list[list[float]], d: int) -> np.ndarray:
    """Orthonormal leading axes (d, AXES); zero columns where d is less."""
    out = np.zeros((d, AXES))
    if rows:
        x = np.array([[*r, *[0.0] * (d - len(r))] for r in rows])
        x = x - x.mean(0)
        _, v = np.linalg.eigh(x.T @ x)
        own = v[:, ::-1][:, :AXES]
        out[:, : own.shape[1]] = own
    return out


def placed(u: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """The components of unit vectors, and the length of the rest: distances between these are never larger than those of the vectors."""
    y = u @ axes
    return np.concatenate([y, np.sqrt(np.maximum(0, 1 - (y * y).sum(1, keepdims=True)))], 1)


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def join_blocks(u: np.ndarray, y: np.ndarray, w: np.ndarray, cut: int, least: float, far: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links among rows of unit vectors u; rows below `cut` are one block, the others another (none: the block with itself).

    Returns each row's summed weight of linked rows, and pairs of rows that connect what is linked.
    """
    counts, union, two = np.zeros(len(u), np.int64), _Union(len(u)), cut < len(u)
    todo = [(0, cut, cut, len(u))] if two else [(0, cut, 0, cut)]
    while todo:
        a, b, c, d = todo.pop()
        gap = np.maximum(0, np.maximum(y[a:b].min(0) - y[c:d].max(0), y[c:d].min(0) - y[a:b].max(0)))
        if gap @ gap > far * far:
            continue
        if b - a > LEAF or d - c > LEAF:
            if a == c:
                m = (a + b) // 2
                todo += [(a, m, a, m), (a, m, m, b), (m, b, m, b)]
            elif b - a >= d - c:
                todo += [(a, (a + b) // 2, c, d), ((a + b) // 2, b, c, d)]
            else:
                todo += [(a, b, c, (c + d) // 2), (a, b, (c + d) // 2, d)]
            continue
        near = u[a:b] @ u[c:d].T >= least
        if a == c:
            np.fill_diagonal(near, False)
        if not near.any():
            continue
        counts[a:b] += near @ w[c:d]
        if a != c:
            counts[c:d] += w[a:b] @ near
        first = near.argmax(1)  # each row to its first partner, and each partner to its first row: what remains apart is found below
        some = near.any(1)
        for i in np.flatnonzero(some).tolist():
            union.join(a + i, c + int(first[i]))
        roots_a = np.array([union.find(a + i) for i in range(b - a)])
        roots_c = np.array([union.find(c + j) for j in range(d - c)])
        apart = near & (roots_a[:, None] != roots_c[None, :])
        while apart.any():
            i, j = np.unravel_index(apart.argmax(), apart.shape)
            union.join(a + int(i), c + int(j))
            roots_a = np.array([union.find(a + i) for i in range(b - a)])
            roots_c = np.array([union.find(c + j) for j in range(d - c)])
            apart = near & (roots_a[:, None] != roots_c[None, :])
    return counts, [(union.find(i), i) for i in range(len(u)) if union.find(i) != i]


def _blocks(classes: DataFrame, axes: np.ndarray, far: float) -> DataFrame:
    """Blocks of the ordered sequence; within one all vectors have one label."""
    d = axes.shape[0]

    def unit(b: pa.RecordBatch) -> np.ndarray:
        v = b.column(b.schema.get_field_index("v"))
        lengths = np.diff(v.offsets.to_numpy())
        out = np.zeros((len(lengths), d))
        out[np.repeat(np.arange(len(lengths)), lengths), np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = v.flatten().to_numpy(zero_copy_only=False)
        out /= np.abs(out).max(1, keepdims=True)  # neither squares nor sums run out of range
        return out / np.sqrt((out * out).sum(1, keepdims=True))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = unit(b)
            cells = np.floor(u @ axes / far).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(list(u), pa.list_(pa.float64())), *[pa.array(c) for c in cells.T]], ["label", "rep", "w", "v", *[f"c{i}" for i in range(AXES)]])

    order = ["label", *[f"c{i}" for i in range(AXES)], "rep"]
    celled = classes.select("label", "rep", "w", "v").mapInArrow(place, "label string, rep long, w long, v array<double>, " + ", ".join(f"c{i} int" for i in range(AXES)))
    ordered = celled.repartitionByRange(parts(classes.sparkSession), *order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = None, TaskContext.get().partitionId() << 32

        def full(rows: list, all_: bool) -> tuple[list, list]:
            nonlocal n
            out = []
            label, rep, w, u = rows
            while len(label):
                other = np.flatnonzero(label != label[0])
                same = int(other[0]) if len(other) else len(label)
                if same < BLOCK and same == len(label) and not all_:
                    break
                m = min(same, BLOCK)
                y = placed(u[:m], axes)
                box = [x for lo, hi in zip(y.min(0).tolist(), y.max(0).tolist(), strict=True) for x in (lo, hi)]
                out.append((n, label[0], *box, rep[:m].tobytes(), w[:m].tobytes(), u[:m].tobytes()))
                n += 1
                label, rep, w, u = label[m:], rep[m:], w[m:], u[m:]
            return out, [label, rep, w, u]

        def batch(rows: list) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.string(), *[pa.float64()] * (2 * _SIDES), *[pa.binary()] * 3]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["block", "label", *_BOX, "reps", "weights", "vectors"])

        for b in batches:
            v = b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            own = [*[b.column(i).to_numpy(zero_copy_only=False) for i in range(3)], v]
            done, held = full(own if held is None else [np.concatenate(x) for x in zip(held, own, strict=True)], False)
            if done:
                yield batch(done)
        if held is not None and len(held[0]):
            yield batch(full(held, True)[0])

    return ordered.select("label", "rep", "w", "v").mapInArrow(cut, _BLOCKS)


def _near(far: float):
    gaps = [F.greatest(F.lit(0.0), F.col(f"b.lo{i}") - F.col(f"a.hi{i}"), F.col(f"a.lo{i}") - F.col(f"b.hi{i}")) for i in range(_SIDES)]
    return sum((g * g for g in gaps), F.lit(0.0)) <= far * far


def _numbered(blocks: DataFrame) -> DataFrame:
    """(block, label, node, the box): blocks of a label numbered in their order. Counts by partition give the offsets, so that no task sees all of a label's."""
    own = blocks.select("block", "label", *_BOX).withColumn("part", F.shiftright("block", 32))
    counts = own.groupBy("label", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("label").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(W.partitionBy("label", "part").orderBy("block")) - 1
    met = own.withColumn("within", within).join(counts.select("label", "part", before.alias("before")), ["label", "part"])
    return met.select("block", "label", (F.col("before") + F.col("within")).cast("int").alias("node"), *_BOX)


def _pairs(numbered: DataFrame, far: float, staged: Staged) -> DataFrame:
    """(label, x, y): pairs of a label's blocks by number, x no later than y, whose boxes are near enough; found down a tree over its sequence."""
    levels = [numbered.drop("block")]
    most = numbered.agg(F.max("node")).first()[0] or 0
    while most:
        most //= FAN
        box = [f(c).alias(c) for i in range(_SIDES) for f, c in ((F.min, f"lo{i}"), (F.max, f"hi{i}"))]
        levels.append(staged.put(levels[-1].groupBy("label", F.floor(F.col("node") / FAN).cast("int").alias("node")).agg(*box)))
    pairs = levels[-1].select("label", F.col("node").alias("x"), F.col("node").alias("y"))
    for below in reversed(levels[:-1]):
        child = below.withColumn("up", F.floor(F.col("node") / FAN).cast("int"))
        a, b = child.alias("a"), child.alias("b")
        met = pairs.alias("p").join(a, (F.col("p.label") == F.col("a.label")) & (F.col("p.x") == F.col("a.up"))).join(b, (F.col("p.label") == F.col("b.label")) & (F.col("p.y") == F.col("b.up")) & (F.col("a.node") <= F.col("b.node")) & _near(far))
        pairs = staged.put(met.select("p.label", F.col("a.node").alias("x"), F.col("b.node").alias("y")))
    return pairs


def vector_components(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of `vectors` (vec_id, embedding, label of any plain type).

    Vectors of one label link at a cosine of `least` (above 0) or more. Those that are null, empty, zero or hold null or non-finite
    components, and those without label or vec_id, link with nothing. Rows that repeat a vector (or a whole row) link like any other copies.
    Vectors may differ in length: missing components are 0; of very long ones a task holds 2 * FAN * BLOCK. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    staged = Staged(spark, "gridjoin")
    far = float(np.sqrt(max(0.0, 2 - 2 * least)) + 1e-6)  # more than what sums of rounded numbers can be off by
    x = F.transform("embedding", lambda c: c.cast("double"))
    fit = F.coalesce(F.col("embedding").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(x, lambda c: c != 0), F.lit(False))
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), x.alias("v"), fit.alias("fit"))
    sound = rows.where("fit").select("vec_id", "label", "v")
    classes = staged.put(sound.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("w")))
    d = classes.agg(F.max(F.size("v"))).first()[0] or 0
    sample = [r.v for r in classes.select("v", "rep").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).collect()]
    axes = axes_of([(np.array(r) / np.linalg.norm(r)).tolist() for r in sample if 0 < np.linalg.norm(r) < np.inf], d)
    blocks = staged.put(_blocks(classes, axes, far))
    numbered = staged.put(_numbered(blocks))
    pairs = _pairs(numbered, far, staged)
    tile = lambda c: F.floor(F.col(c) / FAN).cast("int")
    tiled = pairs.select("label", tile("x").alias("tx"), tile("y").alias("ty"), "x", "y")
    side = lambda node, n: F.struct(F.col(node).alias("node"), n.cast("int").alias("side"))
    met = tiled.select("label", "tx", "ty", F.explode(F.array(side("x", F.lit(0)), side("y", (F.col("tx") < F.col("ty"))))).alias("s")).select("label", "tx", "ty", "s.node", "s.side").distinct()
    load = ["reps", "weights", "vectors"]
    sides = met.join(numbered.select("label", "node", "block"), ["label", "node"]).join(blocks.select("block", *load), "block").select("label", "tx", "ty", "side", "block", *load)

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        own = group.sort_by([("side", "ascending"), ("block", "ascending")])
        reps, w = (np.concatenate([np.frombuffer(r, np.int64) for r in own.column(c).to_pylist()]) for c in ("reps", "weights"))
        u = np.concatenate([np.frombuffer(r).reshape(-1, d) for r in own.column("vectors").to_pylist()])
        first = sum(len(r) // 8 for r, s in zip(own.column("reps").to_pylist(), own.column("side").to_pylist(), strict=True) if s == 0)
        counts, forest = join_blocks(u, placed(u, axes), w, first, least, far)
        some = np.flatnonzero(counts)
        reps_l = reps.tolist()
        cols = [[*reps[some].tolist(), *[reps_l[i] for i, _ in forest]], [*[None] * len(some), *[reps_l[j] for _, j in forest]], [*counts[some].tolist(), *[0] * len(forest)]]
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "n"])

    found = staged.put(sides.groupBy("label", "tx", "ty").applyInArrow(compare, "a long, b long, n long"))
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    comps = connected_components(found.where("b is not null").select("a", "b"), staged)
    joined = classes.join(counts, classes["rep"] == counts["a"], "left").join(comps, classes["rep"] == comps["node"], "left")
    by = staged.put(joined.select(F.col("label").alias("_label"), F.col("v").alias("_v"), (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    linked = sound.join(by, (F.col("label") == F.col("_label")) & (F.col("v") == F.col("_v"))).select("vec_id", "n_links", "component_id")
    rest = rows.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
