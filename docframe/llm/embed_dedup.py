"""Near-duplicate embeddings by a forest of random-projection trees with spill."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.llm.components import components
from docframe.llm.memory import released
from docframe.llm.storage import stored

COSINE = 0.95
#: Trees of a shallow forest; a deeper one has TREES_A_LEVEL more for each level from DEEP on, see forest_trees.
TREES = 5
TREES_A_LEVEL = 3
DEEP = 7
LEAF = 512
#: Half the width of the band about a split whose vectors go to both sides, in standard deviations.
SPILL = 0.08
#: Vectors that are read to place the splits of the upper levels, and vectors of the sample in a fitted node at least.
SAMPLE = 20_000
NODE_SAMPLE = 40
#: Mean cosine from which a node is not split, and sampled vectors needed to tell.
TIGHT = 0.9
TIGHT_LEAST = 8
#: Vectors of a leaf that one task compares with as many others.
BLOCK = 2048
#: Vectors whose cosines with all of a task's are held at once.
ROWS_AT_ONCE = 512
SEED = 20_240_607
#: Largest component of a vector as it travels, in 16-bit steps, and steps of a direction: products of these are
#: whole numbers below 2**53 (up to 2**18 components), so that a sum of them is the same in any order.
STEPS = 32_767
DIRECTION_STEPS = 1 << 20
#: Vectors that a task routes at once.
ROUTED_AT_ONCE = 4096
#: What single precision may add to a cosine's error, for each component.
SINGLE = 2.0**-22
#: Keys of repeated vectors, or of overfull leaves, that are broadcast; more are joined.
BROADCAST_KEYS = 1_000_000
#: Pairs near the limit that are broadcast with a vector each; more are joined.
BROADCAST_PAIRS = 50_000


def usable(vector: Column) -> Column:
    """Not null, not zero, without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def direction(tree: int, level: int, dims: int) -> np.ndarray:
    """The random direction along which all nodes of a level of a tree split, of length 1 and in whole steps."""
    v = np.random.default_rng([SEED, tree, level]).standard_normal(dims)
    return np.rint(v / np.linalg.norm(v) * DIRECTION_STEPS) / DIRECTION_STEPS


def cut_point(p: np.ndarray, band: float) -> float:
    """Where to split projections: of the middle half, the place with the fewest inside the band, so that
    a dense group is not cut through; among equals the nearest to the median."""
    own = np.sort(p)
    places = np.quantile(own, np.linspace(0.25, 0.75, 27))
    inside = np.searchsorted(own, places + band, side="right") - np.searchsorted(own, places - band, side="left")
    return float(places[np.lexsort((np.abs(np.arange(27) - 13), inside))[0]])


def forest_trees(depth: int) -> int:
    """Trees of a forest of that depth: each level cuts some links, so that a deeper tree finds fewer of them."""
    return TREES + TREES_A_LEVEL * max(0, depth - DEEP)


class Forest:
    """Splits of each tree. Upper nodes split where a sample has few vectors; below, where a node has too
    few sampled vectors, all further splits of a branch go through the centre of the last fitted node, so
    that the forest is as small as the sample, however deep it is. A node whose sampled vectors are about
    as close to each other as linked ones is not split: its links would be cut."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int | None = None, spill: float = SPILL) -> None:
        trees = forest_trees(depth) if trees is None else trees
        self.depth, self.trees, self.dims = depth, trees, sample.shape[1] if sample.ndim == 2 else 0
        self.spill = spill
        #: By tree: sorted nodes with cut and deviation; sorted nodes with mean and deviations; sorted whole nodes.
        self.fitted: list[tuple[np.ndarray, np.ndarray]] = []
        self.centre: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.whole: list[np.ndarray] = []
        for t in range(trees):
            nodes: dict[int, tuple[float, float]] = {}
            centres: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            whole: set[int] = set()
            held = {1: sample}
            for level in range(depth):
                along, below = direction(t, level, self.dims), {}
                for node, own in held.items():
                    mean = own.mean(0)
                    if len(own) >= TIGHT_LEAST and mean @ mean >= TIGHT:
                        whole.add(node)
                        continue
                    if len(own) < NODE_SAMPLE and level:
                        centres[node] = (mean, own.std(0))
                        continue
                    p = own @ along
                    nodes[node] = (cut_point(p, spill * float(p.std())), float(p.std()))
                    left = p < nodes[node][0]
                    for k, part in ((2 * node, own[left]), (2 * node + 1, own[~left])):
                        if len(part):
                            below[k] = part
                        else:
                            centres[k] = (mean, own.std(0))
                held = below
            fitted, places = np.array(sorted(nodes), np.int64), np.array(sorted(centres), np.int64)
            self.fitted.append((fitted, np.array([nodes[k] for k in fitted.tolist()]).reshape(-1, 2)))
            self.centre.append((places, *(np.array([centres[k][i] for k in places.tolist()]).reshape(-1, self.dims) for i in (0, 1))))
            self.whole.append(np.array(sorted(whole), np.int64))
        self.directions = np.array([[direction(t, level, self.dims) for level in range(depth)] for t in range(trees)]).reshape(trees, depth, -1)

    def leaves(self, vectors: np.ndarray, tree: int, norm: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for each leaf of the tree that a vector falls into; leaves are numbered in the tree.

        The vectors have length 1, or are whole numbers with the given norms; the leaves of a vector of whole
        numbers are the same wherever they are computed."""
        rows, nodes = np.arange(len(vectors)), np.ones(len(vectors), np.int64)
        # of each path the centre that its splits go through, once it has left the fitted nodes
        last = np.full(len(vectors), -1)
        done_rows, done_nodes = [], []
        fitted, cuts = self.fitted[tree]
        places, means, deviations = self.centre[tree]
        for level in range(self.depth):
            ends = np.isin(nodes, self.whole[tree])
            if ends.any():
                done_rows.append(rows[ends])
                done_nodes.append(nodes[ends])
                rows, nodes, last = rows[~ends], nodes[~ends], last[~ends]
            along = self.directions[tree, level]
            p = vectors @ (along * DIRECTION_STEPS) / DIRECTION_STEPS
            p = (p if norm is None else p / norm)[rows]
            at = np.minimum(np.searchsorted(fitted, nodes), len(fitted) - 1)
            known = fitted[at] == nodes
            new = ~known & (last < 0)
            last[new] = np.searchsorted(places, nodes[new])
            cut, std = cuts[at, 0], cuts[at, 1]
            if not known.all():
                own = last[~known]
                cut[~known], std[~known] = (means * along).sum(1)[own], np.sqrt(((deviations * along) ** 2).sum(1))[own]
            left, right = p < cut + self.spill * std, p >= cut - self.spill * std
            rows = np.concatenate([rows[left], rows[right]])
            nodes = np.concatenate([2 * nodes[left], 2 * nodes[right] + 1])
            last = np.concatenate([last[left], last[right]])
        return np.concatenate([*done_rows, rows]), np.concatenate([*done_nodes, nodes])

    def all_leaves(self, vectors: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) over all trees, by row and leaf; leaves are numbered in the forest."""
        found = [self.leaves(vectors, t, norm) for t in range(self.trees)]
        row = np.concatenate([r for r, _ in found])
        leaf = np.concatenate([n * self.trees + t for t, (_, n) in enumerate(found)])
        order = np.lexsort((leaf, row))
        return row[order], leaf[order]


def _unit(vectors: np.ndarray) -> np.ndarray:
    largest = np.abs(vectors).max(1, keepdims=True)
    scaled = vectors / largest
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column whose lists have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """16-bit whole numbers in the direction of each vector, and how far that direction is from its own, at most."""
    q = np.rint(vectors / np.abs(vectors).max(1, keepdims=True) * STEPS).astype("<i2")
    off = _unit(vectors) - _unit(q.astype(float))
    return q, (np.sqrt((off * off).sum(1)) * 1.001 + 1e-12).astype("<f4")


def _norm(q: np.ndarray) -> np.ndarray:
    return np.sqrt((q * q).sum(1))


def _record(dims: int) -> np.dtype:
    """A vector as it travels."""
    return np.dtype([("node", "<i8"), ("weight", "<i8"), ("off", "<f4"), ("q", "<i2", (dims,))])


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    size = pc.list_value_length(batch["vector"]).to_numpy()
    for dims in np.unique(size).tolist():
        yield dims, batch.filter(pa.array(size == dims))


def _placed(forests, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: (place of its leaves in the numbering, records, row, leaf). A short table of vectors is one leaf."""
    for dims, own in _by_size(batch):
        q, off = quantised(_matrix(own["vector"]))
        records = np.zeros(len(q), _record(dims))
        records["node"], records["weight"] = own["node"].to_numpy(), own["weight"].to_numpy()
        records["off"], records["q"] = off, q
        forest = forests.get(dims)
        if forest is None:
            yield dims, records, np.arange(len(q)), np.zeros(len(q), np.int64)
        else:
            numbers = q.astype(float)
            yield dims, records, *forest.all_leaves(numbers, _norm(numbers))


def _leaf_counter(forests) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dims, _, _, leaf in _placed(forests.value, b):
                leaf, n = np.unique(leaf, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), dims, np.int32)), pa.array(leaf), pa.array(n)], ["dims", "leaf", "n"])

    return count


def _router(forests) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ROUTED_AT_ONCE):
                for dims, records, row, leaf in _placed(forests.value, batch.slice(at, ROUTED_AT_ONCE)):
                    size = records.dtype.itemsize
                    data = records[row].tobytes()
                    blobs = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(np.arange(0, len(data) + 1, size, dtype=np.int32)), pa.py_buffer(data)])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), dims, np.int32)), pa.array(leaf), pa.array(records["node"][row]), blobs], ["dims", "leaf", "node", "blob"])

    return route


def _compare(forests, least: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def compare(group: pd.DataFrame) -> pd.DataFrame:
        """Links between two parts of a leaf (or in one part), each counted in its lowest common leaf only.

        Of sure links, one row for each vector: the smallest node it reaches here and the weight it links with. Of
        pairs too close to the limit for 16 bits to tell, a row for each."""
        dims, leaf, lo, hi = (int(group[c].iloc[0]) for c in ("dims", "leaf", "lo", "hi"))
        held = np.sort(np.frombuffer(b"".join(group["blob"]), _record(dims)), order="node")
        numbers = held["q"].astype(float)
        norm = _norm(numbers)
        unit = (numbers / norm[:, None]).astype(np.float32)
        # the pairs inside a part belong to the task of the part and the next one
        first = _part(held["node"], group, lo) if lo != hi else np.ones(len(held), bool)
        parts = int(group["parts"].iloc[0])
        inner = np.where(first, (lo + 1) % parts == hi, (hi + 1) % parts == lo)
        some, near, sure = _near(unit, held["off"] + np.float32(SINGLE * dims / 2), least, first, inner)
        if not len(some):
            return pd.DataFrame({"a": [], "b": [], "n": [], "sure": []}).astype({"a": "int64", "b": "int64", "n": "int64", "sure": bool})
        ids, weight = held["node"][some], held["weight"][some].astype(float)
        forest = forests.value.get(dims)
        if forest is not None:
            row, at = forest.all_leaves(numbers[some], norm[some])
            lower = at < leaf
            known, at = np.unique(at[lower], return_inverse=True)
            if len(known):
                own = np.zeros((len(some), len(known)), np.float32)
                own[row[lower], at] = 1
                near &= own @ own.T == 0
        sure &= near
        links = (sure * weight[None, :]).sum(1).astype(np.int64)
        label = np.arange(len(ids))
        while True:
            new = np.minimum(np.where(sure, label[None, :], len(ids)).min(1), label)
            if np.array_equal(new, label):
                break
            label = new
        linked = links > 0
        x, y = np.nonzero(np.triu(near & ~sure))
        return pd.DataFrame(
            {
                "a": np.concatenate([ids[linked], ids[x]]),
                "b": np.concatenate([ids[label[linked]], ids[y]]),
                "n": np.concatenate([links[linked], np.zeros(len(x), np.int64)]),
                "sure": np.repeat([True, False], [int(linked.sum()), len(x)]),
            }
        )

    return compare


def _near(unit: np.ndarray, off: np.ndarray, least: float, first: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(some, near, sure): the rows that have a near one, and which of them may link and surely do.

    first: whether a row is of the first of two parts; rows of one part are compared where inner says so."""
    near, sure = np.zeros((len(unit), len(unit)), bool), np.zeros((len(unit), len(unit)), bool)
    for at in range(0, len(unit), ROWS_AT_ONCE):
        rows = slice(at, at + ROWS_AT_ONCE)
        beyond = unit[rows] @ unit.T - np.float32(least)
        doubt = off[rows, None] + off[None, :]
        near[rows], sure[rows] = beyond >= -doubt, beyond > doubt
        near[rows] &= (first[rows, None] != first[None, :]) | inner[rows, None]
    np.fill_diagonal(near, False)
    some = np.flatnonzero(near.any(1))
    return some, near[np.ix_(some, some)], sure[np.ix_(some, some)]


def _part(nodes: np.ndarray, group: pd.DataFrame, lo: int) -> np.ndarray:
    """Whether each node is of the part lo."""
    return np.isin(nodes, group["node"].to_numpy()[group["part"].to_numpy() == lo])


def _verifier(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(len(b), bool)
            for i, (x, y) in enumerate(zip(b["va"], b["vb"], strict=True)):
                u, v = (_unit(np.array([z.as_py()], float))[0] for z in (x, y))
                keep[i] = u @ v >= least
            yield b.select(["a", "b", "wa", "wb"]).filter(pa.array(keep))

    return verify


def _sampled(nodes: DataFrame, sizes: dict[int, int], sample: int, leaf: int, trees: int | None, spill: float) -> dict[int, Forest]:
    """A forest for each length that has more vectors than a leaf, from a share of `sample` vectors in all."""
    out = {}
    total = sum(sizes.values())
    for dims, n in sizes.items():
        want = max(2 * NODE_SAMPLE, sample * n // total)
        share = min(1.0, 1.2 * want / n)
        place = F.pmod(F.xxhash64("node"), F.lit(1 << 30))
        held = nodes.where((F.size("vector") == dims) & (place < int(share * (1 << 30)) + 1)).select("vector").limit(2 * want).toArrow()
        out[dims] = Forest(_unit(_matrix(held["vector"].combine_chunks())), max(0, math.ceil(math.log2(n / leaf))), trees, spill)
    return out


def _either(left: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    """left joined with a stored table of keys, which is broadcast where it is small."""
    return left.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, on, how)


def embedding_groups(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    cosine: float = COSINE,
    trees: int | None = None,
    leaf: int = LEAF,
    spill: float = SPILL,
    sample: int = SAMPLE,
    block: int = BLOCK,
) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors of one length link if their cosine in double precision is `cosine` or more and they meet in a leaf of
    one of `trees` trees (by default as many as the depth of the forest needs). Null and zero vectors, and those with
    null or non-finite components, link with nothing, nor do vectors of different lengths. Equal vectors are one node
    with a weight. Splits are placed by a bounded sample, for each length that has more vectors than a leaf; every
    vector is routed.

    A vector travels to its leaves as 16-bit steps, with a bound on their error. Inside a leaf all vectors are
    compared; a leaf of more than `block` vectors is dealt out in parts, and every two parts are compared in a task
    of their own, one of them with itself too. A pair is counted only in the lowest leaf that it shares, which a task finds by routing again the
    vectors that have a near one, so that tasks return sums by vector and one edge for each vector, not pairs; only a
    pair so near the limit that 16 bits cannot tell is returned, and decided from the vectors themselves.

    n_links counts other rows linked directly, component_id is the smallest id reachable, kept is true where that is
    the row's own. Rows that repeat an id count as vectors of their own, and so do rows with a null id, which never
    names a component: a group without other ids has a null one. Other columns are ignored; an empty table gives an
    empty table.
    """
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)[vector_col]
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("vector"))
    good = rows.where(usable(F.col("vector"))).withColumns({"k": F.xxhash64("vector"), "l": F.xxhash64(F.lit(1), "vector")})
    repeated = stored(good.groupBy("k", "l").count().where("count > 1").select("k", "l"), "repeated-vectors")
    alone = _either(good, repeated, ["k", "l"], "left_anti").select("k", "l", "vector", F.col("vec_id").alias("least"), F.lit(1).cast("long").alias("weight"))
    merged = _either(good, repeated, ["k", "l"], "left_semi").groupBy("k", "l", "vector").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight"))
    nodes = stored(alone.union(merged).withColumn("node", F.monotonically_increasing_id()), "vectors")
    sizes = {r[0]: r[1] for r in nodes.groupBy(F.size("vector")).count().where(F.col("count") > leaf).collect()}
    forests = spark.sparkContext.broadcast(_sampled(nodes, sizes, sample, leaf, trees, spill))
    travelling = nodes.select("node", "weight", "vector")
    counts = travelling.mapInArrow(_leaf_counter(forests), "dims int, leaf long, n long").groupBy("dims", "leaf").agg(F.sum("n").alias("n"))
    wide = stored(counts.where(F.col("n") > block).select("dims", "leaf", F.ceil(F.col("n") / block).cast("int").alias("parts")), "wide-leaves")
    parts = F.coalesce("parts", F.lit(1))
    members = (
        _either(travelling.mapInArrow(released(_router(forests)), "dims int, leaf long, node long, blob binary"), wide, ["dims", "leaf"], "left")
        .withColumns({"parts": parts, "part": F.pmod(F.xxhash64("node"), parts).cast("int")})
        .withColumn("other", F.explode(F.sequence(F.least(F.lit(1), F.col("parts") - 1), F.col("parts") - 1)))
        .withColumn("other", F.pmod(F.col("part") + F.col("other"), F.col("parts")))
        .select("dims", "leaf", "parts", "node", "blob", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
    )
    found = stored(members.groupBy("dims", "leaf", "lo", "hi").applyInPandas(_compare(forests, cosine), "a long, b long, n long, sure boolean"), "links")
    vector_of = lambda c: nodes.select(F.col("node").alias(c), F.col("vector").alias(f"v{c}"), F.col("weight").alias(f"w{c}"))
    doubtful = stored(found.where("not sure").select("a", "b"), "doubtful-links")
    # few pairs go to the vectors, not the vectors to them
    few = F.broadcast if doubtful.count() <= BROADCAST_PAIRS else lambda df: df
    doubtful = vector_of("b").join(few(vector_of("a").join(few(doubtful), "a")), "b")
    told = stored(doubtful.mapInArrow(_verifier(cosine), "a long, b long, wa long, wb long"), "told-links")
    edges = found.where("sure and a <> b").select("a", "b").union(told.select("a", "b"))
    total = (
        found.where("sure").select("a", "n").union(told.select("a", F.col("wb").alias("n"))).union(told.select(F.col("b").alias("a"), F.col("wa").alias("n")))
        .groupBy("a").agg(F.sum("n").alias("n"))
    )
    grouped = nodes.drop("vector").join(components(edges), "node", "left").withColumn("group", F.coalesce("component", "node"))
    names = grouped.groupBy("group").agg(F.min("least").alias("component_id"))
    named = (
        grouped.join(total, grouped["node"] == total["a"], "left").join(names, "group")
        .select("k", "l", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    )
    linked = good.select("k", "l", "vec_id").join(named, ["k", "l"]).select("vec_id", "n_links", "component_id")
    unusable = rows.where(~usable(F.col("vector"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(unusable).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
