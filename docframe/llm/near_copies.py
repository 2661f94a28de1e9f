"""Near copies by the similarity of word shingles: candidates by SimHash and segment popcounts, then verified exactly."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.llm.components import components
from docframe.llm.memory import released
from docframe.llm.simhash import unary_codes
from docframe.llm.storage import stored

SHINGLE = 5
SIMILARITY = 0.8
#: Bits of a fingerprint, in 64-bit words, and its 2-bit segments.
WORDS = 4
SEGMENTS = 32 * WORDS
#: Share of bits in which the fingerprints of candidates differ at most.
FAR = 0.17
#: Share of segments whose popcounts differ in a pair at the limit of similarity, about, and the share of such
#: pairs that may miss all grids.
UNEQUAL = 0.155
MISSED = 0.02
#: Bits of entropy of a segment's popcount.
SEGMENT_BITS = 1.5
#: Fingerprints that one task compares at once.
BLOCK = 512
#: Bytes of shingles of a part of a cell, about.
PART_BYTES = 1 << 24
#: The distance of fingerprints that are far apart.
APART = np.uint16(1 << 15)
#: Nodes whose texts are read again by a broadcast of their hashes; more are joined.
BROADCAST_NODES = 1_000_000
SEED = 42
DISTINCT_AT_ONCE = 1 << 14


def words_of(text: str | None) -> list[bytes]:
    """Runs of other than ASCII white space, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def fingerprint(words: list[bytes]) -> bytes:
    """The SimHash of the set of words and pairs of words, 256 bits; zero without words.

    A changed word touches three elements of the set, but five shingles of five, so that near copies are nearer than
    by shingles; as a set, common words count once, so that other texts stay far, and pairs tell texts of the same
    words apart.
    """
    every = list(dict.fromkeys([*words, *map(b" ".join, zip(words, words[1:], strict=False))]))
    ones = np.zeros(64 * WORDS, np.int64)
    digest = xxhash.xxh3_128_digest
    for at in range(0, len(every), DISTINCT_AT_ONCE):
        some = b"".join([digest(w, seed) for w in every[at : at + DISTINCT_AT_ONCE] for seed in range(SEED, SEED + WORDS // 2)])
        ones += np.unpackbits(np.frombuffer(some, np.uint8).reshape(-1, 8 * WORDS), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(every), bitorder="little").tobytes()


def shingles(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; of fewer words one, of none none."""
    if not words:
        return np.zeros(0, np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    runs = zip(*(words[k:] for k in range(size)), strict=False) if len(words) >= size else [words]
    return np.unique(np.fromiter((digest(join(r), SEED) for r in runs), np.uint64, max(1, len(words) - size + 1)))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = pa.array([fingerprint(words_of(t.as_py())) for t in b["text"]], pa.binary())
        yield pa.RecordBatch.from_arrays([b["node"], b["doc_id"], fp], ["node", "doc_id", "fp"])


def grids(n: int) -> list[np.ndarray]:
    """For each grid the segments whose popcounts make a cell's address.

    As many segments as tell n fingerprints apart, and as many grids as pairs at the limit of similarity need to
    agree in one of them, but for MISSED: both follow from n alone.
    """
    size = min(39, max(8, math.ceil(math.log2(max(n, 2)) / SEGMENT_BITS)))
    count = math.ceil(math.log(1 / MISSED) / (1 - UNEQUAL) ** size)
    rng = np.random.default_rng(SEED)
    return [rng.choice(SEGMENTS, size, replace=False) for _ in range(count)]


def popcounts(fp: np.ndarray) -> np.ndarray:
    """The embedding of fingerprints (n x WORDS): the number of ones in each 2-bit segment."""
    bits = np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(len(fp), -1), axis=1, bitorder="little")
    return bits[:, ::2] + bits[:, 1::2]


def _address(count: np.ndarray, own: np.ndarray) -> np.ndarray:
    return count[:, own].astype(np.int64) @ (3 ** np.arange(len(own), dtype=np.int64))


def _celled(chosen: list[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b["fp"].to_pylist()
            count = popcounts(np.frombuffer(b"".join(raw), "<u8").reshape(-1, WORDS))
            for grid, own in enumerate(chosen):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(raw), grid, np.int32)), pa.array(_address(count, own)), *b.columns], ["grid", "cell", *b.schema.names])

    return cells


def _apart(fp: np.ndarray) -> np.ndarray:
    """For k cells of s fingerprints (k x s x WORDS) the distances in each cell (k x s x s), APART where more than FAR, and of each to itself."""
    code = unary_codes(fp)
    most = int(FAR * 64 * WORDS)
    # the distance of popcounts is a lower bound of that of fingerprints
    near = np.zeros((*fp.shape[:2], fp.shape[1]), np.uint16)
    for w in range(WORDS):
        near += np.bitwise_count(code[:, :, None, w] ^ code[:, None, :, w])
    far = near > most
    apart = np.zeros(near.shape, np.uint16)
    for w in range(WORDS):
        apart += np.bitwise_count(fp[:, :, None, w] ^ fp[:, None, :, w])
    apart[far | (apart > most) | np.eye(fp.shape[1], dtype=bool)] = APART
    return apart


def _neighbours(ids: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For k cells of s fingerprints (k x s x WORDS): pairs of each one with its nearest, and with the smallest id of its near ones.

    An id that has other near ones, in no such pair with it, is also paired with itself.
    """
    apart = _apart(fp)
    near = apart < APART
    some = near.any(2)
    by_id = np.argsort(ids, axis=1, kind="stable")
    ordered = np.take_along_axis(apart, by_id[:, None, :], 2)
    out_a, out_b = [], []
    for pick in (ordered.argmin(2), (ordered < APART).argmax(2)):
        at = np.take_along_axis(by_id, pick, 1)
        out_a.append(ids[some])
        out_b.append(np.take_along_axis(ids, at, 1)[some])
        cell, row = np.nonzero(some)
        near[cell, row, at[some]] = near[cell, at[some], row] = False
    crowded = near.any(2)
    return np.concatenate([*out_a, ids[crowded]]), np.concatenate([*out_b, ids[crowded]])


def _cell_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        by_size: dict[int, list[int]] = {}
        for i, ids in enumerate(batch["ids"]):
            by_size.setdefault(len(ids), []).append(i)
        a, b = [], []
        for s, rows in by_size.items():
            step = max(1, (1 << 19) // (s * s))
            for at in range(0, len(rows), step):
                some = rows[at : at + step]
                ids = np.stack([np.asarray(batch["ids"][i], np.int64) for i in some])
                fp = np.frombuffer(b"".join(x for i in some for x in batch["fps"][i]), "<u8").reshape(len(some), s, WORDS)
                x, y = _neighbours(ids, fp)
                a.append(np.minimum(x, y))
                b.append(np.maximum(x, y))
        if a:
            yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}).drop_duplicates()


def _compared(cells: DataFrame, full: DataFrame, parts: Column) -> DataFrame:
    """The rows of cells in full, dealt out in parts, once for each two parts (lo, hi) that they are compared in."""
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    return (
        cells.join(full.withColumn("parts", F.ceil(parts).cast("int")), ["grid", "cell"])
        .select(*cells.columns, part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        .select(*cells.columns, "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
    )


def met_in_cells(reps: DataFrame, n: int, block: int = BLOCK) -> DataFrame:
    """Distinct rows (a, b), a <= b, of nodes of rows (node, fp) that meet in a cell of a grid and are not far apart.

    Of the fingerprints compared with it each one is paired with its nearest and with the smallest near one, so
    that a group of many near copies gives some pairs a row, not all. Both nodes of every other pair are also paired
    with themselves: these pairs are left to `other_links`. A cell of more than `block` fingerprints is dealt out in
    parts, and every two parts are compared.
    """
    cells = reps.mapInArrow(_celled(grids(n)), "grid int, cell long, node long, fp binary")
    full = cells.groupBy("grid", "cell").count().where("count > 1")
    compared = (
        _compared(cells, full, F.col("count") / block)
        .repartition("grid", "cell", "lo", "hi")
        .groupBy("grid", "cell", "lo", "hi")
        .agg(F.collect_list(F.struct("node", "fp")).alias("held"))
        .where(F.size("held") > 1)
        .select(F.col("held.node").alias("ids"), F.col("held.fp").alias("fps"))
    )
    return compared.mapInPandas(_cell_pairs, "a long, b long").distinct()


def candidate_pairs(reps: DataFrame, n: int, block: int = BLOCK) -> DataFrame:
    """The pairs (a, b), a < b, of `met_in_cells`."""
    return met_in_cells(reps, n, block).where("a < b")


def _shingled(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = pa.array([shingles(words_of(t.as_py()), size).tobytes() for t in b["text"]], pa.binary())
            yield pa.RecordBatch.from_arrays([b["node"], held], ["node", "shingles"])

    return run


def _verifier(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b["sa"], b["sb"], strict=True):
                u, v = (np.frombuffer(z.as_py(), np.uint64) for z in (x, y))
                both = len(np.intersect1d(u, v, assume_unique=True))
                every = len(u) + len(v) - both
                keep.append(not every or both >= least * every)
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return verify


def _common(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many elements sets x[i] and y[i] share; x ascends."""
    size = np.array([len(u) for u in sets])
    code = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(size)[:-1])
    mine = np.zeros(size.sum() + 1, bool)
    both = np.zeros(len(x), np.int64)
    first, at = np.unique(x, return_index=True)
    for u, lo, hi in zip(first, at, [*at[1:], len(x)], strict=True):
        mine[code[u]] = True
        shared = np.concatenate([[0], np.cumsum(mine[np.concatenate([code[v] for v in y[lo:hi]])])])
        both[lo:hi] = np.diff(shared[np.concatenate([[0], np.cumsum(size[y[lo:hi]])])])
        mine[code[u]] = False
    return both


def _label_links(chosen: list[np.ndarray], least: float) -> Callable[[pa.Table], pa.Table]:
    def links(cell: pa.Table) -> pa.Table:
        grid, lo, hi = (cell[c][0].as_py() for c in ("grid", "lo", "hi"))
        label, part = cell["label"].to_numpy(), cell["part"].to_numpy()
        fp = np.frombuffer(b"".join(cell["fp"].to_pylist()), "<u8").reshape(-1, WORDS)
        size = cell["size"].to_numpy()
        near = np.triu(_apart(fp[None])[0] < APART) & (label[:, None] != label)
        # two parts are compared with each other only, and sets of unlike sizes are not alike
        near &= (part[:, None] != part) | (lo == hi)
        near &= np.minimum(size[:, None], size) >= least * np.maximum(size[:, None], size)
        x, y = np.nonzero(near)
        # a pair that meets in several grids is compared in the first of them
        count = popcounts(fp)
        for own in chosen[:grid]:
            if len(x):
                cells = _address(count, own)
                new = cells[x] != cells[y]
                x, y = x[new], y[new]
        reached = label.copy()
        if len(x):
            used, at = np.unique(np.concatenate([x, y]), return_inverse=True)
            sets = [np.frombuffer(cell["shingles"][int(i)].as_py(), np.uint64) for i in used]
            both = _common(sets, at[: len(x)], at[len(x) :])
            alike = both >= least * (size[x] + size[y] - both)
            x, y = x[alike], y[alike]
            while (reached[x] != reached[y]).any():
                low = np.minimum(reached[x], reached[y])
                np.minimum.at(reached, x, low)
                np.minimum.at(reached, y, low)
        moved = reached != label
        return pa.table({"a": label[moved], "b": reached[moved]})

    return links


def other_links(crowded: DataFrame, held: DataFrame, n: int, least: float, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between labels of rows (node, fp, label, size) that join the labels of all alike pairs of nodes.

    Pairs are all that meet in a cell of a grid and are not far apart, and are alike by their sets in held (node,
    shingles) of that size. All of those with different labels are compared, each in one cell and on whole sets;
    those with one label need no link. Only cells of several labels get the sets. Such a cell is dealt out in parts
    of `block` rows or PART_BYTES of sets, and every two parts are compared; a task returns for each row at most
    one link, to the smallest label that it reaches in the same comparison.
    """
    chosen = grids(n)
    cells = crowded.select("node", "fp", "label", "size").mapInArrow(_celled(chosen), "grid int, cell long, node long, fp binary, label long, size long")
    mixed = cells.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("count"), F.sum("size").alias("sizes"), F.min("label").alias("low"), F.max("label").alias("high"))
    full = mixed.where("low < high").select("grid", "cell", "count", "sizes")
    compared = _compared(cells, full, F.greatest(F.col("count") / block, 8 * F.col("sizes") / PART_BYTES)).join(held, "node")
    return compared.groupBy("grid", "cell", "lo", "hi").applyInArrow(_label_links(chosen, least), "a long, b long").distinct()


def near_copy_keepers(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """One row (doc_id, text_hash) for each group of near copies: that of the smallest id, nulls last.

    Texts link if the Jaccard similarity of their sets of `shingle`-word shingles is `similarity` or more, as found
    among the candidates: all pairs whose SimHash fingerprints meet in a cell of the grids of segment popcounts, and
    are near. Every link is verified on whole texts; groups are the components of the links. Some candidates of each
    text are verified first; of the others, all whose texts these have not put in one group. Nodes are texts by
    xxhash64 (null as empty), so that rows that share an id, or have none, are one group only if their texts are
    near; equal texts are one node. A text of fewer words is one shingle; texts without words are near copies of each
    other. Other columns are ignored; an empty table gives an empty table.
    """
    node = F.xxhash64(F.coalesce("text", F.lit(""))).alias("node")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), node, "text")
    fps = stored(rows.mapInArrow(released(_fingerprints), "node long, doc_id long, fp binary"), "wide-fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("node").alias("text_hash"))).alias("first")
    reps = stored(fps.groupBy("node", "fp").agg(first), "text-nodes")
    n = reps.count()
    met = stored(met_in_cells(reps.select("node", "fp"), n, block), "candidate-pairs")
    pairs, crowded = met.where("a < b"), met.where("a = b").select(F.col("a").alias("node"))
    some = stored(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "candidate-nodes")
    texts = rows.select("node", "text").join(F.broadcast(some) if some.count() <= BROADCAST_NODES else some, "node", "left_semi")
    held = stored(texts.mapInArrow(released(_shingled(shingle)), "node long, shingles binary").groupBy("node", "shingles").agg(F.count(F.lit(1))), "shingles")
    side = lambda c: held.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}"))
    links = pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_verifier(similarity), "a long, b long")
    found = components(links)
    labelled = stored(reps.join(found, "node", "left").select("node", "fp", "first", F.coalesce("component", "node").alias("label")), "labelled-nodes")
    sizes = held.select("node", (F.length("shingles") / 8).cast("long").alias("size"))
    rest = stored(labelled.drop("first").join(crowded, "node", "left_semi").join(sizes, "node"), "crowded-nodes")
    joined = components(other_links(rest, held.select("node", "shingles"), n, similarity, block))
    grouped = labelled.join(joined.withColumnRenamed("node", "label"), "label", "left").groupBy(F.coalesce("component", "label").alias("group"))
    return grouped.agg(F.min("first").alias("first")).select(F.col("first.id").alias("doc_id"), "first.text_hash")
