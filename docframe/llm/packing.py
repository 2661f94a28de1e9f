"""Best-fit packing by a configuration linear program over the histogram of piece lengths."""

from __future__ import annotations

import functools
import json
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docframe.llm.memory import released
from docframe.llm.storage import stored

SEQUENCE = 2048
END_ID = 0
#: Share by which the linear program's solution may exceed its lower bound.
GAP = 0.01
#: Rounds of multiplicative weights that may pass without progress.
PATIENCE = 80
#: Configurations that are drawn from one solution, and sequences that are left to best fit.
DRAWS = 4096
LAST_BINS = 24
#: Parts in which the pieces of one length are numbered.
SALTS = 64
#: Runs of text and words that a worker keeps with their ids, in each of two generations.
CACHED_RUNS = 100_000
CACHED_WORDS = 200_000

#: Characters that are encoded at once.
CHARS_AT_ONCE = 1 << 22

#: Code points of the texts that the fast path takes; others go to the tokenizer whole.
LATIN_END = 0x250
#: The rules of a vocabulary's file that the fast path follows.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def _latin(category: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(LATIN_END) if unicodedata.category(chr(c))[0] == category)


class WordEncoder:
    """Ids of whole texts, as little-endian 32-bit bytes, equal to Tokenizer.encode(add_special_tokens=False).

    Where the file states the rules NORMALIZER and PRE_TOKENIZER there is a fast path; with any other file every
    text is encoded by the tokenizer itself. These rules lower-case each text and never join two sides of white space, so that a text's
    ids are those of its white-space runs one after the other, and each distinct run is encoded once and
    kept. This holds for Latin letters (below U+0250, where NFC changes nothing); a text with any other
    character, or with a special token's string, is encoded by the tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        rules = json.loads(self.tokenizer.to_str())
        self.known = (rules["normalizer"], rules["pre_tokenizer"], rules["post_processor"], rules["model"].get("dropout")) == (NORMALIZER, PRE_TOKENIZER, None, None)
        self.special = tuple(t["content"] for t in rules["added_tokens"])
        letters, numbers = _latin("L"), _latin("N")
        #: Fixed value: the vocabulary's own split pattern, for Latin text.
        self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\\s{letters}{numbers}]+")
        self.other = re.compile(f"[^\\t-\\r\\x20-\\x7e\\xa1-{chr(LATIN_END - 1)}]")
        self.space = re.compile("[\t-\r ]")
        self.plain = bytes([*range(9, 14), *range(0x20, 0x7F), *range(0xA1, 0x100)])
        # byte-level letters: printable bytes stand for themselves, others follow from U+0100
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in plain]
        self.letters = {b: b for b in plain} | {b: 0x100 + i for i, b in enumerate(rest)}
        self.runs: dict[str, bytes] = {}
        self.older_runs: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.older_words: dict[str, bytes] = {}

    def forget(self) -> None:
        """Empties the caches; the next task has other words, but for those that are quick to find again."""
        self.runs, self.older_runs, self.words, self.older_words = {}, {}, {}, {}

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            found = self.older_words.get(word)
            if found is None:
                spelt = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
                found = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(spelt)])
            if len(self.words) >= CACHED_WORDS:
                self.older_words, self.words = self.words, {}
            self.words[word] = found
        return found

    def _run(self, run: str) -> bytes:
        found = self.older_runs.get(run)
        if found is None:
            low = run.lower()
            if low.isalpha():
                found = self._word(low)
            elif low[-1] in ".," and low[:-1].isalpha():
                found = self._word(low[:-1]) + self._word(low[-1])
            else:
                found = b"".join(map(self._word, self.split.findall(low)))
        if len(self.runs) >= CACHED_RUNS:
            self.older_runs, self.runs = self.runs, {}
        self.runs[run] = found
        return found

    def _ids(self, run: str) -> bytes:
        found = self.runs.get(run)
        return self._run(run) if found is None else found

    def _is_latin(self, text: str) -> bool:
        if not self.known or any(x in text for x in self.special):
            return False
        try:
            return not text.encode("latin-1").translate(None, self.plain)
        except UnicodeEncodeError:
            return not self.other.search(text)

    def _encode_latin(self, texts: list[str]) -> list[bytes]:
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        coded = lists.values.dictionary_encode()
        parts = [self._ids(run) if run else b"" for run in coded.dictionary.to_pylist()]
        pool = np.frombuffer(b"".join(parts), "<u4")
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        run = coded.indices.to_numpy()
        length = size[run]
        end = np.cumsum(length)
        at = np.repeat((np.cumsum(size) - size)[run] - end + length, length)
        at += np.arange(len(at))
        ids = pool[at].tobytes()
        stop = np.concatenate([[0], end])[lists.offsets.to_numpy()].tolist()
        return [ids[4 * i : 4 * k] for i, k in zip(stop, stop[1:], strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, CHARS_AT_ONCE characters at a time; a longer text is taken in parts at white space."""
        out: list[bytes] = [b""] * len(texts)
        held: list[tuple[int, str]] = []
        chars = 0

        def flush() -> None:
            nonlocal chars
            for (i, _), ids in zip(held, self._encode_latin([t for _, t in held]) if held else (), strict=True):
                out[i] += ids
            held.clear()
            chars = 0

        for i, text in enumerate(texts):
            if not self._is_latin(text):
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
                out[i] = np.array(ids, "<u4").tobytes()
                continue
            at = 0
            while at < len(text):
                cut = self.space.search(text, at + CHARS_AT_ONCE)
                to = cut.start() if cut else len(text)
                held.append((i, text[at:to]))
                chars += to - at
                at = to
                if chars >= CHARS_AT_ONCE:
                    flush()
        flush()
        return out


@functools.lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pieces_of(ids: bytes, sequence: int = SEQUENCE) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids with the closing id."""
    ids += END_ID.to_bytes(4, "little")
    for piece, at in enumerate(range(0, len(ids), 4 * sequence)):
        part = ids[at : at + 4 * sequence]
        yield piece, at // 4, len(part) // 4, zlib.crc32(part)


def _cutter(path: str, sequence: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        for b in batches:
            row, out = [], []
            for i, ids in enumerate(encoder.encode([t or "" for t in b["text"].to_pylist()])):
                for p in pieces_of(ids, sequence):
                    row.append(i)
                    out.append(p)
            columns = np.array(out, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"].take(pa.array(row, pa.int64())), *map(pa.array, columns)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )
        word_encoder(path).forget()

    return cut


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32), without a shuffle."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(released(_cutter(tokenizer_path, sequence)), "doc_id long, piece long, start long, length long, ids_crc32 long")


@dataclass
class Configuration:
    """`bins` sequences that each hold counts[i] pieces of lengths[i]."""

    lengths: np.ndarray
    counts: np.ndarray
    bins: int


class Fill:
    """Configurations drawn in proportion to the product of their pieces' weights, and what they hold on average.

    The knapsack's dynamic program over the fill is taken with sums for maxima: z[f] adds up the weights of all
    ways to fill f tokens. So one pass prices every configuration at once, softly, instead of the single best, and
    its average touches all lengths. Unfilled room costs `rent` a token.
    """

    def __init__(self, lengths: np.ndarray, log_weights: np.ndarray, rent: float, capacity: int) -> None:
        size = capacity + 1
        # a factor for each token changes no proportion, but keeps the sums of weights near 1
        low, high = -(log_weights / lengths).max() - np.log(len(lengths)) - 1.0, -(log_weights / lengths).max()
        for _ in range(60):
            middle = (low + high) / 2
            over = np.exp(np.minimum(log_weights + middle * lengths, 50.0)).sum() > 1
            low, high = (low, middle) if over else (middle, high)
        self.weight = np.zeros(size)
        self.weight[lengths] = np.exp(log_weights + low * lengths)
        self.z, backward = np.zeros(size), np.zeros(size)
        self.z[0] = backward[capacity] = 1.0
        for f in range(1, size):
            self.z[f] = backward[capacity - f] = self.weight[1 : f + 1] @ backward[size - f :]
        # fills that next to no weight reaches end no configuration
        self.z[self.z < 1e-200] = 0.0
        with np.errstate(divide="ignore"):
            end = np.log(self.z) + (capacity - np.arange(size)) * (low - rent)
        self.end = np.exp(end - end.max())
        self.end /= self.end.sum()
        share = np.divide(self.end, self.z, out=np.zeros(size), where=self.z > 0)
        # pieces of a length in a configuration on average: its weight times all ways to fill what is before and after it
        around = np.correlate(share, np.convolve(self.z, self.z)[:size], "full")[capacity:]
        self.held = self.weight[lengths] * around[lengths]
        self.waste = float(self.end @ (capacity - np.arange(size)))

    def draw(self, rng: np.random.Generator) -> list[int]:
        """The lengths of one configuration."""
        f = int(rng.choice(len(self.end), p=self.end))
        out = []
        while f:
            ways = np.cumsum(self.weight[1 : f + 1] * self.z[f - 1 :: -1][:f])
            out.append(min(f, 1 + int(np.searchsorted(ways, rng.random() * ways[-1], side="right"))))
            f -= out[-1]
        return out


def best_value(lengths: np.ndarray, price: np.ndarray, capacity: int) -> float:
    """The most that the pieces of one sequence can be worth: the knapsack's dynamic program over the fill."""
    best = np.zeros(capacity + 1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for fill in range(1, capacity + 1):
        k = upto[fill]
        best[fill] = max(best[fill - 1], (best[fill - lengths[:k]] + price[:k]).max()) if k else best[fill - 1]
    return float(best[capacity])


@dataclass
class Cover:
    """A fractional solution: `bins` sequences dealt out as `fill` says hold each length as often as needed."""

    fill: Fill
    bins: float
    #: No solution has fewer sequences: what all pieces are worth by the best sequence's worth.
    bound: float
    rounds: int


def fractional_cover(lengths: np.ndarray, need: np.ndarray, capacity: int, gap: float = GAP, patience: int = PATIENCE) -> Cover:
    """The linear program over configurations: as few sequences as cover all pieces of each length.

    Multiplicative weights: a round prices all configurations by the weights (see Fill), takes their mixture as
    often as the scarcest length needs, which covers every length, and multiplies each length's weight by its need
    over its cover. While cover is even, the rent of unfilled room rises, so that the mixture turns to the fullest
    configurations. Weights and rent are dual prices: the pieces' worth over the best value of a knapsack bounds the
    program from below. Rounds end when cover and bound are within `gap`, or when `patience` rounds have not brought
    them closer by a hundredth of their distance.
    """
    need = need.astype(float)
    area = float(lengths @ need)
    bound = area / capacity
    log_weights, rent = np.log(need / need.sum()), 1.0 / capacity
    best, bins, since, mark, r = None, np.inf, 0, np.inf, 0
    while True:
        fill = Fill(lengths, log_weights, rent, capacity)
        ratio = need / np.maximum(fill.held, 1e-300)
        if ratio.max() < bins:
            best, bins = fill, float(ratio.max())
        if r % 20 == 0:
            price = np.maximum(log_weights + rent * lengths, 0.0)
            if price.any():
                bound = max(bound, float(need @ price) / best_value(lengths, price, capacity))
        if bins - bound < 0.99 * mark:
            mark, since = bins - bound, r
        r += 1
        if bins <= bound * (1 + gap) or r - since > patience:
            return Cover(best, bins, bound, r)
        now = area / (capacity - fill.waste)
        log_weights = log_weights + np.log(np.clip(ratio / now, 1e-2, 1e2))
        if ratio.max() < 1.1 * now:
            rent *= 1.05


def _best_fit(lengths: np.ndarray, left: np.ndarray, capacity: int, start: np.ndarray | None = None) -> np.ndarray:
    """Counts of one sequence: those of start, then again and again the longest piece left that fits."""
    config = np.zeros(len(lengths), np.int64) if start is None else start.copy()
    room = capacity - int(config @ lengths)
    free = left - config
    top = len(lengths)
    while room > 0:
        top = min(top, int(np.searchsorted(lengths, room, side="right")))
        fits = np.flatnonzero(free[:top])
        if not len(fits):
            break
        i = int(fits[-1])
        k = min(int(free[i]), room // int(lengths[i]))
        config[i] += k
        free[i] -= k
        room -= k * int(lengths[i])
    return config


def _pack_rest(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[Configuration]:
    """Best fit, largest first, one configuration for as many sequences as it can fill."""
    out, left = [], left.copy()
    while left.any():
        config = _best_fit(lengths, left, capacity)
        used = np.flatnonzero(config)
        n = int((left[used] // config[used]).min())
        left -= n * config
        out.append(Configuration(lengths[used], config[used], n))
    return out


def _rounded(lengths: np.ndarray, need: np.ndarray, capacity: int, gap: float) -> Iterator[tuple[list[Configuration], np.ndarray]]:
    """The linear program's solution rounded to whole sequences, step by step: (sequences so far, pieces left).

    Configurations are drawn from the fractional solution, each for an equal part of half its sequences (of nine
    tenths, where they are many), and taken as often as what is left of their lengths allows; room that is left in
    them is filled up by best fit. Then the program is solved again for what remains, until few sequences do
    (LAST_BINS, or a thousandth of all).
    """
    rng = np.random.default_rng(len(lengths))
    left, out = need.copy(), []
    yield [], left
    last = max(LAST_BINS, float(lengths @ left) / capacity / 1000)
    while (bins := float(lengths @ left) / capacity) > last:
        own = np.flatnonzero(left)
        cover = fractional_cover(lengths[own], left[own], capacity, gap)
        quota = int(bins * (0.9 if bins > DRAWS else 0.5))
        draws = min(DRAWS, quota)
        drawn: dict[bytes, int] = {}
        for _ in range(draws):
            config = np.bincount(np.searchsorted(lengths, cover.fill.draw(rng)), minlength=len(lengths)).astype(np.int64)
            drawn[config.tobytes()] = drawn.get(config.tobytes(), 0) + 1
        for key, times in sorted(drawn.items(), key=lambda x: (-int(np.frombuffer(x[0], np.int64) @ lengths), x[0])):
            config = np.frombuffer(key, np.int64)
            n = times * (quota // draws)
            if (left < n * config).any():
                used = np.flatnonzero(config)
                n = max(1, int((left[used] // config[used]).min()))
            config = _best_fit(lengths, left // n, capacity, np.minimum(config, left // n))
            used = np.flatnonzero(config)
            if len(used):
                left = left - n * config
                out.append(Configuration(lengths[used], config[used], n))
        yield list(out), left


def configurations(histogram: dict[int, int], capacity: int = SEQUENCE, gap: float = GAP) -> list[Configuration]:
    """Sequences for all pieces of a histogram (length: count).

    Full pieces are sequences of their own. The linear program is solved and rounded in steps; after each step best
    fit packs what is left, and the packing of fewest sequences is taken (of equals that with most from the program).
    """
    out = []
    if n := histogram.get(capacity):
        out.append(Configuration(np.array([capacity]), np.array([1]), n))
    lengths = np.array(sorted(k for k, n in histogram.items() if k < capacity and n), np.int64)
    need = np.array([histogram[k] for k in lengths.tolist()], np.int64)
    if not len(lengths):
        return out
    best, least = [], np.inf
    for configs, left in _rounded(lengths, need, capacity, gap):
        configs = configs + _pack_rest(lengths, left, capacity)
        if (bins := sum(c.bins for c in configs)) <= least:
            best, least = configs, bins
    return out + best


def _slots(configs: list[Configuration]) -> dict[int, np.ndarray]:
    """For each length, ranges of its numbered pieces: first number, per sequence, first sequence, offset."""
    taken: dict[int, int] = {}
    ranges: dict[int, list[tuple[int, int, int, int]]] = {}
    base = 0
    for c in configs:
        at = 0
        for length, k in zip(c.lengths.tolist(), c.counts.tolist(), strict=True):
            first = taken.get(length, 0)
            ranges.setdefault(length, []).append((first, k, base, at))
            taken[length] = first + k * c.bins
            at += k * length
        base += c.bins
    return {k: np.array(v, np.int64) for k, v in ranges.items()}


def _placer(slots: dict[int, np.ndarray]) -> Callable[[pd.Series, pd.Series], pd.DataFrame]:
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        size, k = length.to_numpy(), number.to_numpy()
        sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        order = np.argsort(size, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(size[order])) + 1) if len(order) else []:
            own = slots[int(size[rows[0]])]
            r = own[np.searchsorted(own[:, 0], k[rows], side="right") - 1]
            within = k[rows] - r[:, 0]
            sequence[rows] = r[:, 2] + within // r[:, 1]
            offset[rows] = r[:, 3] + within % r[:, 1] * size[rows]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    return place


def pack(pieces: DataFrame, sequence: int = SEQUENCE, gap: float = GAP) -> DataFrame:
    """pieces (with a column length) plus sequence_id and offset.

    The driver holds the histogram (at most `sequence` lengths) and the configurations (at most DRAWS for each
    tenth part and one for each exhausted length), whatever the number of pieces. Pieces of a length are
    numbered in salted parts, whose sizes are summed beforehand, so that a length that a third of all
    pieces share is numbered by many tasks. Which of several pieces of a length goes to which place does
    not matter. An empty table gives an empty table.
    """
    salted = stored(pieces.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS))), "pieces")
    sizes = salted.groupBy("length", "__salt").count()
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "__salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__first"))
    histogram = {r[0]: r[1] for r in sizes.groupBy("length").agg(F.sum("count")).collect()}
    place = F.pandas_udf(_placer(_slots(configurations(histogram, sequence, gap))), "sequence_id long, offset long")
    own = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32")
    # at most `sequence` x SALTS rows
    numbered = salted.join(F.broadcast(starts), ["length", "__salt"]).withColumn(
        "__number", F.col("__first") + F.row_number().over(own) - 1
    )
    return numbered.withColumn("__at", place("length", "__number")).select(
        *pieces.columns, F.col("__at.sequence_id").alias("sequence_id"), F.col("__at.offset").alias("offset")
    )


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    sequence: int = SEQUENCE,
    gap: float = GAP,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the closing id alone. Texts longer than a sequence are cut into full pieces
    and a rest. Every input row is packed, repeated rows and rows with a null id too; other columns are
    ignored. An empty table gives an empty table.
    """
    found = pack(tokenized_pieces(docs, tokenizer_path, id_col, text_col, sequence), sequence, gap)
    return found.withColumn("piece", F.col("piece").cast("int"))
