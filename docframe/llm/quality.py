"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text, from sharded count joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.llm.memory import released
from docframe.llm.storage import stored

#: Characters of a gram.
ORDER = 5
#: Trusted documents to keep below the threshold, for each language and class of length.
QUANTILE = 0.99
#: Above that quantile, as a factor on the bits a character.
SLACK = 1.02
#: Held-out trusted documents that a class of length needs for a threshold of its own.
CLASS_LEAST = 50
#: Deviations above the mean, where a language has too few held-out trusted documents for the quantile.
FEW_DEVIATIONS = 4.0
#: Most frequent grams whose probabilities are broadcast; rarer ones are joined, by shards of the gram.
COMMON = 1 << 18
#: Trusted ids that are broadcast; more are joined.
BROADCAST_IDS = 1_000_000
#: Characters whose grams are counted at once.
CHARS_AT_ONCE = 1 << 18
#: Distinct characters at once, so that a gram of ORDER of them is a 64-bit number.
SYMBOLS = 1 << (64 // ORDER)
#: Distinct grams that a task holds before it sends counts on.
GRAMS_HELD = 1 << 18
#: Grams that a task sends on at once.
GRAMS_SENT = 1 << 16
PAD = ord(" ")
UNKNOWN_LANG = ""


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def text_runs(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(code points, owner) of whole texts, at most about CHARS_AT_ONCE at a time.

    Before each text stand ORDER - 1 spaces; a text that does not fit one run goes on in the next after its last
    ORDER - 1 characters. The owner is the number of the text, or -1 where no gram ends: in these first characters.
    """
    pad = np.full(ORDER - 1, PAD, np.uint32)
    nobody = np.full(ORDER - 1, -1, np.int64)
    points: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    held = 0
    for i, text in enumerate(texts):
        own, before = _points(text), pad
        for at in range(0, len(own), CHARS_AT_ONCE):
            part = own[at : at + CHARS_AT_ONCE]
            points += [before, part]
            owner += [nobody, np.full(len(part), i)]
            before = np.concatenate([before, part])[-(ORDER - 1) :]
            held += len(part)
            if held >= CHARS_AT_ONCE:
                yield np.concatenate(points), np.concatenate(owner)
                points, owner, held = [], [], 0
    if points:
        yield np.concatenate(points), np.concatenate(owner)


def run_codes(points: np.ndarray, owner: np.ndarray, symbols: int = SYMBOLS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(codes, owner, alphabet): a number for each gram that ends at an owned place, its owner, and the characters.

    A run with more distinct characters than `symbols` (2 * ORDER at least) is halved, so that a code has 64 bits at most."""
    known = np.zeros(0x110000, bool)
    known[points] = True
    alphabet = np.flatnonzero(known)
    if len(alphabet) > symbols:
        half = len(points) // 2
        start = max(0, half - ORDER + 1)
        rest = owner[start:].copy()
        rest[: half - start] = -1
        yield from run_codes(points[:half], owner[:half], symbols)
        yield from run_codes(points[start:], rest, symbols)
        return
    number = np.zeros(0x110000, np.uint64)
    number[alphabet] = np.arange(len(alphabet), dtype=np.uint64)
    s = number[points]
    bits = np.uint64(_bits(alphabet))
    code = np.zeros(max(0, len(s) - ORDER + 1), np.uint64)
    for k in range(ORDER):
        code = (code << bits) | s[k : len(s) - ORDER + 1 + k]
    own = owner[ORDER - 1 :]
    some = own >= 0
    yield code[some], own[some], alphabet


def _bits(alphabet: np.ndarray) -> int:
    return max(1, (len(alphabet) - 1).bit_length())


def code_points(codes: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """Grams as rows of ORDER code points."""
    bits = _bits(alphabet)
    places = np.arange(ORDER - 1, -1, -1, dtype=np.uint64) * np.uint64(bits)
    return alphabet[((codes[:, None] >> places) & np.uint64((1 << bits) - 1)).astype(np.int64)].astype(np.uint32)


def _strings(grams: np.ndarray) -> list[str]:
    """The rows of code points as texts."""
    text = np.ascontiguousarray(grams, "<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [text[i : i + ORDER] for i in range(0, len(text), ORDER)]


def _utf8(strings: list[str]) -> pa.Array:
    return pa.array([s.encode("utf-8", "replace") for s in strings], pa.binary()).cast(pa.string())


def gram_keys(grams: np.ndarray, lang: str) -> np.ndarray:
    """A 64-bit hash of each gram with the language, the same in every task."""
    seed = sum((ord(c) + 1) * 1_000_003 ** (i + 1) for i, c in enumerate(lang)) % (1 << 64)
    key = np.full(len(grams), seed, np.uint64)
    for k in range(ORDER):
        key = (key ^ grams[:, k].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(29)
    return key


def _by_lang(langs: list[str]) -> Iterator[tuple[str, list[int]]]:
    own: dict[str, list[int]] = {}
    for i, lang in enumerate(langs):
        own.setdefault(lang, []).append(i)
    yield from own.items()


def _counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and their counts; codes are sorted in place."""
    codes.sort()
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.diff(np.concatenate([first, [len(codes)]]))


class _Counts:
    """Counts of a language's grams: keys, code points, counts in the model's texts and in all."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, codes: np.ndarray, alphabet: np.ndarray, learn: bool, lang: str) -> None:
        distinct, n = _counted(codes)
        points = code_points(distinct, alphabet)
        self.parts.append((gram_keys(points, lang), points, n * learn, n))
        self.size += len(n)

    def merge(self) -> None:
        key, points, n_model, n = (np.concatenate([p[k] for p in self.parts]) for k in range(4))
        distinct, first, which = np.unique(key, return_index=True, return_inverse=True)
        sums = [np.bincount(which, x, len(distinct)).astype(np.int64) for x in (n_model, n)]
        self.parts = [(distinct, points[first], *sums)]
        self.size = len(distinct)

    def batches(self, lang: str) -> Iterator[pa.RecordBatch]:
        self.merge()
        for at in range(0, self.size, GRAMS_SENT):
            _, points, n_model, n = (x[at : at + GRAMS_SENT] for x in self.parts[0])
            names = pa.array([lang] * len(n), pa.string())
            yield pa.RecordBatch.from_arrays([names, _utf8(_strings(points)), pa.array(n_model), pa.array(n)], ["lang", "gram", "n_model", "n"])


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n_model, n): counts of each gram in the model's documents and in all, by parts of a partition."""
    held: dict[str, _Counts] = {}
    for b in batches:
        texts, learn = b["text"].to_pylist(), b["learn"].to_pylist()
        for lang, rows in _by_lang(b["lang"].to_pylist()):
            counts = held.setdefault(lang, _Counts())
            for mine in (True, False):
                for points, owner in text_runs([texts[i] for i in rows if learn[i] is mine]):
                    for codes, _, alphabet in run_codes(points, owner):
                        counts.add(codes, alphabet, mine, lang)
                if counts.size >= GRAMS_HELD:
                    counts.merge()
        if sum(c.size for c in held.values()) >= GRAMS_HELD:
            for c in held.values():
                if c.parts:
                    c.merge()
            if sum(c.size for c in held.values()) >= GRAMS_HELD // 2:
                while held:
                    lang, c = held.popitem()
                    yield from c.batches(lang) if c.parts else ()
    while held:
        lang, c = held.popitem()
        yield from c.batches(lang) if c.parts else ()


def _discount(level: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3): discounts for counts 1, 2 and 3 or more, from the counts of counts of a level."""
    n = [F.greatest(F.sum((F.col("c") == k).cast("long")), F.lit(1)).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    between = lambda x, lo, hi: F.least(F.greatest(x, F.lit(lo)), F.lit(hi))
    return level.where("c > 0").groupBy("lang").agg(*n).select(
        F.col("lang"),
        between(1 - 2 * y * F.col("n2") / F.col("n1"), 0.05, 0.95).alias("d1"),
        between(2 - 3 * y * F.col("n3") / F.col("n2"), 0.1, 1.9).alias("d2"),
        between(3 - 4 * y * F.col("n4") / F.col("n3"), 0.15, 2.85).alias("d3"),
    )


def _few(df: DataFrame) -> DataFrame:
    """A table of a few rows for each language, broadcast if it is small, so that no language is one task's key."""
    held = stored(df, "by-language")
    return F.broadcast(held) if held.count() <= BROADCAST_IDS else held


def gram_bits(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, bits): the bits of the last character of each gram after those before it.

    grams: (lang, gram, n_model), distinct by lang and gram; n_model are the counts of the model, which may be 0.
    Interpolated modified Kneser-Ney: the longest grams have these counts, each shorter one the number of
    different characters before it in the model. A gram's probability is its discounted share of its context plus
    what the context's discounts have freed times the probability of the gram without its first character; at the
    end stands an equal share for each character known and one for all unknown. Each level is an aggregation and
    two joins sharded by language and gram, over distinct grams, whatever the length of the corpus.
    """
    levels = [grams.select("lang", "gram", F.col("n_model").cast("double").alias("c"))]
    for k in range(order - 1, 0, -1):
        shorter = levels[0].groupBy("lang", F.substring("gram", 2, order).alias("gram")).agg(F.sum((F.col("c") > 0).cast("double")).alias("c"))
        levels.insert(0, stored(shorter, f"grams{k}"))
    below = levels[0].groupBy("lang").agg((1.0 / (F.sum((F.col("c") > 0).cast("long")) + 1)).alias("p"))
    for k, level in enumerate(levels, 1):
        d = F.when(F.col("c") >= 3, F.col("d3")).when(F.col("c") >= 2, F.col("d2")).when(F.col("c") >= 1, F.col("d1")).otherwise(0.0)
        cut = level.join(_few(_discount(level)), "lang", "left").withColumn("d", d).withColumn("context", F.substring("gram", 1, k - 1))
        contexts = cut.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.sum("d").alias("freed"))
        lower = below.select("lang", "p") if k == 1 else below.select("lang", F.col("gram").alias("shorter"), "p")
        joined = cut.join(contexts, ["lang", "context"]).withColumn("shorter", F.substring("gram", 2, k)).join(lower, ["lang"] if k == 1 else ["lang", "shorter"])
        own = (F.col("c") - F.col("d")) / F.col("total") + F.col("freed") / F.col("total") * F.col("p")
        p = F.when(F.col("total") > 0, own).otherwise(F.col("p"))
        below = joined.select("lang", "gram", p.alias("p"))
        below = stored(below, f"probabilities{k}") if k < order else below
    return below.select("lang", "gram", (-F.log2("p")).alias("bits"))


def _scorer(common) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds to each row its characters, the bits of its common grams, and the other grams with their counts."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, bits = common.value
        for b in batches:
            texts = b["text"].to_pylist()
            size = np.array([len(t) for t in texts], np.int64)
            total = np.zeros(len(texts))
            rare: list[list[str]] = [[] for _ in texts]
            times: list[list[int]] = [[] for _ in texts]
            for lang, rows in _by_lang(b["lang"].to_pylist()):
                place = np.array(rows)
                for points, owner in text_runs([texts[i] for i in rows]):
                    for codes, own, alphabet in run_codes(points, owner):
                        distinct, which = np.unique(codes, return_inverse=True)
                        grams = code_points(distinct, alphabet)
                        key = gram_keys(grams, lang)
                        at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
                        known = keys[at] == key if len(keys) else np.zeros(len(key), bool)
                        if known.any():
                            cost = np.where(known, bits[at], 0.0)
                            total += np.bincount(place[own], cost[which], len(texts))
                        missing = ~known[which]
                        if missing.any():
                            pair, n = np.unique(own[missing] * len(grams) + which[missing], return_counts=True)
                            names = dict(zip(np.flatnonzero(~known).tolist(), _strings(grams[~known]), strict=True))
                            for doc, gram, c in zip((pair // len(grams)).tolist(), (pair % len(grams)).tolist(), n.tolist(), strict=True):
                                rare[rows[doc]].append(names[gram])
                                times[rows[doc]].append(c)
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in rare])]), pa.int32())
            names = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [
                    *[b[c] for c in names],
                    pa.array(size),
                    pa.array(total),
                    pa.ListArray.from_arrays(offsets, _utf8([g for x in rare for g in x])),
                    pa.ListArray.from_arrays(offsets, pa.array([c for x in times for c in x], pa.int32())),
                ],
                [*names, "length", "common_bits", "rare", "times"],
            )

    return score


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        grams = _points("".join(b["gram"].to_pylist())).reshape(-1, ORDER)
        key = np.zeros(len(grams), np.uint64)
        for lang, rows in _by_lang(b["lang"].to_pylist()):
            key[rows] = gram_keys(grams[rows], lang)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b["bits"]], ["key", "bits"])


def _common(grams: DataFrame, scores: DataFrame, most: int = COMMON):
    """The most frequent grams' sorted keys with their bits, `most` at most, as a broadcast of bounded size.

    Frequencies are told apart by sixteenths of a power of two; grams as frequent as the first left out are left out.
    """
    rank = F.floor(F.log2("n") * 16).cast("int")
    least, held = None, 0
    for r in grams.groupBy(rank.alias("rank")).count().orderBy(F.desc("rank")).collect():
        held += r["count"]
        if held > most:
            break
        least = r["rank"]
    some = grams.where(rank >= least) if least is not None else grams.limit(0)
    top = some.select("lang", "gram").join(scores, ["lang", "gram"]).mapInArrow(_keyed, "key long, bits double").toArrow()
    key, bits = top["key"].to_numpy().view(np.uint64), top["bits"].to_numpy()
    order = np.argsort(key)
    return grams.sparkSession.sparkContext.broadcast((key[order], bits[order]))


def quality_scores(
    docs: DataFrame,
    trusted: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    quantile: float = QUANTILE,
    slack: float = SLACK,
    hashed: bool = False,
) -> DataFrame:
    """One row per input row: doc_id, lang, perplexity (a character), threshold, kept, and text_hash if hashed.

    trusted holds the ids (column id_col) of trusted documents. All of their text trains one model of grams of
    five characters for each language (one fifth by id hash is held out to set the thresholds). Characters are code
    points as they are, of any script, and all counts are kept, so that the model grows with the corpus. One pass
    over the texts counts grams, merged in each task before the shuffle; joins sharded by gram give every distinct
    gram its probability (see gram_bits); a second pass adds up the bits of each document. The most frequent grams, a
    table of fixed size, are looked up where the text is read; a document's other grams are joined, sharded by
    gram, and summed. No text is shuffled, and the number of languages adds no pass.

    The threshold is the `quantile` of held-out trusted documents of the same language and class of
    length (a power of two; the language's own, where a class has few, and no less than FEW_DEVIATIONS above the mean
    where the language has too few for the quantile), times slack. A document is kept
    if its bits a character do not exceed it. Empty and null texts have no perplexity and are not kept.
    A language without trusted text has no model and no threshold, and all its documents with text are kept, without
    a perplexity; a null language is one of its own. Repeated rows each get a row; other columns are ignored; empty
    tables give an empty table. text_hash is xxhash64 of the text (null as empty), to tell rows of one id apart.
    """
    ids = trusted.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("is_trusted", F.lit(True))
    ids = F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids
    more = ["text_hash"] if hashed else []
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = (
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.coalesce(F.col(lang_col), F.lit(UNKNOWN_LANG)).alias("lang"),
            text.alias("text"),
            *[F.xxhash64(text).alias(c) for c in more],
        )
        .join(ids, "doc_id", "left")
        .withColumn("trusted", F.coalesce("is_trusted", F.lit(False)))
        .withColumn("held_out", F.coalesce(F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long") % 5 == 0, F.lit(False)))
    )
    counted = rows.select("lang", "text", (F.col("trusted") & ~F.col("held_out")).alias("learn")).mapInArrow(released(_counter), "lang string, gram string, n_model long, n long")
    grams = stored(counted.groupBy("lang", "gram").agg(F.sum("n_model").alias("n_model"), F.sum("n").alias("n")), "grams")
    learned = grams.groupBy("lang").agg(F.max(F.col("n_model") > 0).alias("learned"))
    scores = stored(gram_bits(grams), "gram-bits")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    names = ["doc_id", "lang", "trusted", "held_out", *more]
    out = ", ".join(f"{c} {kinds[c]}" for c in names) + ", length long, common_bits double, rare array<string>, times array<int>"
    partly = rows.select("text", *names).mapInArrow(released(_scorer(_common(grams, scores))), out)
    partly = stored(partly.withColumn("row", F.monotonically_increasing_id()), "partly-scored")
    rare = partly.where("size(rare) > 0").select("row", "lang", F.explode(F.arrays_zip("rare", "times")).alias("g"))
    tail = (
        rare.select("row", "lang", F.col("g.rare").alias("gram"), F.col("g.times").alias("times"))
        .join(scores.select("lang", "gram", "bits"), ["lang", "gram"])
        .groupBy("row")
        .agg(F.sum(F.col("times") * F.col("bits")).alias("rare_bits"))
    )
    bits = (F.col("common_bits") + F.coalesce("rare_bits", F.lit(0.0))) / F.col("length")
    scored = stored(
        partly.drop("rare", "times").join(tail, "row", "left").join(_few(learned), "lang", "left")
        .withColumn("bits", F.when(F.col("learned") & (F.col("length") > 0), bits))
        .withColumn("class", F.floor(F.log2(F.greatest("length", F.lit(1)).cast("double"))).cast("int"))
        .select("lang", "class", "doc_id", "length", "bits", "trusted", "held_out", *more),
        "scores",
    )
    limits = scored.join(_few(_thresholds(scored, quantile, slack)), ["lang", "class"], "left")
    kept = F.when(F.col("length") == 0, False).when(F.col("bits").isNull() | F.col("limit").isNull(), True).otherwise(F.col("bits") <= F.col("limit"))
    return limits.select(
        "doc_id",
        F.nullif("lang", F.lit(UNKNOWN_LANG)).alias("lang"),
        F.pow(F.lit(2.0), "bits").alias("perplexity"),
        F.pow(F.lit(2.0), "limit").alias("threshold"),
        kept.alias("kept"),
        *more,
    )


def _thresholds(scored: DataFrame, quantile: float, slack: float) -> DataFrame:
    """(lang, class, limit) for each language and class of length that occur; at most 32 classes of a language."""
    sample = scored.where("trusted and held_out and bits is not null")
    middle: Column = F.percentile_approx("bits", quantile, 10_000)
    # few documents do not reach the quantile: it is no less than so many deviations above their mean
    far = F.avg("bits") + FEW_DEVIATIONS * F.coalesce(F.stddev_samp("bits"), 0.1 * F.avg("bits"))
    by_lang = sample.groupBy("lang").agg(F.when(F.count(F.lit(1)) * (1 - quantile) < 1, F.greatest(middle, far)).otherwise(middle).alias("of_lang"))
    by_class = sample.groupBy("lang", "class").agg(middle.alias("of_class"), F.count(F.lit(1)).alias("size")).where(F.col("size") >= CLASS_LEAST)
    every = scored.select("lang", "class").distinct().join(by_lang, "lang").join(by_class, ["lang", "class"], "left")
    return every.select("lang", "class", (F.coalesce("of_class", "of_lang") * slack).alias("limit"))
