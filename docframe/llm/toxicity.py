"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton on folded text."""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm.memory import released
from docframe.llm.storage import stored

#: Labelled rows from which lexicon, exceptions and calibration are learned, at most, by hash of the id.
FIT_ROWS = 20_000
#: Texts of more characters are left out of the labelled sample.
FIT_CHARS = 40_000
STEMS = range(4, 9)
LEAST_TOXIC = 4
LEAST_ODDS = 3.0
LEXICON_SIZE = 5_000

#: Letters of other scripts that look like Latin ones, and signs put for letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
_FOLD = str.maketrans(HOMOGLYPHS | SUBSTITUTES)
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_GAP = re.compile(r"[\W_]+")
#: Runs of signs that no letter or digit follows are noise; others stand for letters.
_SIGN_RUN = re.compile(r"[@$]{2,}(?![@$]|[^\W_])")


def fold(text: str) -> str:
    """Words of letters, lower-case, with a single space between, before and after them.

    Compatibility forms and invisible characters go, look-alike letters and digits become Latin letters.
    """
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    return " " + _GAP.sub(" ", _SIGN_RUN.sub(" ", text.lower()).translate(_FOLD)).strip() + " "


@dataclass
class ToxicityModel:
    """Weights of patterns (" stem" or " word "), phrases that excuse a pattern inside them, calibration."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    #: Logistic regression on (1, log(1 + sum), sum per 100 words).
    calibration: tuple[float, float, float] = (-4.0, 1.0, 0.5)

    def automaton(self) -> ahocorasick.Automaton | None:
        if not self.weights:
            return None
        a = ahocorasick.Automaton()
        for p, w in self.weights.items():
            a.add_word(p, (len(p), w))
        for p in self.exceptions:
            a.add_word(p, (len(p), None))
        a.make_automaton()
        return a


def hits(folded: str, automaton: ahocorasick.Automaton | None) -> list[tuple[int, int, float]]:
    """(start, end, weight): the heaviest pattern at each word, without those inside an exception phrase."""
    best: dict[int, tuple[int, float]] = {}
    excused: list[tuple[int, int]] = []
    for end, (n, w) in automaton.iter(folded) if automaton else ():
        start = end - n + 1
        if w is None:
            excused.append((start, end))
        elif start not in best or best[start][1] < w:
            best[start] = (end, w)
    out, reach, k = [], -1, 0
    excused.sort()
    for start, (end, w) in sorted(best.items()):
        while k < len(excused) and excused[k][0] <= start:
            reach = max(reach, excused[k][1])
            k += 1
        if end > reach:
            out.append((start, end, w))
    return out


def features(text: str, automaton: ahocorasick.Automaton | None) -> tuple[float, float]:
    folded = fold(text)
    total = sum(w for _, _, w in hits(folded, automaton))
    words = max(1, folded.count(" ") - 1)
    return math.log1p(total), 100.0 * total / words


def toxicity(text: str | None, model: ToxicityModel, automaton: ahocorasick.Automaton | None) -> float:
    x, y = features(text or "", automaton)
    a, b, c = model.calibration
    return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, a + b * x + c * min(y, 50.0)))))


def _terms(text: str) -> set[str]:
    words = set(fold(text).split())
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in STEMS if len(w) > k}


def _term_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic: Counter[str] = Counter()
    clean: Counter[str] = Counter()
    for b in batches:
        for t, y in zip(b["text"].to_pylist(), b["toxic"].to_pylist(), strict=True):
            (toxic if y else clean).update(_terms(t))
    terms = list(toxic | clean)
    yield pa.RecordBatch.from_arrays(
        [pa.array(terms, pa.string()), pa.array([toxic[t] for t in terms], pa.int64()), pa.array([clean[t] for t in terms], pa.int64())],
        ["term", "n_toxic", "n_clean"],
    )


def _phrase_counter(model: ToxicityModel) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        toxic: Counter[str] = Counter()
        clean: Counter[str] = Counter()
        for b in batches:
            for t, y in zip(b["text"].to_pylist(), b["toxic"].to_pylist(), strict=True):
                folded = fold(t)
                found = set()
                for s, _, _ in hits(folded, automaton):
                    stop = folded.find(" ", s + 1)
                    before, after = folded.rfind(" ", 0, s), folded.find(" ", stop + 1)
                    if before >= 0:
                        found.add(folded[before : stop + 1])
                    if after >= 0:
                        found.add(folded[s : after + 1])
                (toxic if y else clean).update(found)
        terms = list(clean)
        yield pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.string()), pa.array([toxic[t] for t in terms], pa.int64()), pa.array([clean[t] for t in terms], pa.int64())],
            ["term", "n_toxic", "n_clean"],
        )
        # phrases of toxic rows count too where another partition has them in clean rows
        only = [t for t in toxic if t not in clean]
        yield pa.RecordBatch.from_arrays(
            [pa.array(only, pa.string()), pa.array([toxic[t] for t in only], pa.int64()), pa.array([0] * len(only), pa.int64())],
            ["term", "n_toxic", "n_clean"],
        )

    return count


def _featurer(model: ToxicityModel) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for b in batches:
            found = np.array([features(t, automaton) for t in b["text"].to_pylist()], float).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), b["toxic"]], ["x", "y", "toxic"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float, float]:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> ToxicityModel:
    """A model from a bounded sample of labelled rows: about fit_rows by hash of the id.

    A pattern's weight is the log-odds of a toxic document that has it. Stems take the place of the words
    that they begin where they are as telling. Rows without text or label are ignored; without toxic
    rows the lexicon is empty and every score is the same.
    """
    marked = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("toxic"))
    share = min(1.0, fit_rows / max(1, marked.count()))
    # as many ids as fit_rows, about, by the share
    chosen = marked.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") <= FIT_CHARS)
    # written once, so that the passes below don't read all documents each
    sample = stored(rows.join(F.broadcast(chosen), "id").select("text", "toxic"), "toxicity-sample")
    n = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_toxic:
        return ToxicityModel()
    added = [F.sum(c).alias(c) for c in ("n_toxic", "n_clean")]
    counts = "term string, n_toxic long, n_clean long"
    odds = F.log((F.col("n_toxic") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("n_clean") + 0.5) / (n_clean + 1.0))
    terms = (
        sample.mapInArrow(_term_counter, counts).groupBy("term").agg(*added).withColumn("weight", odds)
        .where((F.col("n_toxic") >= LEAST_TOXIC) & (F.col("weight") >= LEAST_ODDS))
        .orderBy(F.desc("n_toxic"), "term").limit(LEXICON_SIZE).collect()
    )
    best: dict[str, tuple[float, float]] = {}
    for r in sorted(terms, key=lambda r: (len(r["term"].strip()), r["term"])):
        # a stem stands for the words that it begins unless they are more telling by far
        stems = [best[r["term"][:k]] for k in range(2, len(r["term"])) if r["term"][:k] in best]
        purity = r["n_toxic"] / (r["n_toxic"] + r["n_clean"] * n_toxic / max(1, n_clean))
        if not any(p >= 0.98 or p >= purity - 0.01 for _, p in stems):
            best[r["term"]] = (r["weight"], purity)
    model = ToxicityModel({t: w for t, (w, _) in best.items()})
    phrases = (
        sample.mapInArrow(_phrase_counter(model), counts).groupBy("term").agg(*added)
        .where("n_clean >= 3 and n_toxic = 0").orderBy(F.desc("n_clean"), "term").limit(LEXICON_SIZE).collect()
    )
    model.exceptions = [r["term"] for r in phrases]
    found = sample.mapInArrow(_featurer(model), "x double, y double, toxic int").toArrow()
    x, y = found["x"].to_numpy(), np.minimum(found["y"].to_numpy(), 50.0)
    model.calibration = _logistic(np.stack([np.ones(len(x)), x, y], 1), found["toxic"].to_numpy().astype(float))
    return model


def _scorer(model: str, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ToxicityModel(**json.loads(model))
        automaton = own.automaton()
        for b in batches:
            s = np.array([toxicity(t.as_py(), own, automaton) for t in b["text"]], float)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return score


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per input row: doc_id, score (0 to 1), predicted (1 if score >= threshold).

    Whole texts are scored where they are read, without a shuffle: the weights of matched patterns,
    those inside an exception phrase left out, are summed, normalised by the number of words and
    calibrated. Null and empty texts have no match and get the lowest score. The model has at most
    LEXICON_SIZE patterns and as many phrases. Repeated rows each get a row; other columns are ignored;
    an empty table gives an empty table.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(released(_scorer(json.dumps(model.__dict__), threshold)), "doc_id long, score double, predicted int")
