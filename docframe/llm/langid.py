"""Language identification by compression with one raw-content dictionary for each language."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docframe.llm.memory import released

#: Bytes of sampled text in a dictionary, and characters of one text in it at most.
DICTIONARY_BYTES = 192 << 10
TEXT_BYTES = 8 << 10
#: Training rows of a language that are looked at to fill its dictionary.
SAMPLE_ROWS = 600
#: Texts of fewer bytes are compressed at a higher level.
SHORT_BYTES = 1 << 10
LEVEL, SHORT_LEVEL = 3, 12
#: Share by which the best language must beat the second to be accepted.
MARGIN = 0.01
UNDETERMINED = "und"


def folded(text: str) -> bytes:
    """Case says little of the language, but costs the matches with lower-case dictionaries."""
    return text.lower().encode("utf-8", "replace")


def fit_dictionaries(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> dict[str, bytes]:
    """Sampled text of each non-null language, most frequent language first.

    The sample is bounded: by hash of the id, about SAMPLE_ROWS rows of a language, and of each a window of
    TEXT_BYTES characters at a place by hash (the whole text, where it is shorter) until DICTIONARY_BYTES are full.
    Rows of a language are thinned by hash before they are ranked, so that no task ranks a whole language.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 4.0 * SAMPLE_ROWS / n))])
    place = F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) / float(1 << 30)
    beyond = F.greatest(F.length(text_col) - TEXT_BYTES, F.lit(0)) + 1
    window = F.substring(F.col(text_col), F.pmod(F.xxhash64(id_col, F.lit(1)), beyond).cast("int") + 1, F.lit(TEXT_BYTES))
    sample = rows.select(F.col(lang_col).alias("lang"), window.alias("text"), place.alias("place")).where(F.col("place") <= share[F.col("lang")])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "text"))
    texts: dict[str, list[bytes]] = {k: [] for k in sorted(counts, key=lambda k: (-counts[k], k))}
    for r in sample.withColumn("rank", rank).where(F.col("rank") <= SAMPLE_ROWS).orderBy("lang", "rank").toLocalIterator():
        texts[r["lang"]].append(folded(r["text"]))
    out = {}
    for lang, own in texts.items():
        held = b""
        for t in own:
            if len(held) + len(t) < DICTIONARY_BYTES:
                held += t + b"\n"
        out[lang] = held
    return out


class Compressors:
    """Compressed sizes of a text under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.langs = list(dictionaries)
        self.by_level = {level: [self._one(d, level) for d in dictionaries.values()] for level in (LEVEL, SHORT_LEVEL)}

    @staticmethod
    def _one(raw: bytes, level: int) -> zstandard.ZstdCompressor:
        if len(raw) < 8:
            return zstandard.ZstdCompressor(level=level, write_content_size=False)
        data = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=data, write_content_size=False, write_dict_id=False)

    def sizes(self, text: bytes) -> list[int]:
        own = self.by_level[SHORT_LEVEL if len(text) < SHORT_BYTES else LEVEL]
        return [len(c.compress(text)) for c in own]

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin): the smallest size wins, ties go to the more frequent language."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, 0.0
        sizes = np.array(self.sizes(folded(text)), float)
        best = int(sizes.argmin())
        if len(sizes) == 1:
            return self.langs[0], 1.0, 1.0
        margin = float(np.delete(sizes, best).min() / sizes[best] - 1.0)
        bits = -8.0 * (sizes - sizes[best])
        return self.langs[best], float(1.0 / np.exp2(np.maximum(bits, -60.0)).sum()), margin


def _predictor(dictionaries, margin: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Compressors(dictionaries.value)
        for b in batches:
            found = [held.predict(t.as_py()) for t in b["text"]]
            lang, score, by = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    b["doc_id"],
                    pa.array(lang, pa.string()),
                    pa.array(score, pa.float64()),
                    pa.array(by, pa.float64()),
                    pa.array([x >= margin for x in by], pa.bool_()),
                ],
                ["doc_id", "lang_pred", "score", "margin", "accepted"],
            )

    return predict


def identify_language(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """One row per input row: doc_id, lang_pred, score, margin, accepted.

    Each whole text is compressed with each dictionary where it is read, without a shuffle; the language
    of the smallest result is predicted, and accepted if the next one is larger by `margin` at least. A
    text that is null or has no letter is "und" with score 0 and is not accepted, as is every text where
    there is no dictionary. Dictionaries have DICTIONARY_BYTES at most, one for each language. Repeated
    rows each get a row; other columns are ignored; an empty table gives an empty table.
    """
    held = docs.sparkSession.sparkContext.broadcast(dictionaries)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(released(_predictor(held, margin)), "doc_id long, lang_pred string, score double, margin double, accepted boolean")
