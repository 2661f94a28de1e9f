"""Secret scan with an incremental ledger of content-addressed blobs."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm.memory import released
from docframe.llm.storage import exists, move, new_path, remove, stored


def _either_case(word: str) -> str:
    """ASCII letters in either case; a case-insensitive flag would also accept other scripts' letters."""
    return re.sub("[a-z]", lambda m: f"[{m.group().upper()}{m.group()}]", word)


#: The base patterns.
ASSIGN = (
    "(" + _either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
#: Further kinds, by the public formats of these credentials.
PRIVATE_KEY = r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[A-Za-z0-9+/=\x09-\x0d\x20]+-----END (?:[A-Z]+ )?PRIVATE KEY-----"
#: A token begins where no token character stands before it, so that each run of them is tried once.
JWT = r"(?<![A-Za-z0-9_.-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"
URL_LOGIN = r"(?<![a-z0-9+.-])[a-z][a-z0-9+.-]{1,15}://[^\x00-\x20/:@]{1,64}:[^\x00-\x20/:@]{3,64}@"


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of pattern; those whose group is shorter than least are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    #: A text without any of these strings has no match.
    needs: tuple[str, ...] = ()
    compiled: re.Pattern = field(init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "compiled", re.compile(self.pattern))

    def __reduce__(self) -> tuple:
        return Rule, (self.kind, self.pattern, self.group, self.least, self.needs)

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        if self.needs and not any(x in text for x in self.needs):
            return
        for m in self.compiled.finditer(text):
            if m.end(self.group) - m.start(self.group) >= self.least:
                yield m.span()


BASE = (
    Rule("assign", ASSIGN, 2, 6),
    Rule("access", ACCESS, 0, 20, ("AKIA",)),
    Rule("hex", HEX, 0, 24),
)
EXTRA = (
    Rule("private_key", PRIVATE_KEY, needs=("PRIVATE KEY-----",)),
    Rule("jwt", JWT, needs=("eyJ",)),
    Rule("url_login", URL_LOGIN, needs=("://",)),
)
FINDINGS = "sha string, rule_version string, kinds array<string>, starts array<long>, ends array<long>"
#: New blobs whose digests are broadcast to find their texts; more are joined.
BROADCAST_BLOBS = 1_000_000


def rules_version(rules: Iterable[Rule]) -> str:
    """A digest of all that decides what the rules find."""
    return hashlib.sha256(repr([(r.kind, r.pattern, r.group, r.least, r.needs) for r in rules]).encode()).hexdigest()[:16]


def scan_text(text: str, rules: Iterable[Rule] = BASE + EXTRA) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) in code points, by start, then in the order of the rules."""
    found = [(s, i, r.kind, e) for i, r in enumerate(rules) for s, e in r.spans(text)]
    return [(kind, s, e) for s, _, kind, e in sorted(found)]


def _scanner(rules: tuple[Rule, ...], version: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["sha", "rule_version", "kinds", "starts", "ends"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [scan_text(t.as_py(), rules) for t in b["text"]]
            yield pa.RecordBatch.from_arrays(
                [
                    b["sha"],
                    pa.array([version] * len(found), pa.string()),
                    pa.array([[x[0] for x in f] for f in found], pa.list_(pa.string())),
                    pa.array([[x[1] for x in f] for f in found], pa.list_(pa.int64())),
                    pa.array([[x[2] for x in f] for f in found], pa.list_(pa.int64())),
                ],
                names,
            )

    return scan


class BlobLedger:
    """A table in shared storage of what was found in each blob under each version of the rules.

    A blob is a text, named by the SHA-256 of its UTF-8 bytes; a version is the digest of the rules, so that changed
    rules never meet old findings. `scan` adds the pairs of blob and version that the ledger does not have yet and
    reads no other text twice; `findings` gives the pairs of one version, each once, also where two writers have added
    the same. A batch of findings is one append of a whole file set, so a lost executor's task is run again and a
    failed append leaves nothing that readers see. `compact` writes the ledger anew, each pair once, in few files.
    """

    def __init__(self, spark, path: str | None = None) -> None:
        self.spark = spark
        self.path = path or new_path(spark, "ledger")

    def table(self) -> DataFrame:
        if exists(self.spark, self.path):
            return self.spark.read.schema(FINDINGS).parquet(self.path)
        return self.spark.createDataFrame([], FINDINGS)

    def _unseen(self, blobs: DataFrame, version: str) -> DataFrame:
        """blobs (sha, text) without those that the ledger has. Digests are compared first, so that texts that are
        known do not move."""
        if not exists(self.spark, self.path):
            return blobs
        seen = self.table().where(F.col("rule_version") == version).select("sha")
        new = stored(blobs.select("sha").distinct().join(seen, "sha", "left_anti"), "new-blobs")
        return blobs.join(F.broadcast(new) if new.count() <= BROADCAST_BLOBS else new, "sha", "left_semi")

    def scan(self, texts: DataFrame, rules: tuple[Rule, ...] = BASE + EXTRA) -> None:
        """texts: one column, text. Equal texts merge in each map task before the shuffle."""
        version = rules_version(rules)
        blobs = self._unseen(texts.select(F.sha2("text", 256).alias("sha"), "text"), version)
        once = blobs.groupBy("sha", "text").agg(F.count(F.lit(1)))
        once.select("sha", "text").mapInArrow(released(_scanner(rules, version)), FINDINGS).write.mode("append").parquet(self.path)

    def findings(self, rules: tuple[Rule, ...] = BASE + EXTRA) -> DataFrame:
        return self._once(self.table().where(F.col("rule_version") == rules_version(rules)))

    @staticmethod
    def _once(rows: DataFrame) -> DataFrame:
        first = F.min(F.struct("kinds", "starts", "ends")).alias("f")
        return rows.groupBy("sha", "rule_version").agg(first).select("sha", "rule_version", "f.kinds", "f.starts", "f.ends")

    def compact(self, files: int | None = None) -> None:
        """The same pairs, each once, in `files` files (or as many as a shuffle has partitions); one writer at a time.

        The new table is whole before it takes the place of the old one, which is put aside and then removed.
        """
        if not exists(self.spark, self.path):
            return
        target = f"{self.path}-compact-{uuid.uuid4().hex}"
        rows = self._once(self.table())
        (rows.coalesce(files) if files else rows).write.parquet(target)
        aside = f"{self.path}-old-{uuid.uuid4().hex}"
        move(self.spark, self.path, aside)
        move(self.spark, target, self.path)
        remove(self.spark, aside)


def find_secrets(
    versions: DataFrame,
    path_cols: list[str],
    text_col: str = "text",
    ledger: BlobLedger | None = None,
    rules: tuple[Rule, ...] = BASE + EXTRA,
) -> DataFrame:
    """Every row of versions (a historical version of a path): its path columns, blob and spans.

    Columns: path_cols, sha, kinds, starts, ends (arrays, equal lengths, by start); a path column of one of the last
    four names is an error. A null text counts as empty; an empty text has no spans; repeated rows each get a row;
    other columns are ignored. Whole texts are scanned, each distinct one once for a version of the rules, also over
    several calls with one ledger. An empty table gives an empty table.
    """
    own = ["sha", "kinds", "starts", "ends"]
    if clash := [c for c in path_cols if c.lower() in own]:
        raise ValueError(f"path columns {clash} have names of the result's own columns")
    ledger = ledger or BlobLedger(versions.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    ledger.scan(versions.select(text.alias("text")), rules)
    paths = versions.select(*path_cols, F.sha2(text, 256).alias("sha"))
    some = ledger.findings(rules).where("size(kinds) > 0").drop("rule_version")
    none = F.expr("array()")
    return paths.join(some, "sha", "left").select(
        *path_cols,
        "sha",
        F.coalesce("kinds", none.cast("array<string>")).alias("kinds"),
        F.coalesce("starts", none.cast("array<long>")).alias("starts"),
        F.coalesce("ends", none.cast("array<long>")).alias("ends"),
    )


def secret_digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, their digest and all spans as text, from the rows of find_secrets."""
    span = F.transform(
        F.arrays_zip("kinds", "starts", "ends"),
        lambda x: F.concat_ws(":", x["kinds"], x["starts"].cast("string"), x["ends"].cast("string")),
    )
    base = [r.kind for r in BASE]
    kept = F.filter(F.col("all"), lambda x: F.substring_index(x, ":", 1).isin(base))
    count = lambda kind: F.size(F.filter("kinds", lambda k: k == kind)).cast("long")
    return found.withColumn("all", span).select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in base],
        F.sha2(F.array_join(kept, ","), 256).alias("base_sha256"),
        F.array_join("all", ",").alias("spans"),
    )
