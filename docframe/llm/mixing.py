"""Mixing sources to target weights by Poisson replication (DataFrame operations only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A larger mean is drawn as a sum of equal Poisson parts, so that exp(-mean) keeps its precision.
LARGEST_PART = 8.0
#: Terms of the distribution function of a part; beyond them a tail of less than 2**-60 is left.
TERMS = 64
#: The key of sources that the weights don't name, null included.
OTHER = "*"
SEED = "mix"


def poisson_table(mean: float, terms: int = TERMS) -> list[float]:
    """P(X <= k) for k = 0, 1, ... up to the first value from which the sum no longer grows."""
    term = total = math.exp(-mean)
    out = [total]
    for k in range(1, terms):
        term *= mean / k
        if total + term == total and k > mean:
            break
        total += term
        out.append(total)
    return out


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts, the same in every engine: 48 bits."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(1 << 48)


def source_key(source: Column, weights: dict[str, float]) -> Column:
    return F.when(source.isin(list(weights)), source).otherwise(F.lit(OTHER))


def source_rates(docs: DataFrame, weights: dict[str, float], source_col: str, total: float | None = None, keep_other: bool = False) -> dict[str, float]:
    """Mean repetitions of a document of each named source, and of OTHER.

    weights: target shares of documents, by source; they are scaled to sum to 1. OTHER may be among
    them; if it isn't, other sources are left out, or with keep_other have the share of the mixture that
    they have of the documents (of these and of the named sources), and the weights divide what remains.
    total: documents of the mixture, or else as many as the sources in it have. The counts that come to
    the driver are as many as the weights, plus one.
    """
    key = source_key(F.col(source_col), {k: w for k, w in weights.items() if k != OTHER})
    counts = {r[0]: r[1] for r in docs.groupBy(key.alias("key")).count().collect()}
    named = {k: w for k, w in weights.items() if counts.get(k) and w > 0}
    own = float(sum(counts[k] for k in named))
    other = counts.get(OTHER, 0) if keep_other and OTHER not in weights else 0
    size = own if total is None else float(total) * (own / (own + other) if own else 0.0)
    scale = sum(named.values())
    rates = {k: size * w / scale / counts[k] for k, w in named.items()}
    if other:
        rates[OTHER] = 1.0 if total is None else float(total) / (own + other)
    return rates


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float],
    id_col: str = "doc_id",
    source_col: str = "source",
    seed: str = SEED,
    total: float | None = None,
    partitions: int | None = None,
    keep_other: bool = False,
) -> DataFrame:
    """docs with each row repeated by a Poisson count, plus copy (from 0) and shuffle_key, shuffled globally.

    The count of a row inverts the Poisson distribution whose mean is the target repetition rate of its
    source at a number from the hash of seed and id; it depends on no other row. Copies go to tasks by
    the hash of (seed, id, copy) and are sorted by it there, so that every task is a random part of the
    mixture and a source with a third of all rows spreads evenly. Sources that have no rows take no
    share. Rows of sources with a zero or no weight are left out (sources that weights don't name stay with
    keep_other, see source_rates), as are rows whose count is 0; a null source is OTHER; a null id hashes as empty;
    rows that repeat an id have the same count. Columns of docs keep their names and values: where one is called
    copy or shuffle_key, the new column has "_" after its name, as often as needed. An empty table gives an empty
    table.
    """
    rates = source_rates(docs, weights, source_col, total, keep_other)
    key = source_key(F.col(source_col), {k: w for k, w in weights.items() if k != OTHER})
    parts = {k: max(1, math.ceil(r / LARGEST_PART)) for k, r in rates.items()}
    if rates:
        n_parts = F.create_map(*[F.lit(x) for k, n in parts.items() for x in (k, n)])[key]
        table = F.create_map(
            *[x for k, r in rates.items() for x in (F.lit(k), F.array(*[F.lit(p) for p in poisson_table(r / parts[k])]))]
        )[key]
    else:
        n_parts, table = F.lit(None).cast("int"), F.array().cast("array<double>")
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    numbers = F.transform(F.sequence(F.lit(1), n_parts), lambda j: uniform(F.lit(seed), ident, j))
    drawn = F.transform(numbers, lambda u: F.size(F.filter(table, lambda p: p <= u)))
    count = F.aggregate(drawn, F.lit(0), lambda a, x: a + x)
    copy, place = _free_name("copy", docs.columns), _free_name("shuffle_key", docs.columns)
    repeated = docs.withColumn("__n", count).where("__n > 0")
    copies = repeated.withColumn(copy, F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).drop("__n")
    keyed = copies.withColumn(place, F.substring(F.md5(F.concat_ws(":", F.lit(seed), ident, F.lit("copy"), F.col(copy).cast("string"))), 1, 16))
    dealt = keyed.repartition(partitions, place) if partitions else keyed.repartition(place)
    return dealt.sortWithinPartitions(place)


def _free_name(name: str, taken: list[str]) -> str:
    used = {c.lower() for c in taken}
    while name in used:
        name += "_"
    return name
