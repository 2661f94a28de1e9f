"""URL lists, mixing and the pipeline, against plain Python; registered SQL against DuckDB."""

import datetime as dt
import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql.readwriter import DataFrameWriter
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from docframe.llm import queries, url_filters
from docframe.llm.mixing import LARGEST_PART, OTHER, mix_sources, poisson_table, source_rates
from docframe.llm.quality import CLASS_LEAST, FEW_DEVIATIONS, ORDER, QUANTILE, SLACK
from docframe.llm.url_filters import filter_urls

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    wanted = db.execute(queries.oracle_sql()[name])
    names = [d[0] for d in wanted.description]
    found = queries.queries()[name](spark, DATA)
    assert sorted(found.columns) == sorted(names)
    assert sorted(repr([r[c] for c in names]) for r in found.collect()) == sorted(repr(list(r)) for r in wanted.fetchall())


def op5_sql() -> tuple[list[str], str]:
    """(steps, result): the model level by level, as it is defined: counts, discounts, contexts, probabilities."""
    levels = [f"t{ORDER} AS (SELECT lang, g, count(*) FILTER (WHERE learn) AS c FROM grams GROUP BY ALL)"]
    levels += [f"t{k} AS (SELECT lang, substr(g, 2) AS g, count(*) FILTER (WHERE c > 0) AS c FROM t{k + 1} GROUP BY ALL)" for k in range(ORDER - 1, 0, -1)]
    levels += ["p0 AS (SELECT lang, '' AS g, 1.0 / (count(*) FILTER (WHERE c > 0) + 1) AS p FROM t1 GROUP BY lang)"]
    for k in range(1, ORDER + 1):
        n = ", ".join(f"greatest(count(*) FILTER (WHERE c = {j}), 1)::DOUBLE AS n{j}" for j in (1, 2, 3, 4))
        d = [f"least(greatest({j} - {j + 1} * n1 / (n1 + 2 * n2) * n{j + 1} / n{j}, {lo}), {hi}) AS d{j}" for j, lo, hi in ((1, 0.05, 0.95), (2, 0.1, 1.9), (3, 0.15, 2.85))]
        levels += [
            f"d{k} AS (SELECT lang, {', '.join(d)} FROM (SELECT lang, {n} FROM t{k} WHERE c > 0 GROUP BY lang))",
            f"u{k} AS (SELECT t.lang, g, substr(g, 1, {k - 1}) AS h, c::DOUBLE AS c, CASE WHEN c >= 3 THEN d3 WHEN c = 2 THEN d2 WHEN c = 1 THEN d1 ELSE 0 END AS d FROM t{k} t LEFT JOIN d{k} USING (lang))",
            f"h{k} AS (SELECT lang, h, sum(c) AS total, sum(d) AS freed FROM u{k} GROUP BY ALL)",
            f"p{k} AS (SELECT u.lang, u.g, CASE WHEN total > 0 THEN (c - d) / total + freed / total * p ELSE p END AS p FROM u{k} u JOIN h{k} USING (lang, h) JOIN p{k - 1} b ON b.lang = u.lang AND b.g = substr(u.g, 2))",
        ]
    before = f"""
docs AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS trusted,
         ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 5 = 0 AS held_out FROM documents),
grams AS (SELECT doc_id, lang, trusted AND NOT held_out AS learn, g FROM cut JOIN docs USING (doc_id))
"""
    after = f"""
learned AS (SELECT lang FROM t{ORDER} GROUP BY lang HAVING max(c) > 0),
scored AS (
  SELECT doc_id, d.lang, trusted, held_out, length(text) AS n, floor(log2(greatest(length(text), 1)))::INTEGER AS class, b.bits
  FROM docs d LEFT JOIN (SELECT doc_id, avg(-log2(p)) AS bits FROM grams JOIN p{ORDER} USING (lang, g) WHERE lang IN (FROM learned) GROUP BY doc_id) b USING (doc_id)),
held AS (SELECT * FROM scored WHERE trusted AND held_out AND bits IS NOT NULL),
by_lang AS (
  SELECT lang, CASE WHEN count(*) * (1 - {QUANTILE}) < 1 THEN greatest(quantile_disc(bits, {QUANTILE}), avg(bits) + {FEW_DEVIATIONS} * coalesce(stddev_samp(bits), 0.1 * avg(bits)))
               ELSE quantile_disc(bits, {QUANTILE}) END AS of_lang FROM held GROUP BY lang),
by_class AS (SELECT lang, class, quantile_disc(bits, {QUANTILE}) AS of_class FROM held GROUP BY ALL HAVING count(*) >= {CLASS_LEAST}),
limits AS (SELECT s.*, coalesce(of_class, of_lang) * {SLACK} AS most FROM scored s LEFT JOIN by_lang USING (lang) LEFT JOIN by_class USING (lang, class))
"""
    last = f"""
SELECT doc_id, nullif(lang, '') AS lang, round(2 ** bits, 6) AS perplexity, round(2 ** most, 6) AS threshold,
       CASE WHEN n = 0 THEN false WHEN bits IS NULL OR most IS NULL THEN true ELSE bits <= most END AS kept FROM limits
"""
    split = lambda text: re.split(r",\n(?=[a-z_]+ AS)", text.strip())
    return [*split(before), *levels, *split(after)], last


def test_op5_in_sql(spark):
    """Step by step; as one statement DuckDB takes minutes and many GB for it, so that it is not registered."""
    db = duckdb.connect(config={"memory_limit": "4GB", "threads": 4})
    for t in ("documents", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    ids, grams = [], []
    for i, text in db.execute("SELECT doc_id, text FROM documents WHERE text <> ''").fetchall():
        padded = " " * (ORDER - 1) + text
        ids += [i] * len(text)
        grams += [padded[k : k + ORDER] for k in range(len(text))]
    db.register("cut", pa.table({"doc_id": ids, "g": grams}))
    steps, result = op5_sql()
    for step in steps:
        db.execute(f"CREATE TEMP TABLE {step}")
    wanted = {r[0]: r for r in db.execute(result).fetchall()}
    found = {r["doc_id"]: tuple(r) for r in queries.op5_quality(spark, DATA).collect()}
    assert found == wanted and len({r[3] for r in found.values()}) > 1


@pytest.mark.parametrize("name", ["op2_exact_dedup", "op8_url_filter", "op9_mixing"])
def test_native_operators_have_no_python(spark, monkeypatch, name):
    """Also not in the jobs before the last one, whose results are stored."""
    plans = []

    def noted(method):
        def run(self, *args, **kwargs):
            frame = self if isinstance(self, DataFrame) else self._df
            plans.append(frame._jdf.queryExecution().executedPlan().toString())
            return method(self, *args, **kwargs)

        return run

    for owner, methods in ((DataFrame, ("collect", "count", "toArrow", "toPandas", "first")), (DataFrameWriter, ("parquet",))):
        for m in methods:
            monkeypatch.setattr(owner, m, noted(getattr(owner, m)))
    queries.queries()[name](spark, DATA).collect()
    assert len(plans) > 1
    assert not any(x in plan for plan in plans for x in ("Python", "Arrow", "Pandas", "MapPartitions", "SerializeFromObject"))


# URL lists


def at(day, hour=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=hour)


ENTRIES = [
    ("l", "Bad.com", "block", at(1)), ("l", "bad.com", "remove", at(5)), ("l", "bad.com", "block", at(40)),
    ("m", "bad.com", "allow", at(3)), ("l", "good.bad.com", "allow", at(1)), ("l", "site.org/ads", "block", at(2)),
    ("l", "bad.com", "allow", at(40)), ("l", None, "block", at(1)), ("l", "x.y", None, at(1)), (None, "late.net", "block", at(70)), ("l", "z.z", "block", None),
]
CAPTURES = [
    (1, "http://bad.com/", at(0)), (2, "https://www.bad.com:80/x?y#z", at(1)), (3, "http://BAD.com.", at(4, 5)), (4, "http://bad.com", at(5)), (5, "http://bad.com/a", at(41)),
    (6, "http://u:p@deep.good.bad.com/", at(2)), (7, "http://site.org/ads/one", at(2)), (8, "http://site.org/adsense", at(3)), (9, None, at(1)), (10, "no url", at(1)),
    (11, "http://bad.com/", None), (12, "http://late.net/", at(71)), (12, "http://late.net/", at(71)), (None, "http://bad.com/", at(2)), (13, "http://sub.late.net/" + "q" * 100_000, at(75)), (14, "http://", at(1)),
]
TYPES = "page_id long, url string, fetch_time timestamp, pattern string, action int"


@pytest.mark.parametrize("broadcast, hot", [(1000, 1000), (0, 1000), (0, 2)])
def test_urls_against_plain_python(spark, monkeypatch, broadcast, hot):
    monkeypatch.setattr(url_filters, "BROADCAST_INTERVALS", broadcast)
    monkeypatch.setattr(url_filters, "HOT_CAPTURES", hot)
    captures = spark.createDataFrame([(*c, "p", 1) for c in CAPTURES], TYPES)
    entries = spark.createDataFrame(ENTRIES, "list_name string, pattern string, action string, listed_at timestamp")
    rows = filter_urls(captures, entries).collect()
    assert len(rows) == len(CAPTURES)
    found = {(r["page_id"], r["fetch_time"]): r for r in rows}
    want = {1: (0, None, False), 2: (1, "bad.com", True), 3: (2, "bad.com", False), 4: (1, "bad.com", False), 5: (2, "bad.com", True), 6: (2, "good.bad.com", False),
            7: (1, "site.org/ads", True), 8: (0, None, False), 9: (0, None, False), 10: (0, None, False), 11: (0, None, False), 12: (1, "late.net", True), None: (1, "bad.com", True),
            13: (1, "late.net", True), 14: (0, None, False)}
    got = {r["page_id"]: (r["n_active"], r["pattern"], r["blocked"]) for r in found.values()}
    assert got == want
    assert filter_urls(captures.limit(0), entries).count() == 0
    assert filter_urls(captures, entries.limit(0)).where("blocked or n_active > 0").count() == 0


def test_closing_slashes_and_addresses(spark):
    listed = ["site.org/", "Other.org//a/", "[2001:DB8::1]", "10.0.0.7", "0.7"]
    entries = spark.createDataFrame([("l", p, "block", at(1)) for p in listed], "list_name string, pattern string, action string, listed_at timestamp")
    urls = ["http://site.org/x", "http://site.org", "http://other.org/a?b", "http://u@[2001:db8::1]:80/x", "http://10.0.0.7/", "http://other.org/b", "http://[2001:db8::2]/"]
    captures = spark.createDataFrame([(i, u, at(2)) for i, u in enumerate(urls)], "page_id long, url string, fetch_time timestamp")
    found = {r["page_id"]: (r["n_active"], r["pattern"], r["host"]) for r in filter_urls(captures, entries).collect()}
    assert found == {
        0: (1, "site.org", "site.org"), 1: (1, "site.org", "site.org"), 2: (1, "other.org/a", "other.org"), 3: (1, "[2001:db8::1]", "[2001:db8::1]"),
        4: (1, "10.0.0.7", "10.0.0.7"), 5: (0, None, "other.org"), 6: (0, None, "[2001:db8::2]"),
    }


def test_path_patterns_of_any_depth_and_case(spark):
    listed = ["Site.org/a/b/c", "SITE.org/Ads", "deep.net/1/2/3/4/5/6", "site.org/a"]
    entries = spark.createDataFrame([("l", p, "block", at(1)) for p in listed], "list_name string, pattern string, action string, listed_at timestamp")
    urls = ["http://site.org/a/b/c/d", "http://SITE.org/Ads/x", "http://site.org/ads", "http://deep.net/1/2/3/4/5/6?q", "http://deep.net/1/2/3/4/5", "http://site.org/a/B/c"]
    captures = spark.createDataFrame([(i, u, at(2)) for i, u in enumerate(urls)], "page_id long, url string, fetch_time timestamp")
    found = {r["page_id"]: (r["n_active"], r["pattern"]) for r in filter_urls(captures, entries).collect()}
    assert found == {0: (2, "site.org/a/b/c"), 1: (1, "site.org/Ads"), 2: (0, None), 3: (1, "deep.net/1/2/3/4/5/6"), 4: (0, None), 5: (1, "site.org/a")}


# mixing


def test_poisson_table():
    for mean in (1e-9, 0.3, 1.0, LARGEST_PART):
        table = poisson_table(mean)
        assert table == sorted(table) and math.isclose(table[-1], 1.0, rel_tol=1e-12)
        assert math.isclose(sum(1 - p for p in table), mean, rel_tol=1e-6)


def _count(seed, ident, rate):
    parts = max(1, math.ceil(rate / LARGEST_PART))
    table = poisson_table(rate / parts)
    numbers = [int(hashlib.md5(f"{seed}:{ident}:{j}".encode()).hexdigest()[:12], 16) / 2**48 for j in range(1, parts + 1)]
    return sum(sum(p <= u for p in table) for u in numbers)


def test_mixture_against_plain_python(spark):
    rng = random.Random(1)
    rows = [(i, f"text {i}", rng.choice(["big"] * 6 + ["mid"] * 3 + ["tiny"]), 5, "s") for i in range(3000)]
    rows += [(5000, None, None, 1, "s"), (5001, "", "unnamed", 1, "s"), (None, "x", "mid", 1, "s"), (7, "again", "mid", 1, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int, u string")
    weights = {"big": 1.0, "mid": 1.0, "tiny": 2.0, "absent": 4.0, "zero": 0.0}
    rates = source_rates(df, weights, "source")
    sizes = Counter(r[2] for r in rows)
    assert math.isclose(rates["tiny"] * sizes["tiny"], 2 * rates["big"] * sizes["big"]) and set(rates) == {"big", "mid", "tiny"}
    found = mix_sources(df, weights, total=20_000.0)
    held = Counter((r["doc_id"], r["text"]) for r in found.collect())
    rates = source_rates(df, weights, "source", 20_000.0)
    assert rates["tiny"] > LARGEST_PART
    want = {(r[0], r[1]): _count("mix", "" if r[0] is None else r[0], rates[r[2]]) for r in rows if r[2] in rates}
    assert held == {k: n for k, n in want.items() if n}
    shares = Counter()
    for r in found.groupBy("source").count().collect():
        shares[r[0]] = r[1] / 20_000
    assert abs(shares["big"] - 0.25) < 0.02 and abs(shares["tiny"] - 0.5) < 0.03
    assert found.columns == [*df.columns, "copy", "shuffle_key"]
    with_other = mix_sources(df, {"big": 1.0, OTHER: 1.0})
    assert with_other.where("source is null or source = 'unnamed'").count() >= 0
    assert mix_sources(df.limit(0), weights).count() == 0 and mix_sources(df, {}).count() == 0


def test_no_source_disappears(spark, tmp_path):
    rows = [(i, "x", ("src0", "src1", None, "blog", "wiki")[i % 5]) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    rates = source_rates(df, queries.MIX_WEIGHTS, "source", keep_other=True)
    assert rates[OTHER] == 1.0 and {k: r for k, r in rates.items() if k != OTHER} == source_rates(df, queries.MIX_WEIGHTS, "source")
    half = source_rates(df, queries.MIX_WEIGHTS, "source", 1000.0, keep_other=True)
    assert all(math.isclose(half[k], r / 2) for k, r in rates.items())
    assert source_rates(df, {}, "source", keep_other=True) == {OTHER: 1.0}
    for found in (queries.op9_mixing(spark, str(tmp_path)), corpus_pipeline.mix(spark, df, str(tmp_path))):
        sizes = Counter(r["source"] for r in found.collect())
        assert all(320 < sizes[s] < 480 for s in (None, "blog", "wiki")) and sizes["src0"] > sizes["src1"] > 0


def test_columns_of_the_new_columns_names_stay(spark):
    df = spark.createDataFrame([(i, "a", f"own{i}", "x") for i in range(50)], "doc_id long, source string, Copy string, shuffle_key string")
    found = mix_sources(df, {"a": 1.0})
    assert found.columns == [*df.columns, "copy_", "shuffle_key_"]
    assert all(r["Copy"] == f"own{r['doc_id']}" and r["shuffle_key"] == "x" for r in found.collect())


def test_order_is_shuffled(spark):
    df = spark.range(2000).selectExpr("id AS doc_id", "'a' AS source")
    ids = [r["doc_id"] for r in mix_sources(df, {"a": 1.0}).collect()]
    steps = sum(abs(a - b) for a, b in zip(ids, ids[1:], strict=False)) / len(ids)
    assert 500 < steps < 850


# pipeline


def test_stages_on_odd_documents(spark, tmp_path):
    rng = random.Random(2)
    words = [f"{a}{b}" for a in "bdfglmn" for b in ("ar", "el", "in", "os")]
    text = lambda n: " ".join(rng.choices(words, k=n)) + "."
    base = [text(300) for _ in range(40)]
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(base)]
    rows += [(100 + i, t, "en", "src0", 1) for i, t in enumerate(base[:10])]  # exact copies
    rows += [(200 + i, base[i].replace(base[i].split()[5], "other", 1), "en", "src1", 1) for i in range(10, 20)]  # near copies
    rows += [(300, "%$!! " * 80, "en", "src0", 1), (301, None, None, None, None), (302, "", "en", "src0", 0), (5, base[5], "en", "src2", 1)]
    root = tmp_path / "sf"
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(root / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(root / "labels.parquet"))
    docs = spark.read.parquet(str(root / "documents.parquet"))
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(root))
        assert docs.columns == df.columns
        docs.write.parquet(str(tmp_path / f"s{len(seen)}"))
        docs = spark.read.parquet(str(tmp_path / f"s{len(seen)}"))
        seen.append({r["doc_id"] for r in docs.collect()})
    assert not seen[0] & {300, 301, 302} and set(range(100, 110)) <= seen[0]
    assert seen[1] >= set(range(100, 110)) and not seen[1] & (set(range(10)) - {5} | {5})
    # a word of 300 changed: the near copies of 10 to 19 go, and nothing else does
    # (with so little trusted text a strange word may cost some of them the first stage)
    assert seen[1] - seen[2] == set(range(210, 220)) & seen[1] and len(seen[1] - seen[2]) >= 5
    # the mixture by hand: each row as often as the hash of its id says
    kept = spark.read.parquet(str(tmp_path / "s2"))
    rates = source_rates(kept, queries.MIX_WEIGHTS, "source", keep_other=True)
    want = {r["doc_id"]: _count("mix", r["doc_id"], rates[r["source"]]) for r in kept.collect()}
    assert Counter(r["doc_id"] for r in docs.collect()) == {k: n for k, n in want.items() if n}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(root))
    plain = Tokenizer.from_file(queries.TOKENIZER)
    tokens = sum(len(plain.encode(r["text"], add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert sum(r["length"] for r in packed.collect()) == tokens
    assert {r["doc_id"] for r in packed.collect()} == seen[3] <= seen[2]


def test_rows_without_or_with_one_id_go_only_by_their_text(spark, tmp_path):
    rng = random.Random(3)
    words = [f"{a}{b}" for a in "bdfglmn" for b in ("ar", "el", "in", "os")]
    text = lambda n=300: " ".join(rng.choices(words, k=n)) + "."
    rows = [(i, text()) for i in range(40)] + [(None, text()) for _ in range(6)] + [(60, text()) for _ in range(3)]
    far = text()
    rows += [(90, far), (91, far), (91, text()), (None, far)]
    junk = [(None, "%$!! " * 80), (60, "#!$% " * 90)]
    root = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    made = lambda some: spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in some], schema)
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    held = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    assert held(corpus_pipeline.keep_quality(spark, made(rows + junk), root)) == Counter(rows)
    # of the three rows of one text that of the smallest id stays; every other text is a row
    assert held(corpus_pipeline.drop_near_copies(spark, made(rows + rows[:1]), root)) == Counter(r for r in rows if r not in ((91, far), (None, far)))


def test_run_equals_its_stages_without_documents(spark, tmp_path):
    root = tmp_path / "empty"
    spark.read.parquet(f"{DATA}/documents.parquet").limit(0).write.parquet(str(root / "documents.parquet"))
    spark.read.parquet(f"{DATA}/labels.parquet").limit(0).write.parquet(str(root / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(root)).count() == 0


def test_registered():
    names = __spark_entry__.queries()
    assert [n for n in range(1, 11) if not any(x.startswith(f"op{n}_") for x in names)] == [] and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "SimHash near-dedup", "mixing sources", "best-fit packing"]
