"""Every registered query: names and types of its columns, folds, and what it leaves in the shared folder."""

import zlib
from collections import Counter
from pathlib import Path

import pytest
from conftest import DATA

import corpus_pipeline
from docframe.llm import queries, storage

LARGER = DATA.replace("0.001", "0.01")
CONTRACTS = {
    "op1_secret_scan": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op2_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op3_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op4_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op5_quality": "doc_id bigint, lang string, perplexity double, threshold double, kept boolean",
    "op6_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op7_embeddings": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op8_url_filter": "page_id bigint, url string, fetch_time string, host string, n_active bigint, pattern string, list_name string, action string, blocked boolean",
    "op9_mixing": "doc_id bigint, text string, source string, copy int, shuffle_key string",
    "op10_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
}
ROWS = {"op7_embeddings": ("embeddings", "vec_id"), "op8_url_filter": ("pages", "page_id")}


def folders(spark):
    place = Path(storage.shared_dir(spark).removeprefix("file:")) / "docframe"
    return {p.name for p in place.iterdir()} if place.exists() else set()


@pytest.mark.parametrize("name", CONTRACTS)
def test_columns_rows_and_folders(spark, name):
    before = folders(spark)
    found = queries.queries()[name](spark, DATA)
    types = dict(found.dtypes)
    for c in CONTRACTS[name].split(", "):
        column, kind = c.split(" ")
        assert types[column] == kind, c
    rows = found.collect()
    # at most the result itself stays, until the application ends
    left = folders(spark) - before
    assert len(left) <= 1 and all(x.startswith(name.split("_")[0] + "-") for x in left)
    table, key = ROWS.get(name, ("documents", "doc_id"))
    ids = Counter(r[0] for r in spark.read.parquet(f"{DATA}/{table}.parquet").select(key).collect())
    own = Counter(r[key] for r in rows)
    if name == "op4_packing":
        assert own.keys() == ids.keys()
    elif name != "op9_mixing":
        assert own == ids
    if "held_out" in types:
        modulus, rest = (5, 0) if name == "op6_language" else (4, 2)
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == rest) for r in rows)
    if "score" in types:
        assert all(0 <= r["score"] <= 1 for r in rows)
    if name == "op10_toxicity":
        assert all(r["predicted"] == (r["score"] >= 0.3) for r in rows)
    if name == "op6_language":
        langs = {r[0] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("lang").distinct().collect()}
        assert {r["lang_pred"] for r in rows} <= langs | {"und"}


def test_the_pipeline_leaves_its_result_only(spark):
    before = folders(spark)
    rows = corpus_pipeline.run(spark, DATA)
    assert rows.count() > 0
    left = folders(spark) - before
    assert len(left) == 1 and left.pop().startswith("stage4-")


def test_a_cluster_without_a_shared_folder_is_an_error(spark, monkeypatch):
    class Conf:
        get = staticmethod(lambda *_: None)

    class Context:
        master = "spark://far:7077"
        getConf = staticmethod(lambda: Conf)
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = Conf

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session)


def test_language_and_toxicity_on_rows_never_seen(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    found = [r for r in queries.op6_language(spark, LARGER).collect() if r["held_out"] and (docs[r["doc_id"]]["text"] or "").strip()]
    right = sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in found)
    assert len(found) > 100 and right >= 0.95 * len(found)
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    scores = [(r["score"], toxic[r["doc_id"]]) for r in queries.op10_toxicity(spark, LARGER).collect() if r["held_out"] and r["doc_id"] in toxic]
    bad, good = [s for s, y in scores if y], [s for s, y in scores if not y]
    better = sum((b > g) + 0.5 * (b == g) for b in bad for g in good)
    assert bad and better >= 0.8 * len(bad) * len(good)
