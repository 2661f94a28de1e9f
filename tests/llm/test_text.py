"""Secret scan, packing, quality, language and toxicity: brute force, round trips, held-out accuracy, edge cases."""

import hashlib
import math
import random
import re
import string
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from conftest import DATA
from tokenizers import Tokenizer

from docframe.llm import packing, quality, queries
from docframe.llm.langid import fit_dictionaries, identify_language
from docframe.llm.quality import quality_scores
from docframe.llm.secrets import BASE, BlobLedger, Rule, find_secrets, scan_text, secret_digest
from docframe.llm.toxicity import ToxicityModel, fit_toxicity, fold, hits, score_toxicity, toxicity

PATH = public_tokenizers.path("word_bpe_49k.json")
CLASH = "doc_id long, text string, lang string, kinds string, sha int, length string, trusted int, score string"


def docs(spark, rows, langs=None):
    return spark.createDataFrame([(i, t, (langs or {}).get(i, "en"), "k", 1, "l", 2, "s") for i, t in rows], CLASH)


# secrets


@pytest.mark.parametrize(
    "text, spans",
    [
        ("password=abcdef", ["assign:0:15"]),
        ("PassWD : 'abc_12", ["assign:0:16"]),
        ("token=abc", []),
        ("api_key=abc token=abcdefg", ["assign:12:25"]),
        ("\u017fecret=abcdefgh to\u212aen=abcdefgh", []),
        ("AKIA" + "A" * 16 + " AKIA" + "B" * 15, ["access:0:20"]),
        ("é" * 3 + "0123456789abcdef01234567", ["hex:3:27"]),
        ("0123456789abcdef0123456", []),
        ("secret=" + "a" * 30, ["assign:0:37", "hex:7:37"]),
        ("", []),
    ],
)
def test_base_spans(text, spans):
    assert [f"{k}:{s}:{e}" for k, s, e in scan_text(text, BASE)] == spans


def test_more_kinds_keep_the_base():
    text = "x https://user:pass1@host/ -----BEGIN RSA PRIVATE KEY-----\nAAAA\n-----END RSA PRIVATE KEY----- eyJhbGciOiJI.eyJzdWIiOiIx.sig token=abcdefg"
    every = scan_text(text)
    assert {k for k, _, _ in every} == {"url_login", "private_key", "jwt", "assign"}
    assert [x for x in every if x[0] == "assign"] == scan_text(text, BASE)


def test_ledger_scans_each_blob_once(spark):
    ledger = BlobLedger(spark)
    first = docs(spark, [(1, "token=abcdefg"), (2, "token=abcdefg"), (3, None), (4, "")])
    found = {r["doc_id"]: r for r in secret_digest(find_secrets(first, ["doc_id"], ledger=ledger)).collect()}
    assert found[1]["n_assign"] == found[2]["n_assign"] == 1 and found[3]["n_assign"] == 0
    assert found[1]["base_sha256"] == hashlib.sha256(b"assign:0:13").hexdigest() and found[1]["spans"] == "assign:0:13"
    assert found[3]["base_sha256"] == found[4]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert ledger.table().count() == 2
    more = first.union(docs(spark, [(5, "secret=qwertyu"), (1, "token=abcdefg")]))
    assert find_secrets(more, ["doc_id"], ledger=ledger).count() == 6 and ledger.table().count() == 3
    short = (Rule("short", "abc"),)
    again = find_secrets(more, ["doc_id"], ledger=ledger, rules=short)
    assert ledger.table().count() == 6 and sorted(r["kinds"] for r in again.collect())[-3:] == [["short"]] * 3
    # the same kind by another pattern is another version
    changed = find_secrets(more, ["doc_id"], ledger=ledger, rules=(Rule("short", "qwe"),))
    assert sum(len(r["kinds"]) for r in changed.collect()) == 1 and ledger.table().count() == 9
    assert find_secrets(docs(spark, []), ["doc_id"]).count() == 0


def test_ledger_of_two_writers(spark):
    ledger = BlobLedger(spark)
    own = docs(spark, [(1, "token=abcdefg"), (2, "")])
    find_secrets(own, ["doc_id"], ledger=ledger)
    ledger.table().write.mode("append").parquet(ledger.path)
    assert ledger.table().count() == 4 and find_secrets(own, ["doc_id"], ledger=ledger).count() == 2
    ledger.compact(files=1)
    assert ledger.table().count() == 2 and len(ledger.table().inputFiles()) == 1
    assert [r["kinds"] for r in find_secrets(own, ["doc_id"], ledger=ledger).orderBy("doc_id").collect()] == [["assign"], []]


def test_path_columns_of_the_results_names_are_an_error(spark):
    with pytest.raises(ValueError, match="kinds"):
        find_secrets(docs(spark, [(1, "x")]), ["doc_id", "kinds"])


@pytest.mark.parametrize("text", ["eyJ" * 333_334, "eyJaaaaaaaa." * 80_000, "password " * 110_000, "a://b:" * 160_000, "-----BEGIN PRIVATE KEY-----" * 40_000])
def test_long_texts_are_scanned_in_linear_time(text):
    began = time.perf_counter()
    scan_text(text)
    assert time.perf_counter() - began < 3


def plain_base_spans(text):
    """The base kinds by hand, without regular expressions."""
    names = ("password", "passwd", "secret", "token", "apikey", "api_key")
    value = set(string.ascii_letters + string.digits + "+/_.=-")
    lower = "".join(c.lower() if c in string.ascii_uppercase else c for c in text)
    found = []
    i = 0
    while i < len(text):
        name = next((n for n in names if lower.startswith(n, i)), None)
        at = i + len(name) if name else i
        if name:
            at += text[at : at + 1] in ('"', "'") and bool(text[at : at + 1])
            while text[at : at + 1] == " ":
                at += 1
            sign = text[at : at + 1] in (":", "=") and bool(text[at : at + 1])
            if sign:
                at += 1
                while text[at : at + 1] == " ":
                    at += 1
                at += text[at : at + 1] in ('"', "'") and bool(text[at : at + 1])
                end = at
                while text[end : end + 1] in value:
                    end += 1
                if end > at:
                    if end - at >= 6:
                        found.append((i, 0, "assign", end))
                    i = end
                    continue
        i += 1
    for rank, kind, head, own, least in ((1, "access", "AKIA", set(string.ascii_uppercase + string.digits), 20), (2, "hex", "", set("0123456789abcdef"), 24)):
        i = 0
        while i < len(text):
            end = i + len(head)
            if text.startswith(head, i):
                while text[end : end + 1] in own:
                    end += 1
            if text.startswith(head, i) and end > i + len(head):
                if end - i >= least:
                    found.append((i, rank, kind, end))
                i = end
            else:
                i += 1
    return [f"{kind}:{s}:{e}" for s, _, kind, e in sorted(found)]


def test_op1_against_a_scan_by_hand(spark):
    found = {r["doc_id"]: r for r in queries.op1_secret_scan(spark, DATA.replace("0.001", "0.01")).collect()}
    rows = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text").collect()
    some = 0
    for r in rows:
        want = plain_base_spans(r["text"] or "")
        some += len(want)
        own = found[r["doc_id"]]
        assert own["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [own[f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(x.startswith(k) for x in want) for k in ("assign", "access", "hex")]
        assert set(want) <= set(own["spans"].split(","))
    assert some > 0 and len(found) == len(rows)


# packing


def test_ids_equal_the_tokenizer():
    own, plain = packing.WordEncoder(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(1)
    letters = "abcXYZ éÉßœſƒ'’s 0²½ .,!?-_()<|> \t\n\x0b\xa0\x85\x1c ΑΣς 漢字 İı"
    texts = ["", " ", "don't can't WE'LL it's 'tis", "a<|endoftext|>b", "x" * 5000, "nb\xa0sp", "a b c d", "Σίσυφος", "Café café"]
    texts += ["".join(rng.choices(letters, k=rng.randrange(1, 60))) for _ in range(800)]
    for t, ids in zip(texts, own.encode(texts), strict=True):
        assert ids == np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_long_texts_are_taken_in_parts(monkeypatch):
    monkeypatch.setattr(packing, "CHARS_AT_ONCE", 50)
    own, plain = packing.WordEncoder(PATH), Tokenizer.from_file(PATH)
    texts = ["one two three " * 20, "y" * 300, "", "short", " lead " * 30]
    assert own.encode(texts) == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_caches_stay_bounded(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_RUNS", 20)
    monkeypatch.setattr(packing, "CACHED_WORDS", 20)
    own, plain = packing.WordEncoder(PATH), Tokenizer.from_file(PATH)
    texts = [f"word{i} other{i} word{i % 5}" for i in range(200)]
    assert own.encode(texts) == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert len(own.runs) <= 20 and len(own.words) <= 20


def test_another_vocabulary_takes_the_slow_path():
    other = public_tokenizers.path("byte_bpe_50k.json")
    own, plain = packing.WordEncoder(other), Tokenizer.from_file(other)
    texts = ["Plain Text, twice.  Twice", "don't", "", "é ü 中文"]
    assert not own.known and packing.WordEncoder(PATH).known
    assert own.encode(texts) == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def held(configs, capacity):
    out = Counter()
    for c in configs:
        assert c.lengths @ c.counts <= capacity and c.bins > 0
        for n, k in zip(c.lengths.tolist(), c.counts.tolist(), strict=True):
            out[n] += k * c.bins
    return out


@pytest.mark.parametrize("seed", range(4))
def test_configurations_place_every_piece(seed):
    rng = random.Random(seed)
    histogram = Counter(min(100, max(1, int(rng.lognormvariate(3, 1)))) for _ in range(rng.choice([5, 300, 4000])))
    found = packing.configurations(dict(histogram), 100)
    assert held(found, 100) == histogram
    bins, least = sum(c.bins for c in found), sum(k * n for k, n in histogram.items()) / 100
    assert bins <= 1.01 * least + 2
    assert packing.configurations({}) == []


@pytest.mark.parametrize("histogram", [{51: 600, 27: 600, 26: 600, 23: 1200}, {60: 10}, {7: 1}, {99: 40, 1: 3}, {k: 1 + k % 7 for k in range(1, 100)}])
def test_linear_program_covers_every_length(histogram):
    lengths = np.array(sorted(histogram))
    need = np.array([histogram[k] for k in lengths.tolist()])
    cover = packing.fractional_cover(lengths, need, 100)
    assert (cover.bins * cover.fill.held >= need * (1 - 1e-9)).all()
    assert (lengths @ need) / 100 - 1e-9 <= cover.bound <= cover.bins
    assert cover.bins <= 1.07 * cover.bound


def test_linear_program_beats_best_fit():
    # best fit, largest first, fills 600 + 200 + 300 sequences; 900 are full
    histogram = {51: 600, 27: 600, 26: 600, 23: 1200}
    found = packing.configurations(histogram, 100)
    lengths = np.array(sorted(histogram))
    plain = packing._pack_rest(lengths, np.array([histogram[k] for k in lengths.tolist()]), 100)
    assert held(found, 100) == histogram and sum(c.bins for c in plain) == 1100
    assert 900 <= sum(c.bins for c in found) <= 910


def test_prices_of_fills_against_all_configurations():
    lengths, log_weights, rent, capacity = np.array([3, 5, 7]), np.array([0.3, -0.2, 0.9]), 0.4, 20
    total, held_sum = 0.0, np.zeros(3)
    stack = [()]
    while stack:
        own = stack.pop()
        size = int(sum(lengths[i] for i in own))
        w = math.exp(sum(log_weights[i] for i in own) - rent * (capacity - size))
        total += w
        held_sum += w * np.bincount(np.array(own, int), minlength=3)
        stack += [(*own, i) for i in range(3) if size + lengths[i] <= capacity]
    assert np.allclose(packing.Fill(lengths, log_weights, rent, capacity).held, held_sum / total)


def test_best_value_is_the_best_knapsack():
    lengths, values = np.array([3, 5, 7, 11]), np.random.default_rng(1).random(4)
    best = max(
        a * values[0] + b * values[1] + c * values[2] + d * values[3]
        for a in range(14) for b in range(9) for c in range(6) for d in range(4) if 3 * a + 5 * b + 7 * c + 11 * d <= 40
    )
    assert math.isclose(packing.best_value(lengths, values, 40), best)


def test_pack_documents(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "don't", "x,"], k=rng.randrange(0, 90)))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, "long " * 500), (150, "again"), (150, "again"), (None, "no id")]
    found = packing.pack_documents(docs(spark, rows), PATH, sequence=64).toPandas()
    plain = Tokenizer.from_file(PATH)
    assert found["length"].sum() == sum(len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    by_place = found.sort_values(["sequence_id", "offset"])
    total = by_place.groupby("sequence_id")["length"]
    assert (by_place["offset"] == total.cumsum() - by_place["length"]).all() and total.sum().max() <= 64
    assert total.ngroups <= 1.05 * found["length"].sum() / 64 + 1
    ids = np.array(plain.encode("long " * 500, add_special_tokens=False).ids + [0], "<u4")
    own = found[found["doc_id"] == 502].sort_values("piece")
    assert own["start"].tolist() == list(range(0, len(ids), 64)) and own["length"].tolist()[:-1] == [64] * (len(own) - 1)
    assert own["ids_crc32"].tolist() == [zlib.crc32(ids[s : s + 64].tobytes()) for s in own["start"]]
    assert packing.pack_documents(docs(spark, []), PATH).count() == 0


# quality


def brute_kneser_ney(texts, order):
    """p(text's grams) by the definition, in plain Python."""
    grams = Counter(p[i : i + order] for t in texts for p in [" " * (order - 1) + t] for i in range(len(p) - order + 1))
    levels = {order: grams}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    stats = {}
    for k, level in levels.items():
        n = {j: max(1, sum(c == j for c in level.values())) for j in (1, 2, 3, 4)}
        y = n[1] / (n[1] + 2 * n[2])
        limits = ((0.05, 0.95), (0.1, 1.9), (0.15, 2.85))
        stats[k] = [0.0] + [min(max(j - (j + 1) * y * n[j + 1] / n[j], lo), hi) for j, (lo, hi) in enumerate(limits, 1)]

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / (len(levels[1]) + 1)
        total = sum(c for g, c in levels[k].items() if g[:-1] == gram[:-1])
        if not total:
            return p(gram[1:])
        freed = sum(stats[k][min(c, 3)] for g, c in levels[k].items() if g[:-1] == gram[:-1])
        c = levels[k].get(gram, 0)
        return (c - stats[k][min(c, 3)]) / total + freed / total * p(gram[1:])

    return lambda t: [p(g) for q in [" " * (order - 1) + t] for i in range(len(q) - order + 1) for g in [q[i : i + order]]]


def test_perplexity_is_that_of_kneser_ney(spark, monkeypatch):
    rng = random.Random(6)
    alphabets = {"en": "ab c.", "ru": "абвг д", "zh": "的一是不了人"}
    rows, langs = [], {}
    for i in range(60):
        lang = rng.choice(sorted(alphabets))
        rows.append((i, "".join(rng.choices(alphabets[lang], k=rng.randrange(1, 60)))))
        langs[i] = lang
    rows += [(100, "zz qq"), (101, "ёж")]
    langs |= {100: "en", 101: "ru"}
    ids = [i for i in range(50)]
    learned = [i for i in ids if int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) % 5]
    model = {lang: brute_kneser_ney([t for i, t in rows if i in learned and langs[i] == lang], quality.ORDER) for lang in alphabets}
    want = {i: 2 ** -np.mean([math.log2(p) for p in model[langs[i]](t)]) for i, t in rows}
    trusted = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    for common, chars, symbols in ((1 << 18, 1 << 20, quality.SYMBOLS), (40, 50, 10), (0, 7, quality.SYMBOLS)):
        monkeypatch.setattr(quality, "CHARS_AT_ONCE", chars)
        common_of = quality._common
        with monkeypatch.context() as m:
            m.setattr(quality, "_common", lambda g, s, n=common: common_of(g, s, n))
            found = {r["doc_id"]: r["perplexity"] for r in quality_scores(docs(spark, rows, langs), trusted).collect()}
        assert found.keys() == want.keys() and all(math.isclose(found[i], want[i], rel_tol=1e-9) for i in want)
        points, owner = next(quality.text_runs(["abcdefghijkl" * 5]))
        grams = Counter()
        for codes, _, alphabet in quality.run_codes(points, owner, symbols):
            grams.update(map(bytes, quality.code_points(codes, alphabet)))
        text = "    " + "abcdefghijkl" * 5
        first = "".join(map(chr, points))
        assert sum(grams.values()) == len(first) - 4 and text.startswith(first)


def test_long_texts_count_every_gram_once(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choices("abcdefghijklmn d.", k=k)) for k in (0, 1, 3, 40, 41, 500, 1000)]

    def counted(symbols):
        out = Counter()
        for points, owner in quality.text_runs(texts):
            for codes, own, alphabet in quality.run_codes(points, owner, symbols):
                out.update(zip(own.tolist(), quality._strings(quality.code_points(codes, alphabet)), strict=True))
        return out

    want = Counter((i, p[k : k + 5]) for i, t in enumerate(texts) for p in ["    " + t] for k in range(len(t)))
    assert counted(quality.SYMBOLS) == want
    monkeypatch.setattr(quality, "CHARS_AT_ONCE", 40)
    assert counted(quality.SYMBOLS) == counted(10) == want


def test_quality_scores(spark):
    rng = random.Random(5)
    words = ["ser", "mar", "lon", "tir", "ved", "pol"]
    clean = lambda: " ".join("".join(rng.choices(words, k=2)) for _ in range(60)) + "."
    rows = [(i, clean()) for i in range(300)] + [(400 + i, re.sub("e", "%$", clean().upper())) for i in range(20)]
    rows += [(500, None), (501, ""), (502, "x"), (None, clean()), (7, "dup"), (503, rows[1][1] * 2000)]
    langs = {502: "xx", 501: None, 500: None}
    trusted = spark.createDataFrame([(i, "x") for i in range(250)] + [(None, "y"), (3, "z")], "doc_id long, text string")
    found = quality_scores(docs(spark, rows, langs), trusted).toPandas()
    assert len(found) == len(rows)
    kept = found.drop_duplicates("doc_id").set_index("doc_id")["kept"]
    assert kept[[i for i in range(300) if i != 7]].mean() > 0.97 and not kept[range(400, 420)].any()
    assert not kept[500] and not kept[501] and kept[502]
    by_id = found.drop_duplicates("doc_id").set_index("doc_id")["perplexity"]
    assert abs(by_id[503] - by_id[1]) < 0.03
    assert quality_scores(docs(spark, []), trusted).count() == 0
    assert quality_scores(docs(spark, rows), trusted.limit(0)).where("kept").count() == len(rows) - 2


# language


def test_language(spark):
    rng = random.Random(6)
    parts = {"aa": ["ka", "lo", "mi", "re"], "bb": ["sch", "und", "ein", "ge"], "cc": ["ção", "que", "nho", "es"]}
    text = lambda x, n: " ".join("".join(rng.choices(parts[x], k=3)) for _ in range(n))
    train = [(i, text(x, 60)) for i, x in enumerate("abc" * 40) for x in [x * 2]]
    langs = {i: x * 2 for i, x in enumerate("abc" * 40)}
    dictionaries = fit_dictionaries(docs(spark, [*train, (900, "none"), (901, None)], langs | {900: None}))
    assert list(dictionaries) == ["aa", "bb", "cc"]
    test = [(1000 + i, text(x * 2, rng.choice([3, 20, 200]))) for i, x in enumerate("abc" * 20)]
    odd = [(2000, None), (2001, ""), (2002, "123 !?"), (2003, "é"), (None, text("bb", 20))]
    found = {r["doc_id"]: r for r in identify_language(docs(spark, test + odd), dictionaries).collect()}
    right = [found[1000 + i]["lang_pred"] == x * 2 for i, x in enumerate("abc" * 20)]
    assert sum(right) >= 58
    assert [found[i]["lang_pred"] for i in (2000, 2001, 2002)] == ["und"] * 3 and found[2003]["lang_pred"] in dictionaries
    assert all(0 <= r["score"] <= 1 for r in found.values()) and found[None]["lang_pred"] == "bb"
    assert not found[2002]["accepted"] and found[1002]["accepted"]
    assert identify_language(docs(spark, test), {}).first()["lang_pred"] == "und"
    # a language that has only very long texts has a dictionary all the same
    long = fit_dictionaries(docs(spark, [(1, "zug nacht " * 40_000), (2, "the night")], {1: "de"}))
    assert len(long["de"]) > 4000 and identify_language(docs(spark, [(3, "nacht zug " * 30_000)]), long).first()["lang_pred"] == "de"
    assert identify_language(docs(spark, []), dictionaries).count() == 0 and fit_dictionaries(docs(spark, [])) == {}


# toxicity


def test_folding():
    assert fold("L0s3r, ｌｏｓｅｒ!") == " loser loser "
    assert fold("A$$hole done$$$ @$$ b@@d, $$x") == " asshole done  baad ssx ".replace("  ", " ")
    assert fold("lоsеr") == " loser " and fold("") == "  " and fold("a​b") == " ab "


def test_exceptions_excuse_only_their_phrase():
    model = ToxicityModel({" trash ": 3.0, " scum": 2.0}, [" trash can "])
    a = model.automaton()
    assert [w for _, _, w in hits(fold("Trash can, trash. Scummy!"), a)] == [3.0, 2.0]
    assert toxicity("trash trash", model, a) > toxicity("trash can", model, a) == toxicity(None, model, a)


def test_toxicity(spark):
    rng = random.Random(7)
    plain = [f"w{rng.choice('abcdefgh')}{i}x" for i in range(200)]
    bad, stems = ["gruff", "nasty"], ["blorg"]
    def text(toxic):
        own = rng.choices(plain, k=rng.randrange(20, 200))
        if toxic:
            for _ in range(max(2, len(own) // 40)):
                own.insert(rng.randrange(len(own)), rng.choice([rng.choice(bad), rng.choice(stems) + rng.choice("abcdefghij") + rng.choice("xyz"), "n@sty", "GRUFF"]))
        return " ".join(own)

    labels = {i: int(i % 6 == 0) for i in range(900)}
    rows = [(i, text(x)) for i, x in labels.items()] + [(2000, None), (2001, ""), (None, "nasty blorgqz gruff"), (2002, "gruff " * 60_000)]
    marked = spark.createDataFrame([(i, x, "t") for i, x in labels.items()] + [(3000, None, "t"), (None, 1, "t")], "doc_id long, toxic int, text string")
    model = fit_toxicity(docs(spark, rows), marked.where("doc_id % 4 <> 2"))
    assert any(p.startswith(" blor") for p in model.weights)
    found = {r["doc_id"]: r for r in score_toxicity(docs(spark, rows), model).collect()}
    held = [i for i in labels if i % 4 == 2]
    wrong = [i for i in held if found[i]["predicted"] != labels[i]]
    assert len(wrong) <= 0.02 * len(held)
    assert found[2000]["score"] == found[2001]["score"] < 0.3 and found[None]["predicted"] == 1 and found[2002]["predicted"] == 1
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert score_toxicity(docs(spark, []), model).count() == 0
    empty = fit_toxicity(docs(spark, rows), marked.where("toxic = 0"))
    assert empty.weights == {} and score_toxicity(docs(spark, rows), empty).where("predicted = 1").count() == 0
