"""Tokens, BPE, rules and licences against plain Python, SQL and the tokenizers library."""

import hashlib
import random
import re
import tracemalloc
import textwrap
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomgraph.llm import bpe, licenses, quality_rules, queries, token_counts

BYTE = bpe.tokenizer_path("byte_bpe_50k.json")
WORD = bpe.tokenizer_path("word_bpe_49k.json")


def noise():
    rng = random.Random(3)
    texts = ["", "a" * 3000, "é" * 300, "\x00\x01\x1c\x85", "don't we'LL 'tis", "<|endoftext|> x <|startoftext|>", "İstanbul ẞ Σς ﬁ", "x" * 129 + " " + "ab" * 70]
    texts += ["".join(chr(rng.randrange(1, 0x3000)) for _ in range(200)) for _ in range(5)]
    return texts + ["".join(rng.choice("thea ndring\n.é'1") for _ in range(rng.randrange(300))) for _ in range(200)]


def test_byte_bpe_equals_library():
    library, own = Tokenizer.from_file(BYTE), bpe.RankArray(BYTE)
    for text, ids in zip(noise(), own.encode(noise()), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == np.array(want, "<u4").tobytes()
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_long_words_merge_like_short_ones():
    own = bpe.RankArray(BYTE)
    rng = random.Random(9)
    for _ in range(50):
        word = "".join(rng.choice("thering") for _ in range(rng.randrange(2, 120))).encode()
        assert own._long(word) == own.encode_words([word])[0]


def test_word_ids_equal_library():
    library = Tokenizer.from_file(WORD)
    for text, ids in zip(noise(), bpe.RankArray(WORD).encode(noise()), strict=True):
        assert ids == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_bpe_round_trip(odd_docs, no_docs):
    got = bpe.decode(bpe.encode(odd_docs, BYTE), BYTE)
    pairs = sorted((r["doc_id"] or -1, r["text"]) for r in got.collect())
    assert pairs == sorted((r["doc_id"] or -1, r["text"] or "") for r in odd_docs.collect())
    assert bpe.decode(bpe.encode(no_docs, BYTE), BYTE).count() == 0


def test_line_tokens_add_up_and_start_where_they_start(odd_docs, no_docs):
    library = Tokenizer.from_file(BYTE)
    rows = {}
    for r in token_counts.line_token_counts(odd_docs.dropDuplicates(["doc_id"]), BYTE).collect():
        rows.setdefault(r["doc_id"], []).append(r)
    for d in odd_docs.dropDuplicates(["doc_id"]).collect():
        text, held = d["text"] or "", sorted(rows[d["doc_id"]], key=lambda r: r["section"])
        assert "".join(text[r["char_start"] : r["char_end"]] for r in held) == text
        enc = library.encode(text, add_special_tokens=False)
        assert sum(r["n_tokens"] for r in held) == len(enc.ids)
        want = Counter(max(r["section"] for r in held if r["char_start"] <= a) for a, _ in enc.offsets)
        assert {r["section"]: r["n_tokens"] for r in held if r["n_tokens"]} == dict(want)
    assert token_counts.line_token_counts(no_docs, BYTE).count() == 0


def test_majority_rule_and_crossing():
    starts, ends = np.array([0, 2, 6]), np.array([2, 6, 9])
    assert [x.tolist() for x in token_counts.attribute(starts, ends, np.array([0, 3]), 9, "start")] == [[2, 1], [1, 0]]
    assert [x.tolist() for x in token_counts.attribute(starts, ends, np.array([0, 3]), 9, "majority")] == [[1, 2], [0, 1]]
    assert [x.tolist() for x in token_counts.attribute(starts, ends, np.array([0, 4]), 9, "majority")] == [[2, 1], [1, 0]]


def test_field_tokens(spark):
    docs = spark.createDataFrame([(1, "Title here", None, "body text\nmore")], "doc_id long, title string, note string, body string")
    got = token_counts.field_token_counts(docs, ["title", "note", "body"], BYTE).orderBy("section").collect()
    whole = Tokenizer.from_file(BYTE).encode("Title here\n\nbody text\nmore\n", add_special_tokens=False)
    assert sum(r["n_tokens"] for r in got) == len(whole.ids) and [r["char_start"] for r in got] == [0, 11, 12]


def rule_measures(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    n = Counter(grams)
    covered = {p for i, g in enumerate(grams) if n[g] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_rules(odd_docs, no_docs):
    got = quality_rules.apply_policy(quality_rules.ledger(odd_docs), "base-1").collect()
    texts = {r["doc_id"]: r["text"] or "" for r in odd_docs.collect()}
    assert len(got) == odd_docs.count()
    for r in got:
        n_words, *rest = rule_measures(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n_words, *rest)
        assert r["kept"] == (n_words >= 50 and 100 * rest[-1] <= 50 * n_words)
    assert quality_rules.ledger(no_docs).count() == 0


@pytest.mark.parametrize("text", [
    "a b c d e f g h a b c x y z q r s t u v a b c d",
    "w1 w27 w9 u0 w22 w103 w97 u1 w1 w27 w9 u2 w22 w103 w97 u3",  # two windows whose hashes agree in 44 bits take turns
    "x " * 50_000, "a b a b a b", "a b", " ".join(f"w{i}" for i in range(60_000)),
])
def test_repeated_windows(spark, text):
    assert quality_rules.measure(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["n_repeat_words"] == rule_measures(text)[-1]


def test_ablation(odd_docs):
    entries = quality_rules.ledger(odd_docs).cache()
    bits = [r["failure_bits"] for r in entries.collect()]
    for r in quality_rules.ablation(entries, "web-1").collect():
        assert r["failed"] == sum(bool(b & r["bit"]) for b in bits)
        assert r["failed_alone"] == sum(b == r["bit"] for b in bits)
        assert r["kept_without"] == sum(not b & ~r["bit"] for b in bits)


def test_containment_join_equals_brute_force(spark):
    rng = random.Random(2)
    pool = [licenses.template_words(t) for _, t in licenses.TEMPLATES]
    lines = []
    for _ in range(300):
        ws = list(rng.choice(pool))
        rng.shuffle(ws)
        ws = ws[: rng.randrange(len(ws) + 1)] + [f"w{rng.randrange(50)}" for _ in range(rng.randrange(6))]
        rng.shuffle(ws)
        lines.append(" ".join(ws))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {(r["doc_id"], r["label"]): r["containment"] for r in licenses.containment_join(docs).collect()}
    want = {}
    for i, line in enumerate(lines):
        for (label, _), t in zip(licenses.TEMPLATES, pool, strict=True):
            c = len(set(line.split()) & set(t)) / len(t)
            if c >= licenses.THRESHOLD - 1e-9 and licenses.TELLING.get(label, set()) <= set(line.split()):
                want[i, label] = max(c, want.get((i, label), 0))
    assert got == pytest.approx(want)


def test_licences_of_odd_rows(odd_docs, no_docs):
    got = licenses.license_scan(odd_docs)
    assert got.count() == odd_docs.count()
    hit = got.where("n_base > 0").first()
    assert (hit["base_labels"], hit["labels"], hit["first_word"], hit["last_word"], hit["score"]) == ("reserved", "mit,reserved", 0, 0, 1.0)
    assert licenses.license_scan(no_docs).count() == 0


def test_long_lines_are_searched_in_windows(spark):
    text = " ".join(f"w{i}" for i in range(500)) + " Redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met " + " ".join(f"v{i}" for i in range(500))
    assert licenses.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["labels"] == "bsd"


def test_passages_wrapped_over_lines(spark):
    wanted = {label: text for label, text in licenses.TEMPLATES if label in ("mit", "bsd", "isc")}
    before = " ".join(f"w{i}" for i in range(45))
    texts = []
    for text in wanted.values():
        lines = textwrap.wrap(text, 75)
        assert len(lines) > 1
        texts += ["\n".join(lines), before + "\n * " + "\n * ".join(lines) + "\n\n" + before, "\r\n".join(text.split())]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.license_scan(docs).collect()}
    assert got == {i: (label, 1.0) for i, label in enumerate(x for x in wanted for _ in range(3))}


def test_words_that_tell_licences_apart(spark):
    texts = ["Licensed under CC BY-NC 4.0", "Licensed under CC BY-SA 4.0.", "licensed under cc by 4.0", "This work is licensed under the GNU General Public License, version 2", "Released under the M\u0130T License", "\u212aelvin"]
    got = licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"]: r["labels"] for r in got.collect()} == {0: "cc-by,cc-by-nc", 1: "cc-by,cc-by-sa", 2: "cc-by", 3: "gpl", 4: "", 5: ""}


def test_special_tokens_stand_between_words():
    text = "a  <|endoftext|><|endoftext|> 's b<|startoftext|><|endoftext|"
    for path in (BYTE, WORD):
        assert bpe.RankArray(path).encode([text])[0] == np.array(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("path", [BYTE, WORD])
@pytest.mark.parametrize("chars", [1 << 22, 7])
def test_cut_words_equal_library(monkeypatch, path, chars):
    monkeypatch.setattr(bpe, "CUT_CHARS", chars)
    monkeypatch.setattr(bpe, "CACHED_WORDS", 500)
    rng = random.Random(5)
    letters = [*"aA bB'sStTreveLl'md  \n\t0129.,!-\"éÉßÅİñ \x85\xa0", " '", "'s", "''", "'re", "'ll ", "ẞ", "中", "а", "ŉ"]
    texts = ["".join(rng.choices(letters, k=rng.randrange(40))) for _ in range(3000)]
    own, library = bpe.RankArray(path), Tokenizer.from_file(path)
    for at in range(0, len(texts), 300):
        part = texts[at : at + 300]
        assert own.encode(part) == [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(part, add_special_tokens=False)]


def test_encoding_takes_little_memory_beside_texts_and_ids():
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("aeinorst", k=rng.randrange(1, 4))) for _ in range(9000)) + " é" for _ in range(160)]
    own = bpe.RankArray(WORD)
    own.encode(texts[:1])
    tracemalloc.start()
    try:
        ids = own.encode(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak - 2 * sum(map(len, ids)) < 80 << 20


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf, name):
    got = queries.QUERIES[name](spark, sf).toPandas()
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = db.sql(queries.SQL[name]).df()[list(got.columns)]
    a, b = (x.sort_values("doc_id").reset_index(drop=True).astype(object) for x in (got, want))
    assert a.where(a.notna(), None).equals(b.where(b.notna(), None))


def test_op4_equals_library(spark, sf):
    library = Tokenizer.from_file(BYTE)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.QUERIES["op4_bpe"](spark, sf).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_no_python_in_native_plans(spark, sf):
    for name in ("op7_license_scan", "op8_quality_rules"):
        plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_word_frequencies_count_documents(spark):
    docs = spark.createDataFrame([(1, "MIT mit license"), (2, "license"), (3, "")], "doc_id long, text string")
    assert licenses.word_frequencies(docs, ["mit", "license", "gnu"]) == {"mit": 1, "license": 2, "gnu": 0}
    assert docs.select(F.size(licenses.words(F.col("text"))).alias("n")).agg(F.sum("n")).first()[0] == 4
