"""Exact, near and substring deduplication and packing against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomgraph.llm import bpe, bwt, exact_dedup, near_dedup, packing, queries, substring_dedup
from loomgraph.operators.stars import star_components

WORD = bpe.tokenizer_path("word_bpe_49k.json")


def texts_of(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect() if r["doc_id"] is not None}


# --- exact

def test_cuckoo_index_keeps_what_it_holds():
    rng = random.Random(4)
    index, held = exact_dedup.CuckooIndex(8), set()
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for _ in range(12000):
        key = rng.choice(keys)
        if rng.random() < 0.6:
            assert index.insert(key) == (key not in held)
            held.add(key)
        else:
            assert index.delete(key) == (key in held)
            held.discard(key)
    assert index.size == len(held) and all((k in index) == (k in held) for k in keys) and index.resizes


def test_cuckoo_index_verifies_false_hits():
    a = bytes(30) + b"\x01\x02"
    b = b"\x07" + bytes(29) + b"\x01\x02"  # the same fingerprint and bucket, another key
    index = exact_dedup.CuckooIndex()
    assert index.insert(a) and b not in index and index.false_hits and index.insert(b) and index.delete(a) and b in index


def test_exact_duplicates(odd_docs, no_docs):
    rows = odd_docs.collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["text"] or "", []).append(r["doc_id"])
    for r in exact_dedup.exact_duplicates(odd_docs).collect():
        text = next(t for t, ids in groups.items() if r["doc_id"] in ids)
        best = max((i for i in groups[text] if i is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (best, len(groups[text]), r["doc_id"] == best, hashlib.sha256(text.encode()).hexdigest())
    kept = exact_dedup.drop_exact_duplicates(odd_docs)
    assert Counter(r["text"] or "" for r in kept.collect()) == Counter(dict.fromkeys(groups, 1)) and kept.columns == odd_docs.columns
    assert exact_dedup.exact_duplicates(no_docs).count() == exact_dedup.drop_exact_duplicates(no_docs).count() == 0


def test_index_follows_insertions_and_deletions(spark):
    first = exact_dedup.digests(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string"))
    index = exact_dedup.build_index(first)
    more = exact_dedup.digests(spark.createDataFrame([(9, "b"), (7, "c")], "doc_id long, text string"))
    gone = exact_dedup.digests(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string"))
    got = {bytes(r["digest"]): (r["keep_id"], r["group_size"]) for r in exact_dedup.update_index(index, first, more, gone).collect()}
    assert got == {hashlib.sha256(b"b").digest(): (9, 1), hashlib.sha256(b"c").digest(): (7, 1)}


def test_the_next_document_stays_when_the_first_goes(spark):
    keyed = lambda *rows: exact_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string"))
    held = keyed((1, "a"), (2, "a"), (3, "a"), (4, "b"))
    index = exact_dedup.update_index(exact_dedup.build_index(held), held, deletes=keyed((3, "a"), (9, "a"), (5, "never")))
    got = {bytes(r["digest"]): (r["keep_id"], r["group_size"]) for r in index.collect()}
    assert got == {hashlib.sha256(b"a").digest(): (2, 2), hashlib.sha256(b"b").digest(): (4, 1)}


# --- near

def brute_components(texts, width, percent):
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common) and find(a) != find(b):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def near_copies(seed, n):
    """Chains of edits around a few base texts: links between neighbours, none between the ends."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(4):
        base = [rng.choice(vocabulary) for _ in range(90)]
        out.append(" ".join(base))
        for _ in range(n):
            if rng.random() < 0.5:
                base = list(base)
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
                out.append(" ".join(base))
            else:
                other = list(base)
                for _ in range(rng.randrange(1, 9)):
                    other[rng.randrange(len(other))] = rng.choice(vocabulary)
                out.append(" ".join(other).upper())
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("width", "percent", "rounds"), [(3, 85, 3), (5, 80, 3), (3, 85, 1)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, width, percent, rounds):
    monkeypatch.setattr(near_dedup, "PIVOT_ROUNDS", rounds)
    texts = dict(enumerate(near_copies(width, 40)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    want, sizes = brute_components(texts, width, percent)
    got = near_dedup.near_duplicates(docs, width, percent).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want and {r["doc_id"]: r["n_shingles"] for r in got} == sizes


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    texts = texts_of(odd_docs)
    want, _ = brute_components(texts, 3, 85)
    got = near_dedup.near_duplicates(odd_docs, 3, 85).collect()
    assert len(got) == odd_docs.count()
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    kept = near_dedup.drop_near_duplicates(odd_docs, 3, 85)
    assert kept.columns == odd_docs.columns and {r["doc_id"] for r in kept.collect()} == {None, *want.values()}
    assert near_dedup.near_duplicates(no_docs, 3, 85).count() == 0


def test_pruning_bounds():
    for threshold in (0.8, 0.85):
        for n, least in near_dedup.least_agreements(threshold):
            assert 0 <= least < threshold * n


def test_star_components(spark):
    rng = random.Random(8)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(40)]
    want, _ = brute_components({}, 1, 1)
    root = {x: x for ab in links for x in ab}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["id"]: r["component"] for r in star_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in root) and want == {}


# --- substrings

def brute_removed(texts):
    seen, out = set(), {}
    for i in sorted(texts):
        raw = texts[i].encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in seen:
                gone[p : p + 100] = True
            seen.add(w)
        out[i] = (len(raw), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum()), hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def removed(docs):
    rest = substring_dedup.remove_repeats(docs)
    rows = rest.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("removed").alias("n_spans"), F.sha2("kept", 256).alias("h")).collect()
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["h"]) for r in rows if r["doc_id"] is not None}, len(rows)


def test_substrings_of_odd_rows(odd_docs, no_docs):
    got, n = removed(odd_docs)
    assert got == brute_removed(texts_of(odd_docs)) and n == odd_docs.count()
    left = substring_dedup.drop_repeats(odd_docs)
    assert left.columns == odd_docs.columns and left.count() == odd_docs.count()
    assert substring_dedup.remove_repeats(no_docs).count() == 0


def shared_passages(seed):
    rng = random.Random(seed)
    piece = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    common = [piece(rng.randrange(60, 400)) for _ in range(6)]
    out = []
    for _ in range(80):
        out.append("".join(rng.choice(common) if rng.random() < 0.4 else piece(rng.randrange(0, 150)) for _ in range(rng.randrange(1, 6))))
    return [*out, "ab" * 400, "b" + "ab" * 300, "z" * 99, "z" * 100, "z" * 101]


@pytest.mark.parametrize(("frequent", "segment"), [(4096, 1 << 19), (3, 1 << 19), (1, 300), (0, 150)])
def test_substrings_equal_brute_force(spark, monkeypatch, frequent, segment):
    monkeypatch.setattr(substring_dedup, "FREQUENT", frequent)
    monkeypatch.setattr(substring_dedup, "CHUNK", 4096)
    monkeypatch.setattr(substring_dedup, "SEGMENT", segment)
    texts = dict(enumerate(shared_passages(segment)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert removed(docs)[0] == brute_removed(texts)


def test_a_passage_of_a_very_long_text_is_found(spark):
    passage = "gngbgnljxqpmhvfaunjceccidrxemltrqwkawveulpipjtlzguvwegqclcrmfhxwdbvtdkmpiqucmehysehyhwvkwhkhlnlvaxtc"
    letters = np.random.default_rng(4).integers(97, 123, 17_000_000, dtype=np.uint8).tobytes().decode()
    docs = spark.createDataFrame([(1, letters + "#" + passage), (2, "#" + passage + "!")], "doc_id long, text string").repartition(2)
    assert {k: v[:3] for k, v in removed(docs)[0].items()} == {1: (17_000_000 + 1 + len(passage), 0, 0), 2: (len(passage) + 2, len(passage) + 1, 1)}


def test_minimisers_are_the_leftmost_least_of_their_window():
    rng = np.random.default_rng(3)
    parts = [rng.integers(97, 99, n, dtype=np.uint8) for n in (0, 99, 100, 400, 250)] + [np.frombuffer(b"z" * 300, np.uint8)]
    text, ends = np.concatenate(parts), np.cumsum([len(x) for x in parts])
    h = substring_dedup._gram_hashes(text)
    span = substring_dedup.LEAST - substring_dedup.GRAM + 1
    windows = {}
    for doc, first, last, place, minimiser in zip(*(x.tolist() for x in substring_dedup.stretches(text, ends)), strict=True):
        windows |= {w: (doc, place, minimiser) for w in range(first, last + 1)}
    want = {}
    for doc, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
        for w in range(a, b - substring_dedup.LEAST + 1):
            place = w + int(h[w : w + span].argmin())
            want[w] = (doc, place, int(h[place]))
    assert windows == want


def test_classes_equal_brute_force():
    rng = random.Random(6)
    text = "".join(rng.choice("ab") for _ in range(200))
    raw = np.frombuffer((text + "c" + text[20:150] + "d" + text[::-1]).encode(), np.uint8)
    for least in (3, 8, 20):
        order, kind = bwt.classes(raw, least)
        kinds = {}
        for place, k in zip(order.tolist(), kind.tolist(), strict=True):
            if place + least <= len(raw):
                kinds.setdefault(k, set()).add(raw[place : place + least].tobytes())
        assert all(len(x) == 1 for x in kinds.values())
        assert len(kinds) == len({raw[p : p + least].tobytes() for p in range(len(raw) - least + 1)})


def test_op3_equals_brute_force(spark, sf):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.QUERIES["op3_substring_dedup"](spark, sf).collect()}
    assert got == brute_removed(texts_of(spark.read.parquet(f"{sf}/documents.parquet")))


def test_cut_characters_go(spark):
    tail = "é" * 60
    docs = spark.createDataFrame([(1, "x" * 99 + "é" + tail, 160), (2, "y" + "x" * 99 + "é" + "z", 102)], "doc_id long, text string, n_chars long")
    left = {r["doc_id"]: r for r in substring_dedup.drop_repeats(docs).collect()}
    assert left[2]["text"] == "yz" and left[2]["n_chars"] == 2


def test_own_replacement_characters_stay(spark):
    passage = "".join(chr(97 + i * i % 23) for i in range(120))
    # the run goes on into the first byte of the character after the passage
    texts = [(1, passage + "é"), (2, "a\ufffdb " + passage + "è c\ufffdd")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    spans = {r["doc_id"]: [(x["a"], x["b"]) for x in r["removed"]] for r in substring_dedup.remove_repeats(docs).collect()}
    assert spans[2] == [(6, 6 + 121)]
    left = {r["doc_id"]: r["text"] for r in substring_dedup.drop_repeats(docs).collect()}
    assert left == {1: passage + "é", 2: "a\ufffdb  c\ufffdd"}


# --- packing

def assert_packed(rows, texts, capacity):
    library = Tokenizer.from_file(WORD)
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    for doc, text in texts.items():
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        held = sorted(by_doc[doc], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"]) for r in held] == [(k, at, len(ids[at : at + capacity])) for k, at in enumerate(range(0, len(ids), capacity))]
        assert all(r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in held)


def test_packing_of_odd_rows(odd_docs, no_docs):
    docs = odd_docs.dropDuplicates(["doc_id"]).where("doc_id is not null")
    assert_packed(packing.pack_documents(docs, WORD, 64).collect(), texts_of(docs), 64)
    assert packing.pack_documents(odd_docs, WORD).agg(F.countDistinct("doc_id")).first()[0] == len(texts_of(odd_docs))
    assert packing.pack_documents(no_docs, WORD).count() == 0


def test_op10(spark, sf):
    rows = queries.QUERIES["op10_packing"](spark, sf).collect()
    assert_packed(rows, texts_of(spark.read.parquet(f"{sf}/documents.parquet")), 2048)
    least = -(-sum(r["length"] for r in rows) // 2048)
    assert len({r["sequence_id"] for r in rows}) <= least + max(2, least // 100)


def test_numbering_in_buckets(odd_docs, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 3)
    docs = odd_docs.dropDuplicates(["doc_id"]).where("doc_id is not null")
    assert_packed(packing.pack_documents(docs, WORD, 32).collect(), texts_of(docs), 32)


def test_plan_uses_every_piece_and_few_patterns():
    rng = random.Random(1)
    for scale in (1, 1000):
        histogram = {n: rng.randrange(1, 30) * scale for n in rng.sample(range(1, 2049), 700)}
        made = packing.plan(histogram)
        used = Counter()
        for times, bin_ in made:
            assert sum(bin_) <= 2048
            for x in bin_:
                used[x] += times
        assert used == Counter(histogram) and len(made) < 6000


def test_two_fit_beats_the_greedy_bin():
    # greedy alone leaves 6 + 3 in a bin of 10; two pieces of 2 fit the gap that the 3 leaves
    assert packing.plan({6: 1, 3: 1, 2: 2}, 10)[0] == (1, [6, 2, 2])
