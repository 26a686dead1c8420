"""Removal of repeated substrings: every byte under a ``LEAST``-byte string that also starts earlier.

1. Every window of ``LEAST`` bytes has a minimiser, the ``GRAM``-byte string with the least 64-bit hash in it (the
   leftmost on ties). It depends on the window's bytes alone, so equal windows have equal minimisers at equal places,
   and only stretches around a minimiser that occurs twice can repeat. Stretches are counted by minimiser; those that
   occur once end here.
2. The bytes of the others are dealt by minimiser to shards. A shard folds equal stretches and finds the classes of
   equal windows among the distinct ones by interval expansion on a Burrows-Wheeler transform (``bwt.py``), a few
   hundred kilobytes at a time. The earliest window of a class stays.
3. The stretches of a minimiser that occurs more than ``FREQUENT`` times (in a passage that a good part of the corpus
   shares) don't fit one task. They are parted by the content next to it: ``PART`` windows whose places relative to the
   minimiser are next to each other share all but ``PART`` - 1 bytes at either end, and go by what they share. Equal
   parts are folded before the shuffle, the distinct ones go through the same shards.

The memory of a task is bounded by ``FREQUENT`` stretches, by the distinct few bytes that surround one string, or by one
document, whichever is largest; texts are worked through in segments.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import blocks
from .bwt import classes
from .common import id_text, lean, materialize, partitions, read_documents, release

LEAST = 100
GRAM = 28
FREQUENT = 4096
#: Windows of one part of a frequent minimiser's stretch.
PART = 8
#: Bytes that one transform is built over, about, and window starts of a text that are looked at together.
CHUNK = 1 << 19
SEGMENT = 1 << 19

#: A stretch's start, its minimiser's place in it and its length in one integer; a stretch is shorter than 256 bytes.
_PLACE_BITS, _LENGTH_BITS = 7, 8


def _gram_hashes(text: np.ndarray) -> np.ndarray:
    """64-bit hash of the ``GRAM`` bytes at every place where they fit."""

    def joined(left: np.ndarray, right: np.ndarray, at: int, factor: int) -> np.ndarray:
        n = len(right) - at
        return left[:n] * np.uint64(factor) + right[at:]

    h = (text.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h2 = joined(h, h, 1, 0xBF58476D1CE4E5B9)
    h4 = joined(h2, h2, 2, 0x94D049BB133111EB)
    h4 ^= h4 >> np.uint64(31)
    h8 = joined(h4, h4, 4, 0xD6E8FEB86659FD93)
    h16 = joined(h8, h8, 8, 0xA0761D6478BD642F)
    h24 = joined(h16, h8, 16, 0xE7037ED1A0B428DB)
    h28 = joined(h24, h4, 24, 0x8EBC6AF09C88C6E3)
    h28 = (h28 ^ (h28 >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h28 ^ (h28 >> np.uint64(29))


def stretches(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first window, last window, minimiser's place, minimiser) of every run of windows with one minimiser.

    ``text`` is the documents' bytes one behind another, ``ends`` their ends; places are those of ``text``.
    """
    none = np.empty(0, np.int64)
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    lengths = np.maximum(0, ends - begins - LEAST + 1)
    total = int(lengths.sum())
    if not total:
        return none, none, none, none, none.astype(np.uint64)
    h = _gram_hashes(text)
    least, place = h, np.arange(len(h), dtype=np.int32)  # of the grams that start in the next ``width`` places
    width, span = 1, LEAST - GRAM + 1
    while width < span:
        step = min(width, span - width)
        left, right = least[:-step], least[step:]
        place = np.where(right < left, place[step:], place[:-step])
        least = np.minimum(left, right)
        width += step
    doc = np.repeat(np.arange(len(ends)), lengths)
    start = np.arange(total) + np.repeat(begins - (np.cumsum(lengths) - lengths), lengths)
    at = place[start]
    cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]))
    last = np.concatenate([cut[1:], [total]]) - 1
    place = at[cut].astype(np.int64)
    return doc[cut], start[cut], start[last], place, h[place]


def _segments(ids: np.ndarray, raw: list[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(documents, offsets, bytes) of about ``SEGMENT`` window starts at a time; every window is whole in one segment."""
    held: tuple[list, list, list] = ([], [], [])
    size = 0
    for doc, text in zip(ids.tolist(), raw, strict=True):
        for at in range(0, max(1, len(text) - LEAST + 1), SEGMENT):
            part = text[at : at + SEGMENT + LEAST - 1]
            for column, value in zip(held, (doc, at, part), strict=True):
                column.append(value)
            size += len(part)
            if size >= SEGMENT:
                yield held
                held, size = ([], [], []), 0
    if size:
        yield held


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every stretch of the documents; one that a segment holds twice counts once, and its later places are repeats at
    once (no minimiser: nothing more to find out)."""
    for block in blocks(batches, "text"):
        ids = block["doc_id"].to_numpy(zero_copy_only=False)
        raw = [t.encode("utf-8", "replace") for t in block["text"].to_pylist()]
        order = np.argsort(ids, kind="stable")
        ids, raw = ids[order], [raw[i] for i in order.tolist()]
        fresh = np.concatenate([[True], ids[1:] != ids[:-1]]) if len(ids) else np.empty(0, bool)
        ids, raw = ids[fresh], [r for r, f in zip(raw, fresh.tolist(), strict=True) if f]
        for docs, offsets, parts in _segments(ids, raw):
            joined = b"".join(parts)
            ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
            doc, first, last, place, minimiser = stretches(np.frombuffer(joined, np.uint8), ends)
            if not len(doc):
                continue
            digest = xxhash.xxh3_64_intdigest
            spans = list(zip(first.tolist(), (last + LEAST).tolist(), strict=True))
            seg = np.fromiter((digest(joined[a:b]) for a, b in spans), np.uint64, len(doc))
            _, earliest, kind = np.unique(seg * np.uint64(0x9E3779B97F4A7C15) ^ minimiser, return_index=True, return_inverse=True)  # in order of document and place
            repeat = np.ones(len(doc), bool)
            repeat[earliest] = False
            for i in np.flatnonzero(repeat).tolist():  # digests agree: so must the bytes
                (a, b), (c, d) = spans[i], spans[earliest[kind[i]]]
                repeat[i] = joined[a:b] == joined[c:d]
            start = first - np.concatenate([[0], ends[:-1]])[doc] + np.array(offsets, np.int64)[doc]
            span = (start << _PLACE_BITS | place - first) << _LENGTH_BITS | last - first + LEAST
            yield pa.RecordBatch.from_arrays([pa.array(np.array(docs, np.int64)[doc]), pa.array(minimiser.view(np.int64), mask=repeat), pa.array(span)], ["doc_id", "minimiser", "span"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted stretches of each document; frequent ones in parts, each with a key of what its windows
    share."""
    names, kinds = ["doc_id", "minimiser", "start", "frequent", "bytes"], [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
    rows: list[tuple[int, int, int, bool, bytes]] = []
    size = 0

    def out() -> pa.RecordBatch:
        nonlocal size
        made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(5)], names)
        rows.clear()
        size = 0
        return made

    for block in blocks(batches, "text"):
        for doc, text, wanted in zip(block["doc_id"].to_pylist(), block["text"].to_pylist(), block["wanted"], strict=True):
            raw = text.encode("utf-8", "replace")
            fields = wanted.values
            for minimiser, span, frequent in zip(*(fields.field(f).to_pylist() for f in ("minimiser", "span", "frequent")), strict=True):
                length, start = span & (1 << _LENGTH_BITS) - 1, span >> _LENGTH_BITS + _PLACE_BITS
                if not frequent:
                    rows.append((doc, minimiser, start, False, raw[start : start + length]))
                else:
                    place, last = start + (span >> _LENGTH_BITS & (1 << _PLACE_BITS) - 1), start + length - LEAST
                    for k in range((place - last) // PART, (place - start) // PART + 1):
                        edge = place - PART * k  # windows from edge - PART + 1 to edge share what lies between
                        a, b = max(start, edge - PART + 1), min(last, edge)
                        key = xxhash.xxh3_64_intdigest(raw[edge : edge - PART + 1 + LEAST], seed=k) ^ minimiser & (1 << 64) - 1
                        rows.append((doc, key - (1 << 64) if key >> 63 else key, a, True, raw[a : b + LEAST]))
                size += 2 * LEAST
                if size > CHUNK:
                    yield out()
    yield out()


def _expand(group: list[tuple[bytes, int, int]]) -> tuple[list[int], list[int], list[int]]:
    """Removed runs of the distinct stretches (bytes, document, start), each at its earliest place."""
    docs, starts, stops = [], [], []
    lengths = np.fromiter((len(b) for b, _, _ in group), np.int64, len(group))
    text = np.frombuffer(b"\0".join(b for b, _, _ in group) + b"\0", np.uint8)
    order, kind = classes(text, LEAST)
    begins = np.concatenate([[0], np.cumsum(lengths[:-1] + 1)])
    which = np.repeat(np.arange(len(group)), lengths + 1)
    inside = np.arange(len(text)) - begins[which]
    valid = inside <= lengths[which] - LEAST
    # a window's place in the corpus as one number: rank of the document, then the byte
    ids = np.fromiter((d for _, d, _ in group), np.int64, len(group))
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    at = np.fromiter((s for _, _, s in group), np.int64, len(group))
    place = np.where(valid, rank[which] << 40 | at[which] + inside, np.iinfo(np.int64).max)
    sorted_place = place[order]
    cuts = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
    earliest = np.minimum.reduceat(sorted_place, cuts)
    later = np.zeros(len(text), bool)
    later[order] = sorted_place > earliest[kind - kind[0]]
    later &= valid
    runs = np.flatnonzero(np.diff(np.concatenate([[0], later.view(np.int8), [0]])))
    for a, b in zip(runs[::2].tolist(), runs[1::2].tolist(), strict=True):
        s = which[a]
        docs.append(int(ids[s]))
        starts.append(int(at[s] + inside[a]))
        stops.append(int(at[s] + inside[b - 1] + LEAST))
    return docs, starts, stops


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removed runs of a shard's stretches, which come sorted by minimiser, document and start."""
    docs: list[int] = []
    starts: list[int] = []
    stops: list[int] = []
    group: list[tuple[bytes, int, int]] = []  # distinct stretches of whole minimisers
    size = 0

    def out() -> pa.RecordBatch:
        nonlocal size
        if group:
            for held, more in zip((docs, starts, stops), _expand(group), strict=True):
                held.extend(more)
        made = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (docs, starts, stops)], ["doc_id", "a", "b"])
        for held in (docs, starts, stops, group):
            held.clear()
        size = 0
        return made

    def close(found: dict[bytes, tuple[int, int]]) -> None:
        """A minimiser with one distinct stretch has nothing to compare."""
        nonlocal size
        if len(found) < 2:
            return
        for b, (d, s) in found.items():
            group.append((b, d, s))
            size += len(b) + 1

    current, found = None, {}
    for batch in batches:
        for key, doc, start, raw in zip(batch["minimiser"].to_pylist(), batch["doc_id"].to_pylist(), batch["start"].to_pylist(), batch["bytes"].to_pylist(), strict=True):
            if key != current:
                close(found)
                current, found = key, {}
                if size >= CHUNK or len(docs) > 100_000:
                    yield out()
            if raw in found:
                if found[raw] != (doc, start):
                    docs.append(doc)
                    starts.append(start)
                    stops.append(start + len(raw))
            else:
                found[raw] = (doc, start)
    close(found)
    yield out()


def repeated_runs(docs: DataFrame) -> tuple[DataFrame, ...]:
    """Tables (doc_id, a, b) of byte runs that are covered by earlier occurrences; runs of one document may overlap."""
    spark = docs.sparkSession
    texts = id_text(docs).where("doc_id is not null")
    found = materialize(texts.mapInArrow(lean(_find), "doc_id long, minimiser long, span long"), "stretches")
    length = F.col("span").bitwiseAND(F.lit((1 << _LENGTH_BITS) - 1))
    start = F.shiftright("span", _PLACE_BITS + _LENGTH_BITS)
    at_once = materialize(found.where("minimiser is null").select("doc_id", start.alias("a"), (start + length).alias("b")), "runs")
    open_ = found.where("minimiser is not null")
    shared = open_.groupBy("minimiser").agg(F.count("*").alias("n")).where("n > 1").select("minimiser", (F.col("n") > FREQUENT).alias("frequent"))
    shared = materialize(shared, "shared")
    wanted = open_.join(shared, "minimiser").groupBy("doc_id").agg(F.collect_list(F.struct("minimiser", "span", "frequent")).alias("wanted"))
    wanted = materialize(wanted, "wanted")
    release(found, shared)
    cut = materialize(texts.join(wanted, "doc_id").select("doc_id", "text", "wanted").mapInArrow(lean(_cut), "doc_id long, minimiser long, start long, frequent boolean, bytes binary"), "bytes")
    release(wanted)
    names = ["minimiser", "doc_id", "start", "bytes"]
    parts = cut.where("frequent")
    first = materialize(parts.groupBy("minimiser", "bytes").agg(F.min(F.struct("doc_id", "start")).alias("e")).select("minimiser", "e.doc_id", "e.start", "bytes"), "parts")
    earliest = first.select(F.col("minimiser").alias("m"), F.col("bytes").alias("s"), F.struct("doc_id", "start").alias("e"))
    later = parts.join(earliest, (F.col("minimiser") == F.col("m")) & (F.col("bytes") == F.col("s"))).where(F.struct("doc_id", "start") > F.col("e"))
    folded = materialize(later.select("doc_id", F.col("start").alias("a"), (F.col("start") + F.octet_length("bytes")).alias("b")), "runs")
    dealt = cut.where("not frequent").select(names).unionByName(first.select(names)).repartition(2 * partitions(spark), "minimiser").sortWithinPartitions("minimiser", "doc_id", "start")
    expanded = materialize(dealt.mapInArrow(lean(_shard), "doc_id long, a long, b long"), "runs")
    release(cut, first)
    return at_once, folded, expanded


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, whole_characters: bool = False) -> DataFrame:
    """doc_id, ``kept`` (the remaining bytes), n_bytes, ``removed`` (array of runs a, b) and ``rest`` (a struct of all
    columns but text), one row per row.

    Texts are judged as UTF-8 bytes on the input; matches never cross documents, and of equal strings the one with the
    least doc_id and start stays. Null and empty texts have no bytes. Rows repeated with one doc_id are one document;
    a row without doc_id is left whole and doesn't count as an earlier occurrence. With ``whole_characters`` the parts of
    characters at the cut edges are left out of ``kept``, too.
    """
    runs = functools.reduce(DataFrame.unionByName, repeated_runs(docs)).groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("runs")).withColumnRenamed("doc_id", "_id")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.struct(*(docs[c] for c in docs.columns if c != "text")).alias("rest"))
    joined = texts.join(runs, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", "runs", "rest")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("kept", T.BinaryType()), T.StructField("n_bytes", T.LongType()), T.StructField("removed", T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))), joined.schema["rest"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            kept, sizes, removed = [], [], []
            for text, found in zip(block["text"].to_pylist(), block["runs"], strict=True):
                raw = text.encode("utf-8", "replace")
                gone = []
                if found.is_valid:
                    gone = merged(list(zip(found.values.field("a").to_pylist(), found.values.field("b").to_pylist(), strict=True)))
                sizes.append(len(raw))
                removed.append([{"a": a, "b": b} for a, b in gone])
                edges = [0, *(x for ab in gone for x in ab), len(raw)]
                pieces = [raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]
                if whole_characters:  # a piece of valid UTF-8 can only be broken at its ends
                    pieces = [p.decode("utf-8", "ignore").encode() for p in pieces]
                kept.append(b"".join(pieces) if gone else raw)
            yield pa.RecordBatch.from_arrays([block["doc_id"], pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(removed, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), block["rest"]], ["doc_id", "kept", "n_bytes", "removed", "rest"])

    return joined.mapInArrow(lean(run), schema)


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the remaining text of every row (and its n_chars, where there is such a column).

    A character that a removed run cuts in two goes altogether. A text that is all repeats becomes empty; its row stays.
    """
    rows = remove_repeats(docs, whole_characters=True).select("rest", F.col("kept").cast("string").alias("_text"))
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return rows.select(*(new[c].alias(c) if c in new else F.col("rest")[c].alias(c) for c in docs.columns))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = remove_repeats(read_documents(spark, sf_dir))
    return rest.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
