"""Byte-pair encoding and decoding with a contiguous rank array.

A word's parts lie side by side, and beside them the merge rank of every adjacent pair. Encoding scans the ranks for
the minimum (the leftmost on ties), deletes that boundary, and looks up the two neighbouring ranks again, until no
adjacent pair merges. Short words are done many at a time: one row of a matrix per word, one scan per step for all
of them. Words beyond ``SHORT`` bytes keep their ranks in a heap instead, since repeated scans would be quadratic.

Texts are cut into words a block at a time, by the classes of neighbouring characters. A block's distinct words are
looked up in a bounded dictionary; those that it lacks are encoded together. Words that were asked for since the
dictionary last filled up stay in it, so it never forgets the frequent ones.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, lean, read_documents

SHORT = 128
#: Words that the dictionary holds before those that were not asked for lately leave it.
CACHED_WORDS = 400_000
#: Characters that are cut into words together, about; longer texts are cut between a word and white space. The arrays
#: over a block's characters and words take some 40 bytes a character, in every worker.
CUT_CHARS = 1 << 20
_NONE = np.iinfo(np.int32).max

#: Characters below this are told apart by a table; parts with others are split by the library's own rule.
_END = 0x250
_OTHER, _LETTER, _DIGIT, _BLANK = range(4)
_WHITE = "\t\n\x0b\x0c\r \x85\xa0"
_KINDS = np.array([_BLANK if chr(c) in _WHITE else {"L": _LETTER, "N": _DIGIT}.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(_END)], np.uint8)
_BEFORE_WHITE = re.compile(rf"(?<=[^{_WHITE}])[{_WHITE}]")
_ONE, _TWO = np.frombuffer(b"stmd", np.uint8), (b"re", b"ve", b"ll")


def cut_words(codes: np.ndarray, begins: np.ndarray, lead_space: bool) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last place of every word of texts that lie one behind another in ``codes`` from ``begins`` on.

    The public split rules over letters, digits, white space and others: a word is a run of one kind or a contraction
    such as 's. With ``lead_space`` a space belongs to the word behind it, other white space is words of its own, and
    digits run on; without, white space goes and every digit is a word.
    """
    n = len(codes)
    kind = _KINDS[codes]
    begin = np.zeros(n + 1, bool)
    begin[begins] = True
    begin[n] = True
    new = begin[:n].copy()
    new[1:] |= kind[1:] != kind[:-1]
    if not lead_space:
        new |= kind == _DIGIT
    # a quote that opens a word, with a known ending behind it
    q = np.flatnonzero((codes == 39) & new)
    q = q[~begin[q + 1]]
    if lead_space:
        q = q[begin[q] | (codes[q - 1] != 32)]
    one = q[np.isin(codes[q + 1], _ONE)]
    rest = q[~begin[np.minimum(q + 2, n)]]
    two = rest[np.any([(codes[rest + 1] == a) & (codes[rest + 2] == b) for a, b in _TWO], 0)]
    for at, size in ((one, 2), (two, 3)):
        new[at + 1] = False
        behind = at + size
        new[behind[behind < n]] = True
    starts = None
    if lead_space:
        last = np.flatnonzero((kind == _BLANK) & ~begin[1:])
        last = last[kind[last + 1] != _BLANK]  # the white space right before a word
        new[last] = True
        new[last[codes[last] == 32] + 1] = False
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], n)
    if lead_space:
        return starts, ends
    words = kind[starts] != _BLANK
    return starts[words], ends[words]


@functools.lru_cache
def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class RankArray:
    """A byte-level BPE vocabulary from a ``tokenizers`` file, with or without marked word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, letters = model["vocab"], byte_letters()
        suffix = model.get("end_of_word_suffix") or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.lead_space = not suffix  # word-end vocabularies drop white space and lower the text
        size = max([*vocab.values(), *self.specials.values()]) + 1
        back = {letter: b for b, letter in enumerate(letters)}
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            token = token.removesuffix(suffix) if suffix else token
            self.token_bytes[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for content, i in self.specials.items():
            self.token_bytes[i] = content.encode()
        self.of_byte = np.array([vocab[c] for c in letters], np.int32)
        self.of_last = np.array([vocab[c + suffix] for c in letters], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        order = np.argsort(keys := left << 32 | right, kind="stable")
        first = np.concatenate([[True], np.diff(keys[order]) > 0])
        self.pair_keys, self.pair_ranks = keys[order][first], order[first].astype(np.int32)
        # ranks of neighbouring letters, inside a word and at its end
        a, b = np.repeat(np.arange(256), 256), np.tile(np.arange(256), 256)
        self.letter_ranks = [self.ranks_of(self.of_byte[a], last[b]).reshape(256, 256) for last in (self.of_byte, self.of_last)]
        self._forget(np.empty(0, np.int64))

    def _forget(self, kept: np.ndarray) -> None:
        """Only the words in the ``kept`` slots stay; a slot has its ids' place in ``flat`` and their number."""
        if len(kept):
            names = list(self.slots)
            sizes = self.sizes[kept]
            shift = np.repeat(self.begins[kept] - (np.cumsum(sizes) - sizes), sizes)
            self.flat = self.flat[np.arange(int(sizes.sum())) + shift]
            self.slots = {names[k]: i for i, k in enumerate(kept.tolist())}
            self.sizes, self.begins = sizes, np.cumsum(sizes) - sizes
        else:
            self.slots: dict[bytes, int] = {}
            self.flat, self.sizes, self.begins = np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, np.int64)
        self.asked = np.zeros(len(self.sizes), bool)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == keys) & (left >= 0) & (right >= 0), self.pair_ranks[at], _NONE)

    def _short(self, words: list[bytes], width: int) -> list[bytes]:
        """Encode words of at most ``width`` bytes in lock step."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        parts = np.full((n, width + 1), -1, np.int32)  # -1 stands behind the last part
        rows = np.repeat(np.arange(n), lengths)
        cols = np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        letters = np.frombuffer(b"".join(words), np.uint8)
        parts[rows, cols] = self.of_byte[letters]
        parts[np.arange(n), lengths - 1] = self.of_last[letters[np.cumsum(lengths) - 1]]
        ranks = np.full((n, width), _NONE, np.int32)
        inner = np.flatnonzero(cols < lengths[rows] - 1)
        ranks[rows[inner], cols[inner]] = self.letter_ranks[0][letters[inner], letters[inner + 1]]
        two = np.flatnonzero(lengths > 1)
        end = np.cumsum(lengths)[two] - 1
        ranks[two, lengths[two] - 2] = self.letter_ranks[1][letters[end - 1], letters[end]]
        out, live = parts.copy(), np.arange(n)
        place = np.arange(width + 1)
        while len(live):
            least = ranks.argmin(1)
            row = np.arange(len(live))
            rank = ranks[row, least]
            if (over := rank == _NONE).any():
                out[live[over]] = parts[over]
                live, parts, ranks, least, rank = live[~over], parts[~over], ranks[~over], least[~over], rank[~over]
                row = np.arange(len(live))
            if not len(live):
                break
            parts[row, least] = self.made[rank]
            behind = place > least[:, None]
            shifted = np.concatenate([parts[:, 1:], np.full((len(live), 1), -1, np.int32)], 1)
            parts = np.where(behind, shifted, parts)
            ranks = np.where(behind[:, :-1], np.concatenate([ranks[:, 1:], np.full((len(live), 1), _NONE, np.int32)], 1), ranks)
            here = parts[row, least]
            ranks[row, least] = self.ranks_of(here, parts[row, least + 1])
            before = least > 0
            ranks[row[before], least[before] - 1] = self.ranks_of(parts[row[before], least[before] - 1], here[before])
        ends = (out >= 0).sum(1)
        flat = out[out >= 0].astype("<u4").tobytes()
        stops = (np.cumsum(ends) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]

    def _long(self, word: bytes) -> bytes:
        """The same merges with a heap of (rank, place) for a word too long to scan again and again."""
        parts = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        parts[-1] = int(self.of_last[word[-1]])
        n = len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        table = self._pair_table()
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := table.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = int(self.made[rank]), -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := table.get((parts[i], parts[k]))) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[k]))
            if (h := before[i]) >= 0 and (r := table.get((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (r, h, parts[h], parts[i]))
        return np.array([p for p in parts if p >= 0], "<u4").tobytes()

    @functools.lru_cache  # noqa: B019  one vocabulary lives as long as its worker
    def _pair_table(self) -> dict[tuple[int, int], int]:
        return {(int(k >> 32), int(k & 0xFFFFFFFF)): int(r) for k, r in zip(self.pair_keys, self.pair_ranks, strict=True)}

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        low = 0
        for width in (2, 4, 6, 8, 10, 12, 14, 16, 20, 24, 32, 64, SHORT):
            group = np.flatnonzero((lengths > low) & (lengths <= width)).tolist()
            step = max(1, 200_000 // width)
            for at in range(0, len(group), step):
                some = group[at : at + step]
                for i, ids in zip(some, self._short([words[i] for i in some], width), strict=True):
                    out[i] = ids
            low = width
        for i in np.flatnonzero(lengths > SHORT).tolist():
            out[i] = self._long(words[i])
        return out

    def slots_of(self, words: list[bytes]) -> np.ndarray:
        """The dictionary's slots of distinct words; new words are encoded and get slots at its end."""
        if len(self.slots) > CACHED_WORDS:
            self._forget(np.flatnonzero(self.asked) if 2 * self.asked.sum() <= CACHED_WORDS else np.empty(0, np.int64))
        found = list(map(self.slots.get, words))
        fresh = [i for i, k in enumerate(found) if k is None]
        if fresh:
            n = len(self.slots)
            new = [words[i] for i in fresh]
            ids = self.encode_words(new)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            self.begins = np.concatenate([self.begins, len(self.flat) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), "<u4")])
            self.asked = np.concatenate([self.asked, np.zeros(len(new), bool)])
            self.slots.update(zip(new, range(n, n + len(new)), strict=True))
            for i, k in zip(fresh, range(n, n + len(new)), strict=True):
                found[i] = k
        out = np.array(found, np.int64)
        self.asked[out] = True
        return out

    def _parts(self, text: str) -> list[str | int]:
        """A text between its special tokens (those as ids), in parts of about ``CUT_CHARS`` characters."""
        out: list[str | int] = []
        for piece in self.special.split(text) if self.special and any(s in text for s in self.specials) else [text]:
            if piece in self.specials:
                out.append(self.specials[piece])
                continue
            at = 0
            while len(piece) - at > CUT_CHARS and (found := _BEFORE_WHITE.search(piece, at + CUT_CHARS)):
                out.append(piece[at : found.start()])
                at = found.start()
            if at < len(piece):
                out.append(piece[at:])
        return out

    def _word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids one behind another, ids of each word) for binary words."""
        coded = words.dictionary_encode()
        ends = np.frombuffer(coded.dictionary.buffers()[1], np.int32)[: len(coded.dictionary) + 1].tolist()
        raw = coded.dictionary.buffers()[2].to_pybytes()
        slots = self.slots_of([raw[a:b] for a, b in zip(ends, ends[1:], strict=False)])[coded.indices.to_numpy()]
        counts = self.sizes[slots]
        shift = self.begins[slots] - (np.cumsum(counts) - counts)
        return self.flat[np.arange(int(counts.sum())) + np.repeat(shift, counts)], counts

    def _encode_parts(self, parts: list[str]) -> list[np.ndarray]:
        """Ids of each part; parts are non-empty."""
        joined = "".join(parts)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        begins = np.cumsum(sizes) - sizes
        if not self.lead_space:
            low = joined.lower()
            if len(low) != len(joined):  # a letter whose small form is several characters
                return [x for p in parts for x in ([self._by_library(p)] if len(p.lower()) != len(p) else self._encode_parts([p]))]
            joined = low
        raw = np.frombuffer(joined.encode("utf-8", "replace"), np.uint8)
        if len(raw) == len(joined):
            codes, at = raw, None
        else:
            codes = np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4")
            strange = np.unique(np.searchsorted(begins, np.flatnonzero(codes >= _END), "right") - 1)
            if len(strange):
                apart = set(strange.tolist())
                plain = [k for k in range(len(parts)) if k not in apart]
                done = dict(zip(plain, self._encode_parts([parts[k] for k in plain]), strict=True)) if plain else {}
                return [done[k] if k in done else self._by_library(p) for k, p in enumerate(parts)]
            at = np.concatenate([[0], np.cumsum(1 + (codes >= 0x80))])
        starts, ends = cut_words(codes, begins, self.lead_space)
        bounds = np.searchsorted(starts, begins)
        if at is not None:
            starts, ends = at[starts], at[ends]
        lengths = ends - starts
        if not self.lead_space:
            held = np.zeros(len(raw) + 1, np.int8)
            np.add.at(held, starts, 1)
            np.add.at(held, ends, -1)
            raw = raw[np.cumsum(held[:-1]).astype(bool)]
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])
        if not len(lengths):
            return [np.empty(0, "<u4") for _ in parts]
        ids, counts = self._word_ids(words)
        return np.split(ids, np.concatenate([[0], np.cumsum(counts)])[bounds[1:]])

    def _by_library(self, part: str) -> np.ndarray:
        """Ids of a part that the library's own rules cut into words."""
        if self.library.normalizer is not None:
            part = self.library.normalizer.normalize_str(part)
        words = [part[a:b].encode("utf-8", "replace") for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(part)]
        return self._word_ids(pa.array(words, pa.binary()))[0] if words else np.empty(0, "<u4")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as little-endian unsigned 32-bit integers."""
        found: list[list[np.ndarray]] = [[] for _ in texts]
        queue: list[tuple[int, int, str]] = []
        held = 0

        def flush() -> None:
            nonlocal held
            if queue:
                for (k, place, _), ids in zip(queue, self._encode_parts([p for _, _, p in queue]), strict=True):
                    found[k][place] = ids
            queue.clear()
            held = 0

        for k, text in enumerate(texts):
            for part in self._parts(text):
                if isinstance(part, int):
                    found[k].append(np.array([part], "<u4"))
                    continue
                queue.append((k, len(found[k]), part))
                found[k].append(np.empty(0, "<u4"))
                held += len(part)
                if held >= CUT_CHARS:
                    flush()
        flush()
        return [x[0].tobytes() if len(x) == 1 else b"".join(y.tobytes() for y in x) for x in found]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> RankArray:
    """One per worker process and file."""
    return RankArray(path)


def blocks(batches: Iterator[pa.RecordBatch], column: str, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``size`` bytes of ``column`` each, so memory doesn't follow the batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), np.int64)
        group = (np.cumsum(lengths) // size).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ``ids`` (binary, little-endian unsigned 32-bit) of every whole text.

    Null and empty texts have no ids. Rows repeated stay repeated. Other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for block in blocks(batches, "text", CUT_CHARS):
            yield pa.RecordBatch.from_arrays([block["doc_id"], pa.array(words.encode(block["text"].to_pylist()), pa.binary())], ["doc_id", "ids"])

    return id_text(docs).mapInArrow(lean(run), "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with the decoded ``text``; bytes that are no UTF-8 become replacement characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for block in blocks(batches, "ids"):
            texts = [words.decode(x) for x in block["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([block["doc_id"], block["ids"], pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(lean(run), "doc_id long, ids binary, text string")


def tokenizer_path(name: str) -> str:
    """A public vocabulary's place on this machine; executors have the same library."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.json")
    back = decode(encode(read_documents(spark, sf_dir), path), path)
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
