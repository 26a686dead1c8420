"""Token counts per section or field by offset-mapped attribution.

A document is encoded whole, once, so the counts of its parts add up to its own count. The tokens' character spans
follow from the bytes each id stands for; they are joined to the sections' spans as sorted intervals (both tile the
document, so the join is one binary search per token), and a token that crosses a boundary goes to one section by a
stated rule:

* ``start``: the section that holds the token's first character;
* ``majority``: the section that holds most of its characters, the earliest on ties.

Documents are independent: no shuffle, and memory for a few megabytes of text at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import CUT_CHARS, blocks, tokenizer_path, vocabulary
from .common import id_text, lean, read_documents

RULES = ("start", "majority")
_OUT = "doc_id long, section int, char_start long, char_end long, n_tokens long, n_crossing long"


def token_spans(text: str, ids: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-end character of every token; a token of part of a character covers that character."""
    raw = np.frombuffer(text.encode(), np.uint8)
    ends = np.cumsum(lengths[np.frombuffer(ids, "<u4")])
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    if len(raw) == len(text):
        return starts, ends
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    return char[starts], char[ends - 1] + 1


def line_starts(text: str) -> np.ndarray:
    """First character of every line; a line holds its line break."""
    if text.isascii():
        breaks = np.flatnonzero(np.frombuffer(text.encode(), np.uint8) == 10)
    else:
        breaks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") == 10)
    starts = np.concatenate([[0], breaks + 1])
    return starts[:-1] if len(starts) > 1 and starts[-1] == len(text) else starts


def attribute(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, n_chars: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens per section, and how many of them cross into another section. Sections of no characters get none."""
    first = np.searchsorted(sections, starts, "right") - 1
    last = np.maximum(np.searchsorted(sections, ends - 1, "right") - 1, first)
    owner = first.copy()
    crossing = np.flatnonzero(last > first)
    if rule == "majority":
        bounds = np.append(sections, n_chars)
        for t in crossing.tolist():
            held = [min(ends[t], bounds[s + 1]) - max(starts[t], bounds[s]) for s in range(first[t], last[t] + 1)]
            owner[t] = first[t] + int(np.argmax(held))
    return np.bincount(owner, minlength=len(sections)), np.bincount(owner[crossing], minlength=len(sections))


def _count(docs: DataFrame, path: str, rule: str, cut: str) -> DataFrame:
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        lengths = np.array([len(x) for x in words.token_bytes], np.int64)
        for block in blocks(batches, "text", CUT_CHARS):
            texts = block["text"].to_pylist()
            given = block["sections"].to_pylist() if cut == "given" else None
            rows: list[list[np.ndarray]] = []
            sizes = []
            for k, (text, ids) in enumerate(zip(texts, words.encode(texts), strict=True)):
                sections = line_starts(text) if given is None else np.array(given[k], np.int64)
                n, crossing = attribute(*token_spans(text, ids, lengths), sections, len(text), rule) if ids else (np.zeros(len(sections), np.int64),) * 2
                rows.append([np.arange(len(sections), dtype=np.int32), sections, np.append(sections[1:], len(text)), n, crossing])
                sizes.append(len(sections))
            ids_out = block["doc_id"].take(pa.array(np.repeat(np.arange(len(texts)), sizes)))
            columns = [np.concatenate([r[i] for r in rows]) for i in range(5)]
            yield pa.RecordBatch.from_arrays([ids_out, pa.array(columns[0], pa.int32()), *(pa.array(c.astype(np.int64)) for c in columns[1:])], ["doc_id", "section", "char_start", "char_end", "n_tokens", "n_crossing"])

    return docs.mapInArrow(lean(run), _OUT)


def line_token_counts(docs: DataFrame, path: str, rule: str = "start") -> DataFrame:
    """One row per document and line: doc_id, section, char_start, char_end, n_tokens, n_crossing.

    Null and empty texts have one section without characters or tokens. Repeated rows each give their own rows.
    """
    return _count(id_text(docs), path, rule, "lines")


def field_token_counts(docs: DataFrame, fields: list[str], path: str, rule: str = "start", separator: str = "\n") -> DataFrame:
    """As ``line_token_counts``, for a document made of ``fields`` in order, each followed by ``separator`` (which
    counts to its field). A null field counts as empty."""
    texts = [F.concat(F.coalesce(F.col(f).cast("string"), F.lit("")), F.lit(separator)) for f in fields]
    ends = F.lit(0)
    starts = []
    for t in texts:
        starts.append(ends)
        ends = ends + F.length(t)
    return _count(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.concat(*texts).alias("text"), F.array(*starts).alias("sections")), path, rule, "given")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_token_counts(read_documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))
