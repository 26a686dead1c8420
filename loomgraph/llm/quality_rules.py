"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements and one failure bit per rule. Policies
are versioned masks over those bits, so a new policy or an ablation re-reads the narrow ledger and never the texts.
All of it is JVM-side column expressions: no Python, no shuffle (but for the ablation report's tiny aggregate).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, read_documents

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Column | None  # over the measurement columns
    bit: int


def rules() -> list[Rule]:
    """The rules in bit order; bits are never reused, new rules take new bits."""
    c = F.col
    made = [
        ("too_few_words", c("n_words") < 50),
        ("repeated_words", 100 * c("n_repeat_words") > 50 * c("n_words")),
        ("symbols", 100 * c("n_symbols") > 30 * c("n_words")),
        ("duplicate_lines", 100 * c("n_dup_lines") > 30 * c("n_lines")),
        ("capitals", 100 * c("n_capitals") > 50 * c("word_chars")),
        ("exclamations", 100 * c("n_exclamations") > 50 * c("n_words")),
        ("long_words", c("word_chars") > 40 * c("n_words")),
        ("short_words", 2 * c("word_chars") < 3 * c("n_words")),
    ]
    return [Rule(name, fails, bit) for bit, (name, fails) in enumerate(made)]


def mask(*names: str) -> int:
    known = {r: i for i, r in enumerate(RULE_NAMES)}
    return sum(1 << known[n] for n in names)


RULE_NAMES = ("too_few_words", "repeated_words", "symbols", "duplicate_lines", "capitals", "exclamations", "long_words", "short_words")
BASE_MASK = mask("too_few_words", "repeated_words")
#: Version -> mask of the rules that reject a document.
POLICIES = {"base-1": BASE_MASK, "web-1": (1 << len(RULE_NAMES)) - 1}


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id`` and every measurement the rules use, one row per input row.

    Null and empty texts have no words and all measurements 0. Repeated rows each give their own row. Windows are
    sorted by (hash, words, place): the hash only speeds up the comparison, equal windows always stand side by side. Texts
    of any length go one way; a row takes memory in proportion to its words.
    """
    n = F.col("n_words")
    cut = id_text(docs).select(
        "doc_id",
        F.array_remove(F.split("text", SPACE), "").alias("w"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")).cast("long").alias("n_capitals"),
        F.regexp_count("text", F.lit("!")).cast("long").alias("n_exclamations"),
    )
    words = cut.select(
        "doc_id", "w", "n_symbols", "n_capitals", "n_exclamations",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    at = lambda i: F.get(F.col("w"), i)
    starts = F.sequence(F.lit(0), (n - 3).cast("int"))
    window = lambda i: F.struct(F.xxhash64(at(i), at(i + 1), at(i + 2)).alias("h"), at(i).alias("x"), at(i + 1).alias("y"), at(i + 2).alias("z"), i.alias("i"))
    sorted_windows = words.withColumn("s", F.when(n >= 3, F.sort_array(F.transform(starts, window))))
    s = F.col("s")
    same = lambda p, q: (p["h"] == q["h"]) & (p["x"] == q["x"]) & (p["y"] == q["y"]) & (p["z"] == q["z"])
    again = F.filter(F.sequence(F.lit(1), F.size(s) - 1), lambda k: same(F.get(s, k), F.get(s, k - 1)))
    covered = F.flatten(F.transform(again, lambda k: F.flatten(F.transform(F.array(F.get(s, k)["i"], F.get(s, k - 1)["i"]), lambda i: F.array(i, i + 1, i + 2)))))
    n_covered = F.when(F.size(s) >= 2, F.size(F.array_distinct(covered))).otherwise(0)
    return sorted_windows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", n_covered.cast("long").alias("n_repeat_words"), "n_lines", "n_capitals", "n_exclamations")


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and ``failure_bits``: bit k is set where rule k fails."""
    bits = F.lit(0)
    for rule in rules():
        bits = bits.bitwiseOR(F.when(rule.fails, F.lit(1 << rule.bit)).otherwise(0))
    return measure(docs).withColumn("failure_bits", bits.cast("long"))


def apply_policy(entries: DataFrame, version: str, into: str = "kept") -> DataFrame:
    return entries.withColumn(into, F.col("failure_bits").bitwiseAND(F.lit(POLICIES[version])) == 0)


def ablation(entries: DataFrame, version: str) -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail it alone, and that stay once it is left out.

    One pass: the ledger folds to its distinct bit patterns (at most 2^rules), and the rules are read off those.
    """
    m = POLICIES[version]
    spark = entries.sparkSession
    patterns = entries.groupBy(F.col("failure_bits").bitwiseAND(F.lit(m)).alias("bits")).agg(F.count("*").alias("n"))
    wanted = spark.createDataFrame([(name, 1 << i) for i, name in enumerate(RULE_NAMES) if m >> i & 1], "rule string, bit long")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    alone = F.col("bits") == F.col("bit")
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return patterns.join(F.broadcast(wanted), F.lit(True)).groupBy("rule", "bit").agg(count(hit).alias("failed"), count(alone).alias("failed_alone"), count(alone | (F.col("bits") == 0)).alias("kept_without"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = apply_policy(ledger(read_documents(spark, sf_dir)), "web-1")
    failed = F.col("failure_bits").bitwiseAND(F.lit(BASE_MASK)) != 0
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept", "n_lines", "n_capitals", "n_exclamations", "failure_bits")


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
k AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS c FROM g),
c AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM k WHERE c > 1) GROUP BY r),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines,
             CAST(length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS BIGINT) AS n_capitals,
             CAST(length(regexp_replace(t, '[^!]', '', 'g')) AS BIGINT) AS n_exclamations FROM w LEFT JOIN c USING (r)),
b AS (SELECT *, CAST((CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
             + (CASE WHEN 100 * n_symbols > 30 * n_words THEN 4 ELSE 0 END) + (CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END)
             + (CASE WHEN 100 * n_capitals > 50 * word_chars THEN 16 ELSE 0 END) + (CASE WHEN 100 * n_exclamations > 50 * n_words THEN 32 ELSE 0 END)
             + (CASE WHEN word_chars > 40 * n_words THEN 64 ELSE 0 END) + (CASE WHEN 2 * word_chars < 3 * n_words THEN 128 ELSE 0 END) AS BIGINT) AS failure_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failure_bits & 3) <> 0 AS base_failed,
       failure_bits = 0 AS kept, n_lines, n_capitals, n_exclamations, failure_bits FROM b
"""
