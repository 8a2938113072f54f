"""Quality rules as a ledger of failure bits.

``ledger`` reads a text once, gives every measurement, evaluates every rule once and
stores the failed ones as bits of one long; ``write_ledger`` keeps that, without the
texts, under the version of the rule set.  ``apply_policy`` reads a versioned policy (a
mask of bits) off the ledger, and ``ablation`` tells, from counts by bit pattern alone,
what each rule of a policy rejects and what it rejects that no other rule would.  No
policy change needs the texts again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litmine.llm.common import Scratch, of_row, table, unwrapped, wrapped

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, "
    "n_repeat_words long, n_caps_words long"
)
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    fails: str  # a SQL condition over the measurements


#: The bit of a rule never changes its meaning; a new threshold is a new rule with a new bit.
RULES = (
    Rule(0, "too_few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbol_heavy", "2 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 20 * n_words"),
    Rule(6, "shouting", "100 * n_caps_words > 60 * n_words"),
)
#: Changes with every rule that is added; a ledger row says which rules it has seen.
RULES_VERSION = 1
POLICIES = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": tuple(r.name for r in RULES),
    #: for tables of short entries and code, where capitals and long tokens are usual
    "v2": ("too_few_words", "repeated_windows", "symbol_heavy", "repeated_lines"),
}


def mask(policy: str | tuple[str, ...]) -> int:
    """The bits of a policy's rules."""
    names = POLICIES[policy] if isinstance(policy, str) else policy
    bits = {r.name: r.bit for r in RULES}
    return sum(1 << bits[n] for n in set(names))


_BYTES = np.arange(256)
_SPACE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
_CONT = (_BYTES & 0xC0) == 0x80
_SYMBOL = np.isin(_BYTES, np.frombuffer(b"#*$%&|<>", np.uint8))


def _repeat_words(words: list[bytes]) -> int:
    """Words inside windows of WINDOW words that the text has at least twice."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    x = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, len(words))
    if len(ids) == len(words):
        return 0
    key = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        key = key * np.uint64(0x9E3779B97F4A7C15) + x[k : k + n] + np.uint64(1)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    at = np.sort(order[np.concatenate(([False], same)) | np.concatenate((same, [False]))])
    windows = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[at]
    _, back, count = np.unique(windows, axis=0, return_inverse=True, return_counts=True)  # equal words, not equal hashes
    at = at[count[back.reshape(-1)] > 1]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measure_text(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES; null is the empty text."""
    raw = (text or "").encode()
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()  # bytes split at exactly 0x20 and 0x09-0x0D
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(words),
        int(count.sum() - count[_CONT].sum() - count[_SPACE].sum()),
        int(count[_SYMBOL].sum()),
        len(lines),
        len(lines) - len(set(lines)),
        _repeat_words(words),
        sum(map(bytes.isupper, words)),
    )


def _measure(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in MEASURES.split(", ")]
    for batch in texts:
        yield pd.DataFrame([measure_text(t) for t in batch], columns=names, dtype="int64")


_NAMES = [x.split()[0] for x in MEASURES.split(", ")]


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus the struct ``measured`` and the long ``fail_bits``; one row per row.

    Null and empty texts measure 0 everywhere (and so fail ``too_few_words``).
    Rows are independent: no shuffle, repeated rows get equal ledgers, an empty
    table gives an empty ledger; columns called like a measurement don't clash,
    as the measurements live inside ``measured``.  Columns of ``docs`` that are
    called ``measured`` or ``fail_bits`` are replaced.
    """
    out = docs.withColumn("measured", F.pandas_udf(_measure, MEASURES)(F.col(f"`{text}`")))
    bits: Column = F.lit(0).cast("long")
    for rule in RULES:
        condition = " ".join(f"measured.{w}" if w in _NAMES else w for w in rule.fails.split())
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << rule.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return out.withColumn("fail_bits", bits)


def write_ledger(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """Append (doc_id, rules_version, measurements, fail_bits) of documents to the ledger table at ``path``."""
    rows = ledger(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")))
    rows.select("doc_id", F.lit(RULES_VERSION).alias("rules_version"), "measured.*", "fail_bits").write.mode("append").parquet(path)


def read_ledger(spark: SparkSession, path: str, version: int = RULES_VERSION) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("rules_version") == version)


def select_documents(docs: DataFrame, policy: str | tuple[str, ...] = "v1", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, all columns as they were, whatever their names.

    Null and empty texts fail ``too_few_words``; repeated rows fare alike; an empty table
    gives an empty one.
    """
    rows = apply_policy(ledger(wrapped(docs).withColumn("text", of_row(text))), policy)
    return unwrapped(rows.filter("kept"), docs.columns)


def apply_policy(rows: DataFrame, policy: str | tuple[str, ...] = "v1") -> DataFrame:
    """The ledger's rows plus ``kept``: no bit of the policy is set."""
    return rows.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0)


def ablation(rows: DataFrame, policy: str | tuple[str, ...] = "v1") -> DataFrame:
    """Per rule of the policy: rows it fails, and rows that only it rejects.

    Rows are first counted by bit pattern (2^rules at most, whatever the input),
    which is all that the second step sees.
    """
    m = mask(policy)
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(m)).alias("p")).agg(F.count("*").alias("n"))
    rules = [F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in RULES if m >> r.bit & 1]
    return (
        patterns.withColumn("r", F.explode(F.array(*rules)))
        .groupBy("r.rule")
        .agg(
            F.sum(F.when(F.col("p").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("p") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only_this"),
            F.sum(F.when(F.col("p").bitwiseAND(F.col("r.bit").bitwiseXOR(F.lit(m))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
            F.sum("n").alias("n_rows"),
        )
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ledger of all documents, rereads it and applies policies v1 (kept) and v2 (kept_v2)."""
    scratch = Scratch(spark, "quality")
    path = f"{scratch.root}/ledger"
    write_ledger(table(spark, sf_dir, "documents"), path)
    rows = read_ledger(spark, path)
    kept_v2 = F.col("fail_bits").bitwiseAND(F.lit(mask("v2"))) == 0
    base_failed = F.col("fail_bits").bitwiseAND(F.lit(mask("base"))) != 0
    return apply_policy(rows, "v1").select("doc_id", *_NAMES, base_failed.alias("base_failed"), "kept", "fail_bits", kept_v2.alias("kept_v2"), "rules_version")


OP1_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), pos AS (
  SELECT r, i, list_aggregate(words[i:i + 7], 'string_agg', ' ') AS win
  FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) > 7)
), rep AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM pos) WHERE c > 1
), cov AS (
  SELECT r, count(DISTINCT i + k) AS n FROM rep, range(0, 8) t(k) GROUP BY r
), m AS (
  SELECT w.r, doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
         len(list_filter(words, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS caps
  FROM w LEFT JOIN cov ON w.r = cov.r
), b AS (
  SELECT *, CASE WHEN n_words < 20 THEN 1 ELSE 0 END | CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    | CASE WHEN 2 * n_symbols > n_words THEN 4 ELSE 0 END | CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
    | CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END | CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END
    | CASE WHEN 100 * caps > 60 * n_words THEN 64 ELSE 0 END AS fail_bits FROM m
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(n_lines AS BIGINT) AS n_lines, CAST(caps AS BIGINT) AS n_caps_words,
       (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, CAST(fail_bits AS BIGINT) AS fail_bits,
       (fail_bits & 15) = 0 AS kept_v2, CAST(1 AS INT) AS rules_version FROM b
"""
