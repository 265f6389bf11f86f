"""Quality rules as a bitmask ledger (operator 5).

Every rule is evaluated once for each document: the ledger holds what was measured and one bit for
each rule that failed. A policy is a set of rules under a version; applying one is a bitwise AND on
the ledger, and what each rule costs (ablation) follows from counts per bitmask, so neither reads a
text again.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loupewright.llm.common import fresh, map_rows, table

_SPACES, _SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def repeated_words(words: list) -> int:
    """How many words lie in a 3-word window that occurs twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    known: dict = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    size = len(known)
    pairs = ids[:-2] * size + ids[1:-1]
    if size > 1 << 20:  # keeps the product below 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    windows = pairs * size + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n + 2, bool)
    for shift in range(3):
        covered[shift : shift + n] |= again
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    text = text or ""
    words = text.encode().split()  # bytes are split at ASCII white space only
    lines = [line for line in text.split("\n") if line.strip(_SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, _SPACES)),
        sum(map(text.count, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
    )


#: Rule, in the order of their bits, and the condition on the measurements under which it fails.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "4 * n_symbols > n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 30 * n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
}
BASE = ("few_words", "repeated_windows")
#: Versioned policies: the rules that reject a document.
POLICIES: dict[str, tuple[str, ...]] = {"base": BASE, "v1": tuple(RULES)}


def mask(rules) -> int:
    order = list(RULES)
    return sum(1 << order.index(rule) for rule in rules)


def failure_bits() -> Column:
    bits = [F.when(F.expr(condition), F.lit(1 << k)).otherwise(F.lit(0)) for k, condition in enumerate(RULES.values())]
    return reduce(lambda a, b: a.bitwiseOR(b), bits).cast("bigint")


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measurements and ``failures`` (bit k: rule k failed) to each document.

    A null or empty text has zero measurements and fails "few_words". Repeated rows are measured
    each for itself; an empty table gives an empty ledger. Columns of the input called like a
    measurement are replaced. No shuffle; memory is one Arrow batch and one text's words.
    """
    made = [part.split()[0] for part in MEASURES.split(", ")]
    plain = docs.drop(*made, "failures")
    measured = map_rows(plain, [text], lambda texts: list(zip(*map(measure, texts))) or [()] * len(made), MEASURES)
    return measured.withColumn("failures", failure_bits())


def allowed(policy: str = "v1", failures: str = "failures") -> Column:
    """Whether a policy keeps a document of the ledger."""
    return F.col(failures).bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def keep(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The documents a policy keeps, with their own columns."""
    (bits,) = fresh(docs, "_bits")
    inner = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    judged = ledger(inner, f"c{docs.columns.index('text')}").withColumnRenamed("failures", bits)
    return judged.where(allowed(policy, bits)).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def ablation(kept_ledger: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule: documents that fail it, that fail it alone, and that the policy would keep without it.

    One aggregate to at most 2^rules bitmasks; the rest is bit arithmetic on those.
    """
    active = mask(POLICIES[policy])
    counts = kept_ledger.groupBy("failures").agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask([r])).cast("bigint").alias("bit")) for r in POLICIES[policy]]))
    rows = counts.select("failures", "n", rules.alias("r")).select("failures", "n", "r.rule", "r.bit")
    failed = F.col("failures").bitwiseAND(F.col("bit")) != 0
    alone = F.col("failures").bitwiseAND(F.lit(active)) == F.col("bit")
    total = lambda condition, name: F.sum(F.when(condition, F.col("n")).otherwise(0)).alias(name)
    kept = F.col("failures").bitwiseAND(F.lit(active).bitwiseAND(F.bitwise_not(F.col("bit")))) == 0
    return rows.groupBy("rule").agg(total(failed, "failed"), total(alone, "failed_alone"), total(kept, "kept_without"))


def op5_quality(spark, folder):
    return ledger(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failures").bitwiseAND(F.lit(mask(BASE))) != 0).alias("base_failed"),
        allowed("v1").alias("kept"), "failures",
    )


_FAIL = " or ".join(f"({c})" for c in RULES.values())
_BITS = " + ".join(f"case when {c} then {1 << k} else 0 end" for k, c in enumerate(RULES.values()))


def measured_sql(relation: str) -> str:
    """DuckDB statement for the measurements of a relation with doc_id and text, with all its columns."""
    return rf"""(
with numbered as (select row_number() over () as rid, d.* from {relation} d
), listed as (
    select rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
    from numbered
), windows as (
    select rid, p, words[p] as a, words[p + 1] as b, words[p + 2] as c
    from (select rid, words, unnest(range(1, len(words) - 1)) as p from listed)
), again as (
    select rid, p from windows qualify count(*) over (partition by rid, a, b, c) > 1
), covered as (
    select rid, count(distinct p + shift)::bigint as n from again, (values (0), (1), (2)) s(shift) group by rid
)
select d.*, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
       len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::bigint as n_symbols,
       (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
       coalesce(n, 0)::bigint as n_repeat_words, len(lines)::bigint as n_lines
from numbered d join listed using (rid) left join covered using (rid))"""


ORACLE = f"""
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, not ({_FAIL}) as kept, ({_BITS})::bigint as failures
from {measured_sql('documents')} m
"""
