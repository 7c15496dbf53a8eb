"""Quality rules as a ledger of failure bits, in DataFrame functions only.

``measure`` computes every measurement of a text once; ``ledger`` turns them into one bit a rule;
``decide`` applies a version of the policy, which is a mask of those bits; ``ablations`` says from
counts by bit mask what each rule does to each policy.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACE_RUN

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
N = 5  # words in a window


@dataclass(frozen=True)
class Rule:
    name: str
    fails: str  # SQL over the measurements


#: The bit of a rule is its place here: new rules are added at the end, none is removed.
RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("many_symbols", "10 * n_symbols > 3 * n_words"),
    Rule("repeated_lines", "n_lines > 0 AND 10 * n_dup_lines > 3 * n_lines"),
    Rule("short_words", "n_words > 0 AND word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
)
#: The first two are the contract's base rules.
BASE = ("few_words", "repeated_windows")
#: Versions of the policy: the rules that each enforces.
POLICIES = {
    "v1": BASE,
    "v2": (*BASE, "many_symbols", "repeated_lines"),
    "v3": (*BASE, "many_symbols", "repeated_lines", "short_words", "long_words"),
}


def mask(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    place = {r.name: i for i, r in enumerate(rules)}
    return sum(1 << place[n] for n in names)


def _repeat_words(hashes: Column) -> Column:
    """Words in windows whose hash comes twice: sort (hash, place), keep places beside an equal hash, join their reach."""
    placed = F.sort_array(F.arrays_zip(hashes.alias("h"), F.sequence(F.lit(0), F.size(hashes) - 1).alias("i")))
    beside = F.arrays_zip(placed.alias("p"), F.slice(placed, 2, F.size(placed)).alias("q"))
    twice = F.transform(F.filter(beside, lambda x: x["p"]["h"] == x["q"]["h"]), lambda x: F.array(x["p"]["i"], x["q"]["i"]))
    places = F.sort_array(F.array_distinct(F.flatten(twice)))
    start = F.struct(F.lit(0).alias("n"), F.lit(-N).alias("last"))
    return F.aggregate(
        places,
        start,
        lambda a, i: F.struct((a["n"] + F.least(F.lit(N), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"].cast("long"),
    )


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, MEASURES and n_lines (lines with a word), all long.

    Null text: zeros. Null ids, repeated rows and ties pass through one to one; an empty table gives
    none; other columns are dropped whatever their names. A text stays in its row whatever its length:
    windows are compared by 64-bit hashes in sorted arrays of its own, so nothing is shuffled.
    """
    named = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = named.select(
        "id", "text", F.split(F.btrim("text", F.lit(SPACE)), SPACE_RUN).alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines")
    )
    n = F.when(F.get("words", F.lit(0)) == "", 0).otherwise(F.size("words"))
    hashed = words.select(
        "id",
        n.cast("long").alias("n_words"),
        F.when(n == 0, 0).otherwise(F.length(F.array_join("words", ""))).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(n > N, F.transform(F.sequence(F.lit(0), n - N), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(N)]))).alias("hashes"),
    )
    repeats = F.size(F.array_distinct("hashes")) < F.size("hashes")
    return hashed.select(
        F.col("id").alias(id_col),
        *(c for c in MEASURES[:4]),
        F.when(repeats, _repeat_words(F.col("hashes"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        "n_lines",
    )


def ledger(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add ``failed_rules``: bit i is set where rule i fails."""
    bits = [f"IF({r.fails}, {1 << i}L, 0L)" for i, r in enumerate(rules)]
    return measured.withColumn("failed_rules", F.expr(" | ".join(f"({b})" for b in bits)))


def decide(marked: DataFrame, policy: str = "v2", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add ``base_failed`` and ``kept`` under a version of the policy."""
    base, own = mask(BASE, rules), mask(POLICIES[policy], rules)
    return marked.withColumns(
        {
            "base_failed": F.col("failed_rules").bitwiseAND(F.lit(base)) != 0,
            "kept": F.col("failed_rules").bitwiseAND(F.lit(base | own)) == 0,
        }
    )


def ablations(marked: DataFrame, policies: dict[str, tuple[str, ...]] | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For every policy and rule in it: rows it fails, rows that only it fails, rows kept with and without it.

    One aggregation to at most 2^rules rows, from which all figures follow by bit operations.
    """
    policies = policies or POLICIES
    counts = marked.groupBy("failed_rules").agg(F.count(F.lit(1)).alias("n"))
    asked = [(p, r.name, mask(names, rules), 1 << i) for p, names in policies.items() for i, r in enumerate(rules) if r.name in names]
    failing = F.col("failed_rules").bitwiseAND(F.col("mask"))
    crossed = counts.withColumn("asked", F.expr("array(" + ", ".join(f"named_struct('policy', '{p}', 'rule', '{r}', 'mask', {m}L, 'bit', {b}L)" for p, r, m, b in asked) + ")"))
    each = crossed.select("failed_rules", "n", F.inline("asked"))
    total = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    return each.groupBy("policy", "rule").agg(
        total(failing.bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(failing == F.col("bit")).alias("n_only"),
        total(failing == 0).alias("n_kept"),
        total(failing.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("n_kept_without"),
    )
