"""URL filters: host and path rules, then a ratio of two character language models.

URLs that a rule allows or blocks train two variable-order Markov models. A URL that no rule fits is
judged by the difference of its log-likelihoods under them, divided by its length, against a threshold
calibrated on rule-judged URLs that the models haven't seen. All n-grams are kept, as a table; the values of
those that a block of URLs has are joined to the block.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, tidied

# The rules, as verdict, host and path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789-._/?=&%:#~"
DEPTH = 5  # characters in the longest n-gram
DISCOUNT = 0.75
#: URLs that are scored together, as a power of two; a common n-gram has one row for each such block.
BLOCK_BITS = 11
BINS, BIN_WIDTH = 801, 0.02
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null and for URLs without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, "(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as ``host/path``, and its verdict; null without one."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, what).otherwise(verdict)
    return text, verdict


_KNOWN = {c: c for c in ALPHABET} | {u: low for u, low in zip(UPPER, LOWER, strict=True)}


def letters(url: str | None) -> str:
    """A URL in the models' alphabet, between a start and an end sign; other characters are ``~``."""
    return "^" + "".join([_KNOWN.get(c, "~") for c in url or ""]) + "$"


def grams(text: str) -> Iterator[str]:
    """Every n-gram of 1 to DEPTH characters that ends on a character after the start."""
    for end in range(2, len(text) + 1):
        for begin in range(max(0, end - DEPTH), end):
            yield text[begin:end]


@dataclass
class Model:
    """Absolute discounting from the longest known context down to a uniform guess; ``values`` does it for tables."""

    counts: dict[str, int]

    def __post_init__(self):
        total, kinds = defaultdict(int), defaultdict(int)
        for gram, n in self.counts.items():
            total[gram[:-1]] += n
            kinds[gram[:-1]] += 1
        self.total, self.kinds = dict(total), dict(kinds)

    def chance(self, context: str, c: str) -> float:
        p = 1 / (len(ALPHABET) + 1)
        for begin in range(len(context), -1, -1):
            own = context[begin:]
            n = self.total.get(own)
            if n is None:
                break
            p = max(0.0, self.counts.get(own + c, 0) - DISCOUNT) / n + DISCOUNT * self.kinds[own] / n * p
        return p


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[bool, Counter] = {True: Counter(), False: Counter()}

    def out():
        for good, counts in held.items():
            if counts:
                yield pa.RecordBatch.from_pydict({"good": [good] * len(counts), "gram": list(counts), "n": list(counts.values())})
                counts.clear()

    for batch in batches:
        for good, url in zip(batch.column("good").to_pylist(), batch.column("url").to_pylist(), strict=True):
            held[good].update(grams(letters(url)))
        if max(map(len, held.values())) > 1 << 20:
            yield from out()
    yield from out()


def needed(text: str) -> list[str]:
    """The n-gram of every character after the start with its longest context."""
    return [text[max(0, end - DEPTH) : end] for end in range(2, len(text) + 1)]


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct n-grams of each block, once for each batch that has a part of it."""
    for batch in batches:
        found: dict[int, set[str]] = defaultdict(set)
        for block, url in zip(batch.column("block").to_pylist(), batch.column("url").to_pylist(), strict=True):
            found[block].update(needed(letters(url)))
        for block, own in found.items():
            yield pa.RecordBatch.from_pydict({"block": [block] * len(own), "gram": list(own)})


def values(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, value): the difference of the log chances of the last character; counts: (gram, good, bad).

    Chances go from each n-gram's last character up to the whole, a join for each length. An n-gram has
    as many that are longer by one character as there are letters, so no join is skewed.
    """
    size = F.length("gram")
    ends = F.expr("explode(transform(sequence(1, length(gram)), k -> substring(gram, length(gram) - k + 1, k)))")
    ends = wanted.select(ends.alias("gram")).distinct().withColumn("context", F.expr("substring(gram, 1, length(gram) - 1)"))
    sums = [f(c).alias(f"{c}_{name}") for c in ("good", "bad") for name, f in (("total", F.sum), ("kinds", lambda c: F.count_if(F.col(c) > 0)))]
    contexts = counts.groupBy(F.expr("substring(gram, 1, length(gram) - 1)").alias("context")).agg(*sums)
    known = stored(ends.join(counts, "gram", "left").join(contexts, "context", "left").drop("context"), "url-chances")

    def chance(c: str, shorter: Column) -> Column:
        n = F.col(f"{c}_total")
        own = F.greatest(F.lit(0.0), F.coalesce(c, F.lit(0)) - DISCOUNT) / n + DISCOUNT * F.col(f"{c}_kinds") / n * shorter
        return F.when(n > 0, own).otherwise(shorter)

    levels = []
    for length in range(1, DEPTH + 1):
        own = known.where(size == length).withColumn("end", F.expr("substring(gram, 2)"))
        if levels:
            own = own.join(levels[-1].select(F.col("gram").alias("end"), F.col("p_good").alias("q_good"), F.col("p_bad").alias("q_bad")), "end")
        else:
            own = own.withColumns(dict.fromkeys(("q_good", "q_bad"), F.lit(1 / (len(ALPHABET) + 1))))
        levels.append(stored(own.select("gram", chance("good", F.col("q_good")).alias("p_good"), chance("bad", F.col("q_bad")).alias("p_bad")), "url-level"))
    return reduce(DataFrame.unionByName, levels).select("gram", (F.log("p_good") - F.log("p_bad")).alias("value"))


def scores(urls: DataFrame, counts: DataFrame) -> DataFrame:
    """The rows, which have a block and a url, with their score for the url: the mean over its characters."""
    asked = stored(urls.select("block", "url").mapInArrow(tidied(_asked), "block long, gram string"), "url-asked")
    told = asked.join(values(counts, asked.select("gram").distinct()), "gram")
    names = [c for c in urls.columns if c not in ("block", "url")]

    def block(own: pa.Table, grams: pa.Table) -> pa.Table:
        value = dict(zip(grams.column("gram").to_pylist(), grams.column("value").to_pylist(), strict=True))
        found = []
        for url in own.column("url").to_pylist():
            each = needed(letters(url))
            found.append(sum(map(value.__getitem__, each)) / len(each))
        return own.select(names).append_column("score", pa.array(found, pa.float64()))

    fields = ", ".join(f"{c} {urls.schema[c].dataType.simpleString()}" for c in names) + ", score double"
    return urls.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(block, fields)


def calibrated(held: np.ndarray) -> float:
    """The bound between bins with the best mean of both classes' shares on their side; of equal ones that nearest to 0."""
    share = held / np.maximum(1, held.sum(1, keepdims=True))
    right = np.concatenate([[0], np.cumsum(share[0])]) + 1 - np.concatenate([[0], np.cumsum(share[1])])
    edges = (np.arange(BINS + 1) - BINS // 2 - 0.5) * BIN_WIDTH
    best = np.flatnonzero(right > right.max() - 1e-12)
    return float(edges[best[np.argmin(np.abs(edges[best]))]])


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, score (null where a rule decided).

    A null URL, or one without ``://``, has an empty host and path and is left to the models like any
    other without a rule; its score is that of its characters, of none that of an end. If the rules give
    only one verdict, or none, all other URLs are allowed. Null ids and repeated rows pass through one to
    one; an empty table gives none; other columns are dropped whatever their names.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    # four fifths of the URLs that a rule judged train, by a hash, and the rest calibrate
    held = verdict.isNotNull() & (F.pmod(F.xxhash64("url"), F.lit(5)) == 0)
    number = F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)
    ruled = stored(parsed.select("*", rule.alias("rule"), verdict.alias("ruled"), held.alias("held"), number.alias("block")), "url-ruled")
    train = ruled.where("ruled IS NOT NULL AND NOT held").select((F.col("ruled") == "allow").alias("good"), "url")
    n = lambda good: F.sum(F.when(F.col("good") == good, F.col("n")).otherwise(0))
    counts = stored(train.mapInArrow(tidied(_counted), "good boolean, gram string, n long").groupBy("gram").agg(n(True).alias("good"), n(False).alias("bad")), "url-grams")
    plain = ruled.where("ruled IS NOT NULL").drop("url", "block", "held").withColumn("score", F.lit(None).cast("double"))
    most = counts.agg(F.max("good"), F.max("bad")).first()
    if not all(most):
        rest = ruled.where("ruled IS NULL").drop("url", "block", "held").withColumn("score", F.lit(None).cast("double"))
        said = F.lit("allow")
    else:
        found = stored(scores(ruled.where("ruled IS NULL OR held"), counts), "url-scores")
        place = F.least(F.greatest(F.bround(F.col("score") / BIN_WIDTH) + BINS // 2, F.lit(0)), F.lit(BINS - 1)).cast("int")
        bins = np.zeros((2, BINS))
        for r in found.where("held").groupBy((F.col("ruled") == "allow").alias("good"), place.alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect():
            bins[int(r.good), r.bin] = r.n
        rest = found.where("ruled IS NULL").drop("held")
        said = F.when(F.col("score") >= calibrated(bins), "allow").otherwise("block")
    scored = plain.unionByName(rest)
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", said).alias("verdict"), "score")

