"""Document quality by pairwise ranking (Bradley and Terry).

A linear score w.x is learned so that sigmoid(w.(a - b)) is the chance that text a is better than
text b, over all pairs of one good and one bad labelled text. x are measures of a text's form and hashed counts of
its words and of its runs of three bytes. A quantile of the training texts' scores, the share of bad ones, is
where the label changes; scores are put on a 0 to 1 scale around it.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, tidied, tidy

FEATURES = (
    "log_words", "word_length", "upper", "symbols", "exclamations", "digits", "bars", "ends", "commas", "repeat_words",
    "twin_words", "repeat_lines", "top_word", "line_length", "ascii", "no_lower", "symbol_words", "short",
)
_SYMBOLS = re.compile(r"[#*$%&<>]")
_SYMBOL_WORD = re.compile(r"[#*$%&<>|!]{2}(?=\s|$)")
_UPPER_WORD = re.compile(r"\b[^\W\d_a-zà-ÿ]{2,}\b")
_DIGIT = re.compile(r"[0-9]")
HASHED = 256  # numbers for words, and as many for runs of three bytes
_place: dict[str, int] = {}


def _places(words: set[str]) -> np.ndarray:
    """The number that each word is counted in; what has been seen is remembered up to a bound."""
    if len(_place) > 50_000:
        _place.clear()
    return np.array([_place[w] if w in _place else _place.setdefault(w, crc32(w.encode()) % HASHED) for w in words], np.int64)


def lexical(text: str | None) -> np.ndarray:
    """Roots of the counts of distinct words and of runs of three bytes by hash, each to length 1; 0 without any."""
    lower = (text or "").lower()
    b = np.frombuffer(lower.encode(), np.uint8).astype(np.uint16)
    runs = (b[:-2] * np.uint16(0x9E37) ^ b[1:-1] * np.uint16(0x85EB) ^ b[2:] * np.uint16(0xC2B3)) >> np.uint16(8)
    out = np.empty(2 * HASHED, np.float16)
    for k, places in enumerate((_places(set(lower.split())), runs)):
        counts = np.sqrt(np.bincount(places, minlength=HASHED))
        out[k * HASHED : (k + 1) * HASHED] = counts / max(1.0, float(np.sqrt(counts @ counts)))
    return out


def features(text: str | None) -> list[float]:
    """The form of a whole text; all are 0 without words, but for ``short``."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * (len(FEATURES) - 1) + [1.0]
    size = len(text)
    lower = text.lower()
    letters = max(1, sum(map(len, words)))
    upper = sum(a != b for a, b in zip(text, lower, strict=False)) if len(lower) == size else 0
    distinct = set(words)
    lines = [x for x in text.split("\n") if x.strip()]
    grams = list(zip(words, words[1:], words[2:], strict=False))
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    return [
        np.log1p(n) / 10,
        min(letters / n, 30) / 10,
        upper / letters,
        min(1.0, len(_SYMBOLS.findall(text)) / n),
        min(1.0, text.count("!") / n),
        min(1.0, len(_DIGIT.findall(text)) / letters * 5),
        min(1.0, text.count("|") / n),
        min(1.0, text.count(".") / n * 5),
        min(1.0, text.count(",") / n * 5),
        1 - len(set(grams)) / max(1, len(grams)) if grams else 0.0,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        max(counts.values()) / n if n >= 20 else 0.05,
        min(1.0, n / max(1, len(lines)) / 100),
        float(text.isascii()),
        min(1.0, len(_UPPER_WORD.findall(text)) / n),
        min(1.0, len(_SYMBOL_WORD.findall(text)) / n) + min(1.0, 1 - len(distinct) / n) * 0.1,
        1.0 if n < 10 else 0.0,
    ]


@dataclass(frozen=True)
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    width: float

    def score(self, x: np.ndarray, hashed: np.ndarray) -> np.ndarray:
        raw = expand((x - self.mean) / self.scale, hashed) @ self.weights
        return 1 / (1 + np.exp(-np.clip((raw - self.threshold) / self.width, -30, 30)))


def expand(z: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """The features, bounded, with their positive parts, so that a score can bend at a feature's mean, and the hashed counts."""
    z = np.clip(z, -4, 8)
    return np.hstack([z, np.maximum(z, 0), np.maximum(z - 2, 0), hashed], dtype=np.float32)


def described(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The features and hashed counts of every text, of which one at a time is a Python string."""
    x, hashed = np.empty((len(texts), len(FEATURES))), np.empty((len(texts), 2 * HASHED), np.float16)
    for i, text in enumerate(texts):
        text = text.as_py()
        x[i], hashed[i] = features(text), lexical(text)
    return x, hashed


def _packed(x: np.ndarray, hashed: np.ndarray) -> list[bytes]:
    return [a.tobytes() + b.tobytes() for a, b in zip(x, hashed, strict=True)]


def _unpacked(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    width = 8 * len(FEATURES)
    rows = np.frombuffer(b"".join(packed.to_pylist()), np.uint8).reshape(len(packed), width + 4 * HASHED)
    return np.ascontiguousarray(rows[:, :width]).view(np.float64), np.ascontiguousarray(rows[:, width:]).view(np.float16)


#: (features, hashed counts, good) of some rows
Rows = tuple[np.ndarray, np.ndarray, np.ndarray]
#: The sum of a kernel's arrays over all rows, in parts of rows that don't matter.
Total = Callable[[Callable[[Rows], tuple[np.ndarray, ...]]], tuple[np.ndarray, ...]]


def _sums(found: Iterable[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    out: list[np.ndarray] = []
    for arrays in found:
        if not out:
            out = [np.array(a) for a in arrays]
        else:
            for a, b in zip(out, arrays, strict=True):
                a += b
    return tuple(out)


def _over(rows: DataFrame) -> Total:
    """Totals over a table (good, x), a job each, of which a task sends one row."""

    def total(kernel):
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            some = (kernel((*_unpacked(b.column("x")), b.column("good").to_numpy(zero_copy_only=False))) for b in batches if b.num_rows)
            if found := _sums(some):
                yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(pickle.dumps(found), 1)], pa.binary())], ["sums"])

        return _sums(pickle.loads(zlib.decompress(r.sums)) for r in rows.mapInArrow(tidied(part), "sums binary").collect())

    return total


def _moments(rows: Rows) -> tuple[np.ndarray, ...]:
    x, _, good = rows
    return np.array([len(good), good.sum()]), x.sum(0), (x * x).sum(0)


#: Scores are tabulated in steps of 1 / STEPS up to REACH; between steps tables are linear, which is off by 3e-6 at most.
STEPS, REACH = 64, 512
_PLACES = 2 * STEPS * REACH + 1


def _at(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The step below each score, and how far it is to the next one."""
    t = (np.clip(raw.astype(float), -REACH, REACH - 1) + REACH) * STEPS
    low = t.astype(np.int64)
    return low, t - low


def _spread(raw: np.ndarray) -> np.ndarray:
    low, rest = _at(raw)
    return np.bincount(low, 1 - rest, _PLACES) + np.bincount(low + 1, rest, _PLACES)


def _pairs(up: np.ndarray, down: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """For the scores of good and bad texts by steps: the loss of all pairs, and by score what a good and a bad text adds to its slope."""
    used = np.flatnonzero(up + down)
    low, size = int(used[0]), int(used[-1] - used[0]) + 1
    gaps = np.arange(1 - size, size) / STEPS
    room = 1 << (3 * size).bit_length()

    def against(counts: np.ndarray, kernel: np.ndarray) -> np.ndarray:
        return np.fft.irfft(np.fft.rfft(counts[low : low + size], room) * np.fft.rfft(kernel, room), room)[size - 1 : 2 * size - 1]

    pairs = up.sum() * down.sum()
    loss = float(up[low : low + size] @ against(down, np.logaddexp(0, -gaps))) / pairs
    better, worse = np.zeros((2, len(up)))
    better[low : low + size] = against(down, -1 / (1 + np.exp(np.clip(gaps, -700, 700)))) / pairs
    worse[low : low + size] = against(up, 1 / (1 + np.exp(np.clip(-gaps, -700, 700)))) / pairs
    return loss, better, worse


def _learn(total: Total, steps: int = 100, ridge: float = 1e-3) -> Ranker:
    """Logistic regression on all pairs of a good and a bad text, by a quasi-Newton method (Liu and Nocedal 1989) and totals over texts.

    What a text adds to the slope depends on its score and on the scores of all texts of the other label, which
    a table has. Without both labels no pair exists: the score is then 0.75 or 0.25, as the only label
    says (0.75 without any label).
    """
    width = len(FEATURES)
    found = total(_moments)
    n, n_good = map(int, found[0]) if found else (0, 0)
    if not 0 < n_good < n:
        only = -1.0 if n and not n_good else 1.0
        return Ranker(np.zeros(width), np.ones(width), np.zeros(3 * width + 2 * HASHED), -only * float(np.log(3)), 1.0)
    mean = found[1] / n
    scale = np.sqrt(np.maximum(found[2] / n - mean * mean, 0)) + 1e-3
    z = lambda rows: expand((rows[0] - mean) / scale, rows[1])

    def value(w):
        w = w.astype(np.float32)

        def kernel(rows):
            raw = z(rows) @ w
            return _spread(raw[rows[2]]), _spread(raw[~rows[2]])

        spread = total(kernel)
        loss, *tables = _pairs(*spread)
        return loss + ridge / 2 * float(w @ w), tables, spread

    def slope(w, tables):
        v = w.astype(np.float32)

        def kernel(rows):
            x = z(rows)
            low, rest = _at(x @ v)
            own = [(1 - rest) * t[low] + rest * t[low + 1] for t in tables]
            return ((np.where(rows[2], *own).astype(np.float32) @ x).astype(float),)

        return total(kernel)[0] + ridge * w

    w = np.zeros(3 * width + 2 * HASHED)
    loss, tables, spread = value(w)
    g = slope(w, tables)
    enough, past = 1e-5 * float(np.linalg.norm(g)), deque(maxlen=20)
    for _ in range(steps):
        if np.linalg.norm(g) <= enough:
            break
        down, back = -g, []
        for s, y in reversed(past):
            back.append(s @ down / (s @ y))
            down = down - back[-1] * y
        if past:
            down = down * (past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]))
        for (s, y), a in zip(past, reversed(back), strict=True):
            down = down + (a - y @ down / (s @ y)) * s
        by = 1.0
        while (ahead := value(w + by * down))[0] > loss + 1e-4 * by * float(g @ down) and by > 1e-4:
            by /= 2
        if ahead[0] >= loss:
            break
        new = w + by * down
        loss, tables, spread = ahead
        steep = slope(new, tables)
        if (new - w) @ (steep - g) > 0:
            past.append((new - w, steep - g))
        w, g = new, steep
    w = w.astype(np.float32)
    high, added = total(lambda rows: _ranked(z(rows) @ w))
    ends = []
    for k in (n - n_good - 1, n - n_good):  # the scores beside the place that parts as many texts as are bad
        first = int(np.searchsorted(np.cumsum(high), k, "right"))
        rest = total(lambda rows, first=first: (_lower_half(z(rows) @ w, first),))[0]
        ends.append(_of_key(first << 16 | int(np.searchsorted(np.cumsum(rest), k - high[:first].sum(), "right"))))
    deviation = float(np.sqrt(max(0.0, added[1] / n - (added[0] / n) ** 2)))
    return Ranker(mean, scale, w, sum(ends) / 2, deviation / 4 + 1e-6)


def _keys(raw: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of single-precision scores."""
    bits = raw.astype(np.float32).view(np.uint32)
    return np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31))


def _of_key(key: int) -> float:
    bits = key & 0x7FFFFFFF if key >> 31 else ~key & 0xFFFFFFFF
    return float(np.uint32(bits).view(np.float32))


def _ranked(raw: np.ndarray) -> tuple[np.ndarray, ...]:
    """How many scores have each upper half of a key; the sums of scores and of their squares."""
    return np.bincount(_keys(raw) >> 16, minlength=1 << 16), np.array([raw.sum(dtype=float), np.square(raw, dtype=float).sum()])


def _lower_half(raw: np.ndarray, upper: int) -> np.ndarray:
    keys = _keys(raw)
    return np.bincount(keys[keys >> 16 == upper] & 0xFFFF, minlength=1 << 16)


def fit(x: np.ndarray, hashed: np.ndarray, good: np.ndarray) -> Ranker:
    """On rows at hand, 2000 at a time."""
    parts = [slice(k, k + 2000) for k in range(0, max(1, len(x)), 2000)]
    return _learn(lambda kernel: _sums(kernel((x[p], hashed[p], good[p])) for p in parts))


def train(docs: DataFrame, labels: DataFrame, gathered: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Ranker:
    """Fit on all labelled rows whose crc32 of the id, modulo 3, is not 1.

    Their ids go to every task, eight bytes each. Up to ``gathered`` described rows come to the driver; more stay a
    table, over which every total of the fit is a job. Labels that are null are left out; an id with two labels
    counts with each; of rows with the same id one counts.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).cast("long").alias("id"), (F.col(label_col) == 1).alias("good")).where("good IS NOT NULL AND pmod(crc32(CAST(id AS STRING)), 3) <> 1").distinct().toArrow()
    ids, is_good = known.column("id").to_numpy(), known.column("good").to_numpy().astype(bool)
    sent = spark.sparkContext.broadcast([np.sort(ids[is_good == label]) for label in (False, True)])

    def described_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("id").to_numpy()
            found = [_within(own, some) for some in sent.value]
            some = np.flatnonzero(found[0] | found[1])
            packed = _packed(*described(batch.column("text").take(pa.array(some))))
            rows = [(own[i], bool(label), p) for i, p in zip(some, packed, strict=True) for label in (0, 1) if found[label][i]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 3, (pa.int64(), pa.bool_(), pa.binary()), strict=True)], ["id", "good", "x"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND pmod(crc32(CAST(id AS STRING)), 3) <> 1")
    rows = texts.mapInArrow(tidied(described_rows), "id long, good boolean, x binary").groupBy("id", "good").agg(F.min("x").alias("x"))
    rows = stored(rows.drop("id"), "described")
    if rows.count() > gathered:
        return _learn(_over(rows))
    held = rows.toArrow()
    x, hashed = _unpacked(held.column("x").combine_chunks())
    good = held.column("good").to_numpy().astype(bool)
    order = np.lexsort((*x.T, good))  # the fit doesn't depend on how rows came in
    return fit(x[order], hashed[order], good[order])


def _within(some: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which are among the sorted ids."""
    if not len(ids):
        return np.zeros(len(some), bool)
    return ids[np.minimum(np.searchsorted(ids, some), len(ids) - 1)] == some


def score(docs: DataFrame, ranker: Ranker, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, score from 0 to 1 and predicted (1 where score >= 0.5).

    A null or empty text is scored as one without words. Null ids and repeated rows pass through one
    to one; an empty table gives none; other columns are dropped whatever their names.
    """

    def rows(batches):
        for batch in batches:
            s = ranker.score(*described(batch.column(1))).astype(float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["id", "score", "predicted"])

    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return named.mapInArrow(tidied(rows), "id long, score double, predicted int").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, ranker: Ranker, text_col: str = "text") -> DataFrame:
    """The rows whose score is at least 0.5, with all their columns; null texts, repeated rows and empty tables as in ``score``."""

    @F.arrow_udf("boolean")
    def good(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(ranker.score(*described(texts)) >= 0.5)
        tidy()

    return docs.where(good(F.col(text_col)))
