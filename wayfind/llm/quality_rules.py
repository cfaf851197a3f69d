"""Quality rules with risk-controlled thresholds.

Base rule: a document fails with fewer than 10 words, or if more than 20 of 100 words lie in 5-word windows that the text
repeats.  Above it stands a learned badness score: the sum of log odds of binned symptoms (symbols, capitals, exclamation
marks, repeated lines, repeated windows, word length), counted over one half of the labelled documents.

The cutoff of the score is chosen per stratum (language) on the other half, the holdout.  Cutoffs are tested from the
most lenient to stricter ones; a cutoff holds if the exact (Clopper-Pearson) upper bound of the share of good documents
above it is at most ``limit``, and testing stops at the first that does not.  That fixed sequence needs no correction within
a stratum; across strata the error level is divided by their number (Bonferroni).  So with probability ``1 - level`` no
stratum loses more than ``limit`` of its good documents.  A stratum with too few labels rejects nothing, and no cutoff goes
below ``EVIDENCE``: what is not clearly bad stays, even where the bound would allow more.

Null text has no words and fails the base rule; null languages form a stratum.  Labels without a quality are left out, and
where an id has several, the document counts as good only if all say so.  Rows that repeat an id are judged one by one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfind.llm.common import free_name, row_of, written
from wayfind.llm.texts import MIX, octets, scramble, slices, window_codes, window_owner, word_codes

MIN_WORDS, WINDOW, MAX_REPEAT = 10, 5, 20
LIMIT, LEVEL = 0.02, 0.05
EVIDENCE = 2.0  # least log odds for which a document may be rejected at all
BINS = 16
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMPTOMS = ("symbols", "capitals", "shouts", "dup_lines", "repeats", "long_words")
SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_IS_CHAR = np.ones(256, dtype=bool)  # first bytes of code points outside white space
_IS_CHAR[0x80:0xC0] = False
_IS_CHAR[[32, 9, 10, 11, 12, 13]] = False


def _repeated_words(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Words of every text that lie in a window found twice or more in it."""
    owner, inside = window_owner(counts, WINDOW)
    at = np.flatnonzero(inside)
    keys = scramble(window_codes(codes, WINDOW)[at] + scramble(owner[at].astype(np.uint64) * MIX[0] + MIX[2]))
    order = np.argsort(keys)
    same = np.zeros(len(keys) + 1, dtype=bool)
    same[1:-1] = keys[order][1:] == keys[order][:-1]
    hit = at[order[same[1:] | same[:-1]]]
    edge = np.zeros(len(codes) + 1, dtype=np.int32)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + WINDOW, -1)
    covered = np.cumsum(edge)[:-1] > 0
    return np.bincount(np.repeat(np.arange(len(counts)), counts)[covered], minlength=len(counts))


def _lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def text_stats(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The base counts and the binned symptoms of every text."""
    codes, counts = word_codes(texts)
    table = np.zeros((len(texts), 256), dtype=np.int64)
    for i, text in enumerate(texts):
        table[i] = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = table[:, _IS_CHAR].sum(1)
    out = {
        "n_words": counts, "word_chars": chars, "n_symbols": table[:, _IS_SYMBOL].sum(1),
        "n_dup_lines": np.array([_lines(t) for t in texts], dtype=np.int64), "n_repeat_words": _repeated_words(codes, counts),
    }
    words, letters = np.maximum(counts, 1), np.maximum(chars, 1)
    shares = {
        "symbols": out["n_symbols"] / letters, "capitals": table[:, 65:91].sum(1) / letters, "shouts": table[:, 33] / words,
        "dup_lines": out["n_dup_lines"] / np.maximum(table[:, 10] + 1, 1), "repeats": out["n_repeat_words"] / words,
        "long_words": np.minimum(1, chars / words / 40),
    }
    return out | {k: np.floor((BINS - 1) * np.sqrt(np.minimum(v, 1))).astype(np.int64) for k, v in shares.items()}


def with_stats(docs: DataFrame) -> DataFrame:
    """``docs`` and one struct column ``_stats`` with the base counts and symptom bins (row by row, no shuffle)."""
    name = free_name(docs, "_stats")
    fields = T.StructType([T.StructField(k, T.LongType()) for k in (*STATS, *SYMPTOMS)])
    schema = T.StructType([*docs.schema.fields, T.StructField(name, fields)])
    names = docs.columns

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                stats = text_stats(octets(part.column(names.index("text"))))
                own = pa.StructArray.from_arrays([pa.array(stats[k], pa.int64()) for k in (*STATS, *SYMPTOMS)], names=[*STATS, *SYMPTOMS])
                yield pa.RecordBatch.from_arrays([*part.columns, own], names=[*names, name])

    return docs.mapInArrow(measure, schema)


def base_failed(stats: str = "_stats") -> Column:
    n = F.col(f"{stats}.n_words")
    return (n < MIN_WORDS) | (F.col(f"{stats}.n_repeat_words") * 100 > n * MAX_REPEAT)


def upper_bound(k: int, n: int, level: float) -> float:
    """Exact upper bound of a share of which ``k`` of ``n`` draws were seen, at error ``level``."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k + 1)]
    low, high = k / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        terms = [c + i * math.log(p) + (n - i) * math.log1p(-p) for i, c in enumerate(logs)] if p < 1 else [-math.inf]
        top = max(terms)
        below = top + math.log(sum(math.exp(t - top) for t in terms)) if top > -math.inf else top
        low, high = (p, high) if below > math.log(level) else (low, p)
    return high


def choose_cutoff(scores: list[float], counts: list[int], limit: float, level: float) -> float | None:
    """The lowest score that may be rejected (``score >= cutoff``), or None."""
    total, above, best = sum(counts), 0, None
    most = next((k for k in range(total + 1) if upper_bound(k, total, level) > limit), total + 1) - 1 if total else -1
    for score, n in sorted(zip(scores, counts, strict=True), reverse=True):
        above += n
        if above > most:
            break
        best = score
    return best


def train_score(labelled: DataFrame) -> list[tuple[str, int, float]]:
    """(symptom, bin, log odds) from the training half; at most symptoms x bins rows."""
    train = labelled.where("not _holdout")
    counts = train.select("good", F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.col(f"_stats.{s}").alias("b")) for s in SYMPTOMS])).alias("x"))
    rows = counts.groupBy("x.s", "x.b").agg(F.sum(F.col("good").cast("int")), F.sum((~F.col("good")).cast("int"))).collect()
    good = max(1, sum(r[2] for r in rows) // len(SYMPTOMS))
    bad = max(1, sum(r[3] for r in rows) // len(SYMPTOMS))
    return [(s, b, math.log((y + 0.5) / (bad + 0.5)) - math.log((x + 0.5) / (good + 0.5))) for s, b, x, y in rows]


def score(table: list[tuple[str, int, float]], stats: str = "_stats") -> Column:
    """Sum of the log odds, in steps of a quarter; bins never seen in training count nothing."""
    total = F.lit(0.0)
    for s in SYMPTOMS:
        pairs = [x for _, b, odds in sorted(t for t in table if t[0] == s) for x in (F.lit(b).cast("long"), F.lit(round(odds, 6)))]
        if pairs:
            total = total + F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(f"{stats}.{s}")), F.lit(0.0))
    return F.floor(total * 4) / 4


def calibrate(stats: DataFrame, labels: DataFrame, limit: float = LIMIT, level: float = LEVEL) -> tuple[list[tuple[str, int, float]], DataFrame]:
    """The score table and (lang, cutoff) from narrow rows (doc_id, lang, _stats) and labels (doc_id, quality)."""
    good = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    rows = stats.select("doc_id", "lang", "_stats").join(good, "doc_id").where(~base_failed())
    half = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(2)) == 1
    labelled = written(rows.withColumn("_holdout", half), "quality-labels")
    table = train_score(labelled)
    held = labelled.where("_holdout").groupBy("lang", score(table).alias("score")).agg(F.sum(F.col("good").cast("long")).alias("n"))
    held = written(held, "quality-holdout")
    strata = max(1, held.select("lang").distinct().count())

    def choose(part: pd.DataFrame) -> pd.DataFrame:  # one row per score step of a stratum
        cutoff = choose_cutoff(part["score"].tolist(), [int(n) for n in part["n"]], limit, level / strata)
        return pd.DataFrame({"lang": part["lang"].iloc[:1].tolist(), "cutoff": pd.array([cutoff], "Float64")})

    cutoffs = held.groupBy("lang").applyInPandas(choose, "lang string, cutoff double")
    return table, written(cutoffs, "quality-cutoffs")


def verdicts(measured: DataFrame, table: list[tuple[str, int, float]], cutoffs: DataFrame) -> DataFrame:
    """``measured`` with ``_failed`` and ``_kept``; a stratum without cutoff keeps all that pass the base rule."""
    rows = measured.alias("m").join(cutoffs.alias("c"), F.col("m.lang").eqNullSafe(F.col("c.lang")), "left")
    failed = base_failed("m._stats")
    bad = F.col("c.cutoff").isNotNull() & (score(table, "m._stats") >= F.greatest(F.col("c.cutoff"), F.lit(EVIDENCE)))
    kept = ~failed & ~F.coalesce(bad, F.lit(False))
    return rows.select("m.*", failed.alias("_failed"), kept.alias("_kept"))


def judge_documents(docs: DataFrame, labels: DataFrame, limit: float = LIMIT, level: float = LEVEL) -> DataFrame:
    """Per document: doc_id, the base counts, base_failed, kept."""
    stats = written(with_stats(docs.select("doc_id", "lang", "text")).drop("text"), "quality-stats")
    judged = verdicts(stats, *calibrate(stats, labels, limit, level))
    return judged.select("doc_id", *[F.col(f"_stats.{s}").alias(s) for s in STATS], F.col("_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def keep_documents(docs: DataFrame, labels: DataFrame, limit: float = LIMIT, level: float = LEVEL) -> DataFrame:
    """The documents that the rules keep, with their columns."""
    rows = docs.select("doc_id", "lang", "text", row_of(docs).alias("_row"))
    table, cutoffs = calibrate(with_stats(docs.select("doc_id", "lang", "text")).drop("text"), labels, limit, level)
    return verdicts(with_stats(rows), table, cutoffs).where("_kept").select("_row.*")
