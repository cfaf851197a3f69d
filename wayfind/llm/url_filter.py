"""URL filter over a sorted array of 64-bit digests.

A rule is a host and a path prefix, written ``host/path``.  All rules are stored as one file in the shared folder: the
ascending xxhash64 digests of the keys, the offsets of the key strings, the strings, and the verdicts.  Spark ships the
file to every node, tasks map it into memory (one page cache per node) and probe it with a vectorised binary search.  A
digest that is found counts only if the stored string equals the probe, so colliding digests never decide.

The keys that a URL may meet are its host and all parent domains, each with the prefixes of its path that have the length
of some rule path.  The longest rule that fits wins, of equally long ones that with
the longer host, then the greater text; where none fits, the verdict is ``default``.

Lists above ``max_mapped_bytes`` are never shipped: those are joined on digest and string instead, with the same result.

Null URLs and URLs without ``://`` have an empty host and path, which no rule fits.  Repeated rules count once (the one
with the smallest verdict, so ``allow``); an empty list lets everything pass with the default.  Further columns of
``pages`` are kept; own columns replace columns of the same name.
"""

from __future__ import annotations

import mmap
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfind.llm.common import shared_folder

#: The rules pass through the driver once; longer lists than this are joined.
MAX_MAPPED_BYTES = 32 << 20
SEED = 42  # of Spark's xxhash64, so both sides may compute digests
VERDICTS = ("allow", "block")


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, with A-Z lower-cased."""
    rest = F.substring_index(url, "://", 1)
    after = F.substring(url, F.length(rest) + 4, 2147483647)
    host = F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(url.contains("://"), F.translate(host, upper, lower)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    rest = F.substring_index(url, "://", 1)
    after = F.substring(url, F.length(rest) + 4, 2147483647)
    return F.when(url.contains("://"), F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def digest(keys: list[str], bits: int = 64) -> np.ndarray:
    """Signed xxhash64 of the UTF-8 strings; ``bits`` below 64 only serves tests that need collisions."""
    values = np.fromiter((xxhash.xxh64_intdigest(k.encode(), SEED) for k in keys), dtype=np.uint64, count=len(keys))
    return (values >> np.uint64(64 - bits) if bits < 64 else values).view(np.int64)


def pack(rules: list[tuple[str, str]], bits: int = 64) -> bytes:
    """The file: count, path lengths, digests, string offsets, verdict codes, strings."""
    chosen: dict[str, str] = {}
    for key, verdict in sorted(rules):
        chosen.setdefault(key, verdict)
    keys = list(chosen)
    order = np.argsort(digest(keys, bits), kind="stable")
    keys = [keys[i] for i in order]
    texts = [k.encode() for k in keys]
    offsets = np.zeros(len(keys) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    lengths = np.unique(np.array([len(k) - k.index("/") for k in keys], dtype=np.int64))
    head = np.array([len(keys), len(lengths), bits], dtype=np.int64)
    codes = np.array([VERDICTS.index(chosen[k]) for k in keys], dtype=np.uint8)
    return b"".join((head.tobytes(), lengths.tobytes(), digest(keys, bits).tobytes(), offsets.tobytes(), codes.tobytes(), *texts))


class DigestArray:
    """The mapped file; ``find`` gives the verdict code of every key, or -1."""

    def __init__(self, buffer) -> None:
        n, m, self.bits = (int(x) for x in np.frombuffer(buffer, np.int64, 3))
        self.lengths = np.frombuffer(buffer, np.int64, m, 24)
        at = 24 + 8 * m
        self.digests = np.frombuffer(buffer, np.int64, n, at)
        self.offsets = np.frombuffer(buffer, np.int64, n + 1, at + 8 * n)
        self.codes = np.frombuffer(buffer, np.uint8, n, at + 16 * n + 8)
        self.base = at + 17 * n + 8
        self.buffer = buffer

    @classmethod
    def open(cls, path: str) -> DigestArray:
        with open(path, "rb") as file:
            return cls(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))

    def find(self, keys: list[str]) -> np.ndarray:
        found = np.full(len(keys), -1, dtype=np.int64)
        wanted = digest(keys, self.bits)
        at = np.searchsorted(self.digests, wanted)
        open_ = np.flatnonzero(at < len(self.digests))
        while len(open_):  # equal digests lie side by side: step on until the string is met
            open_ = open_[self.digests[at[open_]] == wanted[open_]]
            for i in open_:
                j = at[i]
                if self.buffer[self.base + self.offsets[j] : self.base + self.offsets[j + 1]] == keys[i].encode():
                    found[i] = self.codes[j]
            open_ = open_[found[open_] < 0]
            at[open_] += 1
            open_ = open_[at[open_] < len(self.digests)]
        return found


def candidate_keys(host: str, path: str, lengths: np.ndarray) -> list[str]:
    """All keys a rule for this host and path may have."""
    if not host:
        return []
    labels = host.split(".")
    prefixes = [path[: int(n)] for n in lengths if n <= len(path)]
    return [".".join(labels[i:]) + p for i in range(len(labels)) for p in prefixes]


def _precedence(key: str) -> tuple[int, int, str]:
    """The longest rule wins; of equally long ones that with the longer host, then the greater text."""
    return len(key), key.index("/"), key


def judge(hosts: list[str], paths: list[str], array: DigestArray) -> tuple[list[str | None], list[str | None]]:
    """The winning rule and its verdict for every URL: the longest key found."""
    distinct: dict[tuple[str, str], int] = {}
    rows = [distinct.setdefault(hp, len(distinct)) for hp in zip(hosts, paths, strict=True)]
    keys: list[str] = []
    owner: list[int] = []
    for (host, path), i in distinct.items():
        mine = candidate_keys(host, path, array.lengths)
        keys += mine
        owner += [i] * len(mine)
    rule: list[str | None] = [None] * len(distinct)
    verdict: list[str | None] = [None] * len(distinct)
    if keys:
        codes = array.find(keys)
        for k in np.flatnonzero(codes >= 0):
            i = owner[k]
            if rule[i] is None or _precedence(keys[k]) > _precedence(rule[i]):
                rule[i], verdict[i] = keys[k], VERDICTS[codes[k]]
    return [rule[i] for i in rows], [verdict[i] for i in rows]


def ship(spark: SparkSession, content: bytes) -> str:
    """Writes the file to the shared folder and has Spark fetch it to every node; returns its name."""
    name = f"digest-array-{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()
    spark.sparkContext.addFile(path)
    return name


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", max_mapped_bytes: int = MAX_MAPPED_BYTES, bits: int = 64) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``; ``rules`` has ``rule`` (host/path) and ``verdict``."""
    spark = pages.sparkSession
    rules = rules.where(F.col("rule").contains("/") & F.col("verdict").isin(*VERDICTS)).select("rule", "verdict")
    parts = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    stored = rules.agg(F.coalesce(F.sum(F.octet_length("rule") + 17), F.lit(0))).first()[0]
    if stored > max_mapped_bytes:
        return _joined(parts, rules, default)
    name = ship(spark, pack([tuple(r) for r in rules.collect()], bits))  # at most max_mapped_bytes
    schema = T.StructType([f for f in parts.schema if f.name.lower() not in ("rule", "verdict")])
    schema.add("rule", "string").add("verdict", "string")
    kept = [f.name for f in schema][:-2]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray.open(SparkFiles.get(name))
        for batch in batches:
            rule, verdict = judge(batch.column("host").to_pylist(), batch.column("path").to_pylist(), array)
            own = [pa.array(rule, pa.string()), pa.array([default if v is None else v for v in verdict], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=[*kept, "rule", "verdict"])

    return parts.select(*kept).mapInArrow(probe, schema)


def _joined(parts: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same by an equi join on digest and string, for lists that are too large to ship."""
    rules = rules.groupBy("rule").agg(F.min("verdict").alias("verdict")).withColumn("code", F.xxhash64("rule"))
    cut = F.length("rule") - F.length(F.substring_index("rule", "/", 1))
    lengths = [r[0] for r in rules.select(cut.alias("n")).distinct().collect()]  # bounded by the longest URL path
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]), lambda p: p.isNotNull())
    urls = parts.select("host", "path").where("host <> ''").distinct()
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    probes = urls.withColumn("rule", F.explode(keys)).withColumn("code", F.xxhash64("rule"))
    precedence = F.struct(F.length("rule"), F.length(F.substring_index("rule", "/", 1)), F.col("rule"))
    best = probes.join(rules, ["code", "rule"]).groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), precedence).alias("_w"))
    kept = parts.drop("rule", "verdict")
    joined = kept.alias("k").join(best.alias("b"), ["host", "path"], "left")
    own = [F.col(f"k.`{c}`") for c in kept.columns]
    return joined.select(*own, F.col("b._w.rule").alias("rule"), F.coalesce("b._w.verdict", F.lit(default)).alias("verdict"))
