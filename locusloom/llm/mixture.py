"""A training mixture in which each source holds its share of the tokens.

Every source has a weight schedule over training time from 0 to 1, piecewise
linear between knots. Its integral up to t, scaled to the source's demand, is the
number of its tokens the model has seen by then; inverting it gives each document
the time at which its tokens fall due. Sorting by that time interleaves the
sources as the schedules ask. Only the shape of a schedule matters here, its
level follows from the target share.

Within a source documents come in hashed order, anew for each repetition. The
running token count over a source isn't taken in one task: documents are cut into
buckets of the hash axis, which hold about ``bucket_rows`` rows each whatever
their source, so the count needs sums per bucket and a running count inside.

Defined cases: spellings that differ in case, blanks, hyphens or underscores are
one source; sources without a target, and NULL sources, are not used; targets
without documents report a share of 0, and their part falls to the others in
proportion; NULL or negative shares count as 0, several targets of one source add
up and keep the smaller cap; NULL, empty and other texts without tokens are never
used; repeated texts count as documents of their own; whole texts are counted;
empty tables give an empty mixture; other columns are ignored.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

Knots = list[tuple[float, float]]
FLAT: Knots = [(0.0, 1.0), (1.0, 1.0)]
#: How the ranks file's tokenizer splits text before merging (fixed value).
SPLIT_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A mixture is a plan people write; this bounds what the driver holds of it.
MAX_SOURCES = 10_000


def source_key(col: Column | str) -> Column:
    """The comparable form of a source name."""
    return F.regexp_replace(F.lower(F.col(col) if isinstance(col, str) else col), r"[\s_-]+", "")


@lru_cache(maxsize=2)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and n_tokens, the tokens of the whole text."""
    docs = documents.select(*keep, "text")
    schema = documents.select(*keep).schema.add("n_tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer)
        for b in batches:
            # the encoder's own batch call hands each text to a thread, which takes twice the time
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], [*keep, "n_tokens"])

    return docs.mapInArrow(run, schema)


@dataclass(frozen=True)
class Share:
    """What is planned for one source."""

    source: str
    key: str
    target: float
    max_repeats: int
    available: int
    demand: float

    @property
    def passes(self) -> int:
        return min(self.max_repeats, math.ceil(self.demand / self.available)) if self.demand else 0


def plan_shares(targets: list[tuple[str, float, int]], available: dict[str, int], keys: dict[str, str], total: float | None) -> list[Share]:
    """Token demand of each source.

    Without a total the mixture is the largest in which every available source
    holds its share. With one, sources that can't give their part give all they
    may and the others take over the rest, in proportion, as far as they can.
    """
    live = {s: (w, m * available[keys[s]]) for s, w, m in targets if w > 0 and m > 0 and available.get(keys[s], 0) > 0}
    demand: dict[str, float] = {}
    weight = sum(w for w, _ in live.values())
    if live and total is None:
        total = min(cap * weight / w for w, cap in live.values())
    left = total or 0.0
    while live and left > 0:
        weight = sum(w for w, _ in live.values())
        full = [s for s, (w, cap) in live.items() if left * w / weight > cap * (1 + 1e-12)]
        if not full:
            demand |= {s: min(cap, left * w / weight) for s, (w, cap) in live.items()}
            break
        for s in full:
            demand[s] = live.pop(s)[1]
            left -= demand[s]
    return [Share(s, keys[s], w, m, available.get(keys[s], 0), float(demand.get(s, 0.0))) for s, w, m in targets]


def _shape(knots: Knots) -> tuple[list[float], list[float], list[float]]:
    """Times, weights and the integral up to each knot, scaled to end at 1."""
    t, w = [float(a) for a, _ in knots], [float(b) for _, b in knots]
    if len(t) < 2 or t[0] != 0 or t[-1] != 1 or any(a >= b for a, b in zip(t, t[1:])) or min(w) < 0 or max(w) <= 0:
        raise ValueError("a schedule needs rising times from 0 to 1 and weights of 0 or more")
    area = [0.0]
    for k in range(1, len(t)):
        area.append(area[-1] + (t[k] - t[k - 1]) * (w[k] + w[k - 1]) / 2)
    return t, [x / area[-1] for x in w], [x / area[-1] for x in area]


def _due(x: Column) -> Column:
    """The time at which the share x of a source's tokens has been seen.

    Expects the columns kt, kw, ka of the source's knots.
    """
    k = F.greatest(F.lit(1), F.least(F.size("kt") - 1, F.size(F.filter("ka", lambda a: a <= x))))
    at = lambda c, i: F.element_at(c, i)
    t, w, y = at("kt", k), at("kw", k), x - at("ka", k)
    slope = (at("kw", k + 1) - w) / (at("kt", k + 1) - t)
    root = w + F.sqrt(F.greatest(w * w + 2 * slope * y, F.lit(0.0)))
    return F.least(at("kt", k + 1), t + F.when(root > 0, 2 * y / root).otherwise(0.0))


class Mixture:
    """The mixture of one set of targets; ``rows`` and ``report`` are its results."""

    def __init__(
        self, documents: DataFrame, targets: DataFrame, tokenizer: str, total_tokens: float | None = None,
        schedules: dict[str, Knots] | None = None, seed: int = 0, bucket_rows: int = 100_000,
    ):
        spark = documents.sparkSession
        given = (
            targets.filter(F.col("source").isNotNull()).withColumn("key", source_key("source"))
            .groupBy("key").agg(F.min("source").alias("source"), F.sum(F.greatest("target_share", F.lit(0.0))).alias("w"), F.min("max_repeats").alias("m"))
            .orderBy("key").limit(MAX_SOURCES + 1).collect()
        )
        if len(given) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources in the targets")
        keys = {r.source: r.key for r in given}
        weights = [(r.source, float(r.w or 0), int(r.m or 0)) for r in given]
        wanted = spark.createDataFrame([(k,) for k in keys.values()], "key string")
        docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), source_key("source").alias("key"), "text")
        used = docs.join(F.broadcast(wanted), "key", "left_semi")  # at most MAX_SOURCES rows
        used = used.filter("doc_id is not null and text is not null and text != ''")
        counted = cut(token_counts(used, tokenizer, ["doc_id", "key"]).filter("n_tokens > 0"))
        sums = {r.key: (r.t, r.n) for r in counted.groupBy("key").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()}
        self.shares = plan_shares(weights, {k: t for k, (t, _) in sums.items()}, keys, total_tokens)
        self.total = sum(s.demand for s in self.shares)
        shapes = {source: _shape(k) for source, k in (schedules or {}).items()}
        by_key = {_python_key(source): shape for source, shape in shapes.items()}
        flat = _shape(FLAT)
        plan = [(s.source, s.key, s.demand, s.available, s.passes, *by_key.get(s.key, flat)) for s in self.shares if s.demand > 0]
        self.plan = spark.createDataFrame(plan, "source string, key string, demand double, available long, passes int, kt array<double>, kw array<double>, ka array<double>")
        bits = max(0, math.ceil(math.log2(max(1, sum(n for _, n in sums.values()) / bucket_rows))))
        self.rows = self._assign(counted, seed, bits)
        self._targets = weights

    def _assign(self, counted: DataFrame, seed: int, bits: int) -> DataFrame:
        use = (
            counted.join(F.broadcast(self.plan), "key")  # at most MAX_SOURCES rows
            .withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
            .withColumn("u", F.xxhash64("doc_id", "pass", F.lit(seed)))
            .withColumn("bucket", F.shiftright("u", 64 - bits) if bits else F.lit(0).cast("long"))
        )
        part = ["key", "pass", "bucket"]
        sums = use.groupBy(*part).agg(F.sum("n_tokens").alias("t"))
        before = Window.partitionBy("key", "pass").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sums.select(*part, F.coalesce(F.sum("t").over(before), F.lit(0)).alias("offset"))
        inside = Window.partitionBy(*part).orderBy("u", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
        run = use.withColumn("run", F.sum("n_tokens").over(inside)).join(offsets, part)
        middle = F.col("pass") * F.col("available") + F.col("offset") + F.col("run") - F.col("n_tokens") / 2
        rows = run.withColumn("x", middle / F.col("demand")).filter("x < 1")
        rows = rows.select("doc_id", "source", (F.col("pass") + 1).alias("use_no"), "n_tokens", _due(F.col("x")).alias("position"))
        order = ["position", "source", "doc_id", "use_no"]
        return rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def report(self) -> DataFrame:
        """Per source: target, cap, tokens at hand, tokens used, share reached, most uses of a document."""
        spark = self.rows.sparkSession
        planned = spark.createDataFrame([(s.source, s.target, s.max_repeats, s.available, s.demand) for s in self.shares], "source string, target_share double, max_repeats int, available_tokens long, planned_tokens double")
        used = self.rows.groupBy("source").agg(F.sum("n_tokens").alias("used_tokens"), F.count("*").alias("n_uses"), F.max("use_no").alias("most_uses"))
        all_used = used.agg(F.sum("used_tokens").alias("all_tokens"))
        out = planned.join(used, "source", "left").crossJoin(F.broadcast(all_used))  # one row
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        share = F.when(F.col("all_tokens") > 0, zero("used_tokens") / F.col("all_tokens")).otherwise(0.0)
        return out.select("source", "target_share", "max_repeats", "available_tokens", "planned_tokens", zero("used_tokens").alias("used_tokens"), share.alias("actual_share"), zero("n_uses").alias("n_uses"), zero("most_uses").alias("most_uses"))


def _python_key(source: str) -> str:
    return "".join(c for c in source.lower() if not c.isspace() and c not in "_-")
