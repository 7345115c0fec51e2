"""A sample whose category shares follow given targets, by the cube method.

Every record of a target category has the inclusion probability quota / available. The balancing variables
are the category indicators. Flight: within each bucket, a step moves the probabilities of records along
a direction in the kernel of the indicators (two records of one category, one up and one down) until one of
them is 0 or 1; the choice of the end keeps the expectation. At most one record per category stays open in a
bucket. The open records merge upward, eight buckets into one, and fly again, up to a single bucket
of at most eight times as many rows as there are categories. Landing resolves what is left there. The residual imbalance
(sampled minus wanted) and the categories that can't be filled are reported.

Defined results: categories are compared after trimming white space of any kind; null, blank and unlisted
categories belong to no target and aren't drawn; a row without id is ignored; an id that occurs more often
counts once, with its smallest category; a category with fewer records than its quota is taken whole. With
no records at all, every quota is the minimum of its category. The draw depends on the seed, the ids and
``per_bucket`` only: records fly in buckets by a hash of the id, whatever partitions they lie in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import dropped, small_side, written

PER_BUCKET = 50_000  # records that fly together

OPEN = 1e-6
MERGE = 8


def trimmed(c) -> F.Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _uniform(seed: int, a: str, b: str) -> float:
    return int.from_bytes(hashlib.blake2b(f"{seed}|{a}|{b}".encode(), digest_size=8).digest(), "big") / 2.0**64


def _flight(seed: int, landing: bool):
    """Updates pi of rows sorted by bucket; with landing nothing stays open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, tuple[str, float]] = {}  # the one open record of each category
        done: list[tuple[int, str, str, float]] = []
        bucket = None

        def table() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.float64()))], names=["bucket", "id", "category", "pi"])
            done.clear()
            return b

        def left() -> None:
            for category, (a, p) in open_.items():
                done.append((bucket, a, category, float(_uniform(seed, a, "landing") < p) if landing else p))
            open_.clear()

        for batch in batches:
            for of, b, category, pb in zip(*(batch.column(c).to_pylist() for c in ("bucket", "id", "category", "pi"))):
                if of != bucket:
                    left()
                    bucket = of
                if not OPEN < pb < 1 - OPEN:
                    done.append((bucket, b, category, float(round(pb))))
                    continue
                if category not in open_:
                    open_[category] = (b, pb)
                    continue
                a, pa_ = open_.pop(category)
                up, down = min(1 - pa_, pb), min(pa_, 1 - pb)
                step = up if _uniform(seed, a, b) * (up + down) < down else -down
                for record, p in ((a, pa_ + step), (b, pb - step)):
                    if OPEN < p < 1 - OPEN:
                        open_[category] = (record, p)
                    else:
                        done.append((bucket, record, category, float(round(p))))
            if len(done) >= 20_000:
                yield table()
        left()
        yield table()

    return run


def sample_to_targets(df: DataFrame, targets: DataFrame, id_col: str = "id", category_col: str = "category", share_col: str = "share_bp", min_col: str = "min_books", one_in: int = 5, seed: int = 7, per_bucket: int = PER_BUCKET) -> tuple[DataFrame, DataFrame]:
    """(sample, report). sample: (id, category). report: (category, available, quota, sampled, residual), a row per target."""
    spark = df.sparkSession
    ids = df.select(F.col(id_col).cast("string").alias("id"), trimmed(F.col(category_col)).alias("category")).where(F.col("id").isNotNull()).groupBy("id").agg(F.min("category").alias("category"))
    base, base_at = written(ids, "sample")
    goals = targets.select(trimmed(F.col(category_col)).alias("category"), F.col(share_col).cast("long").alias("share"), F.col(min_col).cast("long").alias("least"))
    goals = goals.where(F.length("category") > 0).groupBy("category").agg(F.max("share").alias("share"), F.max("least").alias("least"))
    counts = base.groupBy("category").agg(F.count("*").alias("available"))
    n = base.select(F.floor(F.count("*") / one_in).cast("long").alias("n"))  # one row
    quota = F.greatest(F.ceil(F.col("n") * F.coalesce("share", F.lit(0)) / 10000), F.coalesce("least", F.lit(0))).cast("long")
    goals = goals.crossJoin(F.broadcast(n)).join(counts, "category", "left").select("category", F.coalesce("available", F.lit(0)).cast("long").alias("available"), quota.alias("quota"))
    goals, _ = written(goals, "sample")
    pi = F.when(F.col("available") > 0, F.least(F.lit(1.0), F.col("quota") / F.col("available"))).otherwise(0.0)
    records = base.join(small_side(goals.select("category", pi.alias("pi"))), "category").select("id", "category", "pi")
    schema = "bucket long, id string, category string, pi double"
    width = 1
    n_records = base.count()
    while width * per_bucket < n_records:
        width *= MERGE
    is_open = (F.col("pi") > OPEN) & (F.col("pi") < 1 - OPEN)
    still, parts = records.withColumn("bucket", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(width))), []
    while True:
        flying = still.repartition("bucket").sortWithinPartitions("bucket", F.xxhash64(F.lit(seed), "id"), "id").select("bucket", "id", "category", "pi")
        state, _ = written(flying.mapInArrow(_flight(seed, width == 1), schema), "sample")
        parts.append(state.where(~is_open))
        if width == 1:
            break
        width //= MERGE
        still = state.where(is_open).withColumn("bucket", F.pmod(F.col("bucket"), F.lit(width)))
    dropped(spark, base_at)
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    sample = whole.where(F.col("pi") > 0.5).select("id", "category")
    drawn = sample.groupBy("category").agg(F.count("*").alias("drawn"))
    sampled = F.coalesce("drawn", F.lit(0)).cast("long")
    report = goals.join(drawn, "category", "left").select("category", "available", "quota", sampled.alias("sampled"), (sampled - F.col("quota")).alias("residual"))
    return sample, report
