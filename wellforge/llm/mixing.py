"""A mix of sources by target weights: hash-random order, range-partitioned prefix sums of tokens, cuts at exact budgets."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wellforge.session import stored

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed pattern: how the public byte-level vocabulary divides text before merging.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens) of every document, by the byte-level vocabulary in the file `tokenizer`.

    Null and empty texts have 0 tokens. The file needs to be on the driver only: Spark sends it to every executor.
    """
    documents.sparkSession.sparkContext.addFile(tokenizer)
    name = tokenizer.rsplit("/", 1)[-1]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("file", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            n = [len(encoding.encode_ordinary(t)) if t else 0 for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "n_tokens": n})

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text").mapInPandas(count, "doc_id long, source string, n_tokens long")


MOST_SENT = 100_000  # rows of a table with one row a source that are sent to all tasks; beyond, it is joined by shuffle


def _sent(small: DataFrame, sources: int) -> DataFrame:
    return F.broadcast(small) if sources <= MOST_SENT else small


@dataclass(frozen=True)
class Budget:
    """What a source has and is to give, in tokens."""

    source: str
    share: float
    available: int
    repeats: int
    tokens: int


def plan_budgets(sizes: list[tuple[str, int]], weights: list[tuple[str | None, float | None, int | None]], total: int | None = None) -> list[Budget]:
    """Budgets of the sources: shares of `total` tokens, or of the largest total at which no source needs more than its repeats.

    A source without documents, weight or repeats gives nothing; the shares of the others are in proportion to their weights and
    add up to 1. If `total` asks for more than a source may give, it gives all it may, and the share reached is lower.
    """
    have = dict(sizes)
    usable = {s: (float(w), int(r)) for s, w, r in weights if s is not None and w and w > 0 and r and r > 0 and have.get(s, 0) > 0}
    weight = sum(w for w, _ in usable.values())
    if not usable:
        return []
    if total is None:
        total = int(min(have[s] * r * weight / w for s, (w, r) in usable.items()))
    return [Budget(s, w / weight, have[s], r, min(int(total * w / weight), have[s] * r)) for s, (w, r) in sorted(usable.items())]


def mix(counted: DataFrame, weights: DataFrame, total: int | None = None, seed: int = 11, bucket_rows: int = 50_000) -> DataFrame:
    """(doc_id, source, use, n_tokens, upto): one row for each use of a record in the mix; `use` counts from 1.

    A source's records are put in the order of a hash of the seed and their id. A budget of e whole sizes of the source and a rest
    is met by every record e times and, in that order, by the records whose running sum of tokens stays within the rest: no record
    is used more than one time oftener than another, nor more than max_repeats times, and what is missing to the budget is less than
    one record. `upto` is the running sum at the end of the record in its source's order.

    Hash keys are even, so equal ranges of them are buckets of about `bucket_rows` rows; a source of any size is spread over as many,
    sums of buckets precede the sums inside. Repeated doc_ids and texts are records of their own (ordered by tokens). Records without
    a source, or of a source without weight, are not used; those without tokens are used with the rest they lie in.
    """
    spark = counted.sparkSession
    rows = counted.filter(F.col("source").isNotNull())
    wanted = [(r["source"], r["target_weight"], r["max_repeats"]) for r in weights.select("source", "target_weight", "max_repeats").distinct().collect()]
    # one row a listed source, on both sides
    sizes = rows.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).join(_sent(weights.select("source").distinct(), len(wanted)), "source").collect()
    plan = plan_budgets([(r["source"], int(r["t"])) for r in sizes], wanted, total)
    count = {r["source"]: r["n"] for r in sizes}
    table = spark.createDataFrame(
        [(b.source, max(1, -(-count[b.source] // bucket_rows)), min(b.tokens // b.available, b.repeats), b.tokens % b.available if b.tokens // b.available < b.repeats else 0) for b in plan],
        "source string, buckets long, epochs long, rest long",
    )
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) / F.lit(float(1 << 53))).alias("u")
    keyed = rows.join(_sent(table, len(plan)), "source").select("doc_id", "source", "n_tokens", "epochs", "rest", unit, "buckets").withColumn("bucket", F.floor(F.col("u") * F.col("buckets")))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("s")).select("source", "bucket", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "bucket").orderBy("u", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = keyed.withColumn("run", F.sum("n_tokens").over(inside)).join(offsets, ["source", "bucket"]).withColumn("upto", F.col("run") + F.col("offset"))
    uses = F.col("epochs") + F.when(F.col("upto") <= F.col("rest"), 1).otherwise(0)
    return running.withColumn("uses", uses).filter("uses > 0").select("doc_id", "source", F.explode(F.sequence(F.lit(1).cast("long"), F.col("uses"))).alias("use"), "n_tokens", "upto")


def shares(mixed: DataFrame, weights: DataFrame) -> DataFrame:
    """(source, target_weight, records, uses_most, tokens, share) for every listed source: what the mix has reached."""
    # at most one row a listed source: left to the statistics of the plan
    got = mixed.groupBy("source").agg(F.countDistinct("doc_id").alias("records"), F.max("use").alias("uses_most"), F.sum("n_tokens").alias("tokens"))
    everything = got.agg(F.sum("tokens").alias("everything"))
    out = weights.select("source", "target_weight").distinct().join(got, "source", "left").crossJoin(F.broadcast(everything))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("records", "uses_most", "tokens")}
    return out.withColumns(zero).select("source", "target_weight", "records", "uses_most", "tokens", F.coalesce(F.col("tokens") / F.col("everything"), F.lit(0.0)).alias("share"))


def counted_once(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Token counts written to the shared folder, as several passes over them follow."""
    return stored(token_counts(documents, tokenizer), "token_counts")
