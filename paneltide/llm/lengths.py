"""Exact histogram of encoded lengths, and what follows from it for every context limit.

Texts are encoded where they are; only lengths are shuffled, combined first. The histogram
has a row per distinct length. Sums over all shorter lengths are taken in two levels, inside
ranges of ``RANGE`` lengths and over the ranges, so no task holds more than one range.

Defined cases: a null or empty text has length zero; the result of an empty table is empty;
rows count as often as they occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneltide.llm.batches import append_columns
from paneltide.llm.byte_bpe import Vocabulary
from paneltide.session import materialized

#: Lengths that one window partition holds at most.
RANGE = 4096


def with_lengths(docs: DataFrame, vocabulary: Vocabulary, *, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of bounded size, see Vocabulary

    def compute():
        encode = shared.value.encoding().encode_ordinary
        return lambda texts: {name: [len(encode(t)) if t else 0 for t in texts]}

    return append_columns(docs, text, [T.StructField(name, T.LongType())], compute)


def histogram(lengths: DataFrame, name: str = "n_tokens") -> DataFrame:
    """(length, n_docs) over all rows."""
    return lengths.groupBy(F.col(f"`{name}`").alias("length")).agg(F.count("*").alias("n_docs"))


def length_table(counts: DataFrame) -> DataFrame:
    """One row per length L, taken as a context limit, from a histogram.

    n_docs of that length; docs_upto and tokens_upto with at most L tokens; docs_over with
    more; tokens_truncated, the total when every text is cut at L; tokens_lost by that;
    share_upto, the quantile that L is.
    """
    counts = materialized(counts)  # read twice; a row per distinct length
    ranged = counts.withColumn("_range", F.floor(F.col("length") / RANGE))
    sums = ranged.groupBy("_range").agg(
        F.sum("n_docs").alias("_docs"), F.sum(F.col("n_docs") * F.col("length")).alias("_tokens")
    )
    order = Window.orderBy("_range")  # a row per range of lengths
    everything = Window.partitionBy()
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    sums = materialized(
        sums.select(
            "_range",
            F.coalesce(F.sum("_docs").over(earlier), F.lit(0)).alias("_docs_before"),
            F.coalesce(F.sum("_tokens").over(earlier), F.lit(0)).alias("_tokens_before"),
            F.sum("_docs").over(everything).alias("_all_docs"),
            F.sum("_tokens").over(everything).alias("_all_tokens"),
        )
    )
    inside = Window.partitionBy("_range").orderBy("length")
    out = ranged.join(sums, "_range")
    out = out.withColumn("docs_upto", F.sum("n_docs").over(inside) + F.col("_docs_before"))
    out = out.withColumn("tokens_upto", F.sum(F.col("n_docs") * F.col("length")).over(inside) + F.col("_tokens_before"))
    over = F.col("_all_docs") - F.col("docs_upto")
    truncated = F.col("tokens_upto") + over * F.col("length")
    return out.select(
        "length",
        "n_docs",
        "docs_upto",
        "tokens_upto",
        over.alias("docs_over"),
        truncated.alias("tokens_truncated"),
        (F.col("_all_tokens") - truncated).alias("tokens_lost"),
        (F.col("docs_upto") / F.col("_all_docs")).alias("share_upto"),
    )


def quantiles(table: DataFrame, shares: list[float]) -> dict[float, int | None]:
    """The smallest length that at least each share of the texts does not exceed."""
    found = table.agg(*[F.min(F.when(F.col("share_upto") >= s, F.col("length"))) for s in shares]).first()
    return dict(zip(shares, found))


def truncated_total(table: DataFrame, limit: int) -> int:
    """Tokens in all when every text is cut at ``limit``, also between the lengths that occur."""
    last = table.where(F.col("length") <= limit).agg(
        F.max(F.struct("length", "tokens_upto", "docs_over")).alias("m")
    ).first()["m"]
    if last is None:
        return limit * (table.agg(F.sum("n_docs")).first()[0] or 0)
    return last["tokens_upto"] + last["docs_over"] * limit
