"""Quality rules: fixed limits first, then robust multivariate outliers by language and source.

Statistics of a text become a vector of five transformed numbers. For each language and
source the minimum covariance determinant is sought by concentration steps: from a start of
medians and median deviations, every step takes the share ``CORE`` of rows with the
smallest Mahalanobis distances and estimates mean and covariance anew from them. Rows whose
squared distance under the last estimate exceeds ``LIMIT`` are rejected. Distances with a median
above that of chi-square are scaled down to it. They are never scaled up: statistics that are
constant in the core add next to nothing to the median, which then says nothing of the others.

Order statistics come from fixed bins of the logarithm, so each step is two aggregates that
are combined before the shuffle, for any group size and in any order of rows. Groups of
fewer than ``LEAST`` rows borrow the estimate of their language, or of all rows; with fewer
rows than that overall, nothing is rejected beyond the fixed limits. Only DataFrame functions.

Defined cases: a null text has no words and fails the fixed limits; null language or source
is a group of its own; equal rows get equal verdicts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paneltide.session import materialized

SPACE = r"\x20\x09-\x0D"
SYMBOLS = r"[#*$%&|<>]"
CORE = 0.75
STEPS = 4
LEAST = 200
#: Cut for the squared distance: the 0.999 quantile of chi-square with five degrees of freedom.
LIMIT = 20.515005652432873
#: Groups up to which their estimates are sent to every task, about 200 bytes each.
MANY = 20_000
#: Median of the chi-square distribution with five degrees of freedom.
MEDIAN = 4.351460191095526
#: Bins of the logarithm of a number for each doubling.
FINE = 32
#: Least standard deviation of each transformed statistic. The shares of duplicate lines and of
#: repeated words are at most 1 and, within the fixed limits, 0.5: each alone can pass LIMIT.
FLOOR = (0.25, 0.15, 0.05, 0.12, 0.12)
VECTOR = ("v0", "v1", "v2", "v3", "v4")
D = len(VECTOR)


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    out = docs.withColumn("_words", F.regexp_extract_all(body, F.lit(f"[^{SPACE}]+"), F.lit(0)))
    out = out.withColumn("_lines", F.filter(F.split(body, "\n"), lambda x: x.rlike(f"[^{SPACE}]")))
    n = F.size("_words")
    out = out.withColumn("n_words", n.cast("long"))
    # three-word windows as hashes, with their place in the low bits; their words are compared below
    windows = F.when(
        n >= 3,
        F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)),
        ),
    ).otherwise(F.array().cast("array<long>"))
    out = out.withColumn("_grams", windows)
    out = out.withColumn("_low", F.ceil(F.log2(F.size("_grams") + 1.0)).cast("int"))
    packed = F.transform("_grams", lambda h, i: F.call_function("shiftleft", F.call_function("shiftright", h, F.col("_low")), F.col("_low")).bitwiseOR(i.cast("long")))
    out = out.withColumn("_sorted", F.sort_array(packed))
    last = F.size("_sorted") - 1
    low = F.col("_low")

    def same(a: Column, b: Column) -> Column:
        return F.call_function("shiftright", a.bitwiseXOR(b), low) == 0

    repeated = F.filter(
        "_sorted",
        lambda x, i: same(x, F.get("_sorted", F.greatest(i - 1, F.lit(0)))) & (i > 0)
        | same(x, F.get("_sorted", F.least(i + 1, last))) & (i < last),
    )
    out = out.withColumn("_again", repeated)
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), low) - 1

    def window(packed: Column) -> Column:
        place = packed.bitwiseAND(mask).cast("int")
        return F.struct(*[F.get("_words", place + k).alias(f"w{k}") for k in range(3)], place.alias("p"))

    def equal(a: Column, b: Column) -> Column:
        return (a["w0"] == b["w0"]) & (a["w1"] == b["w1"]) & (a["w2"] == b["w2"])

    # bits that agree only point to equal windows: where words behind them differ, sort those windows by their words
    def differs(x: Column, i: Column) -> Column:
        former = F.get("_again", F.greatest(i - 1, F.lit(0)))
        return (i > 0) & same(x, former) & ~equal(window(x), window(former))

    mixed = F.size(F.filter("_again", differs)) > 0
    out = out.withColumn("_exact", F.when(mixed, F.sort_array(F.transform("_again", window))))
    end = F.size("_exact") - 1
    true = F.filter(
        "_exact",
        lambda x, i: equal(x, F.get("_exact", F.greatest(i - 1, F.lit(0)))) & (i > 0)
        | equal(x, F.get("_exact", F.least(i + 1, end))) & (i < end),
    )
    places = F.when(F.col("_exact").isNull(), F.transform("_again", lambda x: x.bitwiseAND(mask))).otherwise(
        F.transform(true, lambda x: x["p"].cast("long"))
    )
    out = out.withColumn("_places", F.sort_array(places))
    covered = F.aggregate(
        "_places",
        F.struct(F.lit(-3).cast("long").alias("p"), F.lit(0).cast("long").alias("n")),
        lambda acc, p: F.struct(p.alias("p"), (acc["n"] + F.least(F.lit(3).cast("long"), p - acc["p"])).alias("n")),
        lambda acc: acc["n"],
    )
    out = out.withColumn("n_repeat_words", covered)
    out = out.withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
    out = out.withColumn("n_symbols", F.regexp_count(body, F.lit(SYMBOLS)).cast("long"))
    out = out.withColumn("n_lines", F.size("_lines").cast("long"))
    out = out.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.drop("_words", "_lines", "_grams", "_low", "_sorted", "_again", "_exact", "_places")


def with_vector(stats: DataFrame) -> DataFrame:
    """The transformed statistics: log length, log word size, and roots of three shares."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return stats.withColumns(
        {
            "v0": F.log(n.cast("double")),
            "v1": F.log((F.col("word_chars") + 1) / n) * 2,
            "v2": F.sqrt(F.col("n_symbols") / n),
            "v3": F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
            "v4": F.sqrt(F.col("n_repeat_words") / n),
        }
    )


def _quantile(rows: DataFrame, keys: list[str], value: Column, share: float, name: str, step: float) -> DataFrame:
    """Per group the upper edge of the bin that holds the wanted order statistic."""
    bins = rows.select(*keys, F.floor(value / step).cast("long").alias("_bin"))
    bins = bins.groupBy(*keys, "_bin").agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*keys).orderBy("_bin")  # a row per bin: bounded by the range of values
    total = F.sum("_n").over(Window.partitionBy(*keys))
    reached = bins.withColumn("_all", total).withColumn("_upto", F.sum("_n").over(order)).where(F.col("_upto") >= F.ceil(F.lit(share) * F.col("_all")))
    return reached.groupBy(*keys).agg(((F.min("_bin") + 1) * step).alias(name))


def _squared_distance(prefix: str = "") -> Column:
    """Squared Mahalanobis distance by forward substitution with the factor columns l_ij and means m_i."""
    solved: list[Column] = []
    for i in range(D):
        rest = F.col(VECTOR[i]) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * solved[j]
        solved.append(rest / F.col(f"l{i}{i}"))
    return reduce(lambda a, b: a + b, [z * z for z in solved])


def _factored(moments: DataFrame, keys: list[str]) -> DataFrame:
    """Means and the Cholesky factor of the covariance with the least variances added."""
    out = moments
    for i in range(D):
        out = out.withColumn(f"m{i}", F.col(f"s{i}") / F.col("n"))
    for i in range(D):
        for j in range(i + 1):
            c = F.col(f"q{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")
            if i == j:
                c = F.greatest(c, F.lit(0.0)) + FLOOR[i] ** 2
            for k in range(j):
                c = c - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            c = F.sqrt(F.greatest(c, F.lit(FLOOR[i] ** 2 / 4))) if i == j else c / F.col(f"l{j}{j}")
            out = out.withColumn(f"l{i}{j}", c)
    return out.select(*keys, *[f"m{i}" for i in range(D)], *[f"l{i}{j}" for i in range(D) for j in range(i + 1)])


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    sums = [F.count("*").alias("n")]
    for i in range(D):
        sums.append(F.sum(VECTOR[i]).alias(f"s{i}"))
        sums += [F.sum(F.col(VECTOR[i]) * F.col(VECTOR[j])).alias(f"q{i}{j}") for j in range(i + 1)]
    return rows.groupBy(*keys).agg(*sums)


def _start(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Medians, and median deviations on the diagonal."""
    by = [*keys, "_i"]

    def order_statistic(table: DataFrame, values: list[Column]) -> DataFrame:
        tall = table.select(*keys, F.posexplode(F.array(*values)).alias("_i", "_x"))
        return _quantile(tall, by, F.col("_x"), 0.5, "_q", 1 / 64).groupBy(*keys)

    def of(i: int) -> Column:
        return F.max(F.when(F.col("_i") == i, F.col("_q")))

    median = order_statistic(rows, [F.col(v) for v in VECTOR])
    median = materialized(median.agg(*[of(i).alias(f"m{i}") for i in range(D)]))
    off = [F.abs(F.col(v) - F.col(f"m{i}")) for i, v in enumerate(VECTOR)]
    spread = order_statistic(rows.join(_small(median), keys), off)
    spread = spread.agg(*[(of(i) * 1.4826 + FLOOR[i]).alias(f"l{i}{i}") for i in range(D)])
    zeros = [F.lit(0.0).alias(f"l{i}{j}") for i in range(D) for j in range(i)]
    return median.join(spread, keys).select("*", *zeros)


def _small(table: DataFrame) -> DataFrame:
    """A table of groups, sent to every task while it is small; else Spark joins it by key."""
    return F.broadcast(table) if table.limit(MANY + 1).count() <= MANY else table


def covariance_estimates(rows: DataFrame, keys: list[str], steps: int = STEPS, core: float = CORE) -> DataFrame:
    """Per group the means, the factor and the distance scale after the concentration steps.

    ``rows`` holds the non-null ``keys`` and the vector columns. Estimates of each step are
    written and read back.
    """
    log2 = F.log2(F.greatest(_squared_distance(), F.lit(1e-9)))
    now = materialized(_start(rows, keys))
    for _ in range(steps):
        placed = rows.join(_small(now), keys).select(*keys, *VECTOR, log2.alias("_far"))
        edge = materialized(_quantile(placed, keys, F.col("_far"), core, "_edge", 1 / FINE))
        inner = placed.join(_small(edge), keys).where("_far < _edge")
        now = materialized(_factored(_moments(inner, keys), keys))
    placed = rows.join(_small(now), keys).select(*keys, log2.alias("_far"))
    scale = _quantile(placed, keys, F.col("_far"), 0.5, "_mid", 1 / FINE)
    return materialized(now.join(scale, keys).withColumn("scale", F.greatest(F.pow(F.lit(2.0), "_mid") / MEDIAN, F.lit(1.0))).drop("_mid"))


def judged(
    docs: DataFrame,
    carry: tuple[str, ...],
    *,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    least: int = LEAST,
    limit: float = LIMIT,
) -> DataFrame:
    """The columns ``carry`` of ``docs`` with the statistics, base_failed, distance and kept.

    A carried column that has the name of a result is replaced by the result.
    """

    def named(c: str) -> Column:
        return F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit(""))

    narrow = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_row"),
        F.col(f"`{text}`").alias("_text"),
        named(lang).alias("_lang"),
        named(source).alias("_source"),
    )
    stats = materialized(with_vector(with_statistics(narrow, "_text").drop("_text")))
    rows = stats.where(~F.col("base_failed")).select("_lang", "_source", *VECTOR)
    # A long key for each group: a table that is sent to every task and joined by one long takes an executor
    # its few rows, one joined by texts a whole page of Spark's memory (32 MB on small executors).
    sizes = rows.groupBy("_lang", "_source").agg(F.count("*").alias("_n"))
    sizes = materialized(sizes.withColumn("_k", F.monotonically_increasing_id()))
    # groups of their own, then languages, then all rows
    large = sizes.where(F.col("_n") >= least).select("_lang", "_source", "_k")
    langs = sizes.groupBy("_lang").agg(F.sum("_n").alias("_n"), (-F.min("_k") - 2).alias("_k"))
    langs = langs.where(F.col("_n") >= least).select("_lang", "_k")
    every = sizes.agg(F.sum("_n").alias("_n")).where(F.col("_n") >= least)
    all_rows = F.lit(-1).cast("long")
    levels = rows.join(_small(large), ["_lang", "_source"]).select("_k", *VECTOR)
    levels = levels.union(rows.join(_small(langs), "_lang").select("_k", *VECTOR))
    if not every.isEmpty():
        levels = levels.union(rows.select(all_rows.alias("_k"), *VECTOR))
    found = covariance_estimates(materialized(levels), ["_k"])
    # which estimate each pair of language and source uses
    use = (
        stats.select("_lang", "_source").distinct()
        .join(large.withColumnRenamed("_k", "_own"), ["_lang", "_source"], "left")
        .join(langs.withColumnRenamed("_k", "_by_lang"), "_lang", "left")
        .select("_lang", "_source", F.coalesce("_own", "_by_lang", all_rows).alias("_k"))
    )
    chosen = materialized(use.join(found, "_k", "left").drop("_k"))
    out = stats.join(_small(chosen), ["_lang", "_source"])
    out = out.withColumn("distance", _squared_distance() / F.col("scale"))
    out = out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= limit, F.lit(True)))
    results = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"]
    return out.select(*[F.col(f"_row.`{c}`") for c in carry if c not in results], *results)


def passing(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that a rule rejects."""
    names = {k: options.pop(k, k) for k in ("text", "lang", "source")}
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_whole"),
        *[F.col(f"`{c}`").alias(k) for k, c in names.items()],
    )
    return judged(whole, ("_whole",), **options).where("kept").select("_whole.*")
