"""Pairwise-complete Pearson and Spearman correlation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paneltide.functions.quantiles import order_bucket
from paneltide.session import materialized, release_shuffles

# Weather columns set against pollutants, and the fewest rows a cell needs.
WEATHER_DRIVERS = (
    "wind_kph",
    "gust_kph",
    "precip_mm",
    "humidity",
    "pressure_mb",
    "temperature_celsius",
    "cloud",
    "uv_index",
)
MIN_PAIRS = 30
#: Ranks that are sent to every task at most, as numbers of 8 bytes.
LOOKUP = 1 << 20
#: Rows of a column of many values that are ranked together; rows that its cuts are taken from, at most about.
PIECE, CUT_ROWS = 1 << 17, 1 << 16
#: Numbers of parts of one value that holds several pieces.
SALTS = 1 << 20

Pairs = Sequence[tuple[str, str]]


def pearson(df: DataFrame, pairs: Pairs) -> DataFrame:
    """``(x, y, n, pearson)`` for every pair, in one pass over the table.

    Tasks add up the moments of all pairs by matrix products over batches and hand on one row for each
    pair. Means are taken off before anything is squared; a constant side is told by its extremes.
    """
    names = list(dict.fromkeys(c for p in pairs for c in p))
    at = {c: i for i, c in enumerate(names)}
    left, right = [at[x] for x, _ in pairs], [at[y] for _, y in pairs]
    session = df.sparkSession
    if not names:
        return session.createDataFrame([], "x string, y string, n bigint, pearson double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = _moments(_matrix(batch))
                total = part if total is None else _merged(total, part)
        if total is not None:
            there = {k: total[k][left, right] for k in ("n", "bad", "both", "mean", "square", "low", "high")}
            back = {f"{k}_y": total[k][right, left] for k in ("mean", "square", "low", "high")}
            cells = {"pair": np.arange(len(pairs)), **there, **back}
            yield pa.RecordBatch.from_pydict(cells)

    doubles = ("both", "mean", "square", "low", "high", "mean_y", "square_y", "low_y", "high_y")
    kinds = "pair long, n long, bad long, " + ", ".join(f"{c} double" for c in doubles)
    parts = df.select(*[_number(c).alias(c) for c in names]).mapInArrow(run, kinds).where("n > 0")
    # one row for each task and pair
    task = Window.partitionBy("pair")
    off = {c: F.col(c) - F.sum(F.col("n") * F.col(c)).over(task) / F.sum("n").over(task) for c in ("mean", "mean_y")}
    n, x, y = F.col("n"), F.col("_off_mean"), F.col("_off_mean_y")
    merged = parts.withColumns({f"_off_{c}": e for c, e in off.items()}).groupBy("pair").agg(
        F.sum("n").alias("n"),
        F.sum("bad").alias("_bad"),
        F.sum(F.col("both") + n * x * y).alias("_xy"),
        F.sum(F.col("square") + n * x * x).alias("_xx"),
        F.sum(F.col("square_y") + n * y * y).alias("_yy"),
        ((F.min("low") < F.max("high")) & (F.min("low_y") < F.max("high_y"))).alias("_spread"),
    )
    scale = F.sqrt("_xx") * F.sqrt("_yy")
    value = F.when(F.col("_bad") > 0, F.lit(float("nan"))).when(F.col("_spread") & (scale > 0), F.col("_xy") / scale)
    return _every(session, pairs).join(F.broadcast(merged), "pair", "left").select(
        "x", "y", F.coalesce("n", F.lit(0).cast("long")).alias("n"), value.alias("pearson")
    )


def _every(session: SparkSession, pairs: Pairs) -> DataFrame:
    return session.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pairs)], "pair long, x string, y string")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """Rows by columns; nulls are NaN."""
    return np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])


def _moments(values: np.ndarray) -> dict[str, np.ndarray]:
    """Of column i among the rows that have column j too, at [i, j]: rows, mean, squares about it, extremes; ``both``: products."""
    known, endless = ~np.isnan(values), np.isinf(values)
    usable = known & ~endless
    shift = np.where(usable, values, 0.0).sum(axis=0) / np.maximum(usable.sum(axis=0), 1)
    x, m = np.where(usable, values - shift, 0.0), known.astype(float)
    n, total = m.T @ m, x.T @ m
    per = np.maximum(n, 1.0)
    low, high = np.full(n.shape, np.inf), np.full(n.shape, -np.inf)
    for j in range(values.shape[1]):
        some = values[known[:, j]]
        if len(some):
            low[:, j], high[:, j] = np.fmin.reduce(some), np.fmax.reduce(some)
    bad = endless.T.astype(float) @ m
    return {
        "n": n.astype(np.int64),
        "bad": (bad + bad.T).astype(np.int64),
        "mean": total / per + shift[:, None],
        "square": np.maximum((x * x).T @ m - total * total / per, 0.0),
        "both": x.T @ x - total * total.T / per,
        "low": low,
        "high": high,
    }


def _merged(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    n = a["n"] + b["n"]
    per = np.maximum(n, 1)
    weight = a["n"] * (b["n"] / per)
    off = np.where((a["n"] > 0) & (b["n"] > 0), b["mean"] - a["mean"], 0.0)
    mean = (a["mean"] * a["n"] + b["mean"] * b["n"]) / per
    return {
        "n": n,
        "bad": a["bad"] + b["bad"],
        "mean": mean,
        "square": a["square"] + b["square"] + off * off * weight,
        "both": a["both"] + b["both"] + off * off.T * weight,
        "low": np.fmin(a["low"], b["low"]),
        "high": np.fmax(a["high"], b["high"]),
    }


def spearman(df: DataFrame, pairs: Pairs, lookup: int = LOOKUP, piece: int = PIECE) -> DataFrame:
    """``(x, y, n, spearman)``: correlation of average ranks over each pair's complete rows.

    A column of few values has one histogram: per distinct value, how many of its rows have each
    other column too. Cumulated, it gives a value's rank against every partner at once; about ``lookup``
    such ranks at most are sent to every task. Rows are shuffled for columns of many values only, for one
    after another: in ``piece`` rows of neighbouring values each, with the codes of all columns of few
    values in a number or two. Ranks inside a piece and what lies before it give all sums. Two columns of
    many values meet by sending the ranks in the first with the values of the second.
    """
    names = list(dict.fromkeys(c for p in pairs for c in p))
    if not names:
        return df.sparkSession.createDataFrame([], "x string, y string, n bigint, spearman double")
    return _spearman(_wide(df, names), pairs, lookup, piece)


def _wide(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The columns as numbers and a row number, which stays the same when a task runs again, since it is written."""
    return materialized(df.select(F.monotonically_increasing_id().alias("_row"), *[_number(c).alias(c) for c in names]), release=True)


def _spearman(wide: DataFrame, pairs: Pairs, lookup: int = LOOKUP, piece: int = PIECE) -> DataFrame:
    session = wide.sparkSession
    names = list(dict.fromkeys(c for p in pairs for c in p))
    at = {c: i for i, c in enumerate(names)}
    asked = list(dict.fromkeys((at[x], at[y]) for x, y in pairs))
    few, many = _few_and_many(wide, names, lookup)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(names[c]).alias("v")) for c in sorted(few)]))
    parts, spreads, tables = [], [], {}
    if few:
        cells = wide.select(F.array(*names).alias("_v"), each.alias("_cell")).select("_v", "_cell.*").where(F.col("v").isNotNull())
        ranks = materialized(_partner_ranks(cells, len(names)), release=True)
        tables = _tables(ranks, few, len(names))
        spreads.append(_spread(ranks, len(names)))
        parts.append(_sums_of_few(wide, names, tables, asked))
    if many:
        sums, own = _sums_of_many(wide, names, tables, many, asked, piece)
        parts.append(session.createDataFrame([(*p, v) for p, v in sums.items()], _SUMS))
        spreads.append(session.createDataFrame([(*p, *v) for p, v in own.items()], "c int, other int, n long, s double"))
    sums = reduce(DataFrame.unionByName, [p for p in parts if p is not None]).groupBy("c", "other").agg(F.sum("_ab").alias("_ab"))
    spread = reduce(DataFrame.unionByName, spreads)
    there = spread.withColumnRenamed("s", "_aa")
    back = spread.select(F.col("other").alias("c"), F.col("c").alias("other"), F.col("s").alias("_bb"))
    shown = session.createDataFrame([(x, y, at[x], at[y]) for x, y in pairs], "x string, y string, c int, other int")
    both = shown.join(sums, ["c", "other"], "left").join(there, ["c", "other"]).join(back, ["c", "other"])
    scale = F.sqrt(F.col("_aa")) * F.sqrt(F.col("_bb"))
    return both.where(F.col("n") > 0).select(
        "x", "y", "n", F.when(scale > 0, F.coalesce("_ab", F.lit(0.0)) / scale).alias("spearman")
    )


_SUMS = "c int, other int, _ab double"


def _spread(ranks: DataFrame, width: int) -> DataFrame:
    """``(c, other, n, s)``: rows of column c that have the other one too, and the squares of their centred ranks, summed."""
    square = [F.get("n", F.lit(j)) * F.get("r", F.lit(j)) * F.get("r", F.lit(j)) for j in range(width)]
    own = ranks.groupBy("c").agg(
        *[F.sum(F.get("n", F.lit(j))).alias(f"n{j}") for j in range(width)], *[F.sum(square[j]).alias(f"s{j}") for j in range(width)]
    )
    cells = F.array(*[F.struct(F.col(f"n{j}").alias("n"), F.col(f"s{j}").alias("s")) for j in range(width)])
    return own.select("c", F.posexplode(cells).alias("other", "_cell")).select("c", "other", "_cell.*")


def _few_and_many(wide: DataFrame, names: Sequence[str], lookup: int) -> tuple[set[int], list[int]]:
    """The columns of fewest values whose ranks against all columns are about ``lookup`` numbers, and the others."""
    counts = wide.agg(*[F.approx_count_distinct(c) for c in names]).first()
    few, left = set(), lookup
    for c in sorted(range(len(names)), key=lambda c: counts[c]):
        left -= counts[c] * len(names)
        if left < 0:
            break
        few.add(c)
    return few, [c for c in range(len(names)) if c not in few]


def _tables(ranks: DataFrame, few: set[int], width: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Values in order and their ranks against each column, with a last row of zeros for nulls."""
    rows = ranks.select("c", "v", "r").toPandas()
    out = {}
    for c in sorted(few):
        mine = rows[rows["c"] == c].sort_values("v")
        out[c] = (mine["v"].to_numpy(), np.vstack([*mine["r"].to_numpy(), np.zeros(width)]))
    return out


def _codes(values: np.ndarray, column: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(column), len(values), np.searchsorted(values, column))


def _sums_of_few(wide: DataFrame, names: Sequence[str], held: dict, asked: list) -> DataFrame | None:
    """Products of ranks, summed, for pairs of columns of few values; rows stay where they are."""
    mine = [p for p in asked if p[0] in held and p[1] in held]
    if not mine:
        return None
    need = sorted({c for p in mine for c in p})
    tables = wide.sparkSession.sparkContext.broadcast({c: held[c] for c in need})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(mine))
        for batch in batches:
            column = dict(zip(need, _matrix(batch).T))
            found = {c: tables.value[c][1][_codes(tables.value[c][0], column[c])] for c in need}
            total += [found[a][:, b] @ found[b][:, a] for a, b in mine]
        yield _summed(mine, total)

    return wide.select(*[names[c] for c in need]).mapInArrow(run, _SUMS)


def _summed(pairs: list, total: np.ndarray) -> pa.RecordBatch:
    c, other = (pa.array([p[k] for p in pairs], pa.int32()) for k in (0, 1))
    return pa.RecordBatch.from_arrays([c, other, pa.array(total)], ["c", "other", "_ab"])


Cuts = tuple[np.ndarray, np.ndarray]


def _cuts(wide: DataFrame, names: Sequence[str], many: list[int], piece: int) -> dict[int, Cuts]:
    """Values that cut each column into pieces of about as many rows, and how many pieces end at each value.

    They are taken from rows chosen by a hash of their number; results do not depend on them.
    """
    n = wide.count()
    pieces = max(n // piece, min(64, n // 4096), 1)
    chosen = wide.where(F.pmod(F.xxhash64("_row"), F.lit(max(1, n // CUT_ROWS))) == 0).select(*[names[c] for c in many]).toPandas()
    out = {}
    for c in many:
        values = np.sort(chosen[names[c]].dropna().to_numpy(dtype=float))
        at = np.arange(1, pieces) * len(values) // pieces
        out[c] = np.unique(values[at] if len(values) else values, return_counts=True)
    return out


def _parts(v: np.ndarray, row: np.ndarray, cuts: Cuts) -> np.ndarray:
    """The part of each value: pieces in order, each times ``SALTS``; one value of several pieces has several parts."""
    at, times = cuts
    if not len(at):
        return np.zeros(len(v), np.int64)
    below = np.searchsorted(at, v)
    near = np.minimum(below, len(at) - 1)
    heavy = (at[near] == v) & (times[near] > 1)
    return (2 * below + heavy) * SALTS + np.where(heavy, row % times[near], 0)


def _local(v: np.ndarray, sides: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[list[float], np.ndarray]]:
    """For each side, which rows have it and a number for each: [rows, ranks times numbers, numbers, squares of ranks] summed,
    and the ranks. They are average ranks in the part among the rows that have the side, less their mean."""
    order = np.argsort(v, kind="stable")
    place = np.empty(len(v), np.int64)
    place[order] = np.cumsum(np.concatenate(([0], v[order][1:] != v[order][:-1])))
    for has, number in sides:
        many = np.bincount(place, has)
        total = int(has.sum())
        middle = np.cumsum(many) - (many - 1) / 2 - (total + 1) / 2
        rank = np.where(has, middle[place], 0.0)
        yield [total, float(rank @ number), float(number.sum()), float(rank @ rank)], rank


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The columns of each part in turn; rows come in the order of their part."""
    now, held = None, []
    for batch in batches:
        part, *rest = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        for start, end in zip(edges[:-1], edges[1:]):
            if start == end:
                continue
            if held and part[start] != now:
                yield now, [np.concatenate(c) for c in zip(*held)]
                held = []
            now = int(part[start])
            held.append([c[start:end] for c in rest])
    if held:
        yield now, [np.concatenate(c) for c in zip(*held)]


_PIECES = "part long, other int, v double, rank double, sums array<double>"


def _piece(part: int, sums: list[float]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([part]), pa.array([-1], pa.int32()), pa.nulls(1, pa.float64()), pa.nulls(1, pa.float64()), pa.array([sums], pa.list_(pa.float64()))],
        ["part", "other", "v", "rank", "sums"],
    )


def _joined_up(pieces: DataFrame, sides: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each side: products of ranks and numbers; rows; squares of ranks; and per piece, named first, what to add to
    its ranks to have the centred ranks of the whole column. One row for each part reaches the driver."""
    rows = pieces.where("other = -1").select("part", "sums").collect()
    order, at = np.unique([r["part"] // SALTS for r in rows], return_inverse=True)
    sums = np.zeros((len(order), sides, 4))
    np.add.at(sums, at, np.array([r["sums"] for r in rows]).reshape(len(rows), sides, 4))
    n, product, number, square = np.moveaxis(sums, 2, 0)
    shift = np.cumsum(n, axis=0) - (n - 1) / 2 - (n.sum(axis=0) + 1) / 2 if len(order) else n
    return (product + shift * number).sum(axis=0), n.sum(axis=0), (square + n * shift * shift).sum(axis=0), (order, shift)


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("part").sortWithinPartitions("part")


def _words(tables: dict, need: list[int]) -> list[list[tuple[int, int, int]]]:
    """(column, factor, values) of the codes that share a whole number, for each such number."""
    words, factor = [[]], 1
    for o in need:
        size = len(tables[o][0]) + 1
        if factor * size >= 1 << 62:
            words, factor = [*words, []], 1
        words[-1].append((o, factor, size))
        factor *= size
    return words


def _sums_of_many(
    wide: DataFrame, names: Sequence[str], held: dict, many: list[int], asked: list, piece: int
) -> tuple[dict[tuple[int, int], float], dict[tuple[int, int], tuple[int, float]]]:
    """Products of ranks of all pairs with a column of many values, summed; rows and squares of ranks of such columns."""
    spark = wide.sparkSession
    tables, cuts = spark.sparkContext.broadcast(held), _cuts(wide, names, many, piece)
    sums, own, both = {}, {}, {}
    for c in many:
        partners = sorted({b if a == c else a for a, b in asked if c in (a, b)})
        if not partners:
            continue
        ahead = [o for o in partners if o in cuts and o > c]
        pieces = _ranked_pieces(wide, names, tables, c, partners, ahead, cuts[c])
        pieces = materialized(pieces, release=True) if ahead else pieces
        product, n, square, shifts = _joined_up(pieces, len(partners))
        for k, o in enumerate(partners):
            own[c, o] = int(n[k]), float(square[k])
            if o == c or o not in cuts:
                both[c, o] = both[o, c] = float(square[k]) if o == c else float(product[k])
        for o in ahead:
            order, shift = shifts
            met = _met_pieces(pieces, o, order, shift[:, partners.index(o)], cuts[o])
            both[c, o] = both[o, c] = float(_joined_up(met, 1)[0][0])
        pieces = met = None
        release_shuffles(spark)
    for a, b in asked:
        if a in cuts or b in cuts:
            sums[a, b] = both[a, b]
    return sums, own


def _ranked_pieces(
    wide: DataFrame, names: Sequence[str], tables, c: int, partners: list[int], ahead: list[int], cuts: Cuts
) -> DataFrame:
    """Sums of each part of a column, and its ranks next to the values of the columns in ``ahead``."""
    few = [o for o in partners if o in tables.value]
    others = [o for o in partners if o not in few and o != c]
    words = _words(tables.value, few)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, own = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            column = dict(zip([*few, *others], (x.to_numpy(zero_copy_only=False) for x in batch.columns[2:])))
            packed = [sum((_codes(tables.value[o][0], column[o]) * f for o, f, _ in w), np.zeros(len(own), np.int64)) for w in words]
            arrays = [_parts(own, row, cuts), own, *packed, *[column[o] for o in others]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], [f.split()[0] for f in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (own, *rest) in _by_part(batches):
            side = {c: (np.ones(len(own), bool), np.zeros(len(own)))}
            for w, packed in zip(words, rest):
                for o, factor, size in w:
                    codes = packed // factor % size
                    side[o] = codes < size - 1, tables.value[o][1][codes, c]
            value = dict(zip(others, rest[len(words) :]))
            side |= {o: (~np.isnan(x), np.zeros(len(own))) for o, x in value.items()}
            total = []
            for o, (cells, rank) in zip(partners, _local(own, [side[o] for o in partners])):
                total += cells
                if o in ahead and side[o][0].any():
                    has = side[o][0]
                    m = int(has.sum())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(m, part)), pa.array(np.full(m, o, np.int32)), pa.array(value[o][has]), pa.array(rank[has]), pa.nulls(m, pa.list_(pa.float64()))],
                        ["part", "other", "v", "rank", "sums"],
                    )
            yield _piece(part, total)

    kinds = ["part long", "v double", *[f"w{k} long" for k in range(len(words))], *[f"d{o} double" for o in others]]
    read = wide.where(F.col(names[c]).isNotNull()).select("_row", F.col(names[c]).alias("_own"), *[names[o] for o in (*few, *others)])
    return _dealt(read.mapInArrow(code, ", ".join(kinds))).mapInArrow(run, _PIECES)


def _met_pieces(pieces: DataFrame, other: int, order: np.ndarray, shift: np.ndarray, cuts: Cuts) -> DataFrame:
    """Sums of each part of the other column, whose rows bring their ranks in the first one."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, v, rank = (x.to_numpy() for x in batch.columns)
            whole = rank + shift[np.searchsorted(order, part // SALTS)]
            yield pa.RecordBatch.from_arrays([pa.array(_parts(v, np.arange(len(v)), cuts)), pa.array(v), pa.array(whole)], ["part", "v", "number"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (v, number) in _by_part(batches):
            yield _piece(part, next(_local(v, [(np.ones(len(v), bool), number)]))[0])

    rows = pieces.where(F.col("other") == other).select("part", "v", "rank")
    return _dealt(rows.mapInArrow(code, "part long, v double, number double")).mapInArrow(run, _PIECES)


def _number(column: str) -> Column:
    return F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))


def _partner_ranks(cells: DataFrame, width: int) -> DataFrame:
    """``(c, v, n, r)``: per distinct value, its rows with each partner and its centred average ranks."""
    partners = range(width)
    counts = (
        cells.groupBy("c", "v")
        .agg(*[F.count(F.get("_v", F.lit(j))).alias(f"n{j}") for j in partners])
        .withColumn("_b", order_bucket(F.col("v")))
    )
    before = Window.partitionBy("c").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("c")
    starts = (
        counts.groupBy("c", "_b")
        .agg(*[F.sum(f"n{j}").alias(f"b{j}") for j in partners])
        .select(
            "c",
            "_b",
            *[F.coalesce(F.sum(f"b{j}").over(before), F.lit(0)).alias(f"start{j}") for j in partners],
            *[F.sum(f"b{j}").over(whole).alias(f"total{j}") for j in partners],
        )
    )
    upto = Window.partitionBy("c", "_b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)

    def centred(j: int) -> Column:
        last = F.col(f"start{j}") + F.sum(f"n{j}").over(upto)
        return last - (F.col(f"n{j}") - 1) / 2 - (F.col(f"total{j}") + 1) / 2

    return counts.join(starts, ["c", "_b"]).select(
        "c",
        "v",
        F.array(*[F.col(f"n{j}") for j in partners]).alias("n"),
        F.array(*[centred(j) for j in partners]).alias("r"),
    )


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Both correlations and their absolute difference for every unordered pair."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    wide = _wide(df, columns)
    both = pearson(wide, pairs).join(_spearman(wide, pairs).drop("n"), ["x", "y"], "left") if pairs else pearson(df, pairs).withColumn("spearman", F.lit(None).cast("double"))
    return both.withColumn("abs_diff", F.abs(F.col("spearman") - F.col("pearson")))


def square(correlation: DataFrame, value: str, columns: Sequence[str]) -> DataFrame:
    """Full symmetric matrix over ``columns``, one row and one column per variable."""
    there = F.struct(F.col("x").alias("variable"), F.col("y").alias("other"), F.col(value).alias("v"))
    back = F.struct(F.col("y").alias("variable"), F.col("x").alias("other"), F.col(value).alias("v"))
    wide = (
        correlation.select(F.inline(F.array(there, back)))
        .groupBy("variable")
        .pivot("other", list(columns))
        .agg(F.first("v"))
    )
    same = {c: F.when(F.col("variable") == c, F.lit(1.0)).otherwise(F.col(c)) for c in columns}
    return wide.withColumns(same)


def weather_pollutant_correlation(
    df: DataFrame,
    weather: Sequence[str],
    pollutants: Sequence[str],
    method: str = "spearman",
    min_pairs: int = MIN_PAIRS,
) -> DataFrame:
    """``(weather, pollutant, corr, n)``; too few rows or a constant side give null."""
    pairs = [(w, p) for w in weather for p in pollutants if w in df.columns and p in df.columns]
    if method == "spearman":
        ranked = spearman(df, pairs)
        known = _every(df.sparkSession, pairs).join(ranked, ["x", "y"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    else:
        known = pearson(df, pairs)
    return known.select(
        F.col("x").alias("weather"),
        F.col("y").alias("pollutant"),
        F.when(F.col("n") >= min_pairs, F.col(method)).alias("corr"),
        "n",
    )


def correlation_grid(long: DataFrame, pollutants: Sequence[str]) -> DataFrame:
    """Weather by pollutant matrix from the long form."""
    return long.groupBy("weather").pivot("pollutant", list(pollutants)).agg(F.first("corr"))
