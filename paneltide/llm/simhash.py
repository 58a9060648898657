"""SimHash near-duplicates by covering locality-sensitive hashing.

Bit i of a fingerprint gets the vector phi(i) of radius + 1 bits, none of them zero.
Table v, for each of the 2 ** (radius + 1) - 1 nonzero vectors v, keeps the bits with
phi(i) . v = 1. Any set of ``radius`` differing bits spans less than the whole space, so
some v is orthogonal to all of them and the two fingerprints collide in table v: no pair
within the radius is missed. Candidates are verified on all bits.

Only distinct fingerprints enter the tables. A bucket of at most ``BUCKET`` members is
compared in one step and gives a star of links instead of all pairs. The members of
larger buckets are linked exactly by their midpoints: two fingerprints differ in at most
2 k bits just when some value is within k bits of both, so every member lists the values
within k bits of it and meets the others there. Such a value has at most as many
members as there are values around it, so no step holds more than that.

Defined cases: no words, or a null text, is fingerprint zero, linked like any other;
rows with equal fingerprints are always linked; a null id is ignored in the smallest id.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneltide.llm.batches import append_columns, free_name
from paneltide.llm.components import components
from paneltide.session import materialized

BITS = 64
SHINGLE = 4
RADIUS = 4
SEED = 42
#: Members of a bucket that are compared in one step; larger buckets go through midpoints.
BUCKET = 512


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def masks(radius: int = RADIUS) -> list[int]:
    """One mask for each nonzero vector of radius + 1 bits."""
    vectors = 2 ** (radius + 1) - 1
    phi = [i % vectors + 1 for i in range(BITS)]
    return [
        sum(1 << i for i in range(BITS) if (phi[i] & v).bit_count() % 2) for v in range(1, vectors + 1)
    ]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority bits of the shingles' XXH64 as an unsigned number."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, white space 09-0D and 20
    if not words:
        return 0
    joined = b" ".join(words)
    size = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: len(words) - size] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[size - 1 :].tolist())], dtype="<u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def with_fingerprints(df: DataFrame, text: str = "text", name: str = "fingerprint", shingle: int = SHINGLE) -> DataFrame:
    """``df`` with the fingerprint of each text as a signed long."""

    def compute():
        return lambda texts: {name: [signed(fingerprint(t, shingle)) for t in texts]}

    return append_columns(df, text, [T.StructField(name, T.LongType())], compute)


def stars(members: np.ndarray, radius: int) -> np.ndarray:
    """For each member the smallest one it reaches through links among ``members``."""
    bits = members.view(np.uint64)  # counted on signed numbers, the sign would go astray
    linked = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= radius
    label = members.copy()
    most = np.iinfo(members.dtype).max
    while True:
        new = np.where(linked, label[None, :], most).min(axis=1)
        if (new == label).all():
            return label
        label = new


def links(fingerprints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that give the components of all pairs within ``radius``.

    ``fingerprints`` has one distinct long column ``fp``.
    """
    keyed = fingerprints.select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks(radius)])).alias("t", "key")
    )
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    # Spark sizes an exploded table like the one before, a 31st of it, and would send it to every task.
    members = materialized(keyed.join(sizes.hint("merge"), ["t", "key"]))

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def reach(groups: pa.Array) -> pa.Array:
        out = [stars(np.array(g, dtype=np.int64), radius) for g in groups.to_pylist()]
        return pa.array([x.tolist() for x in out], type=pa.list_(pa.int64()))

    small = (
        members.where(F.col("n") <= bucket)
        .groupBy("t", "key")
        .agg(F.collect_list("fp").alias("g"))  # at most ``bucket`` members
        .select(F.explode(F.arrays_zip("g", reach("g").alias("r"))).alias("x"))
        .select(F.col("x.g").alias("a"), F.col("x.r").alias("b"))
    )
    large = members.where(F.col("n") > bucket).select("fp").distinct()
    near = [0] + [
        sum(1 << i for i in c) for k in range(1, radius // 2 + 1) for c in combinations(range(BITS), k)
    ]
    if radius % 2:
        raise ValueError("midpoints need an even radius")
    middle = (
        large.select("fp", F.explode(F.lit(np.array([signed(x) for x in near], dtype=np.int64))).alias("flip"))
        .select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
        .groupBy("mid")
        .agg(F.min("fp").alias("b"), F.collect_list("fp").alias("g"))  # at most len(near) members
        .where(F.size("g") > 1)
        .select(F.explode("g").alias("a"), "b")
    )
    return small.union(middle).where("a != b").distinct()


def near_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE
) -> tuple[DataFrame, DataFrame]:
    """The fingerprints by row and the classes by fingerprint.

    First: (doc_id, fp), one row per row of ``docs``. Second: (fp, root, component_id),
    one row per distinct fingerprint; ``root`` names the class, ``component_id`` is its
    smallest id.
    """
    rows = with_fingerprints(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), "text", "fp", shingle)
    rows = materialized(rows.select("doc_id", "fp"))
    distinct = materialized(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    classed = distinct.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = classed.groupBy("root").agg(F.min("low").alias("component_id"))
    return rows, materialized(classed.join(lowest, "root").select("fp", "root", "component_id"))


def near_duplicate_classes(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint in hexadecimal, component_id."""
    rows, classes = near_duplicates(docs, **options)
    return rows.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each class, the one with the smallest id.

    Where several rows of a class share that id (or have none), the smallest row by all
    its columns stays.
    """
    rows, classes = near_duplicates(docs, doc_id=doc_id, text=text, **options)
    lowest = F.col("doc_id").eqNullSafe(F.col("component_id"))
    key, fp, root, low = (free_name(docs, n) for n in ("_key", "_fp", "_root", "_low"))
    ids = materialized(
        rows.join(classes, "fp")
        .groupBy(F.col("doc_id").alias(key))
        .agg(F.count("*").alias("n"), F.count_if(lowest).alias("smallest"))
        .where("smallest = 0 or n > 1")
    )
    columns = [F.col(f"`{c}`") for c in docs.columns]
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col(key))
    # Texts meet the list of the ids that do not simply stay, far fewer than the others, so that it is sent to
    # the tasks up to Spark's own limit and the texts are not shuffled; they are not fingerprinted again.
    once = docs.join(ids.select(key), same, "left_anti")
    twice = ids.where("n > 1 and smallest > 0").select(key)
    if twice.isEmpty():
        return once
    # Rows that share an id may lie in different classes: only their fingerprints tell.
    shared = docs.join(twice, same, "left_semi")
    named = with_fingerprints(shared, text, fp, options.get("shingle", SHINGLE))
    classes = classes.select(F.col("fp").alias(fp), F.col("root").alias(root), F.col("component_id").alias(low))
    first = named.join(classes, fp).where(F.col(f"`{doc_id}`").eqNullSafe(F.col(low)))
    chosen = first.groupBy(root).agg(F.min(F.struct(*columns)).alias("_row"))
    return once.union(chosen.select("_row.*"))
