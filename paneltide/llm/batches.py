"""Arrow helpers shared by the text operators: bounded slices in, appended columns out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes of text that one step of a task holds at a time, unless one text alone is longer.
SLICE_BYTES = 2 << 20

Compute = Callable[[list[str | None]], dict[str, object]]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts add up to about ``limit`` bytes; a longer text is alone."""
    start = size = 0
    lengths = pa.compute.binary_length(texts).to_pylist()
    for i, n in enumerate(lengths):
        if size and size + (n or 0) > limit:
            yield start, i
            start, size = i, 0
        size += n or 0
    if start < len(lengths):
        yield start, len(lengths)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with more underscores in front if ``df`` has a column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def append_columns(
    df: DataFrame,
    text: str,
    fields: list[T.StructField],
    compute: Callable[[], Compute],
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """``df`` with columns computed from its column ``text``.

    ``compute`` is called once in each task and returns the function that maps a
    list of texts to the values of ``fields`` by name. A column of ``df`` that has
    the name of a new field is replaced. No shuffle; rows stay where they are.
    """
    new = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in new]
    schema = T.StructType(kept + list(fields))
    arrow = [(f.name, to_arrow_type(f.dataType)) for f in fields]
    hidden = "_text_to_map" if text in new else text
    source = df.select(*[F.col(f"`{f.name}`") for f in kept], *([F.col(f"`{text}`").alias(hidden)] if text in new else []))
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = compute()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(hidden))
            for start, end in slices(texts, limit):
                part = batch.slice(start, end - start)
                values = apply(texts.slice(start, end - start).to_pylist())
                columns = [part.column(part.schema.get_field_index(n)) for n in names]
                columns += [
                    v if isinstance(v := values[n], pa.Array) else pa.array(v, type=kind)
                    for n, kind in arrow
                ]
                yield pa.RecordBatch.from_arrays(columns, names + [n for n, _ in arrow])

    return source.mapInArrow(run, schema)
