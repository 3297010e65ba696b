"""What the operators share: table access, Arrow batch mapping and the shared folder.

Texts cross to Python as UTF-8 bytes. ``bytes.split`` cuts at exactly ``\\x20\\x09-\\x0D``, and
``bytes.translate`` lower-cases exactly A-Z, so both word definitions of the operators run at C
speed without decoding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from notewell.sources.scratch import Scratch as Workspace

#: Text bytes handled together inside a task: keeps the arrays of one step in cache.
BLOCK_BYTES = 1_500_000

_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_UPPER = bytes(range(0x41, 0x5B))
_ALNUM = bytes.maketrans(_SEPARATORS + _UPPER, b" " * len(_SEPARATORS) + _UPPER.lower())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def space_words(text: bytes | None) -> list[bytes]:
    """Maximal runs of ``[^\\x20\\x09-\\x0D]``; none for null."""
    return text.split() if text else []


def alnum_words(text: bytes | None) -> list[bytes]:
    """Maximal runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z."""
    return text.translate(_ALNUM).split() if text else []


def blocks(texts: list[bytes | None], limit: int = BLOCK_BYTES) -> Iterator[list[bytes | None]]:
    """Consecutive runs of texts of about ``limit`` bytes; a longer text is a block of its own."""
    run, held = [], 0
    for text in texts:
        size = len(text) if text else 0
        if run and held + size > limit:
            yield run
            run, held = [], 0
        run.append(text)
        held += size
    if run:
        yield run


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, in either case."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_struct(
    df: DataFrame,
    name: str,
    ddl: str,
    compute: Callable[[list[bytes | None]], Iterable[tuple]],
    text: str = "text",
    keep: list[str] | None = None,
    beside: F.Column | None = None,
) -> DataFrame:
    """``df`` (or its ``keep`` columns) with a struct column made from each whole text.

    A column of ``df`` that is called ``name`` already, in either case, gives way to the new one.

    ``compute`` takes the texts of a block as bytes and gives one tuple a text, in the order of
    the fields in ``ddl``; with ``beside``, it takes (text, value of that column) pairs. Rows keep
    their partition; nothing is shuffled.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() != name.lower()]
    fed = fresh_name(df, "fed")
    more = [] if beside is None else [beside.alias(f"{fed}_beside")]
    source = df.select(*[df[c] for c in kept], df[text].cast("string").cast("binary").alias(fed), *more)
    out = df.select(*[df[c] for c in kept]).schema.add(name, StructType.fromDDL(ddl))
    paired = bool(more)
    struct = to_arrow_schema(out).field(name).type
    fields = [struct.field(i) for i in range(struct.num_fields)]

    def run(batches):
        for batch in batches:
            columns = [[] for _ in fields]
            others = iter(batch.column(len(kept) + 1).to_pylist() if paired else ())
            for block in blocks(batch.column(len(kept)).to_pylist()):
                for row in compute([(t, next(others)) for t in block] if paired else block):
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
            made = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=fields)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), made], names=[*kept, name])

    return source.mapInArrow(run, out)


__all__ = ["BLOCK_BYTES", "Workspace", "alnum_words", "blocks", "fresh_name", "sha256_of", "space_words", "table", "with_struct"]


def sha256_of(joined) -> F.Column:
    """Lowercase hex SHA-256 of a string column; null counts as empty."""
    return F.sha2(F.coalesce(joined, F.lit("")).cast("binary"), 256)
