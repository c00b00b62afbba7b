"""What the text operators share: word splitting and bounded Arrow passes over whole texts.

Every operator reads ``id`` and ``text`` and ignores other columns; names are
arguments. NULL and empty texts have no words. Repeated rows each get a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from setwise.llm.store import prepare

# Texts are handed to a function in parts of about so many characters, so that
# a task's memory does not depend on how many rows an Arrow batch holds.
PART_CHARS = 4_000_000

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Bytes 0x00-0x7F other than letters and digits separate words; A-Z become a-z;
# bytes of non-ASCII characters stay.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def space_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8, with A-Z lowered on request."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def plain_words(text: str | None) -> list[bytes]:
    """Lowered words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN).split() if text else []


def parts_of(batch: pa.RecordBatch, text_at: int, most: int = PART_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``most`` bytes of text each, one row at least."""
    start, held = 0, 0
    sizes = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_pylist()
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def add_from_text(
    df: DataFrame, work: Callable[[], Callable[[list], Sequence[Sequence]]], fields: str, keep: Sequence[str],
    text: str = "text", most: int = PART_CHARS,
) -> DataFrame:
    """``keep`` columns and those that a function of the texts gives, in one narrow pass.

    ``work`` is called once a task and returns the function: from a list of
    texts to one list (or Arrow array) per field of ``fields``.
    """
    if clash := set(keep) & set(StructType.fromDDL(fields).names):
        raise ValueError(f"columns to keep have names of the result: {sorted(clash)}")
    prepare(df.sparkSession)
    kept = df.select(*[f"`{c}`" for c in keep]).schema
    added = StructType.fromDDL(fields)
    schema = StructType(kept.fields + added.fields)
    extra_text = text not in keep
    n, at = len(keep), len(keep) if extra_text else list(keep).index(text)
    types = to_arrow_schema(added).types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = work()
        for batch in batches:
            for part in parts_of(batch, at, most):
                made = fn(part.column(at).to_pylist())
                new = [x if isinstance(x, pa.Array) else pa.array(x, type=t) for x, t in zip(made, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *new], names=schema.names)

    wanted = [*keep, text] if extra_text else list(keep)
    return df.select(*[f"`{c}`" for c in wanted]).mapInArrow(run, schema)
