"""Which adapters an input goes to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def classify(value: dict) -> str:
    """Kind of a JSON input that names none."""
    if "text" in value or "annotation" in value:
        return "content"
    if "file_path" in value:
        return "extract-file"
    raise ValueError("can't tell the kind of this input: it has neither text, annotation nor file_path")


def classify_column(value: Column) -> Column:
    """The same for a column of JSON objects; null where it can't be told."""
    keys = F.json_object_keys(value)
    has = lambda *k: F.arrays_overlap(keys, F.array(*map(F.lit, k)))
    return F.when(has("text", "annotation"), "content").when(has("file_path"), "extract-file")


def matching(adapters: Sequence, kind: str) -> list:
    """All adapters of a kind, in the order in which they were registered; none is an error."""
    found = [a for a in adapters if a.kind == kind]
    if not found:
        raise LookupError(f"no adapter for input kind {kind}")
    return found
