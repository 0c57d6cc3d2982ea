"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.operators.graph import components
from attestra.sources.shared import table_path, written

__all__ = ["WORD_GAP", "components", "field", "link_roots", "table_path", "type_of", "utf8", "written"]

#: Bytes that count as white space between words: space and \t \n \v \f \r.
WORD_GAP = "[\\x20\\x09-\\x0D]+"


def field(name: str) -> Column:
    """A top-level column, whatever characters its name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def type_of(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary()).to_pylist()


def link_roots(parent: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Union of the sets of ``left[i]`` and ``right[i]`` for all i, in place; the smallest index leads a set."""
    while left.size:
        a, b = parent[left], parent[right]
        apart = a != b
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        if not left.size:
            return
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            above = parent[parent]
            if np.array_equal(above, parent):
                break
            parent[:] = above
