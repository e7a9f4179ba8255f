"""Walking through the groups of sorted rows inside a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from maskline.plans.session import ship


def each_group(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each value of key (nulls are one), of batches that are sorted by it; a group may span batches."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        if rest is not None:
            t = pa.concat_tables([rest, t])
        keys = t[key].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        at = 0
        for c in (np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist():
            yield t.slice(at, c - at)
            at = c
        rest = t.slice(at)
    if rest is not None and len(rest):
        yield rest


#: Groups of at most so many rows are gone through side by side, so many rows of them at once.
SMALL, LOT = 256, 32_768


def lots(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups, about LOT rows of them at once, of batches that are sorted by key: (rows, places where groups begin and the end)."""
    held, n = [], 0

    def cut(t: pa.Table) -> np.ndarray:
        keys = t[key].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])

    for b in batches:
        held.append(pa.Table.from_batches([b]))
        n += len(b)
        if n >= LOT:
            t = pa.concat_tables(held).combine_chunks()
            at = cut(t)
            if len(at) > 2:  # the last group may go on
                yield t.slice(0, at[-2]), at[:-1]
                t = t.slice(at[-2])
            held, n = [t], 0  # looked at again after as many rows
    if held and (t := pa.concat_tables(held).combine_chunks()).num_rows:
        yield t, cut(t)


def numbers(t: pa.Table, c: str) -> np.ndarray:
    """A column as floats, null: NaN; dates and texts as they are."""
    if pa.types.is_boolean(t[c].type):
        return t[c].cast(pa.int8()).cast(pa.float64()).to_numpy()
    return t[c].cast(pa.float64()).to_numpy() if pa.types.is_floating(t[c].type) or pa.types.is_integer(t[c].type) else t[c].to_numpy()


def side_by_side(at: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[int]]:
    """(first rows and sizes of the small groups, those of like size together and by size; places in `at` of the large ones). What is
    padded to the largest of its like is four times as large as the rows at most."""
    sizes, out, least = np.diff(at), [], 0
    for most in (4, 16, 64, SMALL):
        own = np.flatnonzero((sizes > least) & (sizes <= most))
        if len(own):
            own = own[np.argsort(sizes[own], kind="stable")]
            out.append((at[:-1][own], sizes[own]))
        least = most
    return out, np.flatnonzero(sizes > SMALL).tolist()


def kept_rows(df: DataFrame, key: str, order: list[Column], choose: Callable[[dict[str, np.ndarray]], list[int]], read: list[str], together: Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """The rows of each group that `choose` names: it gets the columns `read` as arrays, in the given order, and returns places.

    together does the same for many small groups at once: it gets the columns, first rows and sizes of groups (by size), and returns rows."""
    ship(df.sparkSession)

    def each_lot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in lots(batches, key):
            columns = {c: numbers(t, c) for c in read}
            small, large = side_by_side(at)
            rows = [together(columns, first, sizes) for first, sizes in small] if together else []
            for g in large if together else range(len(at) - 1):
                rows.append(at[g] + np.array(choose({c: v[at[g] : at[g + 1]] for c, v in columns.items()}), np.int64))
            yield from t.take(pa.array(np.sort(np.concatenate(rows)).astype(np.int64))).combine_chunks().to_batches(4096)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(each_lot, df.schema)
