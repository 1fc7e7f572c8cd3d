"""Python steps over ordered groups: a state that is fed rows, or a whole small group at once.

Groups are dealt by a shuffle on their keys, sorted where they are, and fed batch by batch, so many
small groups share a task without a call each, and a long group is never held whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string


class Steps(Protocol):
    """Takes a group's rows in order, and gives the rows that are settled; end() gives the rest."""

    def feed(self, rows: pd.DataFrame) -> list[tuple]: ...

    def end(self) -> list[tuple]: ...


def names(schema: str) -> list[str]:
    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    return kind.names


def frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    """Rows as a frame of objects, so that integers beside nulls stay integers."""
    out = zip(*rows, strict=True) if rows else [()] * len(columns)
    return pd.DataFrame({c: pd.Series(list(v), dtype=object) for c, v in zip(columns, out, strict=True)})


def starts(b: pd.DataFrame, keys: list[str]) -> list[int]:
    """Where the keys change (nulls are equal), with 0 and the number of rows."""
    new = np.zeros(len(b), bool)
    for k in keys:
        v, missing = b[k].to_numpy(), b[k].isna().to_numpy()
        new[1:] |= (missing[1:] != missing[:-1]) | (~missing[1:] & ~missing[:-1] & (v[1:] != v[:-1]))
    return [0, *np.flatnonzero(new).tolist(), len(b)] if len(b) else [0]


def runs(b: pd.DataFrame, keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Slices of rows with equal keys (nulls are equal), in order."""
    cuts = starts(b, keys)
    for i, j in zip(cuts, cuts[1:], strict=False):
        part = b.iloc[i:j]
        yield tuple(None if pd.isna(x) else x for x in part[keys].iloc[0].tolist()), part


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with each group in one partition.

    By a hash of the keys, not by the keys: Spark leaves out a repartition by what a join before it was
    partitioned by, and then may turn that join into a broadcast, which scatters the groups, for
    mapInPandas asks for no partitioning.
    """
    return df.repartition(F.xxhash64(*keys))


def stepped(df: DataFrame, keys: list[str], order: list[str], start: Callable[[tuple], Steps], schema: str) -> DataFrame:
    """Each group's rows, sorted by order, fed to a state of its own; the result has keys and the columns of schema, which Steps gives."""
    columns = names(schema)
    kinds = dict(df.dtypes)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: tuple | None = None
        state: Steps | None = None
        for b in batches:
            out: list[tuple] = []
            for key, part in runs(b, keys):
                if key != at:
                    if state is not None:
                        out += [at + r for r in state.end()]
                    at, state = key, start(key)
                out += [key + r for r in state.feed(part)]
            yield frame(out, [*keys, *columns])
        if state is not None:
            yield frame([at + r for r in state.end()], [*keys, *columns])

    typed = ", ".join(f"{k} {kinds[k]}" for k in keys)
    return dealt(df, keys).sortWithinPartitions(*keys, *order).mapInPandas(work, f"{typed}, {schema}")


class RowSteps(Protocol):
    """Steps that take rows as tuples."""

    def feed(self, rows: list[tuple]) -> list[tuple]: ...

    def end(self) -> list[tuple]: ...


def cells(column: pd.Series, kind: str) -> list:
    """A column's values, None for what pandas calls missing; beside those pandas makes integers doubles, here they are integers again."""
    missing = np.flatnonzero(column.isna().to_numpy()).tolist()
    if not missing:
        return column.tolist()
    out = column.fillna(0).astype("int64").tolist() if kind in ("tinyint", "smallint", "int", "bigint") else column.tolist()
    for k in missing:
        out[k] = None
    return out


def listed(df: DataFrame, keys: list[str], order: list[str], columns: list[str], start: Callable[[tuple], RowSteps], schema: str) -> DataFrame:
    """stepped() whose rows are tuples of columns, None for nulls: a batch is turned into tuples once, so a group of a few rows costs no more than these."""
    given = names(schema)
    kinds = dict(df.dtypes)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: tuple | None = None
        state: RowSteps | None = None
        for b in batches:
            out: list[tuple] = []
            rows = list(zip(*(cells(b[c], kinds[c]) for c in columns), strict=True))
            key_of = list(zip(*(cells(b[k], kinds[k]) for k in keys), strict=True))
            cuts = starts(b, keys)
            for i, j in zip(cuts, cuts[1:], strict=False):
                if key_of[i] != at:
                    if state is not None:
                        out += [at + r for r in state.end()]
                    at, state = key_of[i], start(key_of[i])
                out += [at + r for r in state.feed(rows[i:j])]
            yield frame(out, [*keys, *given])
        if state is not None:
            yield frame([at + r for r in state.end()], [*keys, *given])

    typed = ", ".join(f"{k} {kinds[k]}" for k in keys)
    needed = list(dict.fromkeys([*keys, *order, *columns]))
    return dealt(df.select(needed), keys).sortWithinPartitions(*keys, *order).mapInPandas(work, f"{typed}, {schema}")


class _Held:
    def __init__(self, work: Callable[[pd.DataFrame], list[tuple]]):
        self.work, self.rows = work, []

    def feed(self, rows: pd.DataFrame) -> list[tuple]:
        self.rows.append(rows)
        return []

    def end(self) -> list[tuple]:
        return self.work(pd.concat(self.rows, ignore_index=True))


def whole(df: DataFrame, keys: list[str], order: list[str], work: Callable[[pd.DataFrame], list[tuple]], schema: str) -> DataFrame:
    """work over each group as one frame; for groups that are small by their nature, as the rows of a frame of play."""
    return stepped(df, keys, order, lambda key: _Held(work), schema)


class _Listed:
    def __init__(self, work: Callable[[list[tuple]], list[tuple]]):
        self.work, self.rows = work, []

    def feed(self, rows: list[tuple]) -> list[tuple]:
        self.rows += rows
        return []

    def end(self) -> list[tuple]:
        return self.work(self.rows)


def together(df: DataFrame, keys: list[str], order: list[str], columns: list[str], work: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """whole() with each group as a list of tuples of columns; for many groups of a few rows."""
    return listed(df, keys, order, columns, lambda key: _Listed(work), schema)


def value(x: Any) -> Any:
    """A cell's value, None for what pandas calls missing."""
    return None if pd.isna(x) else x
