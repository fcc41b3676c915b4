"""Sample tables: column binding, null policy, scalar columns, persistence."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from gradloom.functions.convert import Conversion, float_vector
from gradloom.plans.net import Net


def project(df: DataFrame, **columns: str | Column) -> DataFrame:
    """A table with exactly the named columns, for example `project(df, data="embedding", label="label")`."""
    return df.select(*[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()])


def bind_inputs(df: DataFrame, net: Net, keep: Sequence[str] = (), exact: bool = False) -> DataFrame:
    """The columns a net reads, by name. `exact` also refuses columns the net does not know."""
    wanted = net.columns()
    missing = [name for name in wanted if name not in df.columns]
    unknown = [name for name in df.columns if name not in wanted and name not in keep]
    if missing or (exact and unknown):
        raise ValueError(f"net {net.name}: missing columns {missing}, unknown columns {unknown if exact else []}")
    return df.select(*keep, *[name for name in wanted if name not in keep])


def bind_batch(df: DataFrame, net: Net, keep: Sequence[str] = (), round_no: int = 0) -> DataFrame:
    """`keep` and the columns of the net's batches; what a preparation draws is drawn for this round."""
    drawn = {name: column for i in net.inputs if i.prepare and i.prepare.draw for name, column in zip(i.prepare.columns, i.prepare.draw(round_no))}
    columns = net.batch_columns()
    bound = bind_inputs(df, net, keep)
    return bound.select(*keep, *[drawn[name].alias(name) if name in drawn else F.col(name) for name in columns if name not in keep])


def widen(df: DataFrame, tasks: int) -> DataFrame:
    """Spread a table over `tasks` tasks: for heavy per-row work on a table that is small in bytes."""
    return df.repartition(tasks)


def convert_inputs(df: DataFrame, net: Net, keep: Sequence[str] = (),
                   conversions: Mapping[str, Conversion] | None = None) -> DataFrame:
    """Bind a table to a net and convert each input to a vector of its shape; labels become `bigint`.

    `conversions` replaces the default conversion of single inputs. Inputs with a batch preparation stay raw.
    """
    bound, columns = bind_inputs(df, net, keep), {}
    for item in net.inputs:
        convert = (conversions or {}).get(item.name, float_vector)
        if item.label:
            columns[item.name] = F.col(item.name).cast("bigint")
        elif item.prepare is None:
            columns[item.name] = convert(F.col(item.name), df.schema[item.name].dataType, item.shape)
    return bound.withColumns(columns)


def apply_null_policy(df: DataFrame, names: Sequence[str], on_null: str = "raise") -> DataFrame:
    """Null inputs are never passed on: `raise` fails the job, `drop` removes the rows (see `null_counts`)."""
    if on_null == "drop":
        return df.dropna(subset=list(names))
    if on_null != "raise":
        raise ValueError(f"on_null is raise or drop, not {on_null}")
    checked = {name: F.when(F.col(name).isNull(), F.raise_error(F.lit(f"column {name} is null")))
               .otherwise(F.col(name)) for name in names}
    return df.withColumns(checked)


def null_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row: how many nulls each column holds."""
    return df.agg(*[F.count_if(F.col(name).isNull()).alias(name) for name in names])


def with_scalar(df: DataFrame, name: str, one_value: DataFrame) -> DataFrame:
    """Attach the single value of a one-row table to every row, as a scalar subquery: no join, computed once.

    For values whose size is fixed by a net or an image shape, such as a mean vector or a layer's weights.
    """
    return df.withColumn(name, one_value.scalar())


@contextmanager
def persisted(*tables: DataFrame) -> Iterator[tuple[DataFrame, ...]]:
    """Keep tables in memory, spilling to disk, for the length of a block."""
    try:
        yield tuple(t.persist(StorageLevel.MEMORY_AND_DISK) for t in tables)
    finally:
        for t in tables:
            t.unpersist()
