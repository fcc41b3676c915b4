"""Arrow batches to NumPy arrays and back, as used inside tasks."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from gradloom.plans.net import Net
from gradloom.sources.files import open_path

#: Values per row of the weights table.
CHUNK = 4096
WEIGHTS_SCHEMA = "layer string, blob int, shape array<int>, chunk int, values array<double>"
WEIGHTS_ARROW = pa.schema([("layer", pa.string()), ("blob", pa.int32()), ("shape", pa.list_(pa.int32())),
                           ("chunk", pa.int32()), ("values", pa.list_(pa.float64()))])

Blobs = dict[tuple[str, int], np.ndarray]


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """A column of numbers, numeric lists or bytes as a (rows, width) array; views the Arrow buffer where possible."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        raise ValueError("null input")
    if pa.types.is_large_binary(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_list(column.type):
        column = column.cast(pa.list_(column.type.value_type))
    rows = len(column)
    if pa.types.is_binary(column.type):
        offsets = np.frombuffer(column.buffers()[1], "i4", rows + 1, column.offset * 4) if rows else np.zeros(1, "i4")
        data = column.buffers()[2]
        flat = np.frombuffer(data, "u1", offsets[-1])[offsets[0]:] if data is not None else np.empty(0, "u1")
        even = (np.diff(offsets) == width).all()
    elif pa.types.is_list(column.type):
        flat = column.flatten().to_numpy(zero_copy_only=False)
        even = (np.diff(column.offsets.to_numpy()) == width).all()
    else:
        flat, even = column.to_numpy(zero_copy_only=False), width == 1
    if not even or len(flat) != rows * width:
        raise ValueError(f"every row must hold {width} values")
    return flat.reshape(rows, width)


def list_column(values: np.ndarray, element: pa.DataType) -> pa.Array:
    """A (rows, ...) array as one list per row."""
    rows = len(values)
    width = values.size // rows if rows else 0
    flat = pa.array(np.ascontiguousarray(values).reshape(-1).astype(element.to_pandas_dtype(), copy=False))
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype="i4") * width), flat)


def feed(net: Net, columns: dict[str, pa.Array], rows: slice | None = None) -> dict[str, np.ndarray]:
    """The net's inputs as (rows, *shape) arrays, labels as integers."""
    if rows is not None:
        columns = {name: column.slice(rows.start, rows.stop - rows.start) for name, column in columns.items()}
    out = {}
    for item in net.inputs:
        column = columns[item.name]
        if item.label:
            out[item.name] = matrix(column, 1)[:, 0].astype("i8")
            continue
        if item.prepare:
            extra = [matrix(columns[c], 1)[:, 0] for c in item.prepare.columns]
            values = item.prepare.run(matrix(column, item.prepare.width), *extra)
        else:
            values = matrix(column, int(np.prod(item.shape)))
        out[item.name] = values.astype(net.dtype, copy=False).reshape(len(values), *item.shape)
    return out


def pack(blobs: Blobs, **constants: pa.Scalar) -> pa.Table:
    """Blobs as rows of the weights table, `constants` in front."""
    layers, numbers, shapes, chunks, values = [], [], [], [], []
    for (layer, blob), array in sorted(blobs.items()):
        flat = np.asarray(array, "f8").reshape(-1)
        for at in range(0, len(flat), CHUNK):
            layers.append(layer)
            numbers.append(blob)
            shapes.append(list(array.shape))
            chunks.append(at // CHUNK)
            values.append(flat[at:at + CHUNK])
    table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip((layers, numbers, shapes, chunks, values), WEIGHTS_ARROW)],
                                 schema=WEIGHTS_ARROW)
    for name, value in reversed(constants.items()):
        table = table.add_column(0, name, pa.array([value.as_py()] * len(table), value.type))
    return table


def unpack(table: pa.Table, dtype: str = "float64") -> Blobs:
    """Rows of the weights table as arrays; the rows may come in any order but must be complete."""
    parts: dict[tuple[str, int], dict[int, np.ndarray]] = {}
    shapes: dict[tuple[str, int], tuple[int, ...]] = {}
    values = table.column("values").combine_chunks()
    keys = table.select(["layer", "blob", "shape", "chunk"]).to_pylist()
    for row, key in enumerate(keys):
        name = key["layer"], key["blob"]
        parts.setdefault(name, {})[key["chunk"]] = values[row].values.to_numpy(zero_copy_only=False)
        if shapes.setdefault(name, tuple(key["shape"])) != tuple(key["shape"]):
            raise ValueError(f"weights of {name} differ in shape")
    out = {}
    for name, chunks in parts.items():
        flat = np.concatenate([chunks[c] for c in sorted(chunks)]).astype(dtype)
        if flat.size != int(np.prod(shapes[name])):
            raise ValueError(f"weights of {name} are incomplete")
        out[name] = flat.reshape(shapes[name])
    return out


@dataclass(frozen=True)
class StoredVector:
    """A vector of a fixed size, such as a mean image, written once in the shared folder as (chunk, values) rows."""

    files: tuple[str, ...]
    size: int

    def load(self, dtype: str = "float64") -> np.ndarray:
        """The values, read once per Python worker."""
        return _load_vector(self.files, self.size, dtype)


@functools.lru_cache(maxsize=4)
def _load_vector(files: tuple[str, ...], size: int, dtype: str) -> np.ndarray:
    table = pa.concat_tables(pq.read_table(open_path(f)) for f in files).sort_by("chunk")
    values = table.column("values").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(dtype)
    if len(values) != size:
        raise ValueError(f"the stored vector has {len(values)} values, not {size}")
    return values


def check_weights(net: Net, weights: Blobs) -> None:
    """Exactly the net's blobs, in their shapes; momentum rows aside."""
    check_shapes(net, {name: array.shape for name, array in weights.items() if not name[0].endswith("/momentum")})


def check_shapes(net: Net, found: dict[tuple[str, int], tuple[int, ...]]) -> None:
    expected = {(p.layer, p.blob): tuple(p.shape) for p in net.params()}
    if found != expected:
        raise ValueError(f"weights {found} do not fit net {net.name}, which has {expected}")
