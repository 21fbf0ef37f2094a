"""Media columns: Netpbm and BMP images in a binary column.

Images are decoded to numpy arrays, resized by areas with integral images, cut
into tiles that are stored as NPY files' bytes, and given difference hashes.
All work is by row, in Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifloom.llm.durable import ship

#: Output batches are closed at about so many bytes.
BATCH_BYTES = 8 << 20


def encode_netpbm(image: np.ndarray) -> bytes:
    """P6 for height x width x 3, P5 for height x width; 8-bit samples."""
    kind = b"P6" if image.ndim == 3 else b"P5"
    return b"%s\n%d %d\n255\n" % (kind, image.shape[1], image.shape[0]) + np.ascontiguousarray(image, np.uint8).tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """Uncompressed 24-bit BMP of a height x width x 3 image: rows from the bottom, blue first, padded to 4 bytes."""
    height, width, _ = image.shape
    rows = np.zeros((height, (3 * width + 3) // 4 * 4), np.uint8)
    rows[:, : 3 * width] = image[::-1, :, ::-1].reshape(height, 3 * width)
    head = struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54)
    return head + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


_FIELD = re.compile(rb"(?:\s|#[^\n]*\n)*([0-9]+)")


def _decode_netpbm(data: bytes) -> np.ndarray:
    kind, at, sizes = data[1:2], 2, []
    for _ in range(2 if kind in b"14" else 3):
        found = _FIELD.match(data, at)
        if not found:
            raise ValueError("incomplete Netpbm header")
        sizes.append(int(found[1]))
        at = found.end()
    width, height = sizes[:2]
    peak = sizes[2] if len(sizes) > 2 else 1
    if width < 1 or height < 1 or not 0 < peak < 65536:
        raise ValueError("Netpbm header out of range")
    planes = 3 if kind in b"36" else 1
    n = width * height * planes
    if kind in b"14":  # 0 is white in bitmaps
        if kind == b"1":
            bits = np.frombuffer(re.sub(rb"#[^\n]*|\s", b"", data[at:])[:n], np.uint8) - np.uint8(48)
            if (bits > 1).any():
                raise ValueError("Netpbm bits are 0 or 1")
        else:
            packed = np.frombuffer(data, np.uint8, offset=at + 1)[: (width + 7) // 8 * height]
            bits = np.unpackbits(packed.reshape(height, -1), axis=1)[:, :width].ravel()
        samples = (1 - bits) * 255
    elif kind in b"23":
        samples = np.array([int(x) if len(x) < 9 else -1 for x in re.sub(rb"#[^\n]*", b"", data[at:]).split()[:n]], np.int64)
    else:
        samples = np.frombuffer(data, ">u2" if peak > 255 else np.uint8, offset=at + 1)[:n]
    if len(samples) < n:
        raise ValueError("Netpbm samples are missing")
    if kind not in b"14" and (int(samples.max()) > peak or int(samples.min()) < 0):
        raise ValueError("Netpbm samples are above the maximum")
    if kind not in b"14" and peak != 255:
        samples = (samples.astype(np.int64) * 255 + peak // 2) // peak
    shape = (height, width, 3) if planes == 3 else (height, width)
    return samples.astype(np.uint8).reshape(shape)


def _decode_bmp(data: bytes) -> np.ndarray:
    start, head, width, height, _, depth, packing = struct.unpack_from("<I I i i H H I", data, 10)
    if packing or depth not in (8, 24, 32) or width < 1 or height == 0:
        raise ValueError("only uncompressed BMP of 8, 24 or 32 bits")
    stride = (width * depth // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, count=stride * abs(height), offset=start).reshape(abs(height), stride)
    if height > 0:
        rows = rows[::-1]
    if depth == 8:
        colours = np.frombuffer(data, np.uint8, count=min((start - 14 - head) // 4, 256) * 4, offset=14 + head).reshape(-1, 4)
        return colours[rows[:, :width]][:, :, 2::-1].copy()
    return rows[:, : width * depth // 8].reshape(abs(height), width, depth // 8)[:, :, 2::-1].copy()


def decode_image(data: bytes) -> np.ndarray:
    """uint8 array, height x width or height x width x 3, of Netpbm (P1 to P6) or BMP bytes; ValueError for others."""
    try:
        if data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
            return _decode_netpbm(data)
        if data[:2] == b"BM":
            return _decode_bmp(data)
    except (struct.error, IndexError, OverflowError, MemoryError) as problem:
        raise ValueError(str(problem)) from problem
    raise ValueError("neither Netpbm nor BMP")


def _edge_sums(table: np.ndarray, n: int) -> np.ndarray:
    """Rows of a cumulative table at n + 1 equally spaced, fractional edges."""
    edges = np.linspace(0, table.shape[0] - 1, n + 1)
    low = np.minimum(edges.astype(np.int64), table.shape[0] - 2)
    part = (edges - low).reshape(-1, *[1] * (table.ndim - 1))
    return table[low] * (1 - part) + table[low + 1] * part


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal areas, as float64, from the integral image at fractional edges."""
    table = np.zeros((image.shape[0] + 1, image.shape[1] + 1, *image.shape[2:]))
    np.cumsum(np.cumsum(image, axis=0, dtype=np.float64), axis=1, out=table[1:, 1:])
    across = _edge_sums(np.swapaxes(_edge_sums(table, height), 0, 1), width)
    sums = np.diff(np.diff(np.swapaxes(across, 0, 1), axis=0), axis=1)
    return sums * (height * width / (image.shape[0] * image.shape[1]))


def grey(image: np.ndarray) -> np.ndarray:
    return image.astype(np.float64) if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])


def difference_hash(image: np.ndarray, side: int = 8) -> str:
    """side x side bits, each whether a cell of the resized grey image is darker than the next, as hex digits."""
    small = area_resize(grey(image), side, side + 1)
    return np.packbits(small[:, 1:] > small[:, :-1] + 1e-9).tobytes().hex()


def npy_bytes(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def thumbnail_tiles(image: np.ndarray, width: int = 32, tile: int = 32) -> list[bytes]:
    """The image resized to ``width`` columns with its proportions, cut into tiles of up to ``tile`` rows, as NPY bytes."""
    height = max(1, round(image.shape[0] * width / image.shape[1]))
    small = np.clip(np.rint(area_resize(image, height, width)), 0, 255).astype(np.uint8)
    return [npy_bytes(small[y : y + tile]) for y in range(0, height, tile)]


_IMAGE = pa.schema([("media_height", pa.int32()), ("media_width", pa.int32()), ("feature", pa.string()), ("tiles", pa.list_(pa.binary())), ("media_error", pa.string())])
_PAYLOAD = pa.schema([("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("media_format", pa.string()), ("media", pa.binary())])


def _batches(rows: Iterator[tuple[tuple, int]], kept: list[pa.Array], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of the kept columns beside computed ones; each row comes with its bytes."""
    made: list[tuple] = []
    weight, first = 0, 0

    def close() -> pa.RecordBatch:
        new = [pa.array(x, t) for x, t in zip(zip(*made, strict=True), schema.types[len(kept) :], strict=True)]
        return pa.RecordBatch.from_arrays([k.slice(first, len(made)) for k in kept] + new, schema=schema)

    for row, size in rows:
        made.append(row)
        weight += size
        if weight >= BATCH_BYTES:
            yield close()
            first += len(made)
            made, weight = [], 0
    if made:
        yield close()


def _apply(df: DataFrame, source: Column, keep: list[str], added: pa.Schema, each) -> DataFrame:
    """``each`` of every value of ``source``, beside the columns ``keep``, which are selected by position."""
    from pyspark.sql.pandas.types import from_arrow_schema
    from pyspark.sql.types import StructType

    ship(df.sparkSession)
    narrow = df.select(*keep, source)
    names = [*narrow.columns[:-1], *added.names]
    narrow = narrow.toDF(*[f"c{k}" for k in range(len(narrow.columns))])  # by place, so that any name will do
    out = StructType([*narrow.schema.fields[:-1], *from_arrow_schema(added).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.columns[:-1]
            names = batch.schema.names[:-1]
            schema = pa.schema([*zip(names, [k.type for k in kept], strict=True), *added])
            yield from _batches((each(x.as_py()) for x in batch.column(len(names))), kept, schema)

    return narrow.mapInArrow(run, out).toDF(*names)


def text_media(text: str | None) -> tuple[bytes, str, bytes]:
    """(payload, format, stored form) of a text.

    The payload is the UTF-8 text (null: empty) with bytes 32 up to a positive
    multiple of 192. Each 192 bytes are one row of 64 RGB pixels; images of an
    even number of rows are stored as BMP, the others as binary Netpbm.
    """
    raw = (text or "").encode("utf-8", "replace")
    payload = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
    image = np.frombuffer(payload, np.uint8).reshape(-1, 64, 3)
    if image.shape[0] % 2:
        return payload, "ppm", encode_netpbm(image)
    return payload, "bmp", encode_bmp(image)


def media_from_texts(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Texts stored as lossless images.

    Returns the columns ``keep`` and ``n_bytes`` (of the text), ``media``,
    ``media_format``, ``media_bytes`` and ``media_sha256`` (of the stored
    form), and ``payload_bytes``, ``payload_sha256`` and ``tail_crc32`` (of the
    last 16 bytes), which are computed from the stored bytes read back. Null
    and empty texts give a row of 64 spaces; equal texts give equal values;
    repeated rows stay; an empty table gives an empty table. Other columns are
    not read, so their names can't clash.
    """

    def each(value: str | None) -> tuple[tuple, int]:
        payload, kind, media = text_media(value)
        back = decode_image(media).tobytes()
        if back != payload:
            raise ValueError("the stored image doesn't give back its text")
        size = len((value or "").encode("utf-8", "replace"))
        return (size, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), kind, media), len(media)

    return _apply(docs, F.col(text), keep, _PAYLOAD, each)


def media_features(df: DataFrame, media: str, keep: list[str]) -> DataFrame:
    """Decode the binary column ``media`` and describe each image.

    Returns the columns ``keep`` and ``media_height``, ``media_width``,
    ``feature`` (difference hash, 16 hex digits), ``tiles`` (NPY files' bytes)
    and ``media_error``. A null value gives nulls; bytes that can't be decoded
    give nulls and the reason in ``media_error``.
    """

    def each(value: bytes | None) -> tuple[tuple, int]:
        if value is None:
            return (None, None, None, None, None), 1
        try:
            image = decode_image(value)
        except ValueError as problem:
            return (None, None, None, None, str(problem)), 1
        tiles = thumbnail_tiles(image)
        return (image.shape[0], image.shape[1], difference_hash(image), tiles, None), sum(map(len, tiles))

    return _apply(df, F.col(media), keep, _IMAGE, each)


def write_tiles(features: DataFrame, path: str, keep: list[str]) -> None:
    """One row for each tile (``keep``, ``tile_no``, ``npy``) as Parquet at ``path``, a place that all executors reach."""
    features.select(*keep, F.posexplode("tiles").alias("tile_no", "npy")).write.parquet(path)
