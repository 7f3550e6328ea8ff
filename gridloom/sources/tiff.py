"""Uncompressed TIFF files, gray or with channels, as numpy arrays."""

from __future__ import annotations

import struct

import numpy as np

#: Fixed values of the format: tag numbers, field types, and sample formats.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, CHANNELS, ROWS_PER_STRIP, STRIP_BYTES, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 322, 323, 324, 325, 339
FIELD = {1: "B", 3: "H", 4: "I"}
KINDS = {"u": 1, "i": 2, "f": 3}
MOST_BYTES = (1 << 32) - (1 << 16)  # offsets have 32 bits


def is_tiff(content: bytes) -> bool:
    return content[:4] in (b"II*\0", b"MM\0*")


def header(height: int, width: int, channels: int, dtype: np.dtype, strip_rows: int) -> bytes:
    """What comes before the strips, which follow one another in row order, little-endian."""
    dtype = np.dtype(dtype)
    n_strips = -(-height // strip_rows)
    row_bytes = width * channels * dtype.itemsize
    sizes = [min(strip_rows, height - k * strip_rows) * row_bytes for k in range(n_strips)]
    if sum(sizes) > MOST_BYTES:
        raise ValueError(f"an image of {height} x {width} x {channels} is too large for one file")
    fields = [
        (WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8 * dtype.itemsize] * channels), (COMPRESSION, 3, [1]), (PHOTOMETRIC, 3, [2 if channels >= 3 else 1]),
        (STRIP_OFFSETS, 4, None), (CHANNELS, 3, [channels]), (ROWS_PER_STRIP, 4, [strip_rows]), (STRIP_BYTES, 4, sizes), (PLANAR, 3, [1]), (SAMPLE_FORMAT, 3, [KINDS[dtype.kind]] * channels),
    ]
    apart = 8 + 2 + 12 * len(fields) + 4  # values of more than four bytes lie after the directory
    lengths = [struct.calcsize(FIELD[kind]) * (n_strips if values is None else len(values)) for _, kind, values in fields]
    start = apart + sum(n for n in lengths if n > 4)
    offsets = [start + sum(sizes[:1]) * k for k in range(n_strips)]
    out, rest = struct.pack("<2sHIH", b"II", 42, 8, len(fields)), b""
    for tag, kind, values in fields:
        values = offsets if values is None else values
        data = struct.pack(f"<{len(values)}{FIELD[kind]}", *values)
        place = data.ljust(4, b"\0") if len(data) <= 4 else struct.pack("<I", apart + len(rest))
        rest += data if len(data) > 4 else b""
        out += struct.pack("<HHI", tag, kind, len(values)) + place
    return out + struct.pack("<I", 0) + rest


def encode(a: np.ndarray) -> bytes:
    a = a.astype(a.dtype.newbyteorder("<"))
    whole = a if a.ndim == 3 else a[:, :, None]
    return header(*whole.shape, whole.dtype, max(1, len(whole))) + np.ascontiguousarray(whole).tobytes()


def _directory(content: bytes) -> tuple[str, dict[int, list[int]]]:
    if not is_tiff(content):
        raise ValueError("not a TIFF file")
    order = "<" if content[:2] == b"II" else ">"
    (at,) = struct.unpack_from(f"{order}I", content, 4)
    (n,) = struct.unpack_from(f"{order}H", content, at)
    tags = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(f"{order}HHI", content, at + 2 + 12 * k)
        if kind in FIELD:
            size = struct.calcsize(FIELD[kind]) * count
            place = at + 2 + 12 * k + 8
            (place,) = (place,) if size <= 4 else struct.unpack_from(f"{order}I", content, place)
            tags[tag] = list(struct.unpack_from(f"{order}{count}{FIELD[kind]}", content, place))
    return order, tags


def size(content: bytes) -> tuple[int, int]:
    """(width, height) from the directory alone."""
    _, tags = _directory(content)
    return tags[WIDTH][0], tags[HEIGHT][0]


def decode(content: bytes) -> np.ndarray:
    """The first image: (height, width), or (height, width, channels) for several."""
    order, tags = _directory(content)
    if tags.get(COMPRESSION, [1])[0] != 1 or tags.get(PLANAR, [1])[0] != 1:
        raise ValueError("only uncompressed files with interleaved channels can be read")
    h, w, c = tags[HEIGHT][0], tags[WIDTH][0], tags.get(CHANNELS, [1])[0]
    kind = {v: k for k, v in KINDS.items()}[tags.get(SAMPLE_FORMAT, [1])[0]]
    bits = tags.get(BITS, [1])[0]
    if bits % 8:
        raise ValueError(f"samples of {bits} bits can't be read")
    dtype = np.dtype(f"{order}{kind}{bits // 8}")
    out = np.zeros((h, w, c), dtype)
    if TILE_OFFSETS in tags:
        tw, th = tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]
        across = -(-w // tw)
        for k, at in enumerate(tags[TILE_OFFSETS]):
            y, x = k // across * th, k % across * tw
            part = np.frombuffer(content, dtype, th * tw * c, at).reshape(th, tw, c)
            out[y : y + th, x : x + tw] = part[: h - y, : w - x]
    else:
        rows = min(h, tags.get(ROWS_PER_STRIP, [h])[0])
        for k, at in enumerate(tags[STRIP_OFFSETS]):
            n = min(rows, h - k * rows)
            out[k * rows : k * rows + n] = np.frombuffer(content, dtype, n * w * c, at).reshape(n, w, c)
    out = out.astype(dtype.newbyteorder("="))
    return out[:, :, 0] if c == 1 else out
