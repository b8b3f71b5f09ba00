"""PNG pixels in Arrow functions: 8-bit RGB without interlace is read and written, all else is rejected."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"
IMAGE = "struct<width:int,height:int,pixels:binary,error:string>"


class BadImage(ValueError):
    pass


def _chunks(data: bytes):
    at = len(SIGNATURE)
    while at + 8 <= len(data):
        (size,) = struct.unpack_from(">I", data, at)
        yield data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        at += 12 + size


def decode(data: bytes):
    """(width, height, numpy rows of width * 3 bytes)."""
    import numpy as np

    if not data or not data.startswith(SIGNATURE):
        raise BadImage("no PNG signature")
    head, packed = None, []
    for name, body in _chunks(data):
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"IDAT":
            packed.append(body)
        elif name == b"IEND":
            break
    if head is None:
        raise BadImage("no header")
    width, height, depth, colour, _, _, interlace = head
    if (depth, colour, interlace) != (8, 2, 0):
        raise BadImage("only 8-bit RGB without interlace")
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise BadImage(f"damaged pixels: {e}") from None
    stride = 3 * width
    if len(raw) != height * (stride + 1):
        raise BadImage("wrong number of pixels")
    lines = np.frombuffer(raw, dtype=np.uint8).reshape(height, stride + 1)
    out = np.zeros((height + 1, width + 1, 3), dtype=np.uint8)  # a black row above and column to the left
    for y in range(height):
        kind, line = int(lines[y, 0]), lines[y, 1:].reshape(width, 3)
        above, here = out[y], out[y + 1]
        if kind == 0:
            here[1:] = line
        elif kind == 2:
            here[1:] = line + above[1:]
        elif kind == 1:
            here[1:] = np.cumsum(line, axis=0, dtype=np.uint64).astype(np.uint8)
        elif kind == 3:
            for x in range(width):
                here[x + 1] = line[x] + ((here[x].astype(np.uint16) + above[x + 1]) >> 1).astype(np.uint8)
        elif kind == 4:
            for x in range(width):
                a, b, c = (v.astype(np.int16) for v in (here[x], above[x + 1], above[x]))
                # distances of left + up - corner to left, up and corner
                da, db, dc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
                best = np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))
                here[x + 1] = line[x] + best.astype(np.uint8)
        else:
            raise BadImage(f"unknown filter {kind}")
    return width, height, out[1:, 1:].reshape(height, stride)


def encode(width: int, height: int, pixels: bytes) -> bytes:
    """A PNG of plain rows."""
    stride = 3 * width
    raw = b"".join(b"\0" + pixels[y * stride : (y + 1) * stride] for y in range(height))

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 9)) + chunk(b"IEND", b"")


def crop(data: bytes, box) -> bytes | None:
    """The PNG of a box in whole pixels; None if it is empty."""
    width, height, rows = decode(data)
    x1, y1, x2, y2 = (int(v) for v in box)
    x1, y1, x2, y2 = max(0, x1), max(0, y1), min(width, x2), min(height, y2)
    if x2 <= x1 or y2 <= y1:
        return None
    return encode(x2 - x1, y2 - y1, rows[y1:y2, 3 * x1 : 3 * x2].tobytes())


def decoded(content: Column) -> Column:
    import pandas as pd

    def over(contents: pd.Series) -> pd.DataFrame:
        out = []
        for c in contents:
            try:
                w, h, rows = decode(c)
                out.append((w, h, rows.tobytes(), None))
            except BadImage as e:
                out.append((None, None, None, str(e)))
        frame = pd.DataFrame(out, columns=["width", "height", "pixels", "error"])
        return frame.astype({"width": "Int32", "height": "Int32"})

    over.__annotations__ = {"contents": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(over, IMAGE)(content)


def encoded(width: Column, height: Column, pixels: Column) -> Column:
    import pandas as pd

    def over(ws: pd.Series, hs: pd.Series, ps: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else encode(int(w), int(h), bytes(p)) for w, h, p in zip(ws, hs, ps)], dtype="object")

    over.__annotations__ = {"ws": pd.Series, "hs": pd.Series, "ps": pd.Series, "return": pd.Series}
    return F.pandas_udf(over, "binary")(width, height, pixels)


def cropped(content: Column, box: Column) -> Column:
    """The crop's PNG; null for empty boxes and images that can't be read."""
    import pandas as pd

    def one(c, b):
        try:
            return None if c is None or b is None else crop(c, b)
        except BadImage:
            return None

    def over(contents: pd.Series, boxes: pd.Series) -> pd.Series:
        return pd.Series([one(c, b) for c, b in zip(contents, boxes)], dtype="object")

    over.__annotations__ = {"contents": pd.Series, "boxes": pd.Series, "return": pd.Series}
    return F.pandas_udf(over, "binary")(content, box)
