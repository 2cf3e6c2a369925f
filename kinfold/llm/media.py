"""Media columns: Netpbm and BMP to numpy arrays, area resize by integral images, NPY tiles, difference hashes."""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 64


def _header(raw: bytes, fields: int) -> tuple[list[int], int]:
    """Decimal fields after the two magic bytes ('#' starts a comment), and where the samples begin."""
    out: list[int] = []
    at = 2
    while len(out) < fields:
        while at < len(raw) and raw[at : at + 1].isspace():
            at += 1
        if raw[at : at + 1] == b"#":
            at = raw.index(b"\n", at) + 1
            continue
        end = at
        while end < len(raw) and raw[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("bad Netpbm header")
        out.append(int(raw[at:end]))
        at = end
    return out, at + 1


def decode_netpbm(raw: bytes) -> np.ndarray:
    """P1-P6 to an array of shape (height, width) or (height, width, 3); bitmaps give 0 for black, 255 for white."""
    kind = raw[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm image")
    bitmap, plain, colour = kind in (b"P1", b"P4"), kind in (b"P1", b"P2", b"P3"), kind in (b"P3", b"P6")
    head, at = _header(raw, 2 if bitmap else 3)
    width, height, most = head[0], head[1], 1 if bitmap else head[2]
    shape = (height, width, 3) if colour else (height, width)
    n = width * height * (3 if colour else 1)
    if not n or not 0 < most < 65536:
        raise ValueError("bad Netpbm size or depth")
    # bytes that the samples take at least; a plain sample of more than one digit is parted from the next
    if (height * ((width + 7) // 8) if kind == b"P4" else n if plain or most < 256 else 2 * n) > len(raw) - at + (1 if plain else 0):
        raise ValueError("truncated Netpbm image")
    if plain:
        body = b"\n".join(line.split(b"#")[0] for line in raw[at - 1 :].split(b"\n"))
        flat = np.array([int(c) for c in body.decode() if c in "01"] if bitmap else body.split(), np.int64)[:n]
    elif bitmap:
        rows = np.frombuffer(raw, np.uint8, height * ((width + 7) // 8), at).reshape(height, -1)
        flat = np.unpackbits(rows, axis=1)[:, :width].ravel()
    else:
        flat = np.frombuffer(raw, np.uint8 if most < 256 else ">u2", n, at)
    if len(flat) < n:
        raise ValueError("truncated Netpbm image")
    flat = flat.reshape(shape)
    if bitmap:
        return ((1 - flat) * 255).astype(np.uint8)
    return flat.astype(np.uint8 if most < 256 else np.uint16)


def encode_pgm(samples: np.ndarray) -> bytes:
    """Binary 8-bit PGM of a (height, width) array."""
    height, width = samples.shape
    return b"P5\n%d %d\n255\n" % (width, height) + samples.astype(np.uint8).tobytes()


def decode_bmp(raw: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8 (palette), 16, 24 or 32 bits, with channel masks where it has them, to (height, width, 3) RGB."""
    if raw[:2] != b"BM":
        raise ValueError("not a BMP image")
    at = int.from_bytes(raw[10:14], "little")
    head = int.from_bytes(raw[14:18], "little")
    width = int.from_bytes(raw[18:22], "little", signed=True)
    height = int.from_bytes(raw[22:26], "little", signed=True)
    bits, packed = int.from_bytes(raw[28:30], "little"), int.from_bytes(raw[30:34], "little")
    if head < 40 or bits not in (1, 4, 8, 16, 24, 32) or not (packed == 0 or packed == 3 and bits in (16, 32)):
        raise ValueError("BMP kind not supported")
    stride = (width * bits + 31) // 32 * 4
    if width < 1 or not height or stride * abs(height) > len(raw):
        raise ValueError("bad BMP size or truncated image")
    rows = np.frombuffer(raw, np.uint8, stride * abs(height), at).reshape(abs(height), stride)
    rows = rows[::-1] if height > 0 else rows
    if bits <= 8:
        used = int.from_bytes(raw[46:50], "little") or 1 << bits
        palette = np.frombuffer(raw, np.uint8, used * 4, 14 + head).reshape(-1, 4)
        if bits < 8:
            single = np.unpackbits(rows, axis=1).reshape(abs(height), stride * 8 // bits, bits)
            rows = np.packbits(single, axis=2)[..., 0] >> (8 - bits)
        return palette[rows[:, :width]][..., 2::-1].copy()
    if bits == 24:
        return rows[:, : width * 3].reshape(abs(height), width, 3)[..., ::-1].copy()
    masks = np.frombuffer(raw, "<u4", 3, 54) if packed == 3 else [0x7C00, 0x3E0, 0x1F] if bits == 16 else [0xFF0000, 0xFF00, 0xFF]
    cells = np.ascontiguousarray(rows).view("<u2" if bits == 16 else "<u4")[:, :width].astype(np.int64)
    out = np.zeros((abs(height), width, 3), np.uint8)
    for k, m in enumerate(map(int, masks)):
        low = m & -m
        if m:
            out[..., k] = np.rint((cells & m) // low * 255 / (m // low))
    return out


def encode_bmp(rgb: np.ndarray) -> bytes:
    """Uncompressed bottom-up 24-bit BMP."""
    height, width = rgb.shape[:2]
    stride = (width * 3 + 3) // 4 * 4
    body = np.zeros((height, stride), np.uint8)
    body[:, : width * 3] = rgb[::-1, :, ::-1].reshape(height, -1)
    n = 54 + body.size
    le = lambda v, k: int(v).to_bytes(k, "little")
    return b"BM" + le(n, 4) + bytes(4) + le(54, 4) + le(40, 4) + le(width, 4) + le(height, 4) + le(1, 2) + le(24, 2) + bytes(4) + le(body.size, 4) + bytes(16) + body.tobytes()


def decode(raw: bytes) -> np.ndarray:
    return decode_bmp(raw) if raw[:2] == b"BM" else decode_netpbm(raw)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target cell's exact area, fractions of samples included, by an integral image."""
    img = image.astype(np.float64)
    flat = img.reshape(img.shape[0], img.shape[1], -1)
    table = np.zeros((flat.shape[0] + 1, flat.shape[1] + 1, flat.shape[2]))
    table[1:, 1:] = flat.cumsum(0).cumsum(1)

    def along(t: np.ndarray, axis: int, n: int) -> np.ndarray:
        at = np.linspace(0, t.shape[axis] - 1, n + 1)
        low = np.minimum(at.astype(np.int64), t.shape[axis] - 2)
        part = (at - low).reshape([-1 if k == axis else 1 for k in range(3)])
        edge = t.take(low, axis) * (1 - part) + t.take(low + 1, axis) * part
        return np.diff(edge, axis=axis)

    out = along(along(table, 0, height), 1, width) * (height * width / (img.shape[0] * img.shape[1]))
    return out.reshape((height, width) + image.shape[2:])


def difference_hash(image: np.ndarray) -> str:
    """64 bits in hex: each of 8 x 8 cells of a 9-cell-wide reduction against its right neighbour."""
    grey = image if image.ndim == 2 else image.astype(np.float64).mean(axis=2)
    small = np.round(area_resize(grey, 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy_tiles(image: np.ndarray, size: int = 64) -> list[tuple[int, int, bytes]]:
    """(row, column, NPY bytes) of tiles; those at the lower and right edges are smaller."""
    out = []
    for r in range(0, image.shape[0], size):
        for c in range(0, image.shape[1], size):
            to = io.BytesIO()
            np.save(to, np.ascontiguousarray(image[r : r + size, c : c + size]), allow_pickle=False)
            out.append((r // size, c // size, to.getvalue()))
    return out


def from_tiles(tiles: list[tuple[int, int, bytes]]) -> np.ndarray:
    """The image that npy_tiles() cut."""
    rows: dict[int, list[np.ndarray]] = {}
    for r, _, raw in tiles:
        rows.setdefault(r, []).append(np.load(io.BytesIO(raw), allow_pickle=False))
    return np.concatenate([np.concatenate(row, axis=1) for row in rows.values()])


def media_tiles(df: DataFrame, column: str, keep: list[str], target: tuple[int, int] | None = None, size: int = 64) -> DataFrame:
    """One row a tile: the kept columns, media_height, media_width, media_hash, tile_row, tile_col, tile_npy, media_error.

    A null or empty cell, or one that is no image of these kinds, gives one row with a null tile and
    its error. target: (height, width) to which images are area-resized first. Rows are independent:
    repeats give repeats, and columns not in keep are ignored.
    """
    fields = "media_height int, media_width int, media_hash string, tile_row int, tile_col int, tile_npy binary, media_error string"
    kept = df.select(*[F.col(k) for k in keep]).schema
    cell = "_".join(["media", *keep])  # unlike any of them
    names = [*keep, *[f.split()[0] for f in fields.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, raw in enumerate(b.column(cell).to_pylist()):
                own = [b.column(c)[k].as_py() for c in keep]
                try:
                    if not raw:
                        raise ValueError("no media")
                    img = decode(raw)
                    if target:
                        img = np.clip(np.rint(area_resize(img, *target)), 0, 65535).astype(img.dtype)
                    rows = [(*own, *img.shape[:2], difference_hash(img), *t, None) for t in npy_tiles(img, size)]
                except (ValueError, IndexError, OverflowError) as e:
                    rows = [(*own, None, None, None, None, None, None, str(e))]
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=out_arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = StructType(kept.fields + StructType.fromDDL(fields).fields)
    out_arrow = to_arrow_schema(out)
    return df.select(*[F.col(k) for k in keep], F.col(column).alias(cell)).mapInArrow(run, out)


def text_media(docs: DataFrame) -> DataFrame:
    """Each whole text as a lossless PGM of 64 samples a row, decoded, cut into NPY tiles of 64 rows and read
    back from these, with the digests and features of what came back.

    Null and empty texts become one row of zeros. doc_id may be null or repeated: each row in gives one
    row out. feature holds the image's height and its difference hash; tiles_sha256 is of all tiles' bytes in turn.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.large_string()).cast(pa.large_binary())
            rows = []
            for t in texts:
                raw = t.as_py() or b""
                padded = raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))
                stored = encode_pgm(np.frombuffer(padded, np.uint8).reshape(-1, WIDTH))
                tiles = npy_tiles(decode(stored), WIDTH)
                image = from_tiles(tiles)
                back = image.tobytes()
                feature = f"{image.shape[0]}:{difference_hash(image)}"
                digests = [hashlib.sha256(x).hexdigest() for x in (back, stored, b"".join(t for _, _, t in tiles))]
                rows.append((len(raw), len(back), digests[0], zlib.crc32(back[-WIDTH:]), len(stored), digests[1], feature, len(tiles), digests[2]))
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], names=names)

    i, s = pa.int64(), pa.string()
    kinds = [i, i, s, i, i, s, s, i, s]
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_tiles", "tiles_sha256"]
    ddl = ", ".join(f"{n} {'string' if t == s else 'long'}" for n, t in zip(names, [i, *kinds], strict=True))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ddl)
