"""TIFF columns: write 8-bit grey pages, walk image directories, decode, one row per page.

Reading takes either byte order, any chain of directories, strips or tiles, no compression,
PackBits, LZW or deflate, predictor 1 or 2 (horizontal differencing) and 8- or 16-bit
unsigned samples stored together (planar configuration 1).

Null or empty binaries give no page; a broken file gives one row with page -1 and `error`.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldweave.llm import textvec as V

#: Fixed values of the format: tags, those that are 16-bit fields, sizes of field types, codes of compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
SHORTS = {BITS, COMPRESSION, PHOTOMETRIC, SAMPLES, PREDICTOR}
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
CODES = {"none": 1, "lzw": 5, "deflate": 8, "packbits": 32773}
NAMES = {v: k for k, v in CODES.items()} | {32946: "deflate"}


def unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def pack_bits(row: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(row)
    while i < n:
        j = i + 1
        while j < n and j - i < 128 and row[j] == row[i]:
            j += 1
        if j - i > 1:
            out += bytes((257 - (j - i), row[i]))
        else:
            while j < n and j - i < 128 and not (j + 1 < n and row[j] == row[j + 1]):
                j += 1
            out += bytes((j - i - 1,)) + row[i:j]
        i = j
    return bytes(out)


def _lzw_widths(first: int = 258) -> Iterator[tuple[int, int]]:
    """(next free code, width of codes written then); a reader's table is one entry behind, so it widens at one less."""
    n = first
    while True:
        yield n, 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
        n += 1


def unpack_lzw(data: bytes) -> bytes:
    table: list[bytes] = [bytes((i,)) for i in range(256)] + [b"", b""]
    out, held, bits, width, last, i = bytearray(), 0, 0, 9, b"", 0
    while True:
        while bits < width:
            if i >= len(data):
                return bytes(out)
            held = (held << 8 | data[i]) & 0xFFFFFFF
            i, bits = i + 1, bits + 8
        code = held >> (bits - width) & ((1 << width) - 1)
        bits -= width
        if code == 257:
            return bytes(out)
        if code == 256:
            del table[258:]
            width, last = 9, b""
            continue
        if code < len(table):
            now = table[code]
        elif code == len(table) and last:
            now = last + last[:1]
        else:
            raise ValueError("LZW code out of range")
        out += now
        if last and len(table) < 4096:
            table.append(last + now[:1])
        last = now
        n = len(table)
        width = 9 if n < 511 else 10 if n < 1023 else 11 if n < 2047 else 12


def pack_lzw(data: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    def fresh() -> dict[bytes, int]:
        return {bytes((i,)): i for i in range(256)}

    table, sizes = fresh(), _lzw_widths()
    n, width = next(sizes)
    put(256, width)
    run = b""
    for k in data:
        longer = run + bytes((k,))
        if longer in table:
            run = longer
            continue
        put(table[run], width)
        table[longer] = n
        n, width = next(sizes)
        if n > 4093:
            put(256, width)
            table, sizes = fresh(), _lzw_widths()
            n, width = next(sizes)
        run = bytes((k,))
    if run:
        put(table[run], width)
        n, width = next(sizes)
    put(257, width)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def _compress(block: np.ndarray, how: str, level: int) -> bytes:
    raw = block.tobytes()
    if how == "deflate":
        return zlib.compress(raw, level)
    if how == "lzw":
        return pack_lzw(raw)
    return b"".join(pack_bits(r.tobytes()) for r in block) if how == "packbits" else raw


def _expand(data: bytes, how: int, size: int) -> bytes:
    name = NAMES.get(how)
    if name is None:
        raise ValueError(f"compression {how} is not supported")
    out = {"none": bytes, "packbits": unpack_bits, "lzw": unpack_lzw, "deflate": zlib.decompress}[name](data)
    if len(out) < size:
        raise ValueError("a strip or tile is too short")
    return out[:size]


def write_tiff(pages: list[np.ndarray], compression: str = "deflate", predictor: int = 2, rows: int = 64, tile: tuple[int, int] | None = None, level: int = 1, order: str = "<") -> bytes:
    """A file of 8-bit grey pages (2-d uint8 arrays), in strips of `rows` or tiles of (width, height), both multiples of 16.

    Other readers know predictor 2 with LZW and deflate only.
    """
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        h, w = page.shape
        bw, bh = tile or (w, min(rows, h))
        at, counts = [], []
        for y in range(0, h, bh):
            for x in range(0, w, bw):
                block = page[y : y + bh, x : x + bw]
                if tile:
                    block = np.pad(block, ((0, bh - block.shape[0]), (0, bw - block.shape[1])))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.uint8(0))
                data = _compress(np.ascontiguousarray(block), compression, level)
                at.append(len(out))
                counts.append(len(data))
                out += data
        where = [(TILE_WIDTH, [bw]), (TILE_HEIGHT, [bh]), (TILE_OFFSETS, at), (TILE_COUNTS, counts)] if tile else [(STRIP_OFFSETS, at), (ROWS_PER_STRIP, [bh]), (STRIP_COUNTS, counts)]
        fields = sorted([(WIDTH, [w]), (HEIGHT, [h]), (BITS, [8]), (COMPRESSION, [CODES[compression]]), (PHOTOMETRIC, [1]), (SAMPLES, [1]), (PREDICTOR, [predictor]), *where])
        out += b"\0" * (len(out) % 2)
        beyond = len(out) + 2 + 12 * len(fields) + 4
        struct.pack_into(order + "I", out, link, len(out))
        body, extra = bytearray(struct.pack(order + "H", len(fields))), bytearray()
        for tag, values in fields:
            if tag in SHORTS:
                body += struct.pack(order + "HHIHH", tag, 3, 1, values[0], 0)
                continue
            packed = struct.pack(f"{order}{len(values)}I", *values)
            if len(packed) > 4:
                body += struct.pack(order + "HHII", tag, 4, len(values), beyond + len(extra))
                extra += packed
            else:
                body += struct.pack(order + "HHI", tag, 4, len(values)) + packed
        link = len(out) + len(body)
        out += body + b"\0\0\0\0" + extra
    return bytes(out)


def _fields(data: bytes, order: str, at: int) -> tuple[dict[int, tuple], int]:
    (n,) = struct.unpack_from(order + "H", data, at)
    found = {}
    for i in range(n):
        tag, kind, count, value = struct.unpack_from(order + "HHI4s", data, at + 2 + 12 * i)
        size = TYPE_BYTES.get(kind, 0) * count
        if kind in (1, 3, 4):
            raw = value if size <= 4 else data[(p := struct.unpack(order + "I", value)[0]) : p + size]
            found[tag] = struct.unpack(f"{order}{count}{ {1: 'B', 3: 'H', 4: 'I'}[kind] }", raw[:size])
    return found, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def read_pages(data: bytes) -> Iterator[dict]:
    """One dictionary per page, in the order of the directories; `pixels` is a (height, width * samples) array."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen, k = struct.unpack_from(order + "I", data, 4)[0], set(), 0
    while at:
        if at in seen:
            raise ValueError("the chain of directories has a loop")
        seen.add(at)
        f, at = _fields(data, order, at)
        w, h, samples = f[WIDTH][0], f[HEIGHT][0], f.get(SAMPLES, (1,))[0]
        bits, how, predictor = f.get(BITS, (1,))[0], f.get(COMPRESSION, (1,))[0], f.get(PREDICTOR, (1,))[0]
        if bits not in (8, 16) or f.get(PLANAR, (1,))[0] != 1 or predictor not in (1, 2):
            raise ValueError("only 8- and 16-bit samples stored together, with predictor 1 or 2")
        kind = np.dtype(np.uint8 if bits == 8 else order + "u2")
        tiled = TILE_OFFSETS in f
        bw, bh = (f[TILE_WIDTH][0], f[TILE_HEIGHT][0]) if tiled else (w, min(f.get(ROWS_PER_STRIP, (h,))[0], h))
        across = -(-w // bw) if w else 0
        pixels = np.zeros((h, w * samples), kind.newbyteorder("="))
        for i, (p, n) in enumerate(zip(f[TILE_OFFSETS if tiled else STRIP_OFFSETS], f[TILE_COUNTS if tiled else STRIP_COUNTS], strict=True)):
            y, x = i // across * bh, i % across * bw
            rows = bh if tiled else min(bh, h - y)
            block = np.frombuffer(_expand(data[p : p + n], how, rows * bw * samples * kind.itemsize), kind).reshape(rows, bw, samples)
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype=pixels.dtype)
            part = pixels[y : y + rows, x * samples : (x + bw) * samples]
            part[:] = block.reshape(rows, -1)[: part.shape[0], : part.shape[1]]
        yield {"page": k, "width": w, "height": h, "samples": samples, "bits": bits, "compression": NAMES[how], "predictor": predictor, "tiled": tiled, "pixels": pixels}
        k += 1


PAGE_COLUMNS = "page int, width int, height int, samples int, bits int, compression string, predictor int, tiled boolean, pixels binary, error string"


def page_batches(batches: Iterator[pd.DataFrame], column: str, keep: list[str]) -> Iterator[pd.DataFrame]:
    """Rows with a TIFF in `column` -> a row per page with the columns of `keep`; never more pixels in memory than about 16 MB or one page."""
    names = [*keep, *(c.split()[0] for c in PAGE_COLUMNS.split(", "))]
    out, held = [], 0
    for batch in batches:
        for *own, data in zip(*(batch[k] for k in keep), batch[column]):
            if data is None or not len(data):
                continue
            try:
                for p in read_pages(bytes(data)):
                    p["pixels"] = p["pixels"].tobytes()
                    out.append((*own, *p.values(), None))
                    if (held := held + len(p["pixels"])) > 1 << 24:
                        yield pd.DataFrame(out, columns=names)
                        out, held = [], 0
            except (ValueError, KeyError, struct.error, zlib.error, IndexError) as e:
                out.append((*own, -1, None, None, None, None, None, None, None, None, str(e)))
    if out:
        yield pd.DataFrame(out, columns=names)


def tiff_pages(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """A row per page of every TIFF in `column`, with the columns of `keep`; other columns are not read."""
    clash = set(keep) & {c.split()[0] for c in PAGE_COLUMNS.split(", ")}
    if clash:
        raise ValueError(f"rename {sorted(clash)}: pages have columns of these names")
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep) + ", " + PAGE_COLUMNS
    return df.select(*keep, column).mapInPandas(lambda it: page_batches(it, column, keep), schema)


def text_pages(text: str | None, width: int = 192, rows: int = 4096) -> tuple[int, list[np.ndarray]]:
    """(bytes of the text, its UTF-8 bytes padded with blanks to whole rows, as pages of at most `rows` rows)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    padded = raw + b" " * (-len(raw) % width if raw else width)
    image = np.frombuffer(padded, np.uint8).reshape(-1, width)
    return len(raw), [image[y : y + rows] for y in range(0, len(image), rows)]


def text_batches(batches: Iterator[pd.DataFrame], column: str, keep: list[str], form: Callable[[str], dict] | None = None, rows: int = 4096, **how) -> Iterator[pd.DataFrame]:
    """Each text stored as one TIFF: the columns of `keep`, n_bytes and tiff; form: more arguments of write_tiff() by text."""
    for batch in batches:
        texts = batch[column].tolist()
        for a, b in V.chunks(texts):
            made = [(*text_pages(t, rows=rows), how | (form(t or "") if form else {})) for t in texts[a:b]]
            yield batch[keep].iloc[a:b].assign(n_bytes=np.array([n for n, *_ in made], np.int64), tiff=[write_tiff(p, **h) for _, p, h in made])


def texts_to_tiff(df: DataFrame, column: str, keep: list[str], **how) -> DataFrame:
    """See text_batches(); a null text is an empty one, which is one row of blanks."""
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep) + ", n_bytes bigint, tiff binary"
    return df.select(*keep, F.col(column).alias("__text")).mapInPandas(lambda it: text_batches(it, "__text", keep, **how), schema)
