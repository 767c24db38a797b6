"""TIFF columns: a reader that emits one row per page, and the writer that stores payloads.

The reader walks the chain of image directories in either byte order, decodes strips and tiles that
are stored plainly or by PackBits, LZW or deflate, and undoes the horizontal predictor. It covers
unsigned samples of 8 and 16 bits, chunky or planar, and single samples of 1 and 4 bits. Files that are
truncated, cyclic, lack strips or claim more samples than their bytes can hold raise ValueError in
decode(); the column reader gives such a file one row with its error instead of failing the job.

digest() stores each text with one of LAYOUTS by its checksum, so that strips, tiles, the predictor and
every compression are written and read on whole tables. Null texts are empty, long ones take several
pages, rows that repeat give equal values, an empty table gives an empty one, other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomseq.llm.common import map_batches, texts_of

#: Field types and their sizes, tags, and codes of compression.
TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 6: ("b", 1), 7: ("B", 1), 8: ("h", 2), 9: ("i", 4)}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS_PER_STRIP, COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 284, 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946


# --- codecs ----------------------------------------------------------------------------------

def unpack_bits(data: bytes, size: int) -> bytes:
    """PackBits: a count byte n < 128 copies n + 1 bytes, n > 128 repeats one byte 257 - n times."""
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, at, n = bytearray(), 0, len(data)
    while at < n:
        run = 1
        while run < 128 and at + run < n and data[at + run] == data[at]:
            run += 1
        if run >= 3:
            out += bytes((257 - run, data[at]))
            at += run
            continue
        end = at + run
        while end < n and end - at < 128 and not (end + 2 < n and data[end] == data[end + 1] == data[end + 2]):
            end += 1
        out.append(end - at - 1)
        out += data[at:end]
        at = end
    return bytes(out)


_CLEAR, _END = 256, 257


def unpack_lzw(data: bytes, size: int) -> bytes:
    """TIFF's LZW: codes from the high bit, widths 9 to 12, widening one code early."""
    first = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, last, width, out = list(first), None, 9, bytearray()
    bits, held, at = 0, 0, 0
    while len(out) < size:
        while held < width:
            if at >= len(data):
                return bytes(out)
            bits, held, at = ((bits << 8) | data[at]) & 0xFFFFFFFF, held + 8, at + 1
        held -= width
        code = (bits >> held) & ((1 << width) - 1)
        if code == _END:
            break
        if code == _CLEAR:
            table, last, width = list(first), None, 9
            continue
        if last is None:
            if code > 255:
                raise ValueError("bad LZW code")
            entry = table[code]
        else:
            if code > len(table):
                raise ValueError("bad LZW code")
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
        out += entry
        last = entry
    return bytes(out)


def pack_lzw(data: bytes) -> bytes:
    bits, held, out, width, codes, word = 0, 0, bytearray(), 9, {bytes((i,)): i for i in range(256)}, b""
    following = 258

    def put(code):
        nonlocal bits, held
        bits, held = (bits << width) | code, held + width
        while held >= 8:
            held -= 8
            out.append((bits >> held) & 255)
        bits &= (1 << held) - 1

    put(_CLEAR)
    for k in range(len(data)):
        longer = word + data[k : k + 1]
        if longer in codes:
            word = longer
            continue
        put(codes[word])
        codes[longer] = following
        following += 1
        word = data[k : k + 1]
        if following + 1 > 1 << width and width < 12:
            width += 1
        if following >= 4094:
            put(_CLEAR)
            width, following, codes = 9, 258, {bytes((i,)): i for i in range(256)}
    if word:
        put(codes[word])
        following += 1
        if following + 1 > 1 << width and width < 12:
            width += 1
    put(_END)
    if held:
        out.append((bits << (8 - held)) & 255)
    return bytes(out)


def decompress(data: bytes, how: int, size: int) -> bytes:
    if how == NONE:
        return data[:size]
    if how in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    if how == LZW:
        return unpack_lzw(data, size)
    if how == PACKBITS:
        return unpack_bits(data, size)
    raise ValueError(f"compression {how} is not supported")


def compress(data: bytes, how: int) -> bytes:
    return {NONE: bytes, DEFLATE: lambda d: zlib.compress(d, 1), LZW: pack_lzw, PACKBITS: pack_bits}[how](data)


# --- reader ----------------------------------------------------------------------------------

def directories(data: bytes) -> list[dict[int, tuple]]:
    """Tags of each directory in the file's chain."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen, out = struct.unpack_from(order + "I", data, 4)[0], set(), []
    while at:
        if at in seen or at + 2 > len(data):
            raise ValueError("broken directory chain")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        if at + 2 + 12 * n + 4 > len(data):
            raise ValueError("truncated directory")
        tags: dict[int, tuple] = {0: (order,)}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind not in TYPES:
                continue
            code, size = TYPES[kind]
            place = at + 2 + 12 * k + 8
            if size * count > 4:
                (place,) = struct.unpack_from(order + "I", data, place)
            if place + size * count > len(data):
                raise ValueError(f"tag {tag} lies outside the file")
            tags[tag] = struct.unpack_from(f"{order}{count}{code}", data, place) if kind != 2 else (data[place : place + count],)
        out.append(tags)
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    return out


#: A compressed byte gives fewer than that in any of the compressions (LZW on one value gives most).
MOST = 3000


def page(data: bytes, tags: dict[int, tuple]) -> np.ndarray:
    """The samples of one directory, (height, width, samples)."""
    get = lambda tag, default=None: tags.get(tag, (default,))[0]
    w, h, spp, bits = get(WIDTH), get(HEIGHT), get(SAMPLES, 1), get(BITS, 1)
    if not w or not h or not spp or w < 0 or h < 0 or bits not in (1, 4, 8, 16) or bits < 8 and spp > 1:
        raise ValueError("size or sample depth is not supported")
    kind = np.dtype(tags[0][0] + "u2" if bits == 16 else np.uint8)
    planar = get(PLANAR, 1) == 2 and spp > 1
    depth = 1 if planar else spp
    how, predictor = get(COMPRESSION, NONE), get(PREDICTOR, 1)
    tiled = TILE_OFFSETS in tags
    cw, ch = (get(TILE_WIDTH), get(TILE_HEIGHT)) if tiled else (w, min(get(ROWS_PER_STRIP, h), h))
    offsets, counts = tags[TILE_OFFSETS if tiled else OFFSETS], tags[TILE_COUNTS if tiled else COUNTS]
    if not cw or not ch or cw < 0 or ch < 0:
        raise ValueError("strips or tiles have no size")
    planes, across, down = spp if planar else 1, -(-w // cw), -(-h // ch)
    line = -(-cw * depth * bits // 8)  # bytes of a row of a strip or tile
    if min(len(offsets), len(counts)) < planes * across * down:
        raise ValueError("strips or tiles are missing")
    if planes * across * down * line * (ch if tiled else 1) > MOST * len(data) or planes * h * line > MOST * len(data):
        raise ValueError("the file is too small for its size")
    out = np.zeros((planes, h, w, depth), kind.newbyteorder("="))
    for k, (o, c) in enumerate(zip(offsets[: planes * across * down], counts)):
        plane, rest = divmod(k, across * down)
        y, x = divmod(rest, across)
        rows = ch if tiled else min(ch, h - y * ch)
        raw = decompress(data[o : o + c], how, rows * line)
        if len(raw) < rows * line:
            raise ValueError("a strip or tile is too short")
        if bits < 8:
            lines = np.frombuffer(raw, np.uint8).reshape(rows, line)
            small = np.unpackbits(lines, axis=1) if bits == 1 else np.stack([lines >> 4, lines & 15], axis=2).reshape(rows, -1)
            block = small[:, :cw, None]
        else:
            block = np.frombuffer(raw, kind).reshape(rows, cw, depth).astype(out.dtype)
        if predictor == 2 and bits >= 8:
            block = np.cumsum(block, axis=1, dtype=out.dtype)
        elif predictor != 1:
            raise ValueError(f"predictor {predictor} is not supported")
        put = out[plane, y * ch : y * ch + rows, x * cw : x * cw + cw]
        put[:] = block[: put.shape[0], : put.shape[1]]
    return np.concatenate(list(out), axis=-1)


#: What files that aren't as they should be can raise.
BROKEN = (ValueError, LookupError, TypeError, ArithmeticError, MemoryError, struct.error, zlib.error)


def page_rows(data: bytes):
    """(page number, tags, samples) for each directory."""
    for n, tags in enumerate(directories(data)):
        yield n, tags, page(data, tags)


def decode(data: bytes) -> list[np.ndarray]:
    return [p for _, _, p in page_rows(data)]


def pages(df: DataFrame, key: str, column: str) -> DataFrame:
    """One row a page: key, page, width, height, samples, bits, compression, payload, error. A null
    file has no row; a broken one has one row with page -1 and its error."""
    kind = df.schema[key].dataType.simpleString()

    def run(b: pa.RecordBatch):
        for k, data in zip(b.column(key).to_pylist(), b.column(column).cast(pa.binary()).to_pylist()):
            if data is None:
                continue
            rows = []
            try:
                for n, tags, p in page_rows(data):
                    rows.append((k, n, p.shape[1], p.shape[0], p.shape[2], tags.get(BITS, (1,))[0], tags.get(COMPRESSION, (NONE,))[0], p.tobytes(), None))
            except BROKEN as e:
                rows = [(k, -1, 0, 0, 0, 0, 0, None, f"{type(e).__name__}: {e}")]
            if rows:
                yield dict(zip((key, "page", "width", "height", "samples", "bits", "compression", "payload", "error"), map(list, zip(*rows))))

    return map_batches(df.select(key, column), run, f"{key} {kind}, page int, width int, height int, samples int, bits int, compression int, payload binary, error string")


# --- writer ----------------------------------------------------------------------------------

def _blocks(img: np.ndarray, tile: tuple[int, int] | None, rows: int):
    """Strips of the given rows, or tiles padded at the right and lower edge."""
    h, w = img.shape[:2]
    if not tile:
        return [img[y : y + rows] for y in range(0, h, rows)]
    tw, th = tile
    full = np.zeros((-(-h // th) * th, -(-w // tw) * tw, img.shape[2]), img.dtype)
    full[:h, :w] = img
    return [full[y : y + th, x : x + tw] for y in range(0, full.shape[0], th) for x in range(0, full.shape[1], tw)]


def write(images: list[np.ndarray], layouts: list[dict]) -> bytes:
    """A little-endian file. A layout has compression, predictor, and tile (width, height) or rows."""
    out, link = bytearray(b"II" + struct.pack("<HI", 42, 0)), 4
    for img, lay in zip(images, layouts):
        h, w, spp = img.shape
        how, predictor, tile = lay.get("compression", NONE), lay.get("predictor", 1), lay.get("tile")
        rows = lay.get("rows", h)
        offsets, counts = [], []
        for b in _blocks(img, tile, rows):
            if predictor == 2:
                b = np.concatenate([b[:, :1], b[:, 1:] - b[:, :-1]], axis=1)
            data = compress(b.astype(b.dtype.newbyteorder("<")).tobytes(), how)
            offsets.append(len(out))
            counts.append(len(data))
            out += data + b"\0" * (len(data) % 2)
        tags = [(WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [8 * img.itemsize] * spp), (COMPRESSION, 3, [how]), (PHOTOMETRIC, 3, [1 if spp < 3 else 2]), (SAMPLES, 3, [spp]), (PREDICTOR, 3, [predictor])]
        tags += [(TILE_WIDTH, 4, [tile[0]]), (TILE_HEIGHT, 4, [tile[1]]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)] if tile else [(OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [rows]), (COUNTS, 4, counts)]
        entries = b""
        for tag, kind, values in sorted(tags):
            code, size = TYPES[kind]
            body = struct.pack(f"<{len(values)}{code}", *values)
            if len(body) > 4:
                place = struct.pack("<I", len(out))
                out += body + b"\0" * (len(body) % 2)
                body = place
            entries += struct.pack("<HHI", tag, kind, len(values)) + body.ljust(4, b"\0")
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags)) + entries + b"\0\0\0\0"
        link = len(out) - 4
    return bytes(out)


#: A payload is stored as pages of at most PAGE_ROWS rows of ROW samples.
UNIT, ROW, PAGE_ROWS = 576, 48, 768
#: Strips and tiles, with and without the predictor, in every compression.
LAYOUTS = (
    {"compression": DEFLATE, "rows": 192}, {"compression": PACKBITS, "rows": 64}, {"compression": DEFLATE, "predictor": 2, "tile": (48, 192)},
    {"compression": LZW, "rows": 192}, {"compression": NONE, "tile": (16, 64)}, {"compression": LZW, "predictor": 2, "rows": 96},
)


def payload_of(text: bytes) -> bytes:
    """The text and bytes 255 up to a positive multiple of UNIT."""
    return text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT), b"\xff")


def store(payload: bytes) -> bytes:
    step = ROW * PAGE_ROWS
    images = [np.frombuffer(payload[c : c + step], np.uint8).reshape(-1, ROW, 1) for c in range(0, len(payload), step)]
    first = zlib.crc32(payload)
    return write(images, [LAYOUTS[(first + k) % len(LAYOUTS)] for k in range(len(images))])


def feature(back: list[np.ndarray]) -> str:
    """Pages, and the mean, deviation and sixteen-bin histogram of all samples."""
    flat = np.concatenate([p.reshape(-1) for p in back])
    hist = np.bincount(flat >> 4, minlength=16)
    return f"{len(back)};{flat.mean():.4f};{flat.std():.4f};" + ",".join(map(str, hist.tolist()))


def digest(docs: DataFrame) -> DataFrame:
    """Each text stored as a TIFF, read back, and described; nulls are empty texts. Equal texts give
    equal values. Extra columns are ignored."""

    def run(b: pa.RecordBatch):
        rows = []
        for doc, text in zip(b.column("doc_id").to_pylist(), texts_of(b)):
            media = store(payload_of(text))
            back = decode(media)
            got = b"".join(p.tobytes() for p in back)
            rows.append((doc, len(text), len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(back)))
        return dict(zip(("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"), zip(*rows)))

    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return map_batches(docs.select("doc_id", "text"), run, schema)
