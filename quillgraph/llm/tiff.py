"""TIFF as a media column: writing documents as images and reading images back, a row for each page.

The reader walks the chain of image directories of either byte order, decodes strips or tiles that are stored plain or as
PackBits, LZW or deflate, undoes the horizontal predictor and gives samples of 8 bits in rows of pixels.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import extended, prepare

WIDTH, CHANNELS = 64, 3
ROW = WIDTH * CHANNELS
#: Rows of a stored document's first page.
FIRST = 64
# Fixed values of the format.
PLAIN, LZW, ADOBE_DEFLATE, DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
RUN = re.compile(rb"(.)\1\1+", re.S)
#: The most samples that a stored byte can stand for in any of the codings: LZW's longest entry for 12 bits, with room.
MOST = 4096
NAMES = {PLAIN: "none", LZW: "lzw", ADOBE_DEFLATE: "deflate", DEFLATE: "deflate", PACKBITS: "packbits"}


# ---------------------------------------------------------------- codecs


def packbits(data: bytes) -> bytes:
    """Runs of three and more as runs, all else as literals, each of 128 bytes at most."""
    out, at = bytearray(), 0

    def literals(start: int, end: int) -> None:
        for i in range(start, end, 128):
            part = data[i : min(i + 128, end)]
            out.append(len(part) - 1)
            out.extend(part)

    for m in RUN.finditer(data):
        start, end = m.span()
        literals(at, start)
        while end - start > 1:
            n = min(128, end - start)
            out.append(257 - n)
            out.append(data[start])
            start += n
        literals(start, end)
        at = end
    literals(at, len(data))
    return bytes(out)


def unpackbits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        head = data[at]
        if head < 128:
            out += data[at + 1 : at + 2 + head]
            at += 2 + head
        else:
            if head > 128:
                out += data[at + 1 : at + 2] * (257 - head)
            at += 1 if head == 128 else 2
    return bytes(out)


def widths(k: np.ndarray) -> np.ndarray:
    """Bits of the k-th code after a clear: 9 to 12, growing one code early."""
    return 9 + (k >= 254).astype(np.int64) + (k >= 766) + (k >= 1790)


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first."""
    codes, known, following, current = [256], {}, 258, -1
    clears = [0]
    for byte in data:
        if current < 0:
            current = byte
            continue
        key = current << 8 | byte
        longer = known.get(key)
        if longer is not None:
            current = longer
            continue
        codes.append(current)
        known[key] = following
        following += 1
        if following == 4094:
            clears.append(len(codes))
            codes.append(256)
            known, following = {}, 258
        current = byte
    if current >= 0:
        codes.append(current)
    codes.append(257)
    code, at = np.array(codes, np.int64), np.arange(len(codes))
    since = at - np.array(clears)[np.searchsorted(clears, at, "left") - 1] - 1  # a clear itself has the width of what it follows
    since[0] = 0
    width = widths(since)
    place = np.arange(12)
    bits = code[:, None] >> np.maximum(width[:, None] - 1 - place, 0) & 1
    return np.packbits(bits[place < width[:, None]].astype(np.uint8)).tobytes()


def unlzw(data: bytes, size: int) -> bytes:
    """Decodes a stretch between clears at a time: where its codes lie doesn't depend on what they are."""
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)]).astype(np.int64)
    window = raw[:-3] << 16 | raw[1:-2] << 8 | raw[2:-1]
    out, made, bit, total = [], 0, 0, 8 * len(data)
    fresh = [bytes((i,)) for i in range(256)] + [b"", b""]
    while bit < total and made < size:
        k = np.arange(min((total - bit) // 9, 2 + 4096 + size - made))
        width = widths(k)
        ends = bit + np.cumsum(width)
        starts = ends - width
        inside = ends <= total
        starts, width = starts[inside], width[inside]
        codes = window[starts >> 3] >> (24 - (starts & 7) - width) & (1 << width) - 1
        stop = np.flatnonzero((codes == 256) | (codes == 257))
        n = int(stop[0]) if len(stop) else len(codes)
        table, last = fresh.copy(), b""
        for code in codes[:n].tolist():
            if code < len(table):
                entry = table[code]
            elif last:
                entry = last + last[:1]
            else:
                raise ValueError("LZW code before its entry")
            out.append(entry)
            made += len(entry)
            if made >= size:
                break
            if last:
                table.append(last + entry[:1])
            last = entry
        if not len(stop) or codes[n] == 257:
            break
        bit = int(ends[n])
    return b"".join(out)


def compress(data: bytes, how: int) -> bytes:
    return {PLAIN: bytes, LZW: lzw, ADOBE_DEFLATE: lambda d: zlib.compress(d, 1), DEFLATE: lambda d: zlib.compress(d, 1), PACKBITS: packbits}[how](data)


def decompress(data: bytes, how: int, size: int) -> bytes:
    if how == PLAIN:
        return data
    if how == LZW:
        return unlzw(data, size)
    if how in (ADOBE_DEFLATE, DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    if how == PACKBITS:
        return unpackbits(data, size)
    raise ValueError(f"compression {how}")


# ---------------------------------------------------------------- files


def write(pages: list[np.ndarray], how: int = ADOBE_DEFLATE, predictor: int = 2, strip: int = 64, tile: int = 0, order: str = "<") -> bytes:
    """A file of one directory for each page, an array of (rows, pixels, channels) of 8 bits, in strips of rows or square tiles."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        rows, width, channels = page.shape
        if tile:
            padded = np.zeros((-(-rows // tile) * tile, -(-width // tile) * tile, channels), np.uint8)
            padded[:rows, :width] = page
            parts = [padded[y : y + tile, x : x + tile] for y in range(0, padded.shape[0], tile) for x in range(0, padded.shape[1], tile)]
        else:
            parts = [page[y : y + strip] for y in range(0, rows, strip)]
        offsets, counts = [], []
        for part in parts:
            if predictor == 2:
                part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
            data = compress(np.ascontiguousarray(part).tobytes(), how)
            offsets.append(len(out))
            counts.append(len(data))
            out += data
        out += b"\0" * (len(out) % 2)
        fields = [(256, 4, [width]), (257, 4, [rows]), (258, 3, [8] * channels), (259, 3, [how]), (262, 3, [2 if channels == 3 else 1]), (277, 3, [channels]), (284, 3, [1]), (317, 3, [predictor])]
        fields += [(322, 4, [tile]), (323, 4, [tile]), (324, 4, offsets), (325, 4, counts)] if tile else [(273, 4, offsets), (278, 4, [strip]), (279, 4, counts)]
        entries = []
        for tag, kind, values in sorted(fields):
            data = struct.pack(order + {3: "H", 4: "I"}[kind] * len(values), *values)
            if len(data) > 4:
                at = len(out)
                out += data + b"\0" * (len(data) % 2)
                data = struct.pack(order + "I", at)
            entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + data.ljust(4, b"\0"))
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def whole(raw: bytes, size: int) -> bytes:
    """The first `size` bytes; a strip or tile that decodes to fewer is cut off or damaged."""
    if len(raw) < size:
        raise ValueError(f"{len(raw)} of {size} samples")
    return raw[:size]


def directories(data: bytes) -> Iterator[tuple[str, dict[int, list[int]]]]:
    """The byte order and the whole-number fields of each image directory in turn."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        n = struct.unpack_from(order + "H", data, at)[0]
        fields: dict[int, list[int]] = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            letter = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}.get(kind)
            if letter:
                if count * SIZES[kind] > len(data):
                    raise ValueError(f"field {tag} has more values than the file has bytes")
                where = at + 10 + 12 * i
                if count * SIZES[kind] > 4:
                    where = struct.unpack_from(order + "I", data, where)[0]
                fields[tag] = list(struct.unpack_from(order + letter * count, data, where))
        yield order, fields
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def page(data: bytes, fields: dict[int, list[int]]) -> np.ndarray:
    """The samples of a directory's image, (rows, pixels, channels)."""
    one = lambda tag, default: fields.get(tag, [default])[0]
    width, rows, channels, how, predictor = one(256, 0), one(257, 0), one(277, 1), one(259, 1), one(317, 1)
    if any(b != 8 for b in fields.get(258, [1])) or predictor not in (1, 2):
        raise ValueError("samples must have 8 bits, and the predictor be none or horizontal")
    if not (0 < width and 0 < rows and 0 < channels):
        raise ValueError(f"an image of {width} x {rows} x {channels}")
    apart = one(284, 1) == 2 and channels > 1
    tiled = 322 in fields
    across, down = (one(322, 0), one(323, 0)) if tiled else (width, min(one(278, rows) or rows, rows) or 1)
    if not (0 < across and 0 < down):
        raise ValueError(f"tiles of {across} x {down}")
    offsets, counts = (fields[324], fields[325]) if tiled else (fields[273], fields[279])
    wide, k = -(-width // across), 0
    need = wide * -(-rows // down) * (channels if apart else 1)
    if not need <= min(len(offsets), len(counts)) or any(o + c > len(data) for o, c in zip(offsets[:need], counts[:need], strict=False)):
        raise ValueError("strips or tiles lie outside of the file")
    # no coding makes more than so many samples of a byte, so a header can't ask for more memory than the file warrants
    if rows * width * channels > MOST * (sum(counts[:need]) + need):
        raise ValueError(f"{rows * width * channels} samples of {sum(counts[:need])} bytes")
    out = np.zeros((rows, width, channels), np.uint8)
    for plane in range(channels if apart else 1):
        for y in range(0, rows, down):
            for x in range(0, wide * across, across):
                high = down if tiled else min(down, rows - y)
                depth = 1 if apart else channels
                size = high * across * depth
                raw = decompress(data[offsets[k] : offsets[k] + counts[k]], how, size)
                part = np.frombuffer(whole(raw, size), np.uint8).reshape(high, across, depth)
                if predictor == 2:
                    part = np.cumsum(part, axis=1, dtype=np.uint8)
                h, w = min(high, rows - y), min(across, width - x)
                out[y : y + h, x : x + w, plane if apart else slice(None)] = part[:h, :w, 0] if apart else part[:h, :w]
                k += 1
    return out


def feature(pixels: np.ndarray) -> str:
    """Shape, mean and spread of the samples, entropy in bits and mean step between neighbours."""
    n = np.bincount(pixels.ravel(), minlength=256)
    p = n[n > 0] / max(1, pixels.size)
    step = np.abs(np.diff(pixels.astype(np.int16), axis=1)).mean() if pixels.shape[1] > 1 and pixels.size else 0.0
    mean, spread = (float(pixels.mean()), float(pixels.std())) if pixels.size else (0.0, 0.0)
    return f"{pixels.shape[1]}x{pixels.shape[0]}x{pixels.shape[2]} mean={mean:.3f} std={spread:.3f} entropy={float(-(p * np.log2(p)).sum()):.3f} step={float(step):.3f}"


# ---------------------------------------------------------------- columns


def coding(payload: bytes) -> tuple[int, int, int, int, str]:
    """Compression, predictor, rows of a strip, side of a tile (0: strips) and byte order, by the payload's CRC-32: all mixed at every size."""
    h = zlib.crc32(payload)
    how = (PACKBITS, LZW, ADOBE_DEFLATE)[(h >> 8) % 3]
    return how, 1 + (h & 1), (16, 64)[h >> 1 & 1], (0, 16, 0, 32)[h >> 2 & 3], "<>"[h >> 4 & 1]


def image_of(payload: bytes) -> bytes:
    """A file of the payload in rows of ROW bytes; pages of FIRST rows and then of twice as many as the page before."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, CHANNELS)
    parts, at, rows = [], 0, FIRST
    while at < len(pixels):
        parts.append(pixels[at : at + rows])
        at, rows = at + rows, 2 * rows
    how, predictor, strip, tile, order = coding(payload)
    return write(parts, how, predictor, strip, tile, order)


def store(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, n_bytes (of the text in UTF-8), media: the text, filled with spaces to a positive multiple of ROW, as a file. Null is empty."""
    prepare(df.sparkSession)
    out, schema = extended(df.select(*keep), "n_bytes long, media binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = [(t or "").encode("utf-8", "replace") for t in part.column(part.num_columns - 1).to_pylist()]
                media = [image_of(t.ljust(max(1, -(-len(t) // ROW)) * ROW, b" ")) for t in texts]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], schema=schema)

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, out)


PAGE = "page int, width long, height long, channels int, compression string, samples binary, feature string, error string"


def read_pages(data: bytes) -> Iterator[tuple]:
    """The fields of PAGE for each page; a fault gives the pages before it and one row with `error`."""
    k = -1
    try:
        for k, (_, fields) in enumerate(directories(data)):  # noqa: B007
            pixels = page(data, fields)
            yield k, pixels.shape[1], pixels.shape[0], pixels.shape[2], NAMES[fields.get(259, [1])[0]], pixels.tobytes(), feature(pixels), None
    except (ValueError, KeyError, IndexError, ArithmeticError, struct.error, zlib.error, MemoryError) as e:
        yield max(k, 0), None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:200]


def read(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and `pages`: all pages of each file in order, with their number, size, samples and error; null media has none."""
    prepare(df.sparkSession)
    out, schema = extended(df.select(*keep), f"pages array<struct<{PAGE.replace(' ', ': ').replace(',:', ',')}>>")
    names = [x.split()[0] for x in PAGE.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                found = [[dict(zip(names, row, strict=True)) for row in read_pages(data)] if data is not None else [] for data in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found, schema.field(len(keep)).type)], schema=schema)

    return df.select(*keep, F.col(f"`{media}`").alias("__media")).mapInArrow(run, out)


def pages(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each page: keep, page (from 0), width, height, channels, compression, samples, feature, error.

    A file that can't be read gives the pages before the fault and one row with `error` (cut-off or oversized strips, sizes of
    zero, unknown codings); null media gives no row.
    """
    return read(df, media, keep).select(*keep, F.explode("pages").alias("__page")).select(*keep, "__page.*")


def digests(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document what was stored and what is read back of it: its pages' samples joined in order, and their features."""
    stored = store(df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))).select("doc_id", "n_bytes", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    back = read(stored, keep=("doc_id", "n_bytes", "media_bytes", "media_sha256"))
    # pages double in size, so that joining them one by one stays in proportion to the payload; a fault makes all of it null
    samples = F.aggregate("pages", F.lit(b""), lambda all_, p: F.concat(all_, p["samples"]))
    held = back.withColumn("samples", samples)
    return held.select(
        "doc_id",
        "n_bytes",
        F.length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(samples, -16, 16)")).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        F.array_join(F.transform("pages", lambda p: p["feature"]), "; ").alias("feature"),
        F.col("pages")[0]["compression"].alias("compression"),
        F.size("pages").alias("n_pages"),
    )


#: DuckDB: what is known of the payload; the stored form and the features have no SQL. Bytes are those of the text in UTF-8.
PAYLOAD_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, octet_length(encode(text)) AS n_bytes FROM t),
p AS (SELECT *, greatest(1, (n_bytes + {ROW - 1}) // {ROW}) * {ROW} AS payload_bytes FROM n)
SELECT doc_id, n_bytes, payload_bytes, sha256(text || repeat(' ', payload_bytes - n_bytes)) AS payload_sha256 FROM p
"""
