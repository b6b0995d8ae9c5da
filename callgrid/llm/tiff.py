"""Media columns: TIFF.

A reader for baseline TIFF files in either byte order: it walks the chain of image directories, decodes
strips and tiles stored plain or by PackBits, LZW or deflate, undoes the horizontal predictor and gives
8-bit samples page by page. A writer makes such files. Both work on one file at a time inside a task;
Spark deals the files.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small_batches

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Bytes of a value by field type.
FIELD_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4}
FIELD_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 13: "I"}


class TiffError(ValueError):
    """The bytes are no TIFF file that this reader understands."""


@dataclass
class Page:
    width: int
    height: int
    samples: int
    compression: int
    predictor: int
    tiled: bool
    data: np.ndarray  # (height, width, samples), uint8


def unpack_bits(raw: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(raw)
    while i < n:
        head = raw[i]
        if head < 128:
            out += raw[i + 1 : i + 2 + head]
            i += 2 + head
        elif head > 128:
            out += raw[i + 1 : i + 2] * (257 - head)
            i += 2
        else:
            i += 1
    return bytes(out)


def pack_bits(raw: bytes) -> bytes:
    out, i, n, plain = bytearray(), 0, len(raw), bytearray()

    def flush() -> None:
        for k in range(0, len(plain), 128):
            part = plain[k : k + 128]
            out.append(len(part) - 1)
            out.extend(part)
        plain.clear()

    while i < n:
        j = i + 1
        while j < n and j - i < 128 and raw[j] == raw[i]:
            j += 1
        if j - i >= 3:
            flush()
            out.append(257 - (j - i))
            out.append(raw[i])
        else:
            plain += raw[i:j]
        i = j
    flush()
    return bytes(out)


def lzw_decode(raw: bytes) -> bytes:
    """Most significant bit first, codes widen one entry early, as TIFF files have it."""
    table = [bytes([i]) for i in range(256)] + [b"", b""]
    out, width, buffer, bits, last = [], 9, 0, 0, b""
    entries = list(table)
    for byte in raw:
        buffer, bits = buffer << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = buffer >> bits & (1 << width) - 1
        buffer &= (1 << bits) - 1
        if code == 256:
            entries, width, last = list(table), 9, b""
            continue
        if code == 257:
            break
        if code < len(entries):
            now = entries[code]
        elif code == len(entries) and last:
            now = last + last[:1]
        else:
            raise TiffError("bad LZW code")
        out.append(now)
        if last:
            entries.append(last + now[:1])
        width = min(12, max(9, (len(entries) + 1).bit_length()))
        last = now
    return b"".join(out)


def lzw_encode(raw: bytes) -> bytes:
    out, buffer, bits, width = bytearray(), 0, 0, 9
    table = {bytes([i]): i for i in range(256)}
    size = 258

    def put(code: int) -> None:
        nonlocal buffer, bits
        buffer, bits = buffer << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(buffer >> bits & 255)
        buffer &= (1 << bits) - 1

    put(256)
    word = b""
    for i in range(len(raw)):
        more = word + raw[i : i + 1]
        if more in table:
            word = more
            continue
        put(table[word])
        table[more] = size
        size += 1
        width = min(12, max(9, size.bit_length()))
        if size >= 4094:
            put(256)
            table, size, width = {bytes([k]): k for k in range(256)}, 258, 9
        word = raw[i : i + 1]
    if word:
        put(table[word])
        size += 1
        width = min(12, max(9, size.bit_length()))
    put(257)
    if bits:
        out.append(buffer << 8 - bits & 255)
    return bytes(out)


def _decoded(raw: bytes, compression: int) -> bytes:
    if compression == NONE:
        return raw
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(raw)
    if compression == PACKBITS:
        return unpack_bits(raw)
    if compression == LZW:
        return lzw_decode(raw)
    raise TiffError(f"compression {compression} is not supported")


def _encoded(raw: bytes, compression: int, level: int) -> bytes:
    if compression == NONE:
        return raw
    if compression == DEFLATE:
        return zlib.compress(raw, level)
    return pack_bits(raw) if compression == PACKBITS else lzw_encode(raw)


def read_pages(blob: bytes) -> Iterator[Page]:
    """The pages of a file, in the order of its directories; a chain that loops or leaves the file is an error."""
    order = {b"II": "<", b"MM": ">"}.get(blob[:2])
    if order is None or len(blob) < 8 or struct.unpack_from(order + "H", blob, 2)[0] != 42:
        raise TiffError("no TIFF header")
    at, seen = struct.unpack_from(order + "I", blob, 4)[0], set()
    try:
        while at:
            if at in seen:
                raise TiffError("directories form a loop")
            seen.add(at)
            tags: dict[int, list[int]] = {}
            (count,) = struct.unpack_from(order + "H", blob, at)
            for k in range(count):
                tag, kind, n = struct.unpack_from(order + "HHI", blob, at + 2 + 12 * k)
                if kind not in FIELD_CODES:
                    continue
                where = at + 10 + 12 * k
                if n * FIELD_SIZES[kind] > 4:
                    (where,) = struct.unpack_from(order + "I", blob, where)
                tags[tag] = list(struct.unpack_from(f"{order}{n}{FIELD_CODES[kind]}", blob, where))
            yield _page(blob, tags)
            (at,) = struct.unpack_from(order + "I", blob, at + 2 + 12 * count)
    except (struct.error, KeyError, zlib.error, IndexError) as e:
        raise TiffError(str(e)) from e


def _page(blob: bytes, tags: dict[int, list[int]]) -> Page:
    width, height = tags[256][0], tags[257][0]
    compression, predictor = tags.get(259, [NONE])[0], tags.get(317, [1])[0]
    samples = tags.get(277, [1])[0]
    if any(b != 8 for b in tags.get(258, [1])) or predictor not in (1, 2) or tags.get(284, [1])[0] != 1:
        raise TiffError("only 8-bit chunky samples with predictor 1 or 2 are supported")
    tiled = 322 in tags
    across, down = (tags[322][0], tags[323][0]) if tiled else (width, min(height, tags.get(278, [height])[0]))
    starts, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    data = np.zeros((height, width, samples), np.uint8)
    columns = -(-width // across)
    for k, (start, size) in enumerate(zip(starts, sizes, strict=True)):
        if start + size > len(blob):
            raise TiffError("a strip leaves the file")
        y, x = k // columns * down, k % columns * across
        rows = down if tiled else min(down, height - y)
        block = np.frombuffer(_decoded(blob[start : start + size], compression), np.uint8)
        if block.size < rows * across * samples or y >= height:
            raise TiffError("a strip is too short")
        block = block[: rows * across * samples].reshape(rows, across, samples)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=np.uint8)
        data[y : y + rows, x : x + across] = block[: height - y, : width - x]
    return Page(width, height, samples, compression, predictor, tiled, data)


def write_pages(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, tile: int = 0, rows: int = 64, order: str = "<", level: int = 1) -> bytes:
    """A file of pages (height, width) or (height, width, samples) of uint8. tile: side of tiles, a multiple of 16; 0: strips of ``rows`` rows."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        page = page if page.ndim == 3 else page[:, :, None]
        height, width, samples = page.shape
        across, down = (tile, tile) if tile else (width, min(rows, height))
        starts, sizes = [], []
        for y in range(0, height, down):
            for x in range(0, width, across):
                block = page[y : y + down, x : x + across]
                if tile and block.shape[:2] != (tile, tile):
                    block = np.pad(block, ((0, tile - block.shape[0]), (0, tile - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
                raw = _encoded(block.tobytes(), compression, level)
                starts.append(len(out))
                sizes.append(len(raw))
                out += raw
        tags = {256: [width], 257: [height], 258: [8] * samples, 259: [compression], 262: [1 if samples == 1 else 2], 277: [samples], 317: [predictor]}
        tags |= {322: [tile], 323: [tile], 324: starts, 325: sizes} if tile else {273: starts, 278: [down], 279: sizes}
        fields = b""
        for tag in sorted(tags):
            kind = 4 if tag in (256, 257, 273, 278, 279, 322, 323, 324, 325) else 3
            raw = struct.pack(f"{order}{len(tags[tag])}{FIELD_CODES[kind]}", *tags[tag])
            if len(raw) > 4:
                out += b"\0" * (len(out) % 2)
                raw, value = struct.pack(order + "I", len(out)), raw
                out += value
            fields += struct.pack(order + "HHI", tag, kind, len(tags[tag])) + raw.ljust(4, b"\0")
        out += b"\0" * (len(out) % 2)
        out[link : link + 4] = struct.pack(order + "I", len(out))
        out += struct.pack(order + "H", len(tags)) + fields
        link = len(out)
        out += b"\0" * 4
    return bytes(out)


def decode_tiff(files: DataFrame, key: str, content: str) -> DataFrame:
    """One row per page of each file in ``content``: key, page, width, height, samples, compression, predictor, tiled, pixels, error.

    Null or unreadable bytes give one row with page null and the error; an empty file table gives no rows;
    repeated files stay; other columns are ignored.
    """
    small_batches(files.sparkSession, 64)
    kind = dict(files.dtypes)[key]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, blob in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                rows, error = [], None
                try:
                    for i, p in enumerate(read_pages(blob or b"")):
                        rows.append((i, p.width, p.height, p.samples, p.compression, p.predictor, p.tiled, p.data.tobytes(), None))
                except TiffError as e:
                    error = str(e)
                if error is not None:
                    rows.append((None, None, None, None, None, None, None, None, error))
                if rows:
                    kinds = [pa.int32()] * 6 + [pa.bool_(), pa.binary(), pa.string()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k.as_py()] * len(rows), b.schema.field(0).type), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))],
                        names=["key", "page", "width", "height", "samples", "compression", "predictor", "tiled", "pixels", "error"],
                    )

    out = files.select(F.col(key), F.col(content)).mapInArrow(
        decode, f"key {kind}, page int, width int, height int, samples int, compression int, predictor int, tiled boolean, pixels binary, error string"
    )
    return out.withColumnRenamed("key", key)


#: Samples of a row, and rows of a page, in the stored form of texts.
WIDTH, PAGE_ROWS = 576, 1024


def store(payload: bytes) -> bytes:
    """A payload of whole rows as a TIFF file with pages of at most PAGE_ROWS rows, deflate strips and predictor 2."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return write_pages([image[y : y + PAGE_ROWS] for y in range(0, len(image), PAGE_ROWS)], DEFLATE, predictor=2)


def store_texts(docs: DataFrame) -> DataFrame:
    """Stores each text as a TIFF file, reads the file back page by page and describes what was read.

    feature: pages, size of the first page, then least, greatest and mean sample in thousandths and the
    count of samples in each quarter of the range. Null text counts as empty: one row of 255s. A long text is an
    image of many rows in strips; repeated rows give a row each; an empty table gives no rows; other columns are
    ignored.
    """
    small_batches(docs.sparkSession, 200)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in names[1:]]
            for text in b.column(1).to_pylist():
                raw = (text or "").encode()
                payload = raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, b"\xff")
                blob = store(payload)
                pages = list(read_pages(blob))
                back = b"".join(p.data.tobytes() for p in pages)
                seen = np.bincount(np.frombuffer(back, np.uint8), minlength=256)
                used = np.flatnonzero(seen)
                mean = int((seen * np.arange(256)).sum()) * 1000 // len(back)
                quarters = ",".join(str(int(x)) for x in seen.reshape(4, 64).sum(axis=1))
                feature = f"pages={len(pages)};size={pages[0].width}x{pages[0].height};min={used[0]};max={used[-1]};mean={mean};quarters={quarters}"
                row = (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(blob), hashlib.sha256(blob).hexdigest(), feature)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=names)

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


def op9_media_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_texts(read(spark, sf_dir, "documents"))
