"""Media inventory: a recursive scan, and sizes and dates from the files' own structure, wherever in a file it stands.

The scan lists files without their content; each is then opened for random access, and only its headers are read.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The extensions that count as media.
PHOTOS = (".jpg", ".jpeg", ".png", ".heic")
VIDEOS = (".mp4", ".mov", ".m4v", ".avi")
MAC_EPOCH = 2_082_844_800  # seconds from 1904 to 1970
PLAUSIBLE = (631_152_000, 4_102_444_800)  # 1990 to 2100: other dates of a movie header are no capture dates
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"iprp", b"ipco"}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def kind(path: Column) -> Column:
    return F.when(extension(path).isin(*PHOTOS), "photo").when(extension(path).isin(*VIDEOS), "video")


def _exif_date(segment: bytes) -> str | None:
    """The date text of a TIFF block: original, digitised, or changed, in this order."""
    if len(segment) < 8 or segment[:4] not in (b"II*\0", b"MM\0*"):  # the byte order and 42
        return None
    end = "<" if segment[:2] == b"II" else ">"

    def tags(at: int) -> dict[int, tuple[int, int, int]]:
        if at + 2 > len(segment):
            return {}
        n = struct.unpack_from(end + "H", segment, at)[0]
        return {t: (k, c, v) for t, k, c, v in (struct.unpack_from(end + "HHII", segment, at + 2 + 12 * i) for i in range(min(n, (len(segment) - at - 2) // 12)))}

    first = tags(struct.unpack_from(end + "I", segment, 4)[0])
    inner = tags(first[0x8769][2]) if 0x8769 in first else {}
    for found, tag in ((inner, 0x9003), (inner, 0x9004), (first, 0x0132)):
        if tag in found and found[tag][0] == 2:
            _, count, at = found[tag]
            text = segment[at : at + count].split(b"\0")[0].decode("ascii", "replace").strip()
            if len(text) >= 19:
                return f"{text[:4]}-{text[5:7]}-{text[8:10]}T{text[11:19]}"
    return None


class Bytes:
    """Random access to a file: its size, and n bytes at a place (fewer at its end)."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.size = file, file.size()

    def at(self, place: int, n: int) -> bytes:
        self.file.seek(min(place, self.size))
        return self.file.read(max(0, n))


def _jpeg(data: Bytes) -> dict:
    out: dict = {}
    at = 2
    while at + 4 <= data.size:
        head = data.at(at, 9)
        if head[0] != 0xFF or head[1] in (0x00, 0xFF):  # stray bytes and fill: on to the next marker
            at += 1
            continue
        marker = head[1]
        if marker == 0x01 or 0xD0 <= marker <= 0xD8:
            at += 2
            continue
        if marker in (0xD9, 0xDA):
            break
        size = struct.unpack_from(">H", head, 2)[0]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and len(head) == 9:
            out["height"], out["width"] = struct.unpack_from(">HH", head, 5)
        elif marker == 0xE1 and size > 8 and not out.get("captured"):
            segment = data.at(at + 4, size - 2)
            if segment[:6] == b"Exif\0\0":
                out["captured"] = _exif_date(segment[6:])
        at += 2 + max(size, 2)
    return out


def _boxes(data: Bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Name, first and last place of each box's content; a box of size 0 goes on to the end, one beyond the end is cut there."""
    while at + 8 <= end:
        head = data.at(at, 16)
        size, name = struct.unpack_from(">I4s", head)
        skip = 8
        if size == 1 and len(head) == 16:
            size, skip = struct.unpack_from(">Q", head, 8)[0], 16
        size = size or end - at
        if size < skip:
            return
        yield name, at + skip, min(at + size, end)
        at += size


def _movie(data: Bytes) -> dict:
    """Duration and date of the movie header, and the greatest size of any track or image, wherever in the file they stand."""
    out: dict = {}

    def larger(width: int, height: int) -> None:
        if width > 0 and height > 0 and width * height > out.get("width", 0) * out.get("height", 0):
            out["width"], out["height"] = width, height

    stack = [(0, data.size)]
    while stack:
        for name, a, b in _boxes(data, *stack.pop()):
            body = data.at(a, min(b - a, 128)) if name in (b"mvhd", b"tkhd", b"ispe") else b""
            wide = body[:1] == b"\1"
            if name == b"mvhd" and len(body) >= (32 if wide else 20):
                made, _, scale, length = struct.unpack_from(">QQIQ" if wide else ">IIII", body, 4)
                if scale and "duration" not in out:
                    out["duration"] = length / scale
                if PLAUSIBLE[0] <= made - MAC_EPOCH <= PLAUSIBLE[1]:
                    out.setdefault("made", made - MAC_EPOCH)
            elif name == b"tkhd" and len(body) >= (96 if wide else 84):
                width, height = struct.unpack_from(">II", body, 88 if wide else 76)
                larger(width >> 16, height >> 16)
            elif name == b"ispe" and len(body) >= 12:
                larger(*struct.unpack_from(">II", body, 4))
            if name == b"meta":
                stack.append((a + 4, b))
            elif name in CONTAINERS:
                stack.append((a, b))
    return out


def header(file: pa.NativeFile, video: bool = False) -> dict:
    """width, height, captured, duration, made, note of a file; what is missing or cannot be read is a note, never an error."""
    try:
        data = Bytes(file)
        start = data.at(0, 24)
        if start[:2] == b"\xff\xd8":
            out = _jpeg(data)
        elif start[:8] == b"\x89PNG\r\n\x1a\n" and len(start) == 24:
            out = dict(zip(("width", "height"), struct.unpack_from(">II", start, 16), strict=True))
        elif start[4:8] in (b"ftyp", b"moov", b"mdat", b"wide", b"free", b"skip"):
            out = _movie(data)
        else:
            return {"note": "unknown format"}
    except (struct.error, IndexError, KeyError, UnicodeError, OSError) as e:
        return {"note": f"unreadable header: {type(e).__name__}"}
    missing = ["dimensions not found"] * ("width" not in out) + ["duration not found"] * (video and "duration" not in out)
    return out | ({"note": "; ".join(missing)} if missing else {})


def opened(path: str) -> pa.NativeFile:
    """A file of any store that Arrow knows, for random access: only the bytes that are asked for are read."""
    store, place = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    return store.open_input_file(unquote(place) if "%" in place else place)


def scan(spark: SparkSession, root: str, media_set: str | None = None) -> DataFrame:
    """media_set, relative_path, kind, bytes, created (when the file was last written), width, height, duration_seconds, capture_date, capture_date_source, note of each media file under root; empty files hold no media and are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    media = files.where(kind(F.col("path")).isNotNull()).select("path", "length", "modificationTime", kind(F.col("path")).alias("kind"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = {"width": pa.int32(), "height": pa.int32(), "duration": pa.float64(), "captured": pa.string(), "made": pa.int64(), "note": pa.string()}
        for b in batches:
            found = []
            for path, what in zip(b.column("path").to_pylist(), b.column("kind").to_pylist(), strict=True):
                try:
                    with opened(path) as file:
                        found.append(header(file, what == "video"))
                except (OSError, ValueError) as e:
                    found.append({"note": f"unreadable file: {type(e).__name__}"})
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("length"), b.column("modificationTime"), *(pa.array([f.get(k) for f in found], t) for k, t in fields.items())], names=["path", "length", "modificationTime", *fields])

    schema = "path string, length long, modificationTime timestamp, width int, height int, duration double, captured string, made long, note string"
    read = media.mapInArrow(work, schema)
    stem = root.rstrip("/").removeprefix("file://")
    metadata = F.coalesce(F.try_to_timestamp("captured"), F.when(F.col("made") > 0, F.timestamp_seconds("made")))
    return read.select(
        F.lit(media_set).cast("string").alias("media_set"),
        F.regexp_replace("path", f"^(?:file:)?/*{stem.lstrip('/')}/", "").alias("relative_path"),
        kind(F.col("path")).alias("kind"),
        F.col("length").alias("bytes"),
        F.col("modificationTime").alias("created"),
        "width",
        "height",
        F.col("duration").alias("duration_seconds"),
        F.coalesce(metadata, "modificationTime").alias("capture_date"),
        F.when(metadata.isNotNull(), "metadata").otherwise("modified").alias("capture_date_source"),
        "note",
    )
