"""ISO media containers: build, walk and index them without decoding payloads.

``mux`` wraps a payload of fixed-size samples into a one-track file; ``probe`` walks the nested boxes of any file,
decodes the sample tables and gives codec, duration and the byte ranges of the key frames; ``samples_of`` reads the
stored samples back through those tables.  The tables are ``stsd``, ``stsz`` or ``stz2``, ``stsc``, ``stco`` or ``co64``,
``stss``, ``stts`` and ``ctts``, and those of movie fragments (``trex``, ``tfhd``, ``trun``).  The duration is the sum of the
durations of the samples that are there, or the header's where no table tells.

Null or empty media, and bytes that are no container, give null columns and a reason in ``error``; a truncated box is
read as far as it goes.  A track without a sync table has only key frames, as the format defines.  Repeated rows give
equal values, and very long files cost memory in proportion to one file: a number of samples that a table claims is
believed only as far as there are entries, or bytes in the file, for them.
"""

from __future__ import annotations

import dataclasses
import json
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices

SAMPLE_BYTES = 192  # a frame of 16 x 12 points of 8 bits
FRAME = (16, 12)
RATE = 25
KEY_EVERY = 12

_CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"}


def _box(kind: bytes, *parts: bytes) -> bytes:
    n = 8 + sum(map(len, parts))
    head = struct.pack(">I4s", n, kind) if n < 1 << 32 else struct.pack(">I4sQ", 1, kind, n + 8)
    return b"".join((head, *parts))


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
_FTYP = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")


def mux(payload: bytes) -> bytes:
    """A file whose one video track stores ``payload`` (a positive multiple of 192 bytes) as raw 8-bit frames, one chunk
    for each group of frames that begins with a key frame.  Equal payloads give equal files."""
    n, rest = divmod(len(payload), SAMPLE_BYTES)
    if rest or not n:
        raise ValueError(f"a payload is a positive multiple of {SAMPLE_BYTES} bytes, not {len(payload)}")
    groups, odd = divmod(n, KEY_EVERY)
    chunks = groups + (odd > 0)
    per_chunk = [(1, KEY_EVERY)] * (groups > 0) + [(groups + 1, odd)] * (odd > 0)
    keys = np.arange(1, n + 1, KEY_EVERY, dtype=">u4")
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", *FRAME, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 8, -1))

    def moov(first: int, wide: bool) -> bytes:
        offsets = first + np.arange(chunks, dtype=np.uint64) * np.uint64(KEY_EVERY * SAMPLE_BYTES)
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, 1)),
            _full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            _full(b"stsc", struct.pack(">I", len(per_chunk)), *(struct.pack(">III", a, k, 1) for a, k in per_chunk)),
            _full(b"stsz", struct.pack(">II", SAMPLE_BYTES, n)),
            _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
        )
        minf = _box(b"minf", _full(b"vmhd", bytes(8), flags=1), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl)
        mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0)), _full(b"hdlr", bytes(4), b"vide", bytes(13)), minf)
        tkhd = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(16), _MATRIX, struct.pack(">II", FRAME[0] << 16, FRAME[1] << 16), flags=3)
        mvhd = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, n, 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    wide = len(payload) > 1 << 31
    head = len(_FTYP) + len(moov(0, wide)) + (16 if len(payload) + 8 >= 1 << 32 else 8)
    return b"".join((_FTYP, moov(head, wide), _box(b"mdat", payload)))


def _longs(n: int) -> np.ndarray:
    return np.zeros(n, np.int64)


@dataclass
class Track:
    """Samples lie side by side in chunks, which are kept instead of the samples where these have one size."""

    number: int = 0
    handler: str = ""
    codec: str = ""
    timescale: int = 0
    ticks: int = 0  # of the samples that are there
    width: int = 0
    height: int = 0
    count: int = 0
    fixed: int = 0  # the size of every sample, or 0
    before: np.ndarray = field(default_factory=lambda: _longs(1))  # bytes of the samples before each one, where sizes differ
    chunk_at: np.ndarray = field(default_factory=lambda: _longs(0))
    ends: np.ndarray = field(default_factory=lambda: _longs(0))  # samples up to the end of each chunk
    keys: np.ndarray | None = None  # from 0; none: all samples
    steps: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (_longs(0), _longs(0)))  # runs of samples and their durations
    shifts: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (_longs(0), _longs(0)))  # and of presentation after decoding

    def _bytes_before(self, i: np.ndarray) -> np.ndarray:
        return i * self.fixed if self.fixed else self.before[i]

    def chunk_ranges(self) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each chunk that holds samples."""
        first = np.append(0, self.ends[:-1])
        n = self._bytes_before(self.ends) - self._bytes_before(first) if len(self.ends) else _longs(0)
        return self.chunk_at[n > 0], (self.chunk_at + n)[n > 0]

    def ranges(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offset and length of samples."""
        chunk = np.searchsorted(self.ends, i, side="right")
        first = np.append(0, self.ends)[chunk]
        at = self._bytes_before(i)
        return self.chunk_at[chunk] + at - self._bytes_before(first), self._bytes_before(i + 1) - at

    def key_ranges(self) -> list[tuple[int, int]]:
        """Byte ranges of the key frames.  Samples of one size that are all key frames count by chunks, in which no byte
        belongs to anything else: there may be one for each byte of the file."""
        if self.keys is None and self.fixed:
            at, end = self.chunk_ranges()
            return list(zip(at.tolist(), (end - at).tolist(), strict=True))
        at, n = self.ranges(self.key_samples())
        return list(zip(at.tolist(), n.tolist(), strict=True))

    def key_samples(self) -> np.ndarray:
        """The first sample of each of ``key_ranges``."""
        if self.keys is not None:
            return self.keys
        if self.fixed:
            first = np.append(0, self.ends[:-1])[: len(self.ends)]
            return first[self.ends > first]
        return np.arange(self.count)

    def key_times(self) -> np.ndarray:
        """Presentation times of the key frames in seconds, edit lists aside."""
        i = self.key_samples()
        n, step = self.steps
        at = np.zeros(len(i))
        if len(n):
            ends = np.cumsum(n)
            run = np.minimum(np.searchsorted(ends, i, side="right"), len(n) - 1)
            at = (np.cumsum(n * step.astype(float)) - n * step.astype(float))[run] + (i - (ends - n)[run]) * step[run].astype(float)
        n, shift = self.shifts
        if len(n):
            at = at + np.append(shift, 0)[np.searchsorted(np.cumsum(n), i, side="right")]
        return at / self.timescale if self.timescale else at


def boxes(data: memoryview, begin: int = 0, end: int | None = None):
    """``(kind, begin of content, end)`` of the boxes side by side in a range."""
    end = len(data) if end is None else end
    while begin + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, begin)
        head = 8
        if size == 1:
            if begin + 16 > end:
                return
            (size,) = struct.unpack_from(">Q", data, begin + 8)
            head = 16
        elif size == 0:  # to the end of what holds it
            size = end - begin
        if size < head:
            return
        yield kind, begin + head, min(begin + size, end)
        begin += size


def walk(data: memoryview, begin: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()):
    """``(path, begin, end)`` of all boxes, outer before inner, without recursion deeper than the format's containers."""
    for kind, a, b in boxes(data, begin, end):
        yield (*path, kind), a, b
        if kind in _CONTAINERS and len(path) < 16:
            yield from walk(data, a, b, (*path, kind))


def _table(data: memoryview, at: int, end: int, count: int, kind: str, columns: int = 1) -> np.ndarray:
    one = np.dtype(kind)
    count = max(0, min(count, (end - at) // (one.itemsize * columns)))
    return np.frombuffer(data, one, count * columns, at).astype(np.int64).reshape(count, columns)


def _u32(data: memoryview, at: int) -> int:
    return struct.unpack_from(">I", data, at)[0]


def _sizes(data: memoryview, stbl: dict[bytes, tuple[int, int]]) -> tuple[int, int, np.ndarray]:
    """``number of samples, their one size or 0, sizes where they differ``.  A number is only as large as the table behind it,
    unless all samples have one size."""
    if b"stsz" in stbl:
        a, b = stbl[b"stsz"]
        fixed, n = struct.unpack_from(">II", data, a + 4)
        if fixed:
            return n, fixed, _longs(0)
        own = _table(data, a + 12, b, n, ">u4").ravel()
    elif b"stz2" in stbl:
        a, b = stbl[b"stz2"]
        bits, n = data[a + 7], _u32(data, a + 8)
        if bits == 4:
            pairs = np.frombuffer(data, np.uint8, max(0, min(b - a - 12, (n + 1) // 2)), a + 12).astype(np.int64)
            own = np.stack((pairs >> 4, pairs & 15), 1).ravel()[:n]
        else:
            own = _table(data, a + 12, b, n, ">u2" if bits == 16 else ">u1").ravel()
    else:
        own = _longs(0)
    return len(own), 0, own


def _runs(data: memoryview, box: tuple[int, int] | None, most: int, signed: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A table of runs ``(samples, value)``, of ``most`` samples at most in all."""
    if box is None:
        return _longs(0), _longs(0)
    a, b = box
    rows = _table(data, a + 8, b, _u32(data, a + 4), ">i4" if signed else ">u4", 2)
    ends = np.minimum(np.cumsum(rows[:, 0] & 0xFFFFFFFF), most)
    return np.diff(np.append(0, ends)), rows[:, 1]


def _sample_table(data: memoryview, track: Track, stbl: dict[bytes, tuple[int, int]]) -> None:
    if b"stsd" in stbl:
        a, b = stbl[b"stsd"]
        for kind, x, y in boxes(data, a + 8, b):
            track.codec = kind.decode("latin-1")
            if track.handler == "vide" and y - x >= 28:
                track.width, track.height = struct.unpack_from(">HH", data, x + 24)
            break
    n, track.fixed, sizes = _sizes(data, stbl)
    chunk_at = _longs(0)
    for kind, one in ((b"stco", ">u4"), (b"co64", ">u8")):
        if kind in stbl:
            a, b = stbl[kind]
            chunk_at = _table(data, a + 8, b, _u32(data, a + 4), one).ravel()
            chunk_at = np.where(chunk_at < 0, len(data), chunk_at)  # from 2^63 on
    if b"stsc" in stbl and len(chunk_at) and n:
        a, b = stbl[b"stsc"]
        runs = _table(data, a + 8, b, _u32(data, a + 4), ">u4", 3)
        chunk = np.searchsorted(runs[:, 0], np.arange(1, len(chunk_at) + 1), side="right") - 1
        per = np.where(chunk >= 0, runs[:, 1][chunk.clip(0)], 0) if len(runs) else _longs(len(chunk_at))
        if track.fixed:  # no more than the file has bytes for
            per = np.minimum(per, ((len(data) - chunk_at) // track.fixed).clip(0))
        track.ends = np.minimum(np.cumsum(per), n)
        track.chunk_at = chunk_at
        track.count = int(track.ends[-1])
    track.before = np.append(0, np.cumsum(sizes[: track.count]))
    if b"stss" in stbl:
        a, b = stbl[b"stss"]
        keys = _table(data, a + 8, b, _u32(data, a + 4), ">u4").ravel() - 1
        track.keys = keys[(keys >= 0) & (keys < track.count)]
    if b"stts" in stbl:
        track.steps = _runs(data, stbl[b"stts"], track.count)
        track.ticks = sum(n * step for n, step in zip(track.steps[0].tolist(), track.steps[1].tolist(), strict=True))
    shifts = stbl.get(b"ctts")
    track.shifts = _runs(data, shifts, track.count, signed=bool(shifts and data[shifts[0]]))


@dataclass
class _Defaults:
    duration: int = 0
    size: int = 0
    flags: int = 0


NOT_SYNC = 0x10000


def _fragment(data: memoryview, start: int, box: tuple[int, int], tracks: dict[int, Track], defaults: dict[int, _Defaults], parts: dict[int, list]) -> None:
    """The samples of one movie fragment: ``(offset, sizes, durations, shifts, sync)`` of each of its runs by track."""
    for kind, a, b in boxes(data, *box):
        if kind != b"traf":
            continue
        number, base, own, at = 0, start, _Defaults(), start
        for kind, x, y in boxes(data, a, b):
            if kind == b"tfhd":
                flags, number = _u32(data, x) & 0xFFFFFF, _u32(data, x + 4)
                own, p = dataclasses.replace(defaults.get(number, _Defaults())), x + 8
                if flags & 1:
                    (base,) = struct.unpack_from(">Q", data, p)
                    p += 8
                p += 4 if flags & 2 else 0
                for bit, name in ((8, "duration"), (16, "size"), (32, "flags")):
                    if flags & bit:
                        setattr(own, name, _u32(data, p))
                        p += 4
                at = base
            elif kind == b"trun" and number in tracks:
                flags, n, p = _u32(data, x) & 0xFFFFFF, _u32(data, x + 4), x + 8
                if flags & 1:
                    at = base + struct.unpack_from(">i", data, p)[0]
                    p += 4
                first = _u32(data, p) if flags & 4 else None
                p += 4 if flags & 4 else 0
                fields = [name for bit, name in ((0x100, "duration"), (0x200, "size"), (0x400, "flags"), (0x800, "shift")) if flags & bit]
                rows = _table(data, p, y, n, ">u4", len(fields)) if fields else None
                n = len(rows) if fields else min(n, max(0, len(data) - at) // own.size if own.size else 0)
                column = lambda name, other: rows[:, fields.index(name)] if name in fields else np.full(n, other, np.int64)  # noqa: B023, E731
                sizes, sync = column("size", own.size), (column("flags", own.flags) & NOT_SYNC) == 0
                if first is not None and n:
                    sync[0] = not first & NOT_SYNC
                shift = column("shift", 0)
                if data[x]:  # signed from version 1 on
                    shift = shift - ((shift >> 31) << 32)
                parts.setdefault(number, []).append((at, sizes, column("duration", own.duration), shift, sync))
                at += int(sizes.sum())


def _with_fragments(track: Track, parts: list) -> None:
    """A track with the samples of its fragments after those of its own tables."""
    at, sizes, steps, shifts, sync = zip(*parts, strict=True)
    own = np.diff(track.before) if not track.fixed else np.full(track.count, track.fixed, np.int64)
    n = np.array([len(x) for x in sizes], np.int64)
    steps, shifts, sync = (np.concatenate(x) for x in (steps, shifts, sync))
    keys = track.keys if track.keys is not None else np.arange(track.count)
    track.keys = np.append(keys, track.count + np.flatnonzero(sync))
    if not len(track.shifts[0]):
        track.shifts = (np.array([track.count]), _longs(1))
    track.steps = (np.append(track.steps[0], np.ones(len(steps), np.int64)), np.append(track.steps[1], steps))
    track.shifts = (np.append(track.shifts[0], np.ones(len(shifts), np.int64)), np.append(track.shifts[1], shifts))
    track.ends = np.append(track.ends, track.count + np.cumsum(n))
    track.chunk_at = np.append(track.chunk_at, np.array(at, np.int64))
    track.count, track.fixed = int(track.ends[-1]), 0
    track.before = np.append(0, np.cumsum(np.concatenate((own, *sizes))))
    track.ticks = (track.ticks if len(own) else 0) + int(steps.sum())


def probe(media: bytes) -> list[Track]:
    """The tracks of a file, those of movie fragments included.  Raises ``ValueError`` where there is no movie box or a
    table is cut off."""
    data = memoryview(media)
    tracks: list[Track] = []
    tables: list[dict[bytes, tuple[int, int]]] = []
    defaults: dict[int, _Defaults] = {}
    try:
        for path, a, b in walk(data):
            kind = path[-1]
            if path == (b"moov", b"trak"):
                tracks.append(Track())
                tables.append({})
            elif path == (b"moov", b"mvex", b"trex"):
                number, _, *rest = struct.unpack_from(">5I", data, a + 4)
                defaults[number] = _Defaults(*rest)
            elif path[:2] != (b"moov", b"trak"):
                continue
            elif kind == b"tkhd":
                tracks[-1].number = _u32(data, a + (20 if data[a] else 12))
            elif kind == b"mdhd":
                at, form = (a + 20, ">IQ") if data[a] else (a + 12, ">II")
                tracks[-1].timescale, tracks[-1].ticks = struct.unpack_from(form, data, at)
            elif kind == b"hdlr":
                tracks[-1].handler = bytes(data[a + 8 : a + 12]).decode("latin-1")
            elif path[-2] == b"stbl":
                tables[-1][kind] = (a, b)
        for track, table in zip(tracks, tables, strict=True):
            _sample_table(data, track, table)
        known, parts, start = {t.number: t for t in tracks}, {}, 0
        for kind, a, b in boxes(data):
            if kind == b"moof":
                _fragment(data, start, (a, b), known, defaults, parts)
            start = b
        for number, runs in parts.items():
            _with_fragments(known[number], runs)
    except (struct.error, IndexError) as e:
        raise ValueError(f"cut off: {e}") from e
    if not tracks:
        raise ValueError("no movie box")
    return tracks


def main_track(tracks: list[Track]) -> Track:
    return next((t for t in tracks if t.handler == "vide"), tracks[0])


def samples_of(media: bytes, track: Track) -> bytes:
    """The bytes of a track's samples in order, read through its tables; neighbouring chunks in one piece."""
    at, end = track.chunk_ranges()
    if not len(at):
        return b""
    cut = np.flatnonzero(at[1:] != end[:-1]) + 1
    return b"".join(media[a:b] for a, b in zip(at[np.append(0, cut)].tolist(), end[np.append(cut - 1, len(end) - 1)].tolist(), strict=True))


def feature_of(track: Track) -> str:
    """What a media column stores of a file, as JSON: codec, duration and key frames' byte ranges as ``offset+length``."""
    return json.dumps({
        "codec": track.codec, "width": track.width, "height": track.height, "timescale": track.timescale, "ticks": track.ticks,
        "samples": track.count, "keyframes": ",".join(f"{a}+{n}" for a, n in track.key_ranges()),
    })


PROBED = T.StructType([
    T.StructField("codec", T.StringType()), T.StructField("duration_s", T.DoubleType()), T.StructField("samples", T.LongType()),
    T.StructField("keyframes", T.ArrayType(T.StructType([T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("time_s", T.DoubleType())]))),
    T.StructField("error", T.StringType()),
])


def probe_media(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """``id_col`` and the ``PROBED`` columns for each row's main track."""
    own = df.select(id_col, media_col)
    ranges = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("time_s", pa.float64())]))

    def one(media: bytes | None):
        if not media:
            return None, None, None, None, "no media"
        try:
            t = main_track(probe(media))
        except ValueError as e:
            return None, None, None, None, str(e)
        frames = [{"offset": a, "length": n, "time_s": at} for (a, n), at in zip(t.key_ranges(), t.key_times().tolist(), strict=True)]
        return t.codec, t.ticks / t.timescale if t.timescale else None, t.count, frames, None

    def run(batches):
        for batch in batches:
            for part in slices(batch, media_col):
                rows = [one(m) for m in part.column(1).to_pylist()]
                kinds = (pa.string(), pa.float64(), pa.int64(), ranges, pa.string())
                cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=[id_col, *PROBED.names])

    return own.mapInArrow(run, T.StructType([own.schema[0], *PROBED.fields]))


def payload_of(text: str) -> bytes:
    """The text in UTF-8, padded with spaces to a positive multiple of 192 bytes."""
    raw = text.encode("utf-8", "replace")
    return raw.ljust(max(1, -(-len(raw) // SAMPLE_BYTES)) * SAMPLE_BYTES)


def mux_texts(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` as ``doc_id, n_bytes, media``."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                texts = [t or "" for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t.encode("utf-8", "replace")) for t in texts], pa.int64()), pa.array([mux(payload_of(t)) for t in texts], pa.binary())],
                    names=["doc_id", "n_bytes", "media"],
                )

    return docs.mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]))


def digest_media(media: DataFrame) -> DataFrame:
    """``media(doc_id, n_bytes, media)`` read back: payload, file digests and the feature string."""
    import hashlib
    import zlib

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "media"):
                rows = []
                for m in part.column(2).to_pylist():
                    track = main_track(probe(m))
                    back = samples_of(m, track)
                    rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature_of(track)))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=names)

    schema = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, T.StructType([media.schema["doc_id"], *T._parse_datatype_string(schema).fields]))
