"""ISO media containers: write them, walk their nested boxes, decode sample tables.

``describe`` reads a container's boxes and tables only (never a payload) and gives for each track codec, time scale,
duration, samples, chunks and the byte ranges of runs of samples that start at a sync sample. Samples of fragments
(movie fragment boxes with their runs) follow those of the sample tables. ``mux`` stores bytes losslessly as 8-bit
samples in frames of 64. Payload bytes are read back through the decoded tables, not from a known place.

A null or empty file is described with ``error`` = 'empty' and nulls, a damaged one with what is wrong; neither stops a
job. Repeated rows and ties are described each for itself; an empty table gives an empty result; extra columns are kept or left out as the caller says.
A text is handled whole, so a task's memory is a few times its largest file.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, tidy

#: Box types that hold boxes (fixed values of the format).
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"dinf", b"stbl", b"edts", b"udta", b"mvex", b"moof", b"traf", b"mfra"}
FRAME, CHUNK_FRAMES, SYNC_FRAMES, RATE = 64, 32, 64, 8000


class Damaged(ValueError):
    pass


def boxes(data: memoryview, lo: int = 0, hi: int | None = None, depth: int = 0):
    """(type, first byte of the content, end) of each box from lo to hi; contents of container boxes are not entered."""
    hi = len(data) if hi is None else hi
    while lo < hi:
        if hi - lo < 8:
            raise Damaged("box header cut off")
        size, kind = struct.unpack_from(">I4s", data, lo)
        head = 8
        if size == 1:
            if hi - lo < 16:
                raise Damaged("box header cut off")
            size, head = struct.unpack_from(">Q", data, lo + 8)[0], 16
        elif size == 0:
            size = hi - lo
        if size < head or lo + size > hi:
            raise Damaged(f"box {kind.decode('latin1')} leaves its parent")
        yield kind, lo + head, lo + size
        lo += size


def tree(data: memoryview, lo: int = 0, hi: int | None = None, path: tuple = (), depth: int = 0):
    """All boxes, parents first, as (path of types, content start, end); a path has the ordinal of each trak."""
    if depth > 16:
        raise Damaged("boxes nested too deep")
    traks = 0
    for kind, a, z in boxes(data, lo, hi):
        name = kind.decode("latin1")
        if kind == b"trak":
            name, traks = f"trak{traks}", traks + 1
        yield (*path, name), a, z
        if kind in CONTAINERS:
            yield from tree(data, a, z, (*path, name), depth + 1)


def _table(data, at: int, end: int, kind: str, columns: int = 1) -> np.ndarray:
    if end - at < 8:
        raise Damaged("table cut off")
    n, kind = struct.unpack_from(">I", data, at + 4)[0], np.dtype(kind)
    if n * columns * kind.itemsize > end - at - 8:
        raise Damaged("table longer than its box")
    return np.frombuffer(data, kind, n * columns, at + 8).astype(np.int64).reshape(n, columns)


def _first(counts: np.ndarray, n: int) -> np.ndarray:
    """Counts cut down where they go beyond n in all."""
    return np.diff(np.minimum(np.cumsum(np.minimum(counts, n)), n), prepend=0)


def track(data: memoryview, found: dict) -> dict:
    """Codec, times and samples (offset, size, start time, sync) of one track from its sample tables."""

    def need(name):
        if name not in found:
            raise Damaged(f"no {name}")
        return found[name]

    a, z = need("mdhd")
    scale, duration = struct.unpack_from(">IQ", data, a + 20) if data[a] else struct.unpack_from(">II", data, a + 12)
    a, z = need("stsd")
    if struct.unpack_from(">I", data, a + 4)[0] < 1 or z - a < 16:
        raise Damaged("no sample entry")
    codec = bytes(data[a + 12 : a + 16]).decode("latin1")
    a, z = need("stsz")
    size, n = struct.unpack_from(">II", data, a + 4)
    if size:
        if n * size > len(data):
            raise Damaged("samples beyond the file")
        sizes = np.full(n, size, np.int64)
    else:
        if 4 * n > z - a - 12:
            raise Damaged("table longer than its box")
        sizes = np.frombuffer(data, ">u4", n, a + 12).astype(np.int64)
    chunk_at = _table(data, *need("co64"), ">u8")[:, 0] if "co64" in found else _table(data, *need("stco"), ">u4")[:, 0]
    runs = _table(data, *need("stsc"), ">u4", 3)
    first = np.append(runs[:, 0] - 1, len(chunk_at))
    if len(runs) and (first[0] != 0 or (np.diff(first) < 0).any()):
        raise Damaged("chunk runs out of order")
    per = np.repeat(runs[:, 1], np.diff(first)) if len(runs) else np.zeros(0, np.int64)
    if per.sum() < n:
        raise Damaged("fewer samples in chunks than sizes")
    per = _first(per, n)
    chunk = np.repeat(np.arange(len(per)), per)[:n]
    start = np.concatenate([[0], np.cumsum(sizes)])
    lead = np.concatenate([[0], np.cumsum(per)])[:-1]
    offset = chunk_at[chunk] + start[:-1] - start[np.minimum(lead, n)][chunk] if n else np.zeros(0, np.int64)
    times = _table(data, *need("stts"), ">u4", 2)
    delta = np.repeat(times[:, 1], _first(times[:, 0], n))[:n]
    if len(delta) < n:
        raise Damaged("fewer times than samples")
    sync = np.ones(n, bool)
    if "stss" in found:
        sync[:] = False
        marked = _table(data, *found["stss"], ">u4")[:, 0] - 1
        sync[marked[(marked >= 0) & (marked < n)]] = True
    return {"codec": codec, "timescale": scale, "duration": int(duration), "offset": offset, "size": sizes, "time": np.cumsum(delta) - delta, "delta": delta, "sync": sync, "chunks": len(chunk_at)}


def _fields(flags: int, names: tuple, at: int) -> tuple[dict, int]:
    """Places of the 32-bit fields that ``flags`` say are there, of (bit, name), and the byte after them."""
    out = {}
    for bit, name in names:
        if flags & bit:
            out[name], at = at, at + 4
    return out, at


def fragments(data: memoryview, start: int, lo: int, hi: int, by_id: dict[int, dict], defaults: dict[int, tuple]) -> None:
    """Add the samples of one movie fragment (box from ``start``, content lo to hi) to the tracks."""
    behind = start
    for kind, a, z in boxes(data, lo, hi):
        if kind != b"traf":
            continue
        parts = list(boxes(data, a, z))
        head = next((x for k, x, _ in parts if k == b"tfhd"), None)
        if head is None:
            raise Damaged("no tfhd")
        flags, ident = struct.unpack_from(">II", data, head)
        flags &= 0xFFFFFF
        if ident not in by_id:
            raise Damaged("fragment of no track")
        t, at = by_id[ident], head + 8
        base = start if flags & 0x20000 else behind
        if flags & 1:
            base, at = struct.unpack_from(">Q", data, at)[0], at + 8
        given, _ = _fields(flags, ((2, "entry"), (8, "delta"), (16, "size"), (32, "flags")), at)
        usual = dict(zip(("delta", "size", "flags"), defaults.get(ident, (0, 0, 0))))
        usual |= {name: struct.unpack_from(">I", data, place)[0] for name, place in given.items() if name != "entry"}
        time = int(t["time"][-1] + t["delta"][-1]) if len(t["time"]) else 0
        for k, x, _ in parts:
            if k == b"tfdt":
                time = struct.unpack_from(">Q" if data[x] else ">I", data, x + 4)[0]
        place = base
        for k, x, end in parts:
            if k != b"trun":
                continue
            flags, n = struct.unpack_from(">II", data, x)
            given, at = _fields(flags, ((1, "offset"), (4, "first")), x + 8)
            if "offset" in given:
                place = base + struct.unpack_from(">i", data, given["offset"])[0]
            columns = [name for bit, name in ((0x100, "delta"), (0x200, "size"), (0x400, "flags"), (0x800, "shift")) if flags & bit]
            if 4 * n * len(columns) > end - at:
                raise Damaged("table longer than its box")
            if n * max(1, 0 if "size" in columns else usual["size"]) > len(data):
                raise Damaged("samples beyond the file")
            rows = np.frombuffer(data, ">u4", n * len(columns), at).astype(np.int64).reshape(n, len(columns))
            value = {name: rows[:, columns.index(name)] if name in columns else np.full(n, usual[name], np.int64) for name in ("delta", "size", "flags")}
            if n and "first" in given:
                value["flags"] = value["flags"].copy()
                value["flags"][0] = struct.unpack_from(">I", data, given["first"])[0]
            ends = np.cumsum(value["size"])
            t["offset"] = np.concatenate([t["offset"], place + ends - value["size"]])
            t["size"] = np.concatenate([t["size"], value["size"]])
            t["time"] = np.concatenate([t["time"], time + np.cumsum(value["delta"]) - value["delta"]])
            t["delta"] = np.concatenate([t["delta"], value["delta"]])
            t["sync"] = np.concatenate([t["sync"], value["flags"] & 0x10000 == 0])
            t["chunks"] += 1
            place, time = place + int(ends[-1] if n else 0), time + int(value["delta"].sum())
        behind = place
        t["duration"] = max(t["duration"], time)


def tracks(data) -> list[dict]:
    data, by, defaults, moofs, at = memoryview(data), {}, {}, [], 0
    for kind, a, z in boxes(data):
        if kind == b"moov":
            for path, x, y in tree(data, a, z):
                if path[0].startswith("trak"):
                    by.setdefault(path[0], {})[path[-1]] = (x, y)
                elif path[-1] == "trex":
                    ident, _, *usual = struct.unpack_from(">5I", data, x + 4)
                    defaults[ident] = tuple(usual)
        elif kind == b"moof":
            moofs.append((at, a, z))
        at = z
    if not by:
        raise Damaged("no track")
    found = [by[k] for k in sorted(by, key=lambda x: int(x[4:]))]
    out = [track(data, boxes_of) for boxes_of in found]
    if moofs:
        by_id = {}
        for t, boxes_of in zip(out, found):
            if "tkhd" not in boxes_of:
                raise Damaged("no tkhd")
            x = boxes_of["tkhd"][0]
            by_id[struct.unpack_from(">I", data, x + (20 if data[x] else 12))[0]] = t
        for start, a, z in moofs:
            fragments(data, start, a, z, by_id, defaults)
    return out


def keyframes(t: dict) -> list[tuple[int, int]]:
    """Byte range from each sync sample to the end of the last sample before the next one (end exclusive)."""
    at = np.flatnonzero(t["sync"])
    if not len(at):
        return []
    last = np.append(at[1:], len(t["sync"])) - 1
    return list(zip(t["offset"][at].tolist(), (t["offset"][last] + t["size"][last]).tolist()))


def payload(data, t: dict) -> bytes:
    """The track's samples in order, as its tables place them."""
    end = t["offset"] + t["size"]
    if len(end) and (int(end.max()) > len(data) or int(t["offset"].min()) < 0):
        raise Damaged("sample beyond the file")
    breaks = np.flatnonzero(t["offset"][1:] != end[:-1]) + 1
    lo, hi = np.concatenate([[0], breaks]), np.concatenate([breaks, [len(end)]]) - 1
    return b"".join(data[t["offset"][a] : end[b]] for a, b in zip(lo, hi)) if len(end) else b""


def _box(kind: bytes, *content: bytes) -> bytes:
    body = b"".join(content)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *content: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *content)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def mux(samples: bytes) -> bytes:
    """One track of 8-bit samples in frames of 64 bytes; every 64th frame is a sync sample. Chunks have 32 frames."""
    if not samples or len(samples) % FRAME:
        raise ValueError("samples must fill frames")
    n = len(samples) // FRAME
    chunks, rest = -(-n // CHUNK_FRAMES), n % CHUNK_FRAMES
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    runs = [(1, CHUNK_FRAMES, 1)] * (n >= CHUNK_FRAMES) + [(chunks, rest, 1)] * bool(rest)
    sync = range(1, n + 1, SYNC_FRAMES)

    def moov(base: int) -> bytes:
        entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, FRAME)),
            _full(b"stss", struct.pack(f">I{len(sync)}I", len(sync), *sync)),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", struct.pack(">II", FRAME, n)),
            _full(b"stco", struct.pack(">I", chunks), (base + np.arange(chunks) * (CHUNK_FRAMES * FRAME)).astype(">u4").tobytes()),
        )
        minf = _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl)
        mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n * FRAME, 0x55C4, 0)), _full(b"hdlr", struct.pack(">I4s12s", 0, b"soun", b""), b"\0"), minf)
        tkhd = _full(b"tkhd", struct.pack(">IIIII8sHHHH", 0, 0, 1, 0, n * FRAME, b"", 0, 0, 0x100, 0), _MATRIX, bytes(8), flags=7)
        mvhd = _full(b"mvhd", struct.pack(">IIIIIH10s", 0, 0, RATE, n * FRAME, 0x10000, 0x100, b""), _MATRIX, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    base = len(ftyp) + len(moov(0)) + 8
    return ftyp + moov(base) + _box(b"mdat", samples)


def padded(text: bytes) -> bytes:
    """The bytes with zeros up to a positive multiple of a frame."""
    return text + bytes(-len(text) % FRAME if text else FRAME)


KEYFRAMES = "array<struct<start:long,end:long>>"
DESCRIBED = f"tracks array<struct<codec:string,timescale:long,duration:long,n_samples:long,n_chunks:long,keyframes:{KEYFRAMES}>>, error string"
_TRACK = pa.struct([("codec", pa.string()), *((x, pa.int64()) for x in ("timescale", "duration", "n_samples", "n_chunks")), ("keyframes", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def describe(data: bytes | None) -> dict:
    """``tracks``, one entry each in the file's order, and ``error``, of which one is null."""
    if not data:
        return {"tracks": None, "error": "empty"}
    try:
        found = [(t, keyframes(t)) for t in tracks(data)]
    except (Damaged, struct.error, IndexError) as e:
        return {"tracks": None, "error": str(e) or "damaged"}
    return {"tracks": [{"codec": t["codec"], "timescale": t["timescale"], "duration": t["duration"], "n_samples": len(t["size"]), "n_chunks": t["chunks"], "keyframes": [{"start": a, "end": z} for a, z in keys]} for t, keys in found], "error": None}


def described(media: DataFrame, data: str = "media", keep=("doc_id",)) -> DataFrame:
    """Columns ``keep`` and what ``describe`` finds in the binary column ``data``."""
    keep = [c for c in keep if c not in ("tracks", "error")]
    src = media.select(*keep, F.col(data).alias("_media"))
    schema = src.drop("_media").select("*", F.lit(None).cast(DESCRIBED.split(", ")[0].split(" ", 1)[1]).alias("tracks"), F.lit(None).cast("string").alias("error")).schema

    def run(batches):
        for batch in batches:
            rows = [describe(x.as_py()) for x in batch.column("_media")]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array([r["tracks"] for r in rows], pa.list_(_TRACK)), pa.array([r["error"] for r in rows], pa.string())], names=[*keep, "tracks", "error"])

    return src.mapInArrow(tidy(run), schema)


def stored(docs: DataFrame, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """Columns ``keep``, ``n_bytes`` and ``media``, the container with the text's bytes; a null text is an empty one."""
    keep = [c for c in keep if c not in ("n_bytes", "media")]
    src = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    schema = src.drop("_text").select("*", F.lit(0).cast("long").alias("n_bytes"), F.lit(b"").alias("media")).schema

    def run(batches):
        for batch in batches:
            column = batch.column("_text").cast(pa.binary())
            for lo in range(0, batch.num_rows, 256):
                raw = column.slice(lo, 256).to_pylist()
                part = batch.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array(map(len, raw), pa.int64()), pa.array([mux(padded(r)) for r in raw], pa.binary())], names=[*keep, "n_bytes", "media"])

    return src.mapInArrow(tidy(run), schema)


def digest(raw: bytes) -> tuple:
    """Store the bytes, read the stored form back, and sum up both."""
    media = mux(padded(raw))
    t = tracks(media)[0]
    back, keys = payload(media, t), keyframes(t)
    feature = f"{t['codec'].strip()};{t['timescale']};{t['duration']};{len(t['size'])};{t['chunks']};" + ",".join(f"{a}-{z}" for a, z in keys)
    return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-FRAME:]), len(media), hashlib.sha256(media).hexdigest(), feature


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    def run(batches):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in batches:
            column = batch.column("text").cast(pa.binary())
            rows = [digest(x.as_py()) for x in column]
            cols = list(zip(*rows)) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", *names])

    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return src.mapInArrow(tidy(run), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op2(spark, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
