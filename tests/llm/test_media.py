import hashlib
import random
import struct
import zlib

from strandloom.llm import media


def test_round_trip_of_any_length():
    rnd = random.Random(1)
    for n in [0, 1, 63, 64, 65, 2047, 2048, 2049, 5000, 100_000]:
        raw = rnd.randbytes(n)
        want = media.padded(raw)
        file = media.mux(want)
        t = media.tracks(file)[0]
        assert media.payload(file, t) == want and len(want) % 64 == 0 and len(want) >= 64
        got = media.digest(raw)
        assert got[:4] == (n, len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:])) and got[4:6] == (len(file), hashlib.sha256(file).hexdigest())


def test_tables_agree_with_a_plain_reading():
    raw = bytes(range(256)) * 80
    file = media.mux(media.padded(raw))
    (d,) = media.describe(file)["tracks"]
    frames = len(media.padded(raw)) // 64
    assert (d["codec"], d["timescale"], d["duration"], d["n_samples"]) == ("raw ", 8000, frames * 64, frames)
    base = file.index(b"mdat") + 4
    keys = [(base + a * 64, base + min(a + 64, frames) * 64) for a in range(0, frames, 64)]
    assert [(k["start"], k["end"]) for k in d["keyframes"]] == keys


def test_payload_is_not_needed_to_describe():
    file = media.mux(media.padded(b"abc" * 5000))
    cut = file.index(b"mdat") + 4
    blank = file[:cut] + bytes(len(file) - cut)
    assert media.describe(blank) == media.describe(file)


def test_large_and_open_ended_boxes():
    file = media.mux(media.padded(b"xyz" * 300))
    at = file.index(b"mdat") - 4
    ended = file[:at] + struct.pack(">I4s", 0, b"mdat") + file[at + 8 :]
    assert media.describe(ended) == media.describe(file)
    wide = struct.pack(">I4sQ", 1, b"free", 16 + 5) + b"12345" + file
    assert media.describe(wide)["tracks"][0]["n_samples"] == media.describe(file)["tracks"][0]["n_samples"]


def test_damaged_files_have_an_error():
    file = media.mux(media.padded(b"abc" * 1000))
    rnd = random.Random(2)
    assert media.describe(None)["error"] == "empty" and media.describe(b"")["error"] == "empty"
    for n in range(0, len(file) - 1, 37):
        assert media.describe(file[:n])["error"]
    for _ in range(300):
        bad = bytearray(file)
        for _ in range(4):
            bad[rnd.randrange(700)] = rnd.randrange(256)
        media.describe(bytes(bad))


def box(kind, *content):
    body = b"".join(content)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def inside(file, *path):
    """(start, end) of the first box at a path."""
    lo, hi = 0, len(file)
    for kind in path:
        while file[lo + 4 : lo + 8] != kind:
            lo += struct.unpack_from(">I", file, lo)[0]
        start, hi = lo, lo + struct.unpack_from(">I", file, lo)[0]
        lo += 8
    return start, hi


def test_all_tracks_are_described():
    file = media.mux(media.padded(bytes(range(256)) * 40))
    a, z = inside(file, b"moov", b"trak")
    m, y = inside(file, b"moov")
    second = file[a:z].replace(b"raw ", b"twos")
    moov = box(b"moov", file[m + 8 : y], second)
    both = file[:m] + moov + file[y:]
    got = media.describe(both)
    assert got["error"] is None and [t["codec"] for t in got["tracks"]] == ["raw ", "twos"]
    one = media.describe(file)["tracks"][0]
    assert got["tracks"][0] == one and got["tracks"][1] == {**one, "codec": "twos"}


def fragmented(runs, tfhd=b"", tfhd_flags=0x20000, trex=(5, 10, 0x10000)):
    """A file without samples in its tables, and a fragment for each list of runs (flags, fields, rows of 32-bit numbers)."""
    empty = media.mux(bytes(64))
    stsd = empty[slice(*inside(empty, b"moov", b"trak", b"mdia", b"minf", b"stbl", b"stsd"))]
    table = lambda kind, *x: box(kind, struct.pack(f">I{len(x)}I", 0, *x))
    stbl = box(b"stbl", stsd, table(b"stts", 0), table(b"stsc", 0), table(b"stsz", 0, 0), table(b"stco", 0))
    mdhd = box(b"mdhd", struct.pack(">IIIIIHH", 0, 0, 0, 1000, 0, 0, 0))
    tkhd = box(b"tkhd", struct.pack(">IIII", 0, 0, 0, 7), bytes(68))
    mvex = box(b"mvex", box(b"trex", struct.pack(">IIIIII", 0, 7, 1, *trex)))
    out = box(b"ftyp", b"isom", bytes(4)) + box(b"moov", box(b"trak", tkhd, box(b"mdia", mdhd, box(b"minf", stbl))), mvex)
    starts = []
    for run in runs:
        made = [box(b"trun", struct.pack(">II", flags, n), fields, b"".join(struct.pack(f">{len(r)}I", *r) for r in rows)) for flags, n, fields, rows in run]
        starts.append(len(out))
        out += box(b"moof", box(b"mfhd", bytes(8)), box(b"traf", box(b"tfhd", struct.pack(">II", tfhd_flags, 7), tfhd), *made)) + box(b"mdat", bytes(200))
    return out, starts


def test_fragments():
    # Five samples in two fragments: sizes by run or by default, sync by flags; the third begins where the second ends.
    first = [(0x201, 2, struct.pack(">i", 500), [(11,), (12,)]), (0x4, 1, struct.pack(">I", 0), [])]
    second = [(0x701, 2, struct.pack(">i", 300), [(40, 21, 0), (50, 22, 0x10000)])]
    file, (a, b) = fragmented([first, second])
    (t,) = media.tracks(file)
    assert t["offset"].tolist() == [a + 500, a + 511, a + 523, b + 300, b + 321] and t["size"].tolist() == [11, 12, 10, 21, 22]
    assert t["time"].tolist() == [0, 5, 10, 15, 55] and t["sync"].tolist() == [False, False, True, True, False]
    (d,) = media.describe(file)["tracks"]
    assert (d["n_samples"], d["n_chunks"], d["duration"], d["timescale"]) == (5, 3, 105, 1000)
    assert [(k["start"], k["end"]) for k in d["keyframes"]] == [(a + 523, a + 533), (b + 300, b + 343)]
    # Defaults of the fragment go before those of the file.
    file, (a,) = fragmented([[(0x1, 3, struct.pack(">i", 8), [])]], struct.pack(">III", 9, 30, 0), 0x20038)
    (t,) = media.tracks(file)
    assert t["size"].tolist() == [30] * 3 and t["time"].tolist() == [0, 9, 18] and t["sync"].all()
    for bad in ([(0x201, 9, struct.pack(">i", 0), [(1,)])], [(0x0, 1 << 30, b"", [])]):
        assert media.describe(fragmented([bad])[0])["error"]


def test_columns(docs_of, awkward):
    docs = docs_of(awkward, extra=True)
    held = media.described(media.stored(docs, keep=("doc_id", "text")), keep=("doc_id",)).collect()
    assert len(held) == len(awkward) and all(r.error is None and [t.codec for t in r.tracks] == ["raw "] for r in held)
    rows = media.digests(docs).collect()
    same = [r[1:] for r in rows if r.doc_id in (4, 5)]
    assert len(same) == 3 and len(set(same)) == 1
    assert media.digests(docs_of([])).count() == 0
