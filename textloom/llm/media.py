"""Media columns from ISO media containers (operator 7).

Nested boxes are walked by their headers, at any depth; sample tables (sizes, chunk offsets,
samples per chunk, times, sync samples) and the runs of movie fragments are decoded with numpy;
codec, duration and the byte ranges of keyframes of every track are stored. Payloads are never
decoded.

``write_container`` stores any payload as 8-bit samples in such a file, losslessly.

Defined results: bytes that are no container, and null bytes, have no tracks; a cut box leaves
unset what it would have said. A null text is stored as empty, padded to 64 zero bytes. Equal
texts, repeated rows included, give equal files. A very long text costs memory of a few times its
size. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from textloom.llm.common import map_texts

#: Boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"}
RATE = 8000
SAMPLE = 64
CHUNK_SAMPLES = 32
KEY_EVERY = 16


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, first byte of the body, end) of each box; stops at a box that overruns."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1 and start + 16 <= end:
            (size,) = struct.unpack_from(">Q", data, start + 8)
            body += 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            return
        yield kind, body, start + size
        start += size


def walk(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Every box, those inside others after them, at any depth."""
    open_ = [boxes(data, start, end)]
    while open_:
        found = next(open_[-1], None)
        if found is None:
            open_.pop()
            continue
        yield found
        if found[0] in NESTED:
            open_.append(boxes(data, *found[1:]))


def numbers(data: memoryview, at: int, end: int, count: int, kind: str = ">u4") -> np.ndarray:
    count = max(0, min(count, (end - at) // np.dtype(kind).itemsize))
    return np.frombuffer(data, kind, count, at).astype(np.int64)


def half_bytes(data: memoryview, at: int, end: int, count: int, bits: int) -> np.ndarray:
    """Sample sizes of 4, 8 or 16 bits."""
    if bits != 4:
        return numbers(data, at, end, count, ">u2" if bits == 16 else ">u1")
    pairs = numbers(data, at, end, (count + 1) // 2, ">u1")
    return np.stack([pairs >> 4, pairs & 15], 1).reshape(-1)[:count]


def tracks(raw: bytes) -> list[dict]:
    """Every track: codec, timescale, duration, and arrays of sample offsets, sizes, times, sync samples; fragments included."""
    data = memoryview(raw)
    found: list[dict] = []
    preset: dict[int, tuple[int, int, int]] = {}  # of a track's fragments: duration, size, flags of a sample
    t, end_of, moof, run = {}, 0, 0, {}
    for kind, body, end in walk(data, 0, len(data)):
        try:
            if kind == b"trak":
                t, end_of = {"id": 0, "handler": None, "codec": None, "timescale": 0, "duration": 0, "sync": None, "runs": []}, end
                found.append(t)
            elif kind == b"trex":
                number, _, *defaults = struct.unpack_from(">5I", data, body + 4)
                preset[number] = tuple(defaults)
            elif kind == b"moof":
                moof = body - 8 if data[body - 8 : body - 4] != b"\0\0\0\1" else body - 16
                run = {"next": moof}
            elif kind == b"traf":
                run = {"next": run.get("next", moof)}
            elif kind == b"tfhd":
                run = fragment(data, body, moof, preset, run)
            elif kind == b"trun" and (of := next((x for x in found if x["id"] == run.get("id")), None)):
                of["runs"].append(samples_of_run(data, body, end, run))
            elif body >= end_of:
                continue
            elif kind == b"tkhd":
                (t["id"],) = struct.unpack_from(">I", data, body + (20 if data[body] == 1 else 12))
            elif kind == b"mdhd":
                long = data[body] == 1
                t["timescale"], t["duration"] = struct.unpack_from(">IQ" if long else ">II", data, body + (20 if long else 12))
            elif kind == b"hdlr":
                t["handler"] = bytes(data[body + 8 : body + 12]).decode("latin-1")
            elif kind == b"stsd":
                t["codec"] = bytes(data[body + 12 : body + 16]).decode("latin-1")
            elif kind in (b"stsz", b"stz2"):
                size, count = struct.unpack_from(">II", data, body + 4)
                t["fixed"], t["samples"] = size if kind == b"stsz" else 0, count
                if kind == b"stz2":
                    t["sizes"] = half_bytes(data, body + 12, end, count, size & 255)
                else:
                    t["sizes"] = None if size else numbers(data, body + 12, end, count)
            elif kind in (b"stco", b"co64"):
                (count,) = struct.unpack_from(">I", data, body + 4)
                t["chunks"] = numbers(data, body + 8, end, count, ">u4" if kind == b"stco" else ">u8")
            elif kind == b"stsc":
                (count,) = struct.unpack_from(">I", data, body + 4)
                t["per_chunk"] = numbers(data, body + 8, end, 3 * count).reshape(-1, 3)
            elif kind == b"stts":
                (count,) = struct.unpack_from(">I", data, body + 4)
                t["times"] = numbers(data, body + 8, end, 2 * count).reshape(-1, 2)
            elif kind == b"stss":
                (count,) = struct.unpack_from(">I", data, body + 4)
                t["sync"] = numbers(data, body + 8, end, count) - 1
        except (struct.error, ValueError, IndexError):
            continue  # a cut box: what it would have said stays unset
    return [joined(x | places(x, len(raw))) for x in found]


def fragment(data: memoryview, body: int, moof: int, preset: dict[int, tuple[int, int, int]], before: dict) -> dict:
    """A track fragment's header: its track, where its data start, and what its samples have unless they say otherwise."""
    flags, number = struct.unpack_from(">II", data, body)
    flags &= 0xFFFFFF
    at = body + 8
    base = moof if flags & 0x20000 else before.get("next", moof)
    if flags & 0x1:
        (base,) = struct.unpack_from(">Q", data, at)
        at += 8
    at += 4 if flags & 0x2 else 0
    given = list(preset.get(number, (0, 0, 0)))
    for k, bit in enumerate((0x8, 0x10, 0x20)):
        if flags & bit:
            (given[k],) = struct.unpack_from(">I", data, at)
            at += 4
    return {"id": number, "base": base, "next": base, "given": given}


def samples_of_run(data: memoryview, body: int, end: int, run: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(offset, length, whether a keyframe, duration in all) of a run's samples; moves the fragment's place on."""
    flags, count = struct.unpack_from(">II", data, body)
    flags &= 0xFFFFFF
    at = body + 8
    first_flags = None
    start = run["next"]
    if flags & 0x1:
        (shift,) = struct.unpack_from(">i", data, at)
        start, at = run["base"] + shift, at + 4
    if flags & 0x4:
        (first_flags,) = struct.unpack_from(">I", data, at)
        at += 4
    held = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
    if held:
        count = min(count, (end - at) // (4 * len(held)))
        table = numbers(data, at, end, count * len(held)).reshape(count, len(held))
    elif count > len(data):
        raise ValueError("more samples than bytes")
    duration, length, state = (table[:, held.index(bit)] if bit in held else np.full(count, run["given"][k], np.int64) for k, bit in enumerate((0x100, 0x200, 0x400)))
    state = state.copy()
    if first_flags is not None and count:
        state[0] = first_flags
    total = np.cumsum(length)
    run["next"] = start + (int(total[-1]) if count else 0)
    return start + total - length, length, (state & 0x10000) == 0, int(duration.sum())


def joined(t: dict) -> dict:
    """The samples of the tables, then those of the fragments."""
    if not t["runs"]:
        return t
    n = len(t["offset"])
    sync = np.arange(n) if t["sync"] is None else t["sync"]
    keys = np.concatenate([x[2] for x in t["runs"]])
    duration = t["duration"] + sum(x[3] for x in t["runs"])
    return t | {"offset": np.concatenate([t["offset"], *(x[0] for x in t["runs"])]), "length": np.concatenate([t["length"], *(x[1] for x in t["runs"])]), "sync": np.concatenate([sync, n + np.flatnonzero(keys)]), "duration": duration}


def places(t: dict, size: int) -> dict:
    """Byte offset and length of each sample, from the chunk tables."""
    chunks, per, n = t.get("chunks", np.zeros(0, np.int64)), t.get("per_chunk"), t.get("samples", 0)
    none = {"offset": np.zeros(0, np.int64), "length": np.zeros(0, np.int64)}
    if per is None or not len(per) or not len(chunks) or not n or per[0, 0] != 1 or (np.diff(per[:, 0]) <= 0).any():
        return none
    count = per[np.searchsorted(per[:, 0], np.arange(1, len(chunks) + 1), "right") - 1, 1]
    if n > size or (count > size).any():
        return none  # more samples than bytes
    chunk = np.repeat(np.arange(len(chunks)), count)[:n]
    length = np.full(n, t["fixed"], np.int64) if t["fixed"] else t["sizes"][:n]
    m = min(len(chunk), len(length))
    chunk, length = chunk[:m], length[:m]
    ahead = np.cumsum(length) - length
    first = np.append(True, chunk[1:] != chunk[:-1]) if m else np.zeros(0, bool)
    base = np.maximum.accumulate(np.where(first, ahead, 0))
    return {"offset": chunks[chunk] + ahead - base, "length": length}


def describe_all(raw: bytes | None) -> list[dict]:
    """codec, timescale, duration, samples and keyframe ranges [(offset, length)] of every track."""
    out = []
    for t in tracks(raw) if raw else []:
        n = len(t["offset"])
        key = np.arange(n) if t["sync"] is None else t["sync"][(t["sync"] >= 0) & (t["sync"] < n)]
        out.append({"id": t["id"], "handler": t["handler"], "codec": t["codec"], "timescale": t["timescale"], "duration": t["duration"], "samples": n, "key_offset": t["offset"][key], "key_length": t["length"][key], "track": t})
    return out


def describe(raw: bytes | None) -> dict:
    """The first track with samples, of a file written here the only one."""
    none = {"id": 0, "handler": None, "codec": None, "timescale": 0, "duration": 0, "samples": 0, "key_offset": np.zeros(0, np.int64), "key_length": np.zeros(0, np.int64), "track": None}
    return next((d for d in describe_all(raw) if d["samples"]), none)


def read_payload(raw: bytes, t: dict) -> bytes:
    """All samples in order; neighbours in the file are read as one range."""
    off, n = t["offset"], t["length"]
    cut = np.flatnonzero(np.append(True, off[1:] != off[:-1] + n[:-1]))
    ends = np.append(cut[1:], len(off)) - 1
    return b"".join(raw[off[a] : off[b] + n[b]] for a, b in zip(cut, ends, strict=True))


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def write_container(payload: bytes, unit: int = SAMPLE, rate: int = RATE) -> bytes:
    """One audio track of 8-bit raw samples; a table entry stands for ``unit`` of them."""
    n = len(payload) // unit
    chunks = -(-n // CHUNK_SAMPLES)
    head = box(b"ftyp", b"qt  ", struct.pack(">I", 512), b"qt  ", b"isom")
    first = len(head) + (16 if len(payload) + 8 > 0xFFFFFFFF else 8)
    offsets = first + np.arange(chunks, dtype=np.int64) * CHUNK_SAMPLES * unit
    wide = bool(len(offsets)) and int(offsets[-1]) > 0xFFFFFFFF
    tail = n - (chunks - 1) * CHUNK_SAMPLES
    runs = [(1, CHUNK_SAMPLES, 1)] if tail == CHUNK_SAMPLES else [(1, tail, 1)] if chunks == 1 else [(1, CHUNK_SAMPLES, 1), (chunks, tail, 1)]
    keys = np.arange(1, n + 1, KEY_EVERY)
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    length = len(payload)
    # Durations beyond 32 bits take the boxes' second version.
    long = length > 0xFFFFFFFF
    version, times = (1 << 24, struct.pack(">QQIQ", 0, 0, rate, length)) if long else (0, struct.pack(">IIII", 0, 0, rate, length))
    head_times = struct.pack(">QQIIQ", 0, 0, 1, 0, length) if long else struct.pack(">IIIII", 0, 0, 1, 0, length)
    sound = struct.pack(">I4s6xHHHIHHHHI", 36, b"raw ", 1, 0, 0, 0, 1, 8, 0, 0, rate << 16)
    table = box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), sound),
        full(b"stts", struct.pack(">III", 1, n, unit)),
        full(b"stss", struct.pack(">I", len(keys)), keys.astype(">u4").tobytes()),
        full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        full(b"stsz", struct.pack(">II", unit, n)),
        full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
    )
    media = box(
        b"mdia",
        full(b"mdhd", times, struct.pack(">HH", 0x55C4, 0), flags=version),
        full(b"hdlr", b"mhlr", b"soun", bytes(12), b"\0"),
        box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), table),
    )
    movie = box(
        b"moov",
        full(b"mvhd", times, struct.pack(">IH10x", 0x10000, 0x100), matrix, bytes(24), struct.pack(">I", 2), flags=version),
        box(b"trak", full(b"tkhd", head_times, struct.pack(">QHHHH", 0, 0, 0, 0x100, 0), matrix, bytes(8), flags=version | 7), media),
    )
    data = struct.pack(">I4sQ", 1, b"mdat", length + 16) if first - len(head) == 16 else struct.pack(">I4s", length + 8, b"mdat")
    return b"".join((head, data, payload, movie))


def feature(d: dict) -> str:
    """codec, duration over timescale, samples, keyframes, and a checksum over the keyframes' byte ranges."""
    ranges = np.stack([d["key_offset"], d["key_length"]]).astype("<i8").tobytes()
    return f"{d['codec']}:{d['duration']}/{d['timescale']}:samples={d['samples']}:keys={len(d['key_offset'])}:ranges={zlib.crc32(ranges):08x}"


def media_columns(df: DataFrame, id_col: str, bytes_col: str) -> DataFrame:
    """The tracks of stored files: handler, codec, timescale, duration, samples and keyframe byte ranges of each."""

    def ranges(x: dict) -> list[dict]:
        return [{"offset": int(a), "length": int(b)} for a, b in zip(x["key_offset"], x["key_length"], strict=True)]

    def run(ids, files):
        return {"id": ids, "tracks": [[{"track": x["id"], "handler": x["handler"], "codec": x["codec"], "timescale": x["timescale"], "duration": x["duration"], "samples": x["samples"], "keyframes": ranges(x)} for x in describe_all(f)] for f in files]}

    return map_texts(df, id_col, bytes_col, f"id {df.schema[id_col].dataType.simpleString()}, tracks array<struct<track:long,handler:string,codec:string,timescale:long,duration:long,samples:long,keyframes:array<struct<offset:long,length:long>>>>", run, text="binary")


def padded(text: str | None) -> tuple[int, bytes]:
    raw = text.encode() if text else b""
    return len(raw), raw + bytes(-len(raw) % 64 or 64 * (not raw))


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The container of each text: doc_id, media binary."""
    return map_texts(df, id_col, text_col, f"doc_id {df.schema[id_col].dataType.simpleString()}, media binary", lambda ids, texts: {"doc_id": ids, "media": [write_container(padded(t)[1]) for t in texts]})


def media_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text, read the stored bytes back by their tables, and give digests of both."""

    def run(ids, texts):
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for key, t in zip(ids, texts, strict=True):
            n, payload = padded(t)
            raw = write_container(payload)
            d = describe(raw)
            back = read_payload(raw, d["track"])
            row = (key, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(d))
            for name, v in zip(out, row, strict=True):
                out[name].append(v)
        return out

    return map_texts(df, id_col, text_col, f"doc_id {df.schema[id_col].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", run)
