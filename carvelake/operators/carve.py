"""Carving: every pickle stream in a file, through containers, compression layers and raw bytes.

`carve_bytes` peels recursively: serialization, container and compression are all tried on a buffer; only if none
yields a stream is the buffer walked by the opcode grammar (a chain from its start, then every protocol header).
Nothing is loaded. Streams are deduplicated by digest within a file, the first emission wins.
"""

from __future__ import annotations

import bz2
import gzip
import hashlib
import io
import lzma
import pickletools
import re
import struct
import tarfile
import zipfile
import zlib
from collections import Counter
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame

from carvelake.heap import steady_heap

try:
    import zstandard
except ImportError:
    zstandard = None
try:
    import lz4.frame as lz4_frame
except ImportError:
    lz4_frame = None

DEPTH, JOIN_PROBE, INFLATE, RATIO = 6, 8 << 20, 2 << 30, 1100
RESYNCS, RESYNC_WINDOW, LEAST_OPS = 3, 4096, 3
STARTERS = b"(c}])SVINiltd"
REFERENCES, STRINGS = {"GLOBAL", "INST"}, {"BINUNICODE", "SHORT_BINUNICODE", "BINUNICODE8", "UNICODE", "STRING", "BINSTRING", "SHORT_BINSTRING"}
_HEADER = re.compile(rb"\x80[\x02-\x05]")
_POSITION = re.compile(r"at position (\d+)")
_UNSAFE = re.compile(r"(^|[/\\])\.\.([/\\]|$)|^[/\\]|^[A-Za-z]:")
ITEM_SIZES = {"b": 1, "B": 1, "?": 1, "i1": 1, "u1": 1, "i2": 2, "u2": 2, "f2": 2, "i4": 4, "u4": 4, "f4": 4, "i8": 8, "u8": 8, "f8": 8, "c8": 8, "c16": 16}


def _numpy_payload(data: bytes) -> bytes:
    if data[:6] != b"\x93NUMPY":
        raise ValueError("not npy")
    size, at = struct.unpack_from("<H", data, 8)[0] if data[6] == 1 else struct.unpack_from("<I", data, 8)[0], 10 if data[6] == 1 else 12
    return data[at + size :]


class TooFar(ValueError):
    """Something inflates beyond the limits, so it is not scanned."""


def _bounded(reader, size: int) -> bytes:
    """Reads to the end, but no more than the limits allow."""
    out, total = [], 0
    while chunk := reader(1 << 20):
        total += len(chunk)
        if total > INFLATE or total > RATIO * max(size, 1):
            raise TooFar("inflates too far")
        out.append(chunk)
    return b"".join(out)


def inverted(data: bytes) -> list[tuple[str, bytes | None]]:
    """Every codec whose magic matches, with what it holds; None if that is too much."""
    found: list[tuple[str, bytes | None]] = []
    opened = {
        "gzip": (data[:2] == b"\x1f\x8b", lambda: _bounded(gzip.GzipFile(fileobj=io.BytesIO(data)).read, len(data))),
        "bz2": (data[:3] == b"BZh", lambda: _bounded(bz2.BZ2File(io.BytesIO(data)).read, len(data))),
        "xz": (data[:6] == b"\xfd7zXZ\0", lambda: _bounded(lzma.LZMAFile(io.BytesIO(data)).read, len(data))),
        "lzma": (data[:1] == b"\x5d" and len(data) > 13, lambda: _bounded(lzma.LZMAFile(io.BytesIO(data), format=lzma.FORMAT_ALONE).read, len(data))),
        "lz4": (data[:4] == b"\x04\x22\x4d\x18" and lz4_frame is not None, lambda: _bounded(lz4_frame.LZ4FrameFile(io.BytesIO(data)).read, len(data))),
        "zstd": (data[:4] == b"\x28\xb5\x2f\xfd" and zstandard is not None, lambda: _bounded(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data)).read, len(data))),
        "zlib": (len(data) > 2 and data[0] == 0x78 and (data[0] << 8 | data[1]) % 31 == 0, lambda: _zlib(data)),
        "npy": (data[:6] == b"\x93NUMPY", lambda: _numpy_payload(data)),
    }
    for name, (matches, opener) in opened.items():
        if matches:
            try:
                out = opener()
            except TooFar:
                found.append((name, None))
                continue
            except Exception:  # noqa: BLE001 not this codec after all
                continue
            if out and out != data:
                found.append((name, out))
    return found


def _zlib(data: bytes) -> bytes:
    d, out, total, rest = zlib.decompressobj(), [], 0, data
    while rest and not d.eof:
        part = d.decompress(rest, 1 << 20)
        rest = d.unconsumed_tail
        total += len(part)
        if total > INFLATE or total > RATIO * len(data):
            raise TooFar("inflates too far")
        out.append(part)
    return b"".join(out)


def valid_ops(data: bytes, start: int, most: int) -> int:
    """How many opcodes parse from ``start``, up to ``most``."""
    n, stream = 0, io.BytesIO(data)
    stream.seek(start)
    try:
        for _ in pickletools.genops(stream):
            n += 1
            if n >= most:
                break
    except Exception:  # noqa: BLE001
        pass
    return n


def is_prefix(data: bytes) -> bool:
    return bool(_HEADER.match(data[:2])) or data[:1] != b"" and data[:1] in STARTERS


def ends_complete(data: bytes) -> bool:
    """Whether one stream fills the buffer: STOP is its last byte."""
    try:
        return [p for _, _, p in pickletools.genops(data)][-1] == len(data) - 1
    except Exception:  # noqa: BLE001
        return False


def score(name: str) -> int:
    n = name.lower()
    total = 100 * n.endswith("/data.pkl") + 40 * n.endswith((".pkl", ".pickle", ".joblib", ".p")) + 20 * n.endswith((".pt", ".pth", ".bin", ".ckpt"))
    return total + 5 * n.endswith((".zip", ".tar", ".gz", ".bz2", ".xz", ".lz4", ".npz", ".npy", ".tgz")) - 50 * ("/data/" in n) - 30 * n.endswith(("byteorder", "version", "serialization_id"))


def admits(name: str, head: bytes) -> bool:
    """Whether an archive member may hold a stream."""
    if head[:4] in (b"PK\3\4", b"PK\5\6", b"PK\7\x08", b"\x04\x22\x4d\x18", b"\x28\xb5\x2f\xfd") or head[:6] in (b"\x93NUMPY", b"\xfd7zXZ\0") or head[:2] == b"\x1f\x8b" or head[:3] == b"BZh" or head[257:262] == b"ustar":
        return True
    if _HEADER.match(head[:2]):
        return True
    if is_prefix(head) and valid_ops(head, 0, LEAST_OPS) >= LEAST_OPS:
        return True
    return score(name) > 0


def _local_entries(data: bytes) -> Iterator[tuple[str, bytes]]:
    """Members by their local headers, for archives without a central directory."""
    at = data.find(b"PK\3\4")
    while 0 <= at and at + 30 <= len(data):
        flags, method = struct.unpack_from("<HH", data, at + 6)
        packed, _, n, extra = struct.unpack_from("<IIHH", data, at + 18)
        name, start = data[at + 30 : at + 30 + n].decode("utf-8", "replace"), at + 30 + n + extra
        body, end = b"", start
        if method == 8:
            d = zlib.decompressobj(-15)
            try:
                body = d.decompress(data[start:], min(INFLATE, RATIO * (len(data) - start)))
                end = len(data) - len(d.unused_data) if d.eof else start
            except zlib.error:
                body = b""
        else:
            end = start + packed
            if flags & 8 and not packed:
                following = [p for p in (data.find(m, start) for m in (b"PK\7\x08", b"PK\3\4", b"PK\1\2", b"PK\5\6")) if p >= 0]
                end = min(following, default=len(data))
            body = data[start:end]
        yield name, body
        at = data.find(b"PK\3\4", max(end, at + 4))


def is_tar(data: bytes) -> bool:
    """Whether it begins with a tar header of any age; the oldest have a checksum and no magic."""
    if len(data) < 512 or not data[0]:
        return False
    try:
        return tarfile.is_tarfile(io.BytesIO(data))
    except Exception:  # noqa: BLE001 some damaged headers raise
        return False


def _wanted(name: str, head: bytes) -> bool:
    return name.split("/")[-1] in ("pickle", "data.pkl") or admits(name, head)


def members(data: bytes) -> list[tuple[str, bytes | None]]:
    """Admitted members of a zip or tar archive, by falling score; None for one that inflates too far."""
    out: list[tuple[str, bytes | None]] = []
    if data[:4] == b"PK\3\4":
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for info in z.infolist():
                    if not info.is_dir():
                        try:
                            with z.open(info) as f:
                                out.append((info.filename, _bounded(f.read, info.compress_size)))
                        except TooFar:
                            out.append((info.filename, None))
                        except Exception:  # noqa: BLE001 one bad member does not stop the others
                            continue
        except zipfile.BadZipFile:
            out = list(_local_entries(data))
    else:
        try:
            with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as t:
                out = [(m.name, _bounded(t.extractfile(m).read, len(data))) for m in t.getmembers() if m.isfile()]
        except Exception:  # noqa: BLE001 not a tar archive
            return []
    return sorted(((n, b) for n, b in out if b is None or _wanted(n, b[:512])), key=lambda m: -score(m[0]))


def member_names(file) -> list[str]:
    """Names of the members of a seekable archive file."""
    head = file.read(4)
    file.seek(0)
    try:
        if head == b"PK\3\4":
            with zipfile.ZipFile(file) as z:
                return z.namelist()
        with tarfile.open(fileobj=file, mode="r:*") as t:
            return t.getnames()
    except Exception:  # noqa: BLE001
        return []


def name_findings(names: list[str]) -> tuple[list[str], list[str]]:
    """Names of members that leave their folder, sorted, eight at most; and of duplicates, five at most."""
    return sorted({n for n in names if _UNSAFE.search(n)})[:8], sorted(n for n, c in Counter(names).items() if c > 1)[:5]


def findings(data: bytes) -> list[str]:
    return name_findings(member_names(io.BytesIO(data)))[0]


def walk(data: bytes, start: int) -> dict:
    """One fragment from ``start``: end, number of opcodes, whether it stops, and whether it refers to a callable."""
    stream, n, strings, refers, end, complete = io.BytesIO(data), 0, 0, False, start, False
    stream.seek(start)
    try:
        for op, arg, pos in pickletools.genops(stream):
            n += 1
            end = pos + 1
            strings += op.name in STRINGS
            refers |= op.name in REFERENCES and bool(arg) or op.name == "STACK_GLOBAL" and strings >= 2
            complete = op.name == "STOP"
    except Exception as e:  # noqa: BLE001
        m = _POSITION.search(str(e))
        end = max(min(int(m[1]) if m else len(data), len(data)), end)
    return {"start": start, "end": end, "ops": n, "complete": complete, "refers": refers}


def robust_walk(data: bytes, start: int) -> dict:
    out, resyncs = walk(data, start), 0
    while not out["complete"] and resyncs < RESYNCS:
        following = next((m.start() for m in _HEADER.finditer(data, out["end"], min(out["end"] + RESYNC_WINDOW, len(data))) if valid_ops(data, m.start(), LEAST_OPS) >= LEAST_OPS), None)
        if following is None:
            break
        more = walk(data, following)
        out = {"start": start, "end": more["end"], "ops": out["ops"] + more["ops"], "complete": more["complete"], "refers": out["refers"] or more["refers"]}
        resyncs += 1
    return out | {"resyncs": resyncs}


def grammar(data: bytes) -> list[dict]:
    """Fragments of a buffer that is no known format."""
    found, at, ranges = [], 0, []
    chain = []
    while at < len(data):
        f = walk(data, at)
        if not f["complete"]:
            break
        chain.append(f | {"resyncs": 0, "kind": "pgs_chain"})
        at = f["end"]
    if chain and sum(f["ops"] for f in chain) >= LEAST_OPS and (chain[-1]["end"] == len(data) or any(f["refers"] for f in chain)):
        found, ranges = chain, [(f["start"], f["end"]) for f in chain]
    at = 0
    while m := _HEADER.search(data, at):
        start = m.start()
        inside = next((b for a, b in ranges if a <= start < b), None)
        if inside:
            at = inside
            continue
        f = robust_walk(data, start)
        if f["ops"] >= LEAST_OPS and (f["complete"] or f["refers"]):
            found.append(f | {"kind": "pgs_complete" if f["complete"] else "pgs_partial"})
            at = max(f["end"], start + 1)
        else:
            at = start + 1
    return found


def _joblib_segments(data: bytes) -> list[tuple[int, int]]:
    """Ranges of opcodes between the raw array regions of an interleaved joblib file."""
    out, at = [], 0
    while at < len(data):
        stream, end, shape, item, last = io.BytesIO(data), at, 1, 0, []
        stream.seek(at)
        try:
            for op, arg, pos in pickletools.genops(stream):
                end = pos + 1
                if isinstance(arg, int) and not isinstance(arg, bool):
                    last = [*last, arg][-3:]
                if isinstance(arg, str) and arg in ITEM_SIZES:
                    item = ITEM_SIZES[arg]
                if op.name in ("TUPLE1", "TUPLE2", "TUPLE3") and last:
                    shape = 1
                    for v in last[-int(op.name[5]) :]:
                        shape *= v
            out.append((at, end))
            break
        except Exception:  # noqa: BLE001 a raw region begins here
            if end == at or not item:
                break
            out.append((at, end))
            pad = data[end] if end < len(data) else 0
            after = end + 1 + pad + shape * item
            at = next((k for k in range(after, min(after + 128, len(data))) if valid_ops(data, k, LEAST_OPS) >= LEAST_OPS), len(data))
    return out


def carve_bytes(data: bytes, label: str = "") -> list[dict]:
    """Streams of one file, in emission order."""
    out: list[dict] = []
    seen: set[str] = set()

    def emit(part: bytes, where: str, kind: str, start: int, end: int, complete: bool, resyncs: int = 0) -> bool:
        sha = hashlib.sha256(part).hexdigest()
        if not part or sha in seen:
            return False
        seen.add(sha)
        out.append({"blob_seq": len(out), "logical_name": where, "source_kind": kind, "sha256": sha, "size": len(part), "offset_start": start, "offset_end": end, "complete": complete, "resync_count": resyncs, "content": part})
        return True

    def route(part: bytes, where: str, depth: int) -> bool:
        if not part or depth > DEPTH:
            return False
        got = False
        if is_prefix(part):
            if b"joblib" in part[: 2 << 20] and not ends_complete(part):
                for a, b in _joblib_segments(part):
                    got |= emit(part[a:b], where, "joblib_pickle_segment", a, b, True)
            if ends_complete(part):
                got |= emit(part, where, "routed_pickle", 0, len(part), True)
        every = members(part) if part[:4] == b"PK\3\4" or is_tar(part) else []
        out.extend(not_scanned(f"{where}/{name}", "inflates too far") for name, body in every if body is None)
        own = [(name, body) for name, body in every if body is not None]
        for name, body in own:
            got |= route(body, f"{where}/{name}", depth + 1)
        if len(own) > 1 and sum(len(b) for _, b in own) <= JOIN_PROBE:
            got |= route(b"".join(b for _, b in own), f"{where}!join", depth + 1)
        for codec, body in inverted(part):
            if body is None:
                out.append(not_scanned(f"{where}!{codec}", "inflates too far"))
            else:
                got |= route(body, f"{where}!{codec}", depth + 1)
        if not got:
            for f in grammar(part):
                got |= emit(part[f["start"] : f["end"]], where, f["kind"], f["start"], f["end"], f["complete"], f["resyncs"])
        return got

    route(data, label, 0)
    return [b | {"blob_seq": k} for k, b in enumerate(out)]


NOT_SCANNED = "not_scanned"


def not_scanned(where: str, why: str) -> dict:
    """The row of something that was given up: no content, and the reason in its name."""
    return {"blob_seq": 0, "logical_name": f"{where} ({why})", "source_kind": NOT_SCANNED, "sha256": "", "size": 0, "offset_start": 0, "offset_end": 0, "complete": False, "resync_count": 0, "content": b""}


#: Bytes that one batch of streams may hold, about.
BATCH_BYTES = 4 << 20
BLOBS_DDL = "artifact_id string, blob_id string, blob_seq int, logical_name string, source_kind string, sha256 string, size long, offset_start long, offset_end long, complete boolean, resync_count int, content binary"
_BLOBS = pa.schema(
    [("artifact_id", pa.string()), ("blob_id", pa.string()), ("blob_seq", pa.int32()), ("logical_name", pa.string()), ("source_kind", pa.string()), ("sha256", pa.string()), ("size", pa.int64()),
     ("offset_start", pa.int64()), ("offset_end", pa.int64()), ("complete", pa.bool_()), ("resync_count", pa.int32()), ("content", pa.binary())]
)


def _rows(artifact: str, label: str, data: bytes) -> list[dict]:
    return [b | {"artifact_id": artifact, "blob_id": f"{artifact}:{b['blob_seq']}"} for b in carve_bytes(data, label)]


def carve(artifacts: DataFrame) -> DataFrame:
    """One row for each stream of (artifact_id, content). A scan: files are independent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady_heap()
        held: list[dict] = []
        size = 0
        for batch in batches:
            for artifact, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                for row in _rows(artifact, artifact, content.as_py() or b""):
                    held.append(row)
                    size += 256 + row["size"]
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(held, _BLOBS)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, _BLOBS)

    return artifacts.select("artifact_id", "content").mapInArrow(run, BLOBS_DDL)


def container_findings(artifacts: DataFrame) -> DataFrame:
    """artifact_id, unsafe member names and duplicate member names of the top-level archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _finding_rows(batch.column(0), [name_findings(member_names(io.BytesIO(c.as_py() or b""))) for c in batch.column(1)])

    return artifacts.select("artifact_id", "content").mapInArrow(run, FINDINGS_DDL)


FINDINGS_DDL = "artifact_id string, unsafe_names array<string>, duplicate_names array<string>"


def _finding_rows(ids: pa.Array, found: list[tuple[list[str], list[str]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, *(pa.array([f[k] for f in found], pa.list_(pa.string())) for k in (0, 1))], ["artifact_id", "unsafe_names", "duplicate_names"])


def large_findings(files: DataFrame) -> DataFrame:
    """`container_findings` of files (artifact_id, path) that are too large for a cell: only their directories or headers are read, where they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column(1).to_pylist():
                with opened(path) as file:
                    found.append(name_findings(member_names(file)))
            yield _finding_rows(batch.column(0), found)

    n = max(files.count(), 1)
    return files.select("artifact_id", "path").repartition(n, "artifact_id").mapInArrow(run, FINDINGS_DDL)


def opened(path: str):
    """A file of any store that Arrow knows, opened for reading anywhere in it; the path is Hadoop's, so no character of it is escaped."""
    import pyarrow.fs as pafs

    if path.startswith(("file:/", "/")):
        return pafs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    store, inner = pafs.FileSystem.from_uri(quote(path, safe=":/@"))
    return store.open_input_file(inner)


#: Bytes that are searched at once, how far windows overlap, and how far a window grows for one stream.
WINDOW, OVERLAP, MOST_STREAM = 256 << 20, 1 << 20, 512 << 20


class Forward:
    """A reader that can give back what was read, and that stops where something inflates beyond the ratio.

    read: bytes of at most the size asked for. What was read before damage or the limit comes out first; then ``error`` tells.
    """

    def __init__(self, read, packed: int | Forward | None = None):
        """packed: how many bytes it is made of, or the reader that they are taken from."""
        self._read, self._back, self._total, self._packed = read, b"", 0, packed
        self.error: Exception | None = None

    def read(self, size: int = -1) -> bytes:
        if 0 <= size < len(self._back):
            out, self._back = self._back[:size], self._back[size:]
            return out
        parts, self._back = [self._back], b""
        left = size - len(parts[0]) if size >= 0 else 1 << 62
        while left > 0 and self.error is None:
            try:
                chunk = self._read(min(left, 1 << 20))
            except Exception as e:  # noqa: BLE001 each codec has errors of its own
                self.error = e
                break
            self._total += len(chunk)
            packed = self._packed.at if isinstance(self._packed, Forward) else self._packed
            if packed is not None and self._total > RATIO * max(packed, 1):
                self.error = TooFar("inflates too far")
            elif not chunk:
                break
            else:
                parts.append(chunk)
                left -= len(chunk)
        found = b"".join(parts)
        if self.error is not None and not found and size:
            raise self.error
        return found

    def back(self, data: bytes) -> None:
        self._back = data + self._back

    @property
    def at(self) -> int:
        """How many bytes have been taken."""
        return self._total - len(self._back)

    def told(self, where: str) -> Iterator[dict]:
        if self.error is not None:
            yield not_scanned(where, f"{type(self.error).__name__}: {self.error}"[:200])


class _Inflating:
    """What a decompressor object of zlib's kind makes of a reader; ``rest`` is what came after its end."""

    def __init__(self, source: Forward, unpack):
        self.source, self.unpack, self.rest = source, unpack, b""

    def read(self, size: int) -> bytes:
        while not self.unpack.eof:
            data = self.unpack.unconsumed_tail or self.source.read(1 << 16)
            out = self.unpack.decompress(data, size)
            if out:
                return out
            if not data:
                break
        if self.unpack.unused_data and not self.rest:
            self.rest = self.unpack.unused_data
        return b""


def decoder(source: Forward, head: bytes) -> tuple[str, Forward] | None:
    """The codec that a stream begins with, and what it holds, as a stream."""
    if head[:2] == b"\x1f\x8b":
        return "gzip", Forward(gzip.GzipFile(fileobj=source).read, source)
    if head[:3] == b"BZh":
        return "bz2", Forward(bz2.BZ2File(source).read, source)
    if head[:6] == b"\xfd7zXZ\0":
        return "xz", Forward(lzma.LZMAFile(source).read, source)
    if head[:1] == b"\x5d" and head[5:13] in (b"\xff" * 8, head[5:10] + bytes(3)):
        return "lzma", Forward(lzma.LZMAFile(source, format=lzma.FORMAT_ALONE).read, source)
    if head[:4] == b"\x04\x22\x4d\x18" and lz4_frame is not None:
        return "lz4", Forward(lz4_frame.LZ4FrameFile(source).read, source)
    if head[:4] == b"\x28\xb5\x2f\xfd" and zstandard is not None:
        return "zstd", Forward(zstandard.ZstdDecompressor().stream_reader(source).read, source)
    if head[:1] == b"\x78" and len(head) > 2 and (head[0] << 8 | head[1]) % 31 == 0:
        return "zlib", Forward(_Inflating(source, zlib.decompressobj()).read, source)
    if head[:6] == b"\x93NUMPY":
        source.read(len(head) - len(_numpy_payload(head)))
        return "npy", source
    return None


def local_streams(source: Forward) -> Iterator[tuple[str, Forward, int, int]]:
    """Members of a zip archive that is read forwards only, by their local headers: name, contents, where the header is, and method. The next one comes when the last was taken."""
    while (start := source.at) >= 0 and (raw := source.read(30))[:4] == b"PK\3\4" and len(raw) == 30:
        flags, method = struct.unpack_from("<HH", raw, 6)
        packed, _, n, extra = struct.unpack_from("<IIHH", raw, 18)
        name = source.read(n).decode("utf-8", "replace")
        source.read(extra)
        if method == 8:
            inner = _Inflating(source, zlib.decompressobj(-15))
            yield name, Forward(inner.read), start, method
            while inner.read(1 << 20):
                pass
            source.back(inner.rest)
        elif flags & 8 and not packed:
            yield name, source, start, method  # its end is told behind it only
            return
        else:
            left = [packed]

            def read(size: int, left=left) -> bytes:
                data = source.read(min(size, left[0]))
                left[0] -= len(data)
                return data

            yield name, Forward(read), start, method
            while read(1 << 20):
                pass
        if flags & 8:
            found = source.read(1 << 16)
            at = min((p for p in (found.find(m) for m in (b"PK\3\4", b"PK\1\2", b"PK\5\6")) if p >= 0), default=len(found))
            source.back(found[at:])


def open_stream(data: bytes, rows: list[dict]) -> int:
    """Where the first stream begins that reaches the end of the bytes without an end of its own; their length if there is none."""
    ends = {b["offset_start"]: b["offset_end"] for b in rows if b["complete"]}
    at = 0
    while m := _HEADER.search(data, at):
        at = ends.get(m.start(), 0)
        if not at:
            f = walk(data, m.start())
            if not f["complete"] and f["end"] >= len(data) and f["ops"] >= LEAST_OPS:
                return m.start()
            at = f["end"] if f["complete"] else m.start() + 1
    return len(data)


def _windows(source: Forward, where: str, window: int, overlap: int) -> Iterator[dict]:
    """Streams of raw bytes. The next window begins at the first stream that reaches the end of the last one, and grows for a stream that fills it."""
    at, data, wanted = 0, b"", window
    while True:
        data += source.read(wanted - len(data))
        last = len(data) < wanted
        rows = carve_bytes(data, where)
        open_at = len(data) if last else open_stream(data, rows)
        if not last and open_at == 0 and wanted < MOST_STREAM:
            wanted = min(2 * wanted, MOST_STREAM)
            continue
        if not last and open_at == 0:
            yield not_scanned(where, "a stream longer than a window may grow")
            open_at = len(data)
        yield from (b | {"offset_start": b["offset_start"] + at, "offset_end": b["offset_end"] + at} for b in rows if last or b["offset_start"] < open_at)
        if last:
            yield from source.told(where)
            return
        step = max(min(open_at, len(data) - overlap), 1)
        at, data, wanted = at + step, data[step:], max(window, len(data) - step + 1)


def _carve_stream(source: Forward, where: str, depth: int, window: int, overlap: int) -> Iterator[dict]:
    """Streams of a reader of any length, layer by layer, with no more than a window of each in memory; what fits a window is carved as `carve_bytes` does."""
    if depth > DEPTH:
        return
    try:
        data = source.read(window + 1)
        if len(data) <= window:
            yield from carve_bytes(data, where)
            yield from source.told(where)
            return
        source.back(data)
        layer = decoder(source, data[: 1 << 16])
        if layer is not None:
            yield from _carve_stream(layer[1], f"{where}!{layer[0]}", depth + 1, window, overlap)
        elif data[:4] == b"PK\3\4":
            yield from _carve_members(((name, body) for name, body, *_ in local_streams(source)), where, depth, window, overlap)
        elif is_tar(data[:1024] + bytes(1024)):
            with tarfile.open(fileobj=source, mode="r|") as t:
                yield from _carve_members(((m.name, Forward(t.extractfile(m).read)) for m in t if m.isfile()), where, depth, window, overlap)
        else:
            yield from _windows(source, where, window, overlap)
    except Exception as e:  # noqa: BLE001 damaged data: what came out so far stays, and the rest is told
        yield not_scanned(where, f"{type(e).__name__}: {e}"[:200])


def _carve_members(members: Iterator[tuple[str, Forward]], where: str, depth: int, window: int, overlap: int) -> Iterator[dict]:
    together: list[bytes] | None = []  # small members are also looked at joined
    for name, body in members:
        try:
            data = body.read(min(JOIN_PROBE, window) + 1)
        except Exception as e:  # noqa: BLE001 one bad member does not stop the others
            yield not_scanned(f"{where}/{name}", f"{type(e).__name__}: {e}"[:200])
            continue
        body.back(data)
        if not _wanted(name, data[:512]):
            continue
        if together is not None:
            together = [*together, data] if sum(map(len, together)) + len(data) <= JOIN_PROBE and len(data) <= window else None
        yield from _carve_stream(body, f"{where}/{name}", depth + 1, window, overlap)
    if together and len(together) > 1:
        yield from carve_bytes(b"".join(together), f"{where}!join")


def carve_file(file, label: str = "", window: int = WINDOW, overlap: int = OVERLAP) -> Iterator[dict]:
    """Streams of a seekable file of any size, as `carve_bytes` gives them, with about a window of each layer in memory.

    Archives are opened member by member, compressed files are decoded as they are read, and anything else is searched in windows.
    What has to be given up comes as a row (`not_scanned`).
    """
    seen: set[str] = set()

    def new(rows: Iterator[dict]) -> Iterator[dict]:
        for b in rows:
            if b["source_kind"] == NOT_SCANNED or b["sha256"] not in seen:
                seen.add(b["sha256"])
                new.n += 1
                yield b | {"blob_seq": new.n - 1}

    new.n = 0
    head = file.read(4)
    file.seek(0, 2)
    size = file.tell()
    file.seek(0)
    if head == b"PK\3\4" and zipfile.is_zipfile(file):
        file.seek(0)
        with zipfile.ZipFile(file) as z:

            def zipped() -> Iterator[tuple[str, Forward]]:
                for info in sorted((i for i in z.infolist() if not i.is_dir()), key=lambda i: -score(i.filename)):
                    try:
                        body = z.open(info)
                    except Exception:  # noqa: BLE001 one bad member does not stop the others
                        continue
                    with body:
                        yield info.filename, Forward(body.read, info.compress_size)

            yield from new(_carve_members(zipped(), label, 0, window, overlap))
    else:
        file.seek(0)
        yield from new(_carve_stream(Forward(file.read), label, 0, window, overlap))
    if not new.n:
        file.seek(0)
        yield from new(_windows(Forward(file.read), label, max(window, min(size, window)), overlap))


def carve_large(files: DataFrame, window: int = WINDOW) -> DataFrame:
    """Streams of files that are too large for a cell (artifact_id, path): a task opens them where they lie. One file is one task's work, a window at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for artifact, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with opened(path) as file:
                    for b in carve_file(file, artifact, window):
                        yield pa.RecordBatch.from_pylist([b | {"artifact_id": artifact, "blob_id": f"{artifact}:{b['blob_seq']}"}], _BLOBS)

    n = max(files.count(), 1)
    return files.select("artifact_id", "path").repartition(n, "artifact_id").mapInArrow(run, BLOBS_DDL)
