"""Documents too large for a row: read in chunks, with the automaton's state carried between them."""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterator, Sequence
from urllib.parse import quote

from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from rangelake import kernel

_OUT = re.compile(rb'["\[\]:]|[^\s"\[\]:]')
_IN = re.compile(rb'["{}\[\]]')
_END = re.compile(rb'["\\]')


class ChunkScanner:
    """feed() takes a document's bytes in chunks of any size and gives the ranges that end in each; memory is the parser's state and the current key or object."""

    def __init__(self, targets: dict[str, str], *, structure: bool = True, max_size: int = kernel.MAX_OBJECT_SIZE):
        self.targets, self.structure, self.max_size = targets, structure, max_size
        self.base = self.depth = self.level = self.braces = self.index = 0
        self.activation, self.name, self.start = -1, None, -1
        self.in_string = self.escaped = False
        self.key: bytearray = bytearray()
        self.done_key: str | None = None
        self.pending: str | None = None
        self.held: bytearray = bytearray()

    def feed(self, chunk: bytes) -> Iterator[tuple]:
        pos = 0
        held_from = 0
        while pos < len(chunk):
            if self.in_string:
                if self.escaped:
                    self.escaped = False
                    if self.name is None:
                        self.key += chunk[pos : pos + 1]
                    pos += 1
                    continue
                m = _END.search(chunk, pos)
                stop = m.start() if m else len(chunk)
                if self.name is None:
                    self.key += chunk[pos:stop]
                pos = stop
                if m:
                    pos += 1
                    if m[0] == b"\\":
                        self.escaped = True
                        if self.name is None:
                            self.key += b"\\"
                    else:
                        self.in_string = False
                        if self.name is None:
                            self.done_key = self.key.decode("utf-8", "replace")
                            self.key = bytearray()
                continue
            m = (_OUT if self.name is None else _IN).search(chunk, pos)
            if not m:
                break
            pos, c = m.end(), m[0]
            if self.name is None:
                pending, self.pending = self.pending, None
                done, self.done_key = self.done_key, None
                if c == b'"':
                    self.in_string, self.key = True, bytearray()
                elif c == b":":
                    self.pending = done
                elif c == b"[":
                    self.depth += 1
                    if pending is not None and (name := self.targets.get(kernel.fold(pending))) is not None:
                        self.name, self.level, self.index, self.activation = name, self.depth, 0, self.activation + 1
                elif c == b"]":
                    self.depth = max(0, self.depth - 1)
            elif c == b'"':
                self.in_string = True
            elif c == b"{":
                if not self.braces:
                    self.start, held_from, self.held = self.base + m.start(), m.start(), bytearray()
                self.braces += 1
            elif c == b"}":
                if self.braces:
                    self.braces -= 1
                    if not self.braces:
                        length = self.base + m.end() - self.start
                        problem = None
                        if length > self.max_size:
                            problem = f"Object size ({length}) exceeds maximum ({self.max_size})"
                        elif self.structure and not kernel.valid_json(bytes(self.held + chunk[held_from : m.end()])):
                            problem = kernel.INVALID_STRUCTURE
                        yield self.name, self.activation, self.index, self.start, length, problem
                        self.index += 1
                        self.start = -1
            elif c == b"[":
                self.depth += 1
            else:
                if not self.braces and self.depth == self.level:
                    self.name = None
                self.depth = max(0, self.depth - 1)
        if self.start >= 0 and self.structure and len(self.held) <= self.max_size:
            self.held += chunk[held_from:]
        self.base += len(chunk)

    def finish(self) -> Iterator[tuple]:
        if self.start >= 0:
            yield self.name, self.activation, self.index, self.start, 0, kernel.INVALID_STRUCTURE if self.structure else "Stream ended before JSON object was closed."


class ChunkPathScanner:
    """Like ChunkScanner for the first array at a path; memory is a token, and an object where its bytes are wanted."""

    def __init__(self, json_path: str, *, strict: bool = False, max_size: int = kernel.MAX_OBJECT_SIZE, keep_errors: bool = True, chunk: int = kernel.BUFFER_SIZE):
        self.scanner = kernel.PathScanner(kernel.path_segments(json_path, strict), strict=strict, max_size=max_size, keep_errors=keep_errors, buffer_size=chunk)
        self.json_path, self.rest, self.base, self.begun, self.given = json_path, b"", 0, False, 0

    def feed(self, chunk: bytes, final: bool = False) -> Iterator[tuple]:
        data = self.rest + chunk
        if not self.begun:
            if len(data) < 3 and not final:
                self.rest = data
                return
            self.begun, self.base = True, 3 * data.startswith(kernel.BOM)
            data = data.removeprefix(kernel.BOM)
        if self.scanner.done:
            return
        pos = self.scanner.step(data, self.base, 0, final)
        self.rest, self.base = data[pos:], self.base + pos
        if not self.scanner.error:
            fresh = self.scanner.out[self.given :]
            self.given += len(fresh)
            yield from ((self.json_path, 0, i, s, n, None) for i, s, n in fresh)

    def finish(self) -> Iterator[tuple]:
        if not self.scanner.done:
            yield from self.feed(b"", True)
        if self.scanner.error:
            yield None, None, None, None, None, self.scanner.error


def _at(uri: str) -> tuple[FileSystem, str, str]:
    """A store, the path in it, and what stands before paths in its URIs."""
    uri = uri if "://" in uri else f"file://{quote(uri.removeprefix('file:'))}"
    fs, path = FileSystem.from_uri(uri)
    return fs, path, "" if uri.startswith("file:") else uri[: uri.index("://") + 3]


def files_below(uri: str) -> list[tuple[int, str, int]]:
    """(time, URI, size) of a file, or of the files in a folder and those below it; names that start with a dot or an underscore are not for readers."""
    fs, path, scheme = _at(uri)
    info = fs.get_file_info(path)
    found = fs.get_file_info(FileSelector(path, recursive=True)) if info.type == FileType.Directory else [info]
    files = [i for i in found if i.type == FileType.File and not any(x.startswith((".", "_")) for x in i.path[len(path) :].split("/"))]
    return sorted((i.mtime_ns or 0, scheme + i.path, i.size or 0) for i in files)


#: Bytes that a task reads of small files, and what opening one costs besides its own; a larger file has a task of its own.
TASK_BYTES, OPEN_BYTES = 16 << 20, 128 << 10


def tasks_of(files: list[tuple[int, str, int]]) -> list[InputPartition]:
    """Files in their order, small ones together in a task."""
    groups, room = [], 0
    for _, name, size in files:
        if not groups or room < size + OPEN_BYTES:
            groups.append([])
            room = TASK_BYTES
        groups[-1].append(name)
        room -= size + OPEN_BYTES
    return [InputPartition(g) for g in groups]


class _Lines:
    """The lines of a file that aren't empty, each as an iterator of its chunks; what is left of a line is skipped."""

    def __init__(self, f, chunk: int):
        self.f, self.chunk, self.block, self.at = f, chunk, b"", 0

    def more(self) -> bool:
        if self.at >= len(self.block):
            self.block, self.at = self.f.read(max(self.chunk, 1 << 20)), 0
        return self.at < len(self.block)

    def line(self) -> Iterator[bytes]:
        while self.more():
            end = self.block.find(b"\n", self.at, self.at + self.chunk)
            piece = self.block[self.at : end if end >= 0 else self.at + self.chunk]
            self.at += len(piece) + (end >= 0)
            if piece:
                yield piece
            if end >= 0:
                return

    def __iter__(self) -> Iterator[Iterator[bytes]]:
        while self.more():
            line = self.line()
            yield line
            for _ in line:
                pass


class _Window:
    """The bytes of a document from the first one that may still be wanted on."""

    def __init__(self, most: int):
        self.held, self.at, self.most = bytearray(), 0, most

    def add(self, chunk: bytes) -> None:
        self.held += chunk

    def drop(self, before: int) -> None:
        n = min(before - self.at, len(self.held))
        if n > 0:
            del self.held[:n]
            self.at += n

    def piece(self, start: int, length: int) -> bytes | None:
        return bytes(self.held[start - self.at : start - self.at + length]) if start >= self.at and 0 < length <= self.most else None


class _Reader:
    """What the batch and the stream reader share: a task reads a file or some small ones, a chunk at a time."""

    def __init__(self, options: dict):
        flag = lambda name, default: str(options.get(name, default)).lower() == "true"
        self.targets = [t for t in options.get("targets", "").split(",") if t.strip()] or list(kernel.DEFAULT_COLLECTIONS)
        self.json_path, self.strict = options.get("jsonpath", ""), flag("strict", False)
        self.chunk, self.max_size = int(options.get("chunksize", 1 << 20)), int(options.get("maxobjectsize", kernel.MAX_OBJECT_SIZE))
        self.utf8, self.structure, self.keep_errors = flag("validateutf8", not self.json_path), flag("validatestructure", True), flag("continueonerror", True)
        self.content, self.hashes, self.lines = flag("includecontent", False), flag("hashes", False), flag("lines", False)

    def read(self, partition: InputPartition):
        for uri in partition.value:
            fs, path, _ = _at(uri)
            with fs.open_input_stream(path) as f:
                for chunks in _Lines(f, self.chunk) if self.lines else [iter(lambda: f.read(self.chunk), b"")]:  # noqa: B023
                    yield from self.document(uri, chunks)

    def document(self, uri: str, chunks: Iterator[bytes]):
        """Rows of a document, in its order. A scan that fails as a whole gives, behind what it has found so far, a row with nothing but its error."""
        if self.json_path:
            scanner = ChunkPathScanner(self.json_path, strict=self.strict, max_size=self.max_size, keep_errors=self.keep_errors, chunk=self.chunk)
        else:
            scanner = ChunkScanner({kernel.fold(n): n for n in self.targets}, structure=self.structure, max_size=self.max_size)
        check = codecs.getincrementaldecoder("utf-8")() if self.utf8 else None
        window = _Window(self.max_size) if self.content or self.hashes else None
        read, failed = 0, None

        def row(r: tuple) -> tuple:
            piece = window.piece(r[3], r[4]) if window and r[3] is not None and not (r[5] or "").startswith("Object size") else None
            content = piece.decode("utf-8", "replace") if piece is not None and self.content else None
            digest = hashlib.md5(piece).hexdigest() if piece is not None and self.hashes else None  # noqa: S324
            return (uri, *r[:5], digest, content, r[5])

        def wanted(found):
            return (row(r) for r in found if self.keep_errors or r[5] is None or r[3] is None)

        for data in chunks:
            if check:
                held = len(check.getstate()[0])
                try:
                    check.decode(data)
                except UnicodeDecodeError as e:
                    failed = f"{'Path scan' if self.json_path else 'Scan'} failed: invalid UTF-8 at byte {read - held + e.start}"
                    break
            read += len(data)
            if window:
                window.add(data)
            yield from wanted(scanner.feed(data))
            if window:
                start = scanner.scanner.start if self.json_path else scanner.start
                # an object that is being read may be wanted, if it isn't too large already
                window.drop(start if 0 <= start and read - start <= self.max_size else (scanner.base if self.json_path and start < 0 else read))
            if self.json_path and scanner.scanner.done:
                break
        else:
            if check and check.getstate()[0]:
                failed = f"{'Path scan' if self.json_path else 'Scan'} failed: invalid UTF-8 at byte {read - len(check.getstate()[0])}"
        if failed:
            yield (uri, *[None] * 7, failed)
            return
        for r in scanner.finish():
            if self.keep_errors or r[5] is None or r[3] is None:
                yield row(r)
            elif not self.json_path:
                yield (uri, *[None] * 7, f"Incomplete JSON object starting at position {r[3]}.")


class _Batch(_Reader, DataSourceReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.paths = [p for p in options["path"].split(",") if p]

    def partitions(self) -> Sequence[InputPartition]:
        found = [(p, files_below(p)) for p in self.paths]
        if gone := [p for p, files in found if not files]:
            raise FileNotFoundError(f"File not found: {', '.join(gone)}")
        return tasks_of([f for _, files in found for f in files])


class _Stream(_Reader, DataSourceStreamReader):
    """Files of a folder in the order of their times and names; an offset is the last file of its batch."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.folder = options["path"]

    def initialOffset(self) -> dict:
        return {"time": -1, "name": ""}

    def latestOffset(self) -> dict:
        files = files_below(self.folder)
        return {"time": files[-1][0], "name": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        low, high = (start["time"], start["name"]), (end["time"], end["name"])
        return tasks_of([f for f in files_below(self.folder) if low < f[:2] <= high])

    def commit(self, end: dict) -> None:
        pass


class JsonRangesSource(DataSource):
    """format("json_ranges") for documents too large for a row, in batches and streams; a task reads a file, or some small ones.

    Options: path (files and folders, separated by commas, or a stream's folder, in any store that Arrow knows), targets or
    jsonPath (with strict), chunkSize, maxObjectSize, validateUtf8 (by default for targets only),
    validateStructure, continueOnError, includeContent, hashes and lines: each line of a file is a document
    then, whose offsets count from its own first byte; empty lines are none. A scan that fails as a whole leaves
    a row with path and error alone, behind the ranges that were found before. A stream takes files in
    the order of their times: one that appears with an older time than the last is not read.
    """

    @classmethod
    def name(cls) -> str:
        return "json_ranges"

    def schema(self) -> str:
        return "path string, collection string, activation int, item_index int, start_position long, length long, hash string, content string, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options)
