"""Byte-level readers for JSON text: plain Python from bytes to tuples, no Spark."""

from __future__ import annotations

import json
import re

DEFAULT_COLLECTIONS = ("items", "data", "results", "products", "records", "entries", "list", "array")
MAX_OBJECT_SIZE = 10 * 1024 * 1024
MAX_DEPTH = 64
#: A token of a path scan may be as long as a read buffer or an object, whichever is larger.
BUFFER_SIZE = 64 * 1024
INVALID_STRUCTURE = "Invalid JSON structure"

_STRING = rb'"([^"\\]*+(?:\\.[^"\\]*+)*+)'
#: Outside a collection: a string with what decides whether it opens one, or a bracket.
_OUTSIDE = re.compile(_STRING + rb'(?:"(\s*+:\s*+\[)?|\\?\Z)|[\[\]]', re.S)
#: Inside one: strings are skipped, brackets and braces counted.
_INSIDE = re.compile(_STRING + rb'(?:"|\\?\Z)|[{}\[\]]', re.S)
_PLAIN = rb'[^{}\[\]"]++|"[^"\\]*+(?:\\.[^"\\]*+)*+"'
#: The same, but an object without objects, with arrays of scalars at most, is one match.
_OBJECTS = re.compile(rb"(\{(?:" + _PLAIN + rb"|\[(?:" + _PLAIN + rb")*+\])*+\})|" + _INSIDE.pattern.replace(b"([^", b"(?:[^", 1), re.S)


def fold(name: str) -> str:
    """The form in which names are compared when case doesn't count."""
    return name.lower()


def utf8_error(data: bytes) -> str | None:
    try:
        data.decode("utf-8")
    except UnicodeDecodeError as e:
        return f"invalid UTF-8 at byte {e.start}"
    return None


def _no_constant(name: str):
    raise ValueError(name)


def _depth(data: bytes) -> int:
    deepest = depth = 0
    for m in _INSIDE.finditer(data):
        c = m[0]
        if c in b"{[" and len(c) == 1:
            depth += 1
            deepest = max(deepest, depth)
        elif c in b"}]" and len(c) == 1:
            depth -= 1
    return deepest


def valid_json(data: bytes | str | None) -> bool:
    """Whether data is one JSON value, strictly: no NaN, no control characters in strings, at most 64 levels."""
    if data is None:
        return False
    data = data.encode("utf-8", "surrogatepass") if isinstance(data, str) else data
    if not data.strip():
        return False
    try:
        json.loads(data.decode("utf-8"), parse_constant=_no_constant, parse_int=str, parse_float=str)
    except (ValueError, RecursionError):
        return False
    return data.count(b"{") + data.count(b"[") <= MAX_DEPTH or _depth(data) <= MAX_DEPTH


def scan_ranges(data: bytes, targets: dict[str, str], *, utf8: bool = True, structure: bool = True, max_size: int = MAX_OBJECT_SIZE, keep_errors: bool = True):
    """(document error, [(collection, activation, item_index, start, length, error)]) of the arrays named in targets.

    targets: folded name -> the spelling to report. The outermost objects of such an array count, in
    arrays nested in it too; inside it no other target opens. Names are raw bytes of the string. The
    text needn't be valid JSON as a whole. A UTF-8 error leaves no ranges.
    """
    if utf8 and (e := utf8_error(data)):
        return f"Scan failed: {e}", []
    out, error = [], None
    pos, depth, activation = 0, 0, -1
    while True:
        name = None
        for m in _OUTSIDE.finditer(data, pos):
            raw = m[1]
            if raw is None:
                depth = depth + 1 if m[0] == b"[" else max(0, depth - 1)
            elif m[2]:
                depth += 1
                name = targets.get(fold(raw.decode("utf-8", "replace")))
                if name is not None:
                    pos = m.end()
                    break
        if name is None:
            return error, out
        activation, level, index, braces, start = activation + 1, depth, 0, 0, -1
        ended = False
        for m in _OBJECTS.finditer(data, pos):
            c = m[0]
            if m[1] is not None or c == b"}":
                if m[1] is not None:
                    if braces:
                        continue
                    start = m.start()
                elif braces != 1:
                    braces -= braces > 0
                    continue
                braces, length, problem = 0, m.end() - start, None
                if length > max_size:
                    problem = f"Object size ({length}) exceeds maximum ({max_size})"
                elif structure and not valid_json(data[start : m.end()]):
                    problem = INVALID_STRUCTURE
                if problem is None or keep_errors:
                    out.append((name, activation, index, start, length, problem))
                index += 1
            elif c == b"{":
                if braces == 0:
                    start = m.start()
                braces += 1
            elif c == b"[":
                depth += 1
            elif c == b"]":
                if braces == 0 and depth == level:
                    ended, depth, pos = True, depth - 1, m.end()
                    break
                depth = max(0, depth - 1)
        if not ended:
            if braces:
                if keep_errors:
                    out.append((name, activation, index, start, 0, INVALID_STRUCTURE if structure else "Stream ended before JSON object was closed."))
                else:
                    error = f"Incomplete JSON object starting at position {start}."
            return error, out


_TOKEN = re.compile(
    rb'[ \t\n\r]*+(?:([{}\[\]:,])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")|(-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?(?![0-9.eE+-])|true\b|false\b|null\b))',
    re.S,
)
_WS = rb"[ \t\n\r]*+"
_SCALAR = rb'(?:"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"|-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?(?![0-9.eE+-])|true\b|false\b|null\b)'
_ITEMS = _SCALAR + _WS + rb"(?:," + _WS + _SCALAR + _WS + rb")*+"
_MEMBER = rb'"(?:[^"\\\x00-\x1f]|\\["\\/bfnrt])*+"' + _WS + rb":" + _WS + rb"(?:" + _SCALAR + rb"|\[" + _WS + rb"(?:" + _ITEMS + rb")?\])" + _WS
#: A valid object of scalars and arrays of scalars, whose names hold no numbered escapes.
_FLAT = re.compile(_WS + rb"(\{" + _WS + rb"(?:" + _MEMBER + rb"(?:," + _WS + _MEMBER + rb")*+)?\})", re.S)
BOM = b"\xef\xbb\xbf"


def path_segments(path: str, strict: bool) -> list[str]:
    parts = [p.strip() for p in path.split(".") if p.strip()]
    return parts if strict else [fold(p) for p in parts]


class PathScanner:
    """A path scan of text that comes in pieces: step() reads the whole tokens of what it is given.

    out gets (item_index, start, length); error is set where the text isn't JSON; done where nothing
    more needs to be read. start is where the object begins that is being read, or -1.
    """

    def __init__(self, segments: list[str], *, strict: bool = False, max_size: int = MAX_OBJECT_SIZE, keep_errors: bool = True, buffer_size: int = BUFFER_SIZE):
        self.segments, self.strict, self.max_size, self.keep_errors = segments, strict, max_size, keep_errors
        self.most = max(max_size, buffer_size)
        self.out: list[tuple[int, int, int]] = []
        self.path: list[str] = []
        self.stack: list[tuple[bytes, bool, bool]] = []  # opener, whether it added to the path, whether it is the target
        self.found, self.key, self.start, self.begun = False, None, -1, 0
        # what may come next: a value, a value or ], a key or }, a key, a colon, a comma or the end of the container
        self.want = "value"
        self.error: str | None = None
        self.done = False

    def fail(self, why: str) -> None:
        self.error, self.done = f"Path scan failed: {why}", True

    def step(self, data: bytes, base: int, pos: int, final: bool) -> int:
        """Reads data, which stands at byte base of the document, from pos on; the place after the last whole token."""
        out, path, stack, segments = self.out, self.path, self.stack, self.segments
        found, key, start, begun, want = self.found, self.key, self.start, self.begun, self.want
        why, clean = None, None
        while True:
            if found and stack[-1][2] and want in ("value", "value]") and len(stack) < MAX_DEPTH - 1 and (m := _FLAT.match(data, pos)) and m.end() - m.start(1) <= self.most:
                if clean is None:
                    clean = utf8_error(data) is None
                if clean or utf8_error(m[1]) is None:  # names are decoded, so their bytes have to be UTF-8
                    pos, length = m.end(), m.end() - m.start(1)
                    if length <= self.max_size:
                        out.append((len(out), base + m.start(1), length))
                    elif not self.keep_errors:
                        why = f"Object size ({length}) exceeds maximum ({self.max_size})"
                        break
                    start, key, want = -1, None, "end"
                    continue
            m = _TOKEN.match(data, pos)
            if m is None or (m.end() == len(data) and not final and m[1] is None and m[2] is None):
                rest = data[pos:].lstrip(b" \t\n\r")
                if not final:
                    if len(rest) > self.most:
                        why = f"a token at byte {base + len(data) - len(rest)} is longer than {self.most}"
                    break
                if want == "end" and not stack and not rest:
                    self.done = True
                else:
                    why = f"malformed JSON at byte {base + pos}" if rest else "the text ends too early"
                break
            at, after = m.end() - len(m[m.lastindex]), m.end()
            if after - at > self.most:
                why = f"a token at byte {base + at} is longer than {self.most}"
                break
            c, text = m[1], m[2]
            bad = f"malformed JSON at byte {base + at}"
            if want == "end" and not stack:
                why = bad
                break
            if c in (b"{", b"["):
                if want not in ("value", "value]"):
                    why = bad
                    break
                if len(stack) >= MAX_DEPTH:
                    why = f"deeper than {MAX_DEPTH} at byte {base + at}"
                    break
                in_target = bool(stack) and stack[-1][2]
                pushed = key is not None
                if pushed:
                    path.append(key)
                    key = None
                target = c == b"[" and not found and path == segments
                found |= target
                stack.append((c, pushed, target))
                if c == b"{" and in_target:
                    start, begun = base + at, len(stack)
                want = "key}" if c == b"{" else "value]"
            elif c in (b"}", b"]"):
                opener = b"{" if c == b"}" else b"["
                if not stack or stack[-1][0] != opener or want not in ("end", "key}" if c == b"}" else "value]"):
                    why = bad
                    break
                _, pushed, target = stack.pop()
                if pushed:
                    path.pop()
                key, want = None, "end"
                if target:
                    pos, self.done = after, True
                    break
                if c == b"}" and start >= 0 and len(stack) == begun - 1:
                    length = base + after - start
                    if length <= self.max_size:
                        out.append((len(out), start, length))
                    elif not self.keep_errors:
                        why = f"Object size ({length}) exceeds maximum ({self.max_size})"
                        break
                    start = -1
            elif c == b":":
                if want != "colon":
                    why = bad
                    break
                want = "value"
            elif c == b",":
                if want != "end" or not stack:
                    why = bad
                    break
                want = "key" if stack[-1][0] == b"{" else "value"
            elif text is not None and want in ("key", "key}"):
                try:
                    name = json.loads(text)
                except ValueError as e:
                    why = str(e)
                    break
                key, want = name if self.strict else fold(name), "colon"
            elif want in ("value", "value]"):
                key, want = None, "end"
            else:
                why = bad
                break
            pos = after
        self.found, self.key, self.start, self.begun, self.want = found, key, start, begun, want
        if why is not None:
            self.fail(why)
        return pos


def path_ranges(data: bytes, segments: list[str], *, strict: bool = False, utf8: bool = False, max_size: int = MAX_OBJECT_SIZE, keep_errors: bool = True, buffer_size: int = BUFFER_SIZE):
    """(document error, [(item_index, start, length)]) of the first array at a path of names.

    Arrays on the way add nothing to the path. Objects that lie directly in the array count; those over
    max_size are left out, without taking an index, or fail the scan. Reading stops at the array's end.
    Text that isn't JSON up to there fails the scan, and so does a single token over max_size and
    buffer_size; a failed scan has no ranges.
    """
    return path_scan(data, segments, strict=strict, utf8=utf8, max_size=max_size, keep_errors=keep_errors, buffer_size=buffer_size)[:2]


def path_scan(data: bytes, segments: list[str], *, utf8: bool = False, **options):
    """What path_ranges() gives, and the number of bytes read."""
    if utf8 and (e := utf8_error(data)):
        return f"Path scan failed: {e}", [], len(data)
    scanner = PathScanner(segments, **options)
    pos = scanner.step(data, 0, 3 if data.startswith(BOM) else 0, True)
    return scanner.error, [] if scanner.error else scanner.out, pos


def top_level_arrays(data: bytes | str) -> list[str] | None:
    """The names of a root object's array-valued members, in order; None if the text isn't such an object or has none."""
    try:
        root = json.loads(data, parse_int=str, parse_float=str)
    except (ValueError, RecursionError):
        return None
    names = [k for k, v in root.items() if isinstance(v, list) and k.strip()] if isinstance(root, dict) else []
    return names or None


def strings_below(value) -> list[str]:
    """The strings in a value, at any depth, that aren't blank, in order."""
    if isinstance(value, str):
        return [value] if value and not value.isspace() else []
    found = []
    for v in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
        found += strings_below(v)
    return found


class _Members(list):
    """An object's members with repeated names."""


def field_strings(data: bytes | str | None, fields: list[str]) -> list[tuple[str, int, str]]:
    """(field, number, string) under the top-level fields named, without regard to case; all fields if none is. Nothing for text that isn't an object."""
    try:
        root = json.loads(data) if data is not None else None
    except (ValueError, RecursionError):
        return []
    if not isinstance(root, dict):
        return []
    wanted, out = {fold(f) for f in fields}, []
    for k, v in root.items():
        if not wanted or fold(k) in wanted:
            if isinstance(v, str):
                if v and not v.isspace():
                    out.append((k, 0, v))
            elif isinstance(v, (list, dict)):
                out += [(k, i, s) for i, s in enumerate(strings_below(v))]
    return out


_TERM_SPLIT = re.compile(r"[ ,.;:\-_]")


def json_terms(data: bytes | str | None) -> list[tuple[str, str]]:
    """(keyword, datum) of a whole document: names, words of over two characters, and numbers as they are written."""
    class Number(str):
        pass

    try:
        root = json.loads(data, parse_int=Number, parse_float=Number, object_pairs_hook=_Members) if data is not None else None
    except (ValueError, RecursionError):
        return []
    out: list[tuple[str, str]] = []

    def walk(v) -> None:
        if isinstance(v, _Members):
            for k, x in v:
                if k.strip():
                    out.append((k.lower(), k))
                walk(x)
        elif isinstance(v, Number):
            out.append((str(v), str(v)))
        elif isinstance(v, str):
            if v.strip():
                out.extend((w.lower(), w) for w in _TERM_SPLIT.split(v) if len(w) > 2)
        elif isinstance(v, list):
            for x in v:
                walk(x)

    walk(root)
    return out
