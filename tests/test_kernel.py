"""The automata, rule by rule."""

import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rangelake import kernel as k
from rangelake.sources.chunked import ChunkScanner


def scan(text, *targets, **options):
    data = text.encode() if isinstance(text, str) else text
    return k.scan_ranges(data, {k.fold(t): t for t in targets or k.DEFAULT_COLLECTIONS}, **options)


def pieces(text, *targets, **options):
    data = text.encode() if isinstance(text, str) else text
    return [(c, i, data[s : s + n].decode()) for c, _, i, s, n, _ in scan(data, *targets, **options)[1]]


def path(text, p, strict=False, **options):
    data = text.encode() if isinstance(text, str) else text
    error, found = k.path_ranges(data, k.path_segments(p, strict), strict=strict, **options)
    return error, [(i, data[s : s + n].decode()) for i, s, n in found]


def test_slices_and_hash():
    text = '{"items":[{"id":1,"name":"alpha"},{"id":2,"name":"beta"}]}'
    got = pieces(text, "items")
    assert [json.loads(p)["id"] for _, _, p in got] == [1, 2]
    assert hashlib.md5(got[0][2].encode()).hexdigest() == hashlib.md5(b'{"id":1,"name":"alpha"}').hexdigest()


@pytest.mark.parametrize(
    "text, targets, want",
    [
        ('{"items":[]}', ["items"], []),
        ('[{"id":1}]', ["items"], []),
        ('{"ITEMS" :\n [{"a":1}]}', ["items"], [("items", 0, '{"a":1}')]),
        ('{"x":[{"items":[{"a":1}]}]}', ["items"], [("items", 0, '{"a":1}')]),
        ('{"items":[[{"a":1}],{"b":2}, 3, "x"]}', ["items"], [("items", 0, '{"a":1}'), ("items", 1, '{"b":2}')]),
        ('{"items":[{"items":[{"n":1}]}]}', ["items"], [("items", 0, '{"items":[{"n":1}]}')]),
        ('{"a":[{"x":1}],"a":[{"y":1}]}', ["a"], [("a", 0, '{"x":1}'), ("a", 0, '{"y":1}')]),
        ('{"k":"\\"items\\":[{","items":[{"s":"}]{"}]}', ["items"], [("items", 0, '{"s":"}]{"}')]),
        ('{"k":"items","items":{"a":[{"b":1}]}}', ["items"], []),
        ('{"it\\u0065ms":[{"a":1}]}', ["items"], []),
        ('{"data":[{"a":1}],"items":[{"b":1}]}', [], [("data", 0, '{"a":1}'), ("items", 0, '{"b":1}')]),
        ('not json "items":[{"a":1} trailing', ["items"], [("items", 0, '{"a":1}')]),
        ('﻿{"items":[{"a":"漢é😀"}]}', ["items"], [("items", 0, '{"a":"漢é😀"}')]),
    ],
)
def test_scan_rules(text, targets, want):
    assert pieces(text, *targets) == want


def test_offsets_are_bytes():
    (_, _, _, start, length, _), = scan('{"é":1,"items":[{"a":"漢"}]}', "items")[1]
    assert (start, length) == (len('{"é":1,"items":['.encode()), len('{"a":"漢"}'.encode()))


def test_errors():
    text = '{"items":[{"a":11111},{"b":1},{"c":}]}'
    rows = scan(text, "items", max_size=8)[1]
    assert [(r[2], r[5]) for r in rows] == [(0, "Object size (11) exceeds maximum (8)"), (1, None), (2, k.INVALID_STRUCTURE)]
    assert [(r[2], r[5]) for r in scan(text, "items", max_size=8, keep_errors=False)[1]] == [(1, None)]
    assert [r[5] for r in scan(text, "items", structure=False)[1]] == [None] * 3
    cut = '{"items":[{"a":1},{"b":"x'
    assert scan(cut, "items")[1][1][2:] == (1, 18, 0, k.INVALID_STRUCTURE)
    assert scan(cut, "items", structure=False)[1][1][5] == "Stream ended before JSON object was closed."
    assert scan(cut, "items", keep_errors=False) == ("Incomplete JSON object starting at position 18.", [("items", 0, 0, 10, 7, None)])
    error, rows = scan(b'{"items":[{"a":1}]}\xc3\x28', "items")
    assert error.startswith("Scan failed:") and rows == []
    assert len(scan(b'{"items":[{"a":1}]}\xc3\x28', "items", utf8=False)[1]) == 1


@pytest.mark.parametrize(
    "text, p, want",
    [
        ('{"a":{"b":[{"x":1},{"y":2}]}}', "a.b", [(0, '{"x":1}'), (1, '{"y":2}')]),
        ('{"a":{"b":[{"x":1}]}}', "a..b", [(0, '{"x":1}')]),
        ('{"a":[{"b":[{"x":1}]},{"b":[{"y":1}]}]}', "a.b", [(0, '{"x":1}')]),
        ('{"Employees":[{"x":1}]}', "employees", [(0, '{"x":1}')]),
        ('{"a":[[{"x":1}],{"y":2}]}', "a", [(0, '{"y":2}')]),
        ('[{"x":1}]', ".", [(0, '{"x":1}')]),
        ('{"n\\u0061me":[{"x":1}]}', "name", [(0, '{"x":1}')]),
        ('﻿{"a":[{"x":1}]}', "a", [(0, '{"x":1}')]),
        ('{"a":[{"x":1}]} garbage', "a", [(0, '{"x":1}')]),
        ('{"a":{"x":1}}', "a", []),
        ('{"a":1}', "no.such", []),
    ],
)
def test_path_rules(text, p, want):
    assert path(text, p) == (None, want)


def test_path_strict_and_limits():
    assert path('{"Employees":[{"x":1}]}', "employees", strict=True) == (None, [])
    assert path('{"a":[{"x":111111},{"y":2}]}', "a", max_size=8) == (None, [(0, '{"y":2}')])
    error, rows = path('{"a":[{"x":111111},{"y":2}]}', "a", max_size=8, keep_errors=False)
    assert "exceeds" in error and rows == []
    for bad in ('{"b":[1,],"a":[{}]}', '{"a":[{"x":NaN}]}', '{"a":[{"x":1}', '{"x" 1}', "", '{"a":[{"x":"\x01"}]}', "[" * 65 + "]" * 65, '{"b":01}', "{} {}"):
        error, rows = path(bad, "a")
        assert error.startswith("Path scan failed:") and rows == [], bad


@pytest.mark.parametrize(
    "text, want",
    [("{}", True), ("[1,2]", True), ('{"a":{"b":[null,true,1.5e3]}}', True), ("1", True), ('{"a":1,"a":2}', True), ("", False), ("  ", False), ("{", False), ('{"a":1} x', False), ("[NaN]", False), ("[1,]", False), ('"a\tb"', False), ("[" * 64 + "]" * 64, True), ("[" * 65 + "]" * 65, False), (None, False), (b"\xc3\x28", False)],
)
def test_valid_json(text, want):
    assert k.valid_json(text) is want


def test_terms_and_fields():
    assert k.json_terms('{"Name":"Big-Red ox","n":1.50,"t":true,"l":[null,"abc"]}') == [("name", "Name"), ("big", "Big"), ("red", "Red"), ("n", "n"), ("1.50", "1.50"), ("t", "t"), ("l", "l"), ("abc", "abc")]
    assert k.json_terms("{bad") == []
    assert k.field_strings('{"A":"x","b":{"c":["y"," "]},"d":1}', []) == [("A", 0, "x"), ("b", 0, "y")]
    assert k.field_strings('{"A":"x","b":"y"}', ["a"]) == [("A", 0, "x")]
    assert k.top_level_arrays('{"a":[1],"b":{},"c":[]}') == ["a", "c"] and k.top_level_arrays("[1]") is None and k.top_level_arrays("{") is None


values = st.recursive(st.none() | st.booleans() | st.integers() | st.text(alphabet='ab"\\{}[]:é漢 ', max_size=6), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["items", "a", "é"]), x, max_size=3), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(values, st.integers(1, 9), st.integers(0, 30), st.booleans())
def test_chunks_give_what_the_whole_gives(value, size, cut, ascii_only):
    data = json.dumps(value, ensure_ascii=ascii_only).encode()
    data = data[: max(0, len(data) - cut)] if cut % 3 == 0 else data
    scanner = ChunkScanner({"items": "items"})
    got = [r for i in range(0, len(data), size) for r in scanner.feed(data[i : i + size])] + list(scanner.finish())
    assert got == k.scan_ranges(data, {"items": "items"}, utf8=False)[1]


@settings(max_examples=200, deadline=None)
@given(values)
def test_scan_finds_outermost_objects(value):
    data = json.dumps({"w": 1, "items": [value, {"z": 1}]}, ensure_ascii=False).encode()

    def outer(v):
        return [v] if isinstance(v, dict) else [x for y in v for x in outer(y)] if isinstance(v, list) else []

    got = [json.loads(data[s : s + n]) for _, _, _, s, n, _ in k.scan_ranges(data, {"items": "items"})[1]]
    assert got == outer([value, {"z": 1}])


@settings(max_examples=300, deadline=None)
@given(st.lists(values, max_size=4), st.integers(0, 40), st.sampled_from(["", "\x01", "\\q", "01", ",", '"', "}"]), st.integers(0, 60))
def test_fast_objects_change_nothing(items, cut, noise, at):
    data = json.dumps({"a": items, "items": items}, ensure_ascii=False).encode()
    data = data[:at] + noise.encode() + data[at:]
    data = data[: len(data) - cut] if cut > 30 else data
    for p in ("items", "a"):
        fast = k.path_ranges(data, [p])
        kept, k._FLAT = k._FLAT, k.re.compile(rb"(?!)")
        try:
            slow = k.path_ranges(data, [p])
        finally:
            k._FLAT = kept
        assert fast[1] == slow[1] and (fast[0] is None) == (slow[0] is None)
