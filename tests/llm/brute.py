"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

SPACES = " \t\n\x0b\x0c\r"


def lower(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t or "")].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[lower(t or "")] if x is not None]
        keep = max(ids) if ids else None
        n = len(groups[lower(t or "")])
        out.append((i, keep, n, i == keep or n == 1, sha(lower(t or ""))))
    return out


def shingle_set(t, width):
    w = words(lower(t or ""))
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def near(rows, width, percent):
    sets = [shingle_set(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                parent[find(a)] = find(b)
    ids = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        ids[find(k)].append(i)
    smallest = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    return [(i, len(sets[k]), smallest[find(k)]) for k, (i, _) in enumerate(rows)]


def quality(t):
    w = words(t)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeat = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(repeat)


BASE = [
    ("assign", re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), lambda m: len(m[1]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def base_spans(t):
    found = [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, p, ok) in enumerate(BASE) for m in p.finditer(t or "") if ok(m)]
    return [s for _, _, s in sorted(found)]


def units(t, least):
    """(start, end, normalised text) of the shortest runs of sentences with so many words, from each and up to each."""
    tiles, at = [], 0
    for line in t.split("\n"):
        for m in re.finditer(r"[^.!?]*[.!?]+|[^.!?]+", line):
            if words(m[0]):
                tiles.append((at + m.start(), at + m.end(), words(lower(m[0]))))
        at += len(line) + 1
    size = lambda a, z: sum(len(w) for *_, w in tiles[a : z + 1])
    runs = set()
    for k in range(len(tiles)):
        runs |= {(k, z) for z in [next((z for z in range(k, len(tiles)) if size(k, z) >= least), None)] if z is not None}
        runs |= {(a, k) for a in [next((a for a in range(k, -1, -1) if size(a, k) >= least), None)] if a is not None}
    for a, z in sorted(runs):
        yield tiles[a][0], tiles[z][1], " ".join(x for *_, w in tiles[a : z + 1] for x in w)


def repeats(rows, least):
    first, out = {}, []
    found = [(i is None, i or 0, *u) for i, t in set(rows) for u in units(t or "", least)]
    for no_id, i, s, e, norm in sorted(found):
        keep = first.setdefault(norm, (no_id, i, s, e))
        if not (keep[:2] == (no_id, i) and keep[2] <= s < keep[3]):
            out.append((None if no_id else i, s, e, None if keep[0] else keep[1], keep[2]))
    return out
