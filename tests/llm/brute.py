"""Plain, quadratic versions of the operators' definitions."""

import re


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(text, n, kind=r"[^\x20\x09-\x0D]+"):
    w = re.findall(kind, lower(text))
    if not w:
        return set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}


def components(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_duplicates(rows, n, percent):
    """rows: (id, text) with distinct ids -> id -> (set size, component)."""
    sets = {i: shingles(t, n) for i, t in rows}
    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    pairs = {}
    for ids in where.values():
        for k, a in enumerate(ids):
            for b in ids[:k]:
                pairs[b, a] = pairs.get((b, a), 0) + 1
    links = [(a, b) for (a, b), k in pairs.items() if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k)]
    comp = components(sets, links)
    return {i: (len(sets[i]), comp[i]) for i in sets}


def removed_lines(rows, percent):
    """rows: (id, text) -> id -> sorted numbers of lines with an earlier similar line (ids distinct)."""
    lines = []
    for i, t in sorted(r for r in rows if r[0] is not None and r[1] is not None):
        for k, line in enumerate(t.split("\n")):
            w = frozenset(re.findall(r"[^\x20\x09-\x0D]+", lower(line)))
            if w:
                lines.append((i, k, w))
    out, where, seen = {}, {}, set()
    for n, (i, k, w) in enumerate(lines):
        if w in seen:
            out.setdefault(i, []).append(k)
            continue
        seen.add(w)
        shared = {}
        for x in w:
            for m in where.get(x, ()):
                shared[m] = shared.get(m, 0) + 1
        if any(100 * c >= percent * (len(w) + len(lines[m][2]) - c) for m, c in shared.items()):
            out.setdefault(i, []).append(k)
        for x in w:
            where.setdefault(x, []).append(n)
    return out
