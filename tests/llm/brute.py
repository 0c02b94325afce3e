"""Plain Python versions of what the operators return."""

from __future__ import annotations

import re
from collections import Counter, defaultdict


def line_dedup(docs: dict[int, str | None], least: int = 5, depth: int = 4) -> dict[int, tuple[int, int, str]]:
    leaves: dict[tuple, list[list]] = defaultdict(list)  # [template, [(doc, line)], lines]
    for d in sorted(docs):
        for i, line in enumerate((docs[d] or "").split("\n")):
            plain = re.findall(r"[^\x20\x09-\x0d]+", line)
            words = ["<*>" if re.search("[0-9]", w) else w for w in plain]
            if len(words) < max(1, least):
                continue
            if 2 * words.count("<*>") > len(words):  # word for word
                group = leaves["=", *plain]
                if not group:
                    group.append([plain, [], {tuple(plain)}])
                group[0][1].append((d, i))
                continue
            group = leaves[len(words), *words[: depth if len(words) > 4 else 4]]
            exact = next((g for g in group if tuple(words) in g[2]), None)
            if exact is None:
                best, most = None, -1
                for g in group:
                    same = sum(a == b and a != "<*>" for a, b in zip(g[0], words))
                    wild = sum(a == "<*>" for a in g[0])
                    if 100 * (same + wild) >= 80 * len(words) and 2 * same >= len(words) and same > most:
                        best, most = g, same
                if best is None:
                    best = [list(words), [], set()]
                    group.append(best)
                best[0] = [a if a == b else "<*>" for a, b in zip(best[0], words)]
                best[2].add(tuple(words))
                exact = best
            exact[1].append((d, i))
    gone: dict[int, set[int]] = defaultdict(set)
    for group in leaves.values():
        for _, spots, _ in group:
            if len({d for d, _ in spots}) > 1:
                for d, i in sorted(spots)[1:]:
                    gone[d].add(i)
    out = {}
    for d, t in docs.items():
        lines = (t or "").split("\n")
        kept = [x for i, x in enumerate(lines) if i not in gone[d]]
        out[d] = (sum(bool(re.search(r"[^\x20\x09-\x0d]", x)) for x in lines), len(gone[d]), "\n".join(kept))
    return out


def components(docs: dict[int, str | None], k: int, percent: int) -> dict[int, tuple[int, int]]:
    sets = {}
    for d, t in docs.items():
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d, s in sets.items():
        for e, n in Counter(e for x in s for e in holders[x] if e < d).items():
            if 100 * n >= percent * (len(s) + len(sets[e]) - n):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return {d: (len(s), find(d)) for d, s in sets.items()}


def substring_dedup(docs: dict[int, str | None], window: int = 20) -> dict[int, tuple[list[bytes], list[bool]]]:
    seen: set = set()
    out = {}
    for d in sorted(docs):
        w = (docs[d] or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        out[d] = (w, gone)
    return out


def suffix_dedup(docs: dict[int, str | None], length: int = 200) -> dict[int, tuple[bytes, list[bool]]]:
    raw = {d: (t or "").encode() for d, t in docs.items()}
    seen = Counter(r[i : i + length] for r in raw.values() for i in range(len(r) - length + 1))
    out = {}
    for d, r in raw.items():
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out[d] = (r, gone)
    return out
