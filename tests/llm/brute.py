"""Plain, slow versions of the operators, straight from their definitions."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def white_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def word_runs(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def decontaminate(docs, items, window=10):
    """docs: (doc_id, text); items: (item_id, text)."""
    windows = defaultdict(set)
    for item, text in items:
        words = word_runs(text)
        size = min(window, len(words))
        for i in range(len(words) - size + 1) if words else []:
            windows[tuple(words[i : i + size])].add("null" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        words, hit, found = word_runs(text), set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                owners = windows.get(tuple(words[i : i + size]))
                if owners:
                    hit.update(range(i, i + size))
                    found |= owners
        names = hashlib.sha256(",".join(sorted(found, key=str.encode)).encode()).hexdigest()
        out.append((doc_id, len(words), len(hit), len(found), names, bool(hit)))
    return out


def shingle_set(text: str | None, size=5) -> set:
    words = white_words((text or "").translate(LOWER))
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or {tuple(words)}


def groups(n: int, links) -> list[int]:
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def near_duplicates(docs, percent=85):
    """docs: (doc_id, text) -> (doc_id, n_shingles, component_id, kept)."""
    sets = [shingle_set(t) for _, t in docs]
    owners, links = defaultdict(list), set()
    for i, s in enumerate(sets):
        for x in s:
            owners[x].append(i)
    shared = defaultdict(int)
    for members in owners.values():
        for k, a in enumerate(members):
            for b in members[k + 1 :]:
                shared[a, b] += 1
    for (a, b), both in shared.items():
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            links.add((a, b))
    part = groups(len(docs), links)
    lowest = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            lowest[part[i]] = min(lowest.get(part[i], doc_id), doc_id)
    return [(d, len(sets[i]), lowest.get(part[i]), d == lowest.get(part[i])) for i, (d, _) in enumerate(docs)]


def repeated_bytes(docs, size=100):
    """docs: (doc_id, text) in order -> (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    first, out = {}, []
    for n, (doc_id, text) in enumerate(docs):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - size + 1):
            if first.setdefault(data[i : i + size], (n, i)) != (n, i):
                gone[i : i + size] = b"\x01" * size
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = len(re.findall(b"\x01+", bytes(gone)))
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def rule_statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = white_words(text)
    triples, covered = defaultdict(list), set()
    for i in range(len(words) - 2):
        triples[tuple(words[i : i + 3])].append(i)
    for places in triples.values():
        if len(places) > 1:
            for i in places:
                covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if white_words(x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def base_secrets(text: str | None) -> list[tuple[str, int, int]]:
    text, found = text or "", []
    assign = r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for kind, pattern in (("assign", assign), ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+")):
        for m in re.finditer(pattern, text):
            length = len(m.group(2)) if kind == "assign" else len(m.group())
            if length >= {"assign": 8, "access": 16, "hex": 32}[kind]:
                found.append((m.start(), ("assign", "access", "hex").index(kind), kind, m.end()))
    return [(kind, s, e) for s, _, kind, e in sorted(found)]


def repeated_paragraphs(docs, percent=80, least=20):
    """docs: (doc_id, text) in order -> (doc_id, n_removed bytes, places, kept text)."""
    lines = [(d, k, x) for d, (_, t) in enumerate(docs) for k, x in enumerate((t or "").split("\n")) if len(white_words(x)) >= least]
    sets = [shingle_set(x) for _, _, x in lines]
    links = []
    for i in range(len(lines)):
        for j in range(i + 1, len(lines)):
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * len(sets[i] | sets[j]):
                links.append((i, j))
    part = groups(len(lines), links)
    gone = {(d, k) for i, (d, k, _) in enumerate(lines) if part[i] != i}
    out = []
    for d, (doc_id, text) in enumerate(docs):
        parts = [x + "\n" for x in (text or "").split("\n")]
        parts[-1] = parts[-1][:-1]
        places = [k for k in range(len(parts)) if (d, k) in gone]
        kept = "".join(x for k, x in enumerate(parts) if (d, k) not in gone)
        size = sum(len(parts[k].encode()) for k in places)
        out.append((doc_id, size, places, None if text is None else kept))
    return out
