"""Brute-force versions of the corpus operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def passes(kind: str, value: str) -> bool:
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(part) <= 255 for part in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    return [
        (kind, m.start(), m.end())
        for kind in KINDS
        for m in re.finditer(PATTERNS[kind], text or "")
        if passes(kind, m.group())
    ]


def base_row(text: str | None) -> tuple:
    spans = base_spans(text)
    listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    return (*[sum(s[0] == k for s in spans) for k in KINDS], hashlib.sha256(listed.encode()).hexdigest())


def counts(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(repeated),
    )


def shingle_weights(text: str | None) -> Counter:
    words = (text or "").lower().split()
    if not words:
        return Counter()
    if len(words) < 5:
        return Counter([tuple(words)])
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def probability_jaccard(a: Counter, b: Counter) -> float:
    both = set(a) | set(b)
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in both) for d in set(a) & set(b))


def classes(texts: dict[int, str | None], similarity: float = 0.8) -> dict[int, int]:
    """Least key that links reach, by key."""
    sets = {k: shingle_weights(t) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(k: int) -> int:
        while root[k] != k:
            k = root[k]
        return k

    holders: dict = {}
    for k, found in sets.items():
        for s in found:
            holders.setdefault(s, []).append(k)
    pairs = {(a, b) for ks in holders.values() for i, a in enumerate(ks) for b in ks[i + 1 :]}
    for a, b in pairs:
        one, two = find(a), find(b)
        small, large = sorted((sum(sets[a].values()), sum(sets[b].values())))
        if one != two and len(sets[a].keys() & sets[b].keys()) >= 0.5 * min(len(sets[a]), len(sets[b])):
            if probability_jaccard(sets[a], sets[b]) >= similarity:
                root[max(one, two)] = min(one, two)
    return {k: find(k) for k in texts}
