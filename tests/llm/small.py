"""Small tables with every odd case, and plain Python versions of the definitions."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, score double, node string, class_id string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(_LOWER))


def prose(seed: int, n: int) -> str:
    pick = random.Random(seed)
    parts = ["an", "ther", "Re", "tion", "ou", "é", "ung", "los", "ing", "st", "7"]
    return " ".join("".join(pick.choices(parts, k=pick.randint(1, 4))) for _ in range(n))


def shingles(text: str | None) -> Counter:
    w = words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similarity(a: Counter, b: Counter) -> float:
    shared = sum((a & b).values())
    union = sum(a.values()) + sum(b.values()) - shared
    return shared / union if union else 0.0


def edited(text: str, places: list[int]) -> str:
    out = text.split(" ")
    for p in places:
        out[p] = f"new{p}"
    return " ".join(out)


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties and repeated rows, clashing column names."""
    base, long = prose(1, 120), prose(2, 30_000)
    texts = [
        (1, base), (2, base.upper()), (3, edited(base, [50])), (4, edited(base, [5, 20, 40, 60, 80, 100, 110])),
        (5, None), (6, ""), (7, "!!! ... ???"), (8, "one two"), (9, "One, two!"), (10, long), (11, long + " end"), (12, "x" * 5_000),
        (13, "\n\n" + base + "\n" + prose(3, 40)), (14, prose(3, 40) + "\n" + prose(4, 30)), (15, prose(5, 200)), (15, prose(5, 200)),
        (16, "a\x00b \x7f é€𐍈 " * 30), (17, "le " * 400), (18, "le " * 380), (None, base), (None, None),
    ]
    rows = [(i, t, "en" if (i or 0) % 2 else None, f"s{(i or 0) % 3}" if i != 8 else None, None if i == 9 else len(t or ""), 1, 0.5, "n", None) for i, t in texts]
    return rows


def classes(links: list[tuple], ids) -> dict:
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def near_links(texts: dict, threshold: float = 0.8) -> list[tuple]:
    bags = {i: shingles(t) for i, t in texts.items()}
    holders = defaultdict(set)
    for i, bag in bags.items():
        for s in bag:
            holders[s].add(i)
    return [
        (i, j) for i, bag in bags.items() for j in set().union(*[holders[s] for s in bag]) if j < i and similarity(bag, bags[j]) >= threshold
    ]
