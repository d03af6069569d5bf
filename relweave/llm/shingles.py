"""Word shingles of texts as numpy arrays."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from relweave.llm.words import Texts, Words, mix, powers, words_of

#: Words of a shingle.
SHINGLE_WORDS = 5


class Bags(NamedTuple):
    """Multisets of shingles: one entry for each distinct shingle of each text, ordered by text."""

    text: np.ndarray
    code: np.ndarray
    count: np.ndarray


def shingles_of(words: Words, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Text and 64-bit code of every shingle; a text of fewer words, but not none, is one shingle."""
    counts = np.diff(words.first)
    short = np.flatnonzero((counts > 0) & (counts < size))
    steps = powers(size)
    last = max(len(words.code) - size + 1, 0)
    start = np.flatnonzero(words.text[:last] == words.text[size - 1 : size - 1 + last])
    code = np.zeros(len(start), dtype=np.uint64)
    for k in range(size):
        code += words.code[start + k] * steps[k]
    text = words.text[start]
    if len(short):
        whole = np.array([
            np.sum(words.code[words.first[t] : words.first[t + 1]] * steps[: counts[t]], dtype=np.uint64) + np.uint64(counts[t]) for t in short
        ], dtype=np.uint64)
        text, code = np.concatenate([text, short]), np.concatenate([code, whole])
    return text, mix(code)


def bags_of(texts: Texts, size: int = SHINGLE_WORDS) -> Bags:
    return bags(*shingles_of(words_of(texts), size))


def bags(text: np.ndarray, code: np.ndarray) -> Bags:
    order = np.lexsort((code, text))
    text, code = text[order], code[order]
    begin = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (code[1:] != code[:-1])])) if len(text) else np.zeros(0, np.int64)
    return Bags(text[begin], code[begin], np.diff(np.append(begin, len(text))))


def overlaps(left: Bags, right: Bags, pairs: int) -> np.ndarray:
    """Weighted Jaccard similarity of the i-th left and the i-th right multiset; 0 if both are empty."""
    text = np.concatenate([left.text, right.text])
    code = np.concatenate([left.code, right.code])
    count = np.concatenate([left.count, right.count])
    order = np.lexsort((code, text))
    text, code, count = text[order], code[order], count[order]
    both = np.flatnonzero((text[1:] == text[:-1]) & (code[1:] == code[:-1]))
    shared = np.bincount(text[both], np.minimum(count[both], count[both + 1]), pairs)
    union = np.bincount(text, count, pairs) - shared
    return np.divide(shared, union, out=np.zeros(pairs), where=union > 0)
