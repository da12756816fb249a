"""Statistics of one whole text, as used inside tasks."""

from __future__ import annotations

import numpy as np

from steepgrid.llm.words import window_hashes, word_hashes

SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
_STRIP = SPACES


def word_characters(text: str) -> int:
    """Code points of the text that belong to words."""
    return len(text) - sum(map(text.count, SPACES))


def repeated_lines(text: str) -> tuple[int, int]:
    """Lines with a word, and how many of them equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(_STRIP)]
    return len(lines), len(lines) - len(set(lines))


def repeated_words(hashes: np.ndarray, width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    windows = window_hashes(hashes, width)
    if len(windows) < 2:
        return 0
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    marked = np.zeros(len(hashes) + width, np.int64)
    places = np.concatenate([order[1:][same], order[:-1][same]])
    for i in range(width):
        marked[places + i] = 1
    return int(marked.sum())


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int, int, int]:
    """Words, their code points, symbols, lines with a word, repeated lines, words in repeated windows."""
    lines, repeated = repeated_lines(text)
    symbols = sum(map(text.count, SYMBOLS))
    return len(words), word_characters(text), symbols, lines, repeated, repeated_words(word_hashes(words))
