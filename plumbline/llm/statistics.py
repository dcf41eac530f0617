"""Statistics of whole texts, computed per block of documents with array operations."""

from __future__ import annotations

import numpy as np

from . import vectors as V

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
PUNCTUATION = np.zeros(256, dtype=bool)
PUNCTUATION[[ord(c) for c in ".,;:!?'\"()[]{}-_/\\@^~`=+"]] = True
UPPER = np.zeros(256, dtype=bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, dtype=bool)
DIGIT[48:58] = True


def base(block: V.Block) -> dict[str, np.ndarray]:
    """Counts per document: the exact ones that quality rules use, and inputs of ratios.

    ``n_words``; ``word_chars`` code points in words; ``n_symbols``;
    ``n_dup_lines`` lines with a word equal to an earlier line; ``n_repeat_words``
    words in 3-word windows that occur at least twice, the first included.
    """
    data, off = block.data, block.offsets
    is_word = V.NOT_SPACE[data]
    starts, ends = V.runs(is_word, off)
    owner = block.owner(starts)
    lead = (data & 0xC0) != 0x80
    prefix = V.prefix_hash(data)
    words = V.span_hash(prefix, starts, ends)
    n_words = np.bincount(owner, minlength=block.n).astype(np.int64)

    ls, le = V.lines(block)
    words_before = np.searchsorted(starts, np.stack([ls, le]))
    written = words_before[1] > words_before[0]
    ls, le = ls[written], le[written]
    line_owner = block.owner(ls)
    _, later = V.repeated(line_owner, V.span_hash(prefix, ls, le))

    covered = np.zeros(len(words), dtype=bool)
    windows = V.shingle_hash(words, 3)
    if len(windows):
        inside = np.flatnonzero(owner[:-2] == owner[2:])
        many, _ = V.repeated(owner[inside], windows[inside])
        at = inside[many]
        covered[at] = covered[at + 1] = covered[at + 2] = True

    again = np.zeros(len(words), dtype=bool)
    if len(words) > 1:
        again[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    _, seen = V.repeated(owner, words)
    size = (ends - starts).astype(np.float64)
    return {
        "n_words": n_words,
        "word_chars": block.count(is_word & lead),
        "n_symbols": block.count(SYMBOLS[data]),
        "n_dup_lines": np.bincount(line_owner[later], minlength=block.n).astype(np.int64),
        "n_repeat_words": np.bincount(owner[covered], minlength=block.n).astype(np.int64),
        "n_bytes": np.diff(off),
        "n_chars": block.count(lead),
        "n_lines": np.bincount(line_owner, minlength=block.n).astype(np.int64),
        "n_again": np.bincount(owner[again], minlength=block.n).astype(np.int64),
        "n_seen": np.bincount(owner[seen], minlength=block.n).astype(np.int64),
        "n_upper": block.count(UPPER[data]),
        "n_digit": block.count(DIGIT[data]),
        "n_punctuation": block.count(PUNCTUATION[data]),
        "n_exclaim": block.count(data == 33),
        "n_stop": block.count(data == 46),
        "n_comma": block.count(data == 44),
        "n_wide": block.count(data >= 0x80),
        "n_short": np.bincount(owner[size <= 2], minlength=block.n).astype(np.int64),
        "n_capital": np.bincount(owner[UPPER[data[starts]]], minlength=block.n).astype(np.int64),
        "size_squares": np.bincount(owner, weights=size * size, minlength=block.n),
        "line_squares": np.bincount(line_owner, weights=(le - ls).astype(np.float64) ** 2, minlength=block.n),
    }


RATIOS = [
    "log_words", "log_chars", "log_lines", "word_size", "word_size_sd", "line_size", "line_size_sd", "symbols",
    "punctuation", "exclaim", "stops", "commas", "digits", "upper", "capital", "wide", "short", "repeat", "seen",
    "again", "dup_lines", "spaces", "few_words",
]


def ratios(counts: dict[str, np.ndarray]) -> np.ndarray:
    """One row of scale-free statistics per document, finite also for empty texts."""
    c = {k: v.astype(np.float64) for k, v in counts.items()}
    words, chars, lines = (np.maximum(c[k], 1.0) for k in ("n_words", "n_chars", "n_lines"))
    mean = c["word_chars"] / words
    line = c["n_bytes"] / lines
    columns = [
        np.log1p(c["n_words"]), np.log1p(c["n_chars"]), np.log1p(c["n_lines"]), mean,
        np.sqrt(np.maximum(c["size_squares"] / words - mean**2, 0.0)), np.log1p(line),
        np.log1p(np.sqrt(np.maximum(c["line_squares"] / lines - line**2, 0.0))),
        np.sqrt(c["n_symbols"] / words), c["n_punctuation"] / words, np.sqrt(c["n_exclaim"] / words),
        np.sqrt(c["n_stop"] / words), np.sqrt(c["n_comma"] / words), np.sqrt(c["n_digit"] / chars),
        np.sqrt(c["n_upper"] / chars), c["n_capital"] / words, c["n_wide"] / np.maximum(c["n_bytes"], 1.0),
        c["n_short"] / words, c["n_repeat_words"] / words, c["n_seen"] / words, c["n_again"] / words,
        c["n_dup_lines"] / lines, 1.0 - c["word_chars"] / chars, 1.0 / (1.0 + c["n_words"]),
    ]
    return np.stack(columns, axis=1)
