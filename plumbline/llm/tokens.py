"""Token ids of whole texts through the tokenizers library, one call per distinct piece.

Both vocabularies split text before their merges, and neither split ever joins the two
sides of a single space or line feed between two visible characters. A text is cut there,
and the distinct pieces of a group of texts are encoded once; the ids of a text are the
ids of its pieces in order. Latin words, with or without punctuation behind them, are
spelt one after the other and go through the vocabulary's merges in long runs; cutting,
finding distinct pieces and laying out ids are array operations. All other pieces are
remembered, unless they are unusually long, in two generations: when the younger one
passes ``MEMORY`` bytes it becomes the older one, and what of that is met again moves
up, so frequent pieces stay and rare ones go.
"""

from __future__ import annotations

import json
import os
import re
import string
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import vectors as V

MEMORY = 64 << 20
#: Bytes of a remembered piece besides its characters and ids.
PIECE_BYTES = 220
GROUP_CHARS = 1 << 22
LONGEST_KEPT = 64
#: Words that go through the merges together, and the punctuation a word may end with.
RUN_WORDS = 64
PUNCTUATION = string.punctuation.replace("'", "")
LONGEST_TAIL = 4
MOST_TAILS = 1 << 14
#: Added to the last character of a word, a character of the private area.
ENDING = 0xE000
SAFE_CUT = re.compile(r"(?<=\S) (?=\S)|(?<=\S)(?=\n\S)")
DOUBLE_SPACE = re.compile(r"\s\s")
#: Up to here letters are stable under NFC and both Unicode versions agree on them.
LATIN_END = "\u0250"
#: Its lower case is two code points here and other ids in the library.
DOTTED_I = "\u0130"
LATIN = "".join(c for c in map(chr, range(ord(LATIN_END))) if c.isalpha() and c != DOTTED_I)


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = {b: chr(b) for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    hidden = [b for b in range(256) if b not in shown]
    return shown | {b: chr(256 + i) for i, b in enumerate(hidden)}


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _marked_merges(path: str, spaces_kept: bool):
    """The merges of a vocabulary without its split, and which of its tokens mark a word's bound.

    With ``spaces_kept`` words begin with the character of the space or line feed before them. Otherwise their last
    character is another one, in place of the suffix that ends words in such vocabularies.
    """
    from tokenizers import Tokenizer, models

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    suffix, space, line = model.get("end_of_word_suffix") or "", byte_characters()[32], byte_characters()[10]

    def spelt(token: str) -> str:
        last = len(token) - len(suffix) - 1
        return token[:last] + chr(ENDING + ord(token[last])) if suffix and last >= 0 and token.endswith(suffix) else token

    merges = [tuple(map(spelt, m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    marked = np.zeros(max(model["vocab"].values()) + 1, dtype=bool)
    for token, i in model["vocab"].items():
        marked[i] = token.startswith((space, line)) if spaces_kept else token.endswith(suffix)
    return Tokenizer(models.BPE({spelt(t): i for t, i in model["vocab"].items()}, merges)), marked


class Encoder:
    """``spaces_kept`` says that the vocabulary writes the space before a word."""

    def __init__(self, path: str, end_id: int, spaces_kept: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = np.array([end_id], dtype="<u4").tobytes()
        self.spaces_kept = spaces_kept
        self.heads: dict[str, bytes] = {"": b""}
        #: Ids of the pieces after the first, without the space before them.
        self.known: dict[str, bytes] = {} if spaces_kept else self.heads
        self.older_heads, self.older = {}, {}
        self.bytes = 0
        self.characters = byte_characters()
        self.merges, self.marked = _marked_merges(path, spaces_kept)
        self.spelling = np.array([ord(self.characters[b]) for b in range(256)], dtype="<u4")
        self.tails: dict[str, bytes] = {"": b""}
        self.ends = {"": b""} | {c: np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, "<u4").tobytes() for c in ".,"}

    @property
    def size(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def _pieces(self, text: str) -> list[str]:
        """Pieces of a text; each but the first follows a single space or begins with a line feed."""
        if not self.spaces_kept:
            return text.replace("\n", " ").split(" ")
        return SAFE_CUT.split(text) if DOUBLE_SPACE.search(text) else text.replace("\n", " \n").split(" ")

    def _word(self, word: str, lead: str) -> bytes:
        """Ids of a Latin word after ``lead``, from the merges alone.

        Such a word is one unit of either split, so the library's model is asked for
        it directly; anything else is left to the whole tokenizer.
        """
        if not self.spaces_kept:
            word = word.lower()
        if word.isascii():
            units = self.characters[32] + word if lead else word
        else:
            units = (lead + word).encode().decode("latin-1").translate(self.characters)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(units)]).tobytes()

    def _learn(self, pieces: set[str], known: dict[str, bytes], lead: str) -> None:
        """Encode pieces that are not known: words by their merges, the rest in one batch."""
        rest = []
        for piece in pieces:
            tail = piece[-1:] if piece[-1:] in self.ends else ""
            core = piece[:-1] if tail else piece
            if not core.isalpha() or not (core.isascii() or max(core) < LATIN_END) or DOTTED_I in core:
                rest.append(piece)
                continue
            ids = known.get(core) if tail else None
            if ids is None:
                ids = self._word(core, lead)
            known[piece] = ids + self.ends[tail] if tail else ids
        for piece, found in zip(rest, self.tokenizer.encode_batch_fast([p if p[:1] == "\n" else lead + p for p in rest], add_special_tokens=False)):
            known[piece] = array("I", found.ids).tobytes()

    def _split(self, texts: list[str | None]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Pieces of all texts in one column, and where those of each text begin and end."""
        odd = [i for i, t in enumerate(texts) if self.spaces_kept and t and DOUBLE_SPACE.search(t)]
        cut = [self._pieces(texts[i]) for i in odd]
        plain = pa.array(texts, pa.large_string()).fill_null("")
        if odd:
            plain = pc.if_else(pa.array(np.isin(np.arange(len(texts)), odd)), "", plain)
        plain = pc.replace_substring(plain, "\n", " \n" if self.spaces_kept else " ")
        lists = pc.split_pattern(plain, " ")
        edges = lists.offsets.to_numpy().astype(np.int64)
        lo, hi = edges[:-1].copy(), edges[1:].copy()
        edges = edges[-1] + np.cumsum([0, *map(len, cut)])
        lo[odd], hi[odd] = edges[:-1], edges[1:]
        return pa.concat_arrays([lists.values, *[pa.array(p, pa.large_string()) for p in cut]]), lo, hi

    def _merged(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of Latin words one after the other, and how many each has.

        Such a word is one unit of either split. No merge joins two words whose bounds are
        marked, so many go through the merges together; the tokens that bear a mark give
        the bounds back.
        """
        data, edges = V.text_buffers(words)
        letters = self.spelling[data]
        if self.spaces_kept:
            after_space = data[edges[:-1]] != 10
            letters = np.insert(letters, edges[:-1][after_space], self.spelling[32])
            edges = edges + np.concatenate([np.zeros(1, np.int64), np.cumsum(after_space)])
        else:
            letters[edges[1:] - 1] += ENDING
        spelt = letters.tobytes().decode("utf-32-le")
        cuts = [*edges[:-1:RUN_WORDS].tolist(), len(spelt)]
        found = self.merges.encode_batch_fast([spelt[a:b] for a, b in zip(cuts, cuts[1:])], add_special_tokens=False)
        ids = np.array(list(chain.from_iterable([f.ids for f in found])), dtype="<u4")
        at = np.flatnonzero(self.marked[ids])
        return ids, np.diff(at, append=len(ids)) if self.spaces_kept else np.diff(at, prepend=-1)

    def _tail(self, tail: str) -> bytes:
        """Ids of punctuation at the end of a word, a unit of its own in either split."""
        if tail not in self.tails:
            if len(self.tails) > MOST_TAILS:
                self.tails = {"": b""}
            self.tails[tail] = array("I", self.tokenizer.encode(tail, add_special_tokens=False).ids).tobytes()
        return self.tails[tail]

    def _known(self, pieces: set[str], known: dict[str, bytes], lead: str) -> list[str]:
        """Make all pieces known; those that were not in this generation."""
        new = pieces.difference(known)
        self._recall(new, known)
        self._learn(new.difference(known), known, lead)
        return list(new)

    def _table(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Ids of distinct pieces one after the other, how many each has, and what is newly remembered.

        Latin words with or without punctuation behind them are merged again in every group
        of texts, which costs less than to remember them; others are looked up.
        """
        core = pc.utf8_rtrim(pieces, PUNCTUATION)
        short = pc.less_equal(pc.subtract(pc.binary_length(pieces), pc.binary_length(core)), LONGEST_TAIL)
        simple = pc.and_(pc.match_substring_regex(core, rf"^\n?[{LATIN}]+$"), short)
        core = core.filter(simple)
        core = (core if self.spaces_kept else pc.utf8_lower(core)).dictionary_encode()
        ids, sizes = self._merged(core.dictionary)
        tails = pc.utf8_ltrim(pieces.filter(simple), "\n" + LATIN).dictionary_encode()
        rest = pieces.filter(pc.invert(simple)).to_pylist()
        new = self._known(set(rest), self.known, " " * self.spaces_kept)
        more = [*[self._tail(t) for t in tails.dictionary.to_pylist()], *[self.known[p] for p in rest], b""]
        ids = np.concatenate([ids, np.frombuffer(b"".join(more), "<u4")])
        n_words, n_tails = len(core.dictionary), len(tails.dictionary)
        sizes = np.concatenate([sizes, np.fromiter(map(len, more), np.int64, len(more)) // 4])
        # Every piece is a word and a tail, or a piece that was looked up and nothing.
        parts = np.full((len(pieces), 2), len(sizes) - 1)
        simple = simple.to_numpy(zero_copy_only=False)
        parts[simple, 0], parts[simple, 1] = core.indices.to_numpy(), n_words + tails.indices.to_numpy()
        parts[~simple, 0] = n_words + n_tails + np.arange(len(rest))
        return _laid_out(ids, sizes, parts.ravel()), sizes[parts].sum(axis=1), new

    def encode_all(self, texts: list[str | None]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text, the end id last."""
        for lo, hi in _groups(texts):
            pieces, first, last = self._split(texts[lo:hi])
            heads = pieces.take(pa.array(first)).to_pylist() if self.spaces_kept else [""] * (hi - lo)
            new_heads = self._known(set(heads), self.heads, "")
            pieces = pieces.dictionary_encode()
            ids, sizes, new = self._table(pieces.dictionary)
            codes = pieces.indices.to_numpy()
            if self.spaces_kept:
                # Heads have ids of their own; here they count as a piece without any.
                codes, sizes = codes.copy(), np.append(sizes, 0)
                codes[first] = len(sizes) - 1
            ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes[codes])])
            ids = _laid_out(ids, sizes, codes)
            for head, a, b in zip(heads, ends[first].tolist(), ends[last].tolist()):
                yield self.heads[head] + ids[a:b].tobytes() + self.end
            for known, new in ((self.heads, new_heads), (self.known, new)):
                kept = [p for p in new if len(p) <= LONGEST_KEPT]
                for piece in [p for p in new if len(p) > LONGEST_KEPT]:
                    del known[piece]
                self.bytes += sum(map(len, kept)) + sum([len(known[p]) for p in kept]) + PIECE_BYTES * len(kept)
            if self.bytes > MEMORY:
                self._age()

    def _recall(self, pieces: set[str], known: dict[str, bytes]) -> None:
        """Move pieces of the older generation up."""
        older = self.older_heads if known is self.heads else self.older
        known.update((p, older[p]) for p in pieces.intersection(older))

    def _age(self) -> None:
        """Start a new generation and drop the older one."""
        shared = self.known is self.heads
        self.older_heads, self.heads = self.heads, {"": b""}
        self.older, self.known = self.known, self.heads if shared else {}
        self.bytes = 0

    def forget(self) -> None:
        """Drop both generations."""
        self._age()
        self.older_heads, self.older = {}, {}

    def encode(self, text: str | None) -> bytes:
        """:meth:`encode_all` of one text."""
        return next(self.encode_all([text]))


def _laid_out(ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Ids of a run of pieces, each given by its place among those that lie one after the other in ``ids``."""
    n = sizes[codes]
    ends = np.cumsum(n)
    shift = (np.cumsum(sizes) - sizes)[codes] - (ends - n)
    return ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(shift, n)]


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int, spaces_kept: bool) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    return Encoder(path, end_id, spaces_kept)


def _groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``GROUP_CHARS`` together, one text at least."""
    lo = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= GROUP_CHARS:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)
