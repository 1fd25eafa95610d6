"""Token identifiers of many texts, with repeated words encoded once per worker."""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np

# A space next to other white space: only then may a token reach over a cut before a space.
_SPACES = re.compile(r" (?:\s|(?<=\s ))")
# ASCII marks other than the apostrophe. The pre-tokenizers cut between letters and these,
# and around a single line break between them, whatever else stands there.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
# Letters that stay single letters when a tokenizer normalises them (NFC, lower-case).
_LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
_WORD = re.compile(_LETTERS)
_TWO_LINES = re.compile(f"({_LETTERS})([{re.escape(_MARKS)}]*)(\n)({_LETTERS})([{re.escape(_MARKS)}]*)")

CACHED_PIECES = 1_000_000
CACHED_PARTS = 300_000
# Words that are encoded as one text.
AT_ONCE = 5000


class TextEncoder:
    """Encodes whole texts with a public tokenizer file.

    The pre-tokenizers of these files never join a character with the single
    space after it, so a text cut before each such space has the same tokens as
    the whole, and a word the same tokens wherever it stands. Pieces that were
    seen before are looked up. The words of new ones are encoded as one text and
    told apart by the tokens that begin or end a word; what follows a word in its
    piece is encoded apart. Texts with other runs of white space are encoded as
    they are. Two limits on what is remembered bound the memory of a worker.
    """

    def __init__(self, path: str, pieces: int = CACHED_PIECES, parts: int = CACHED_PARTS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._limits = pieces, parts
        # Pieces without the space before them; words and marks that follow no space.
        self._pieces: dict[str, bytes] = {}
        self._parts: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as file:
            held = json.load(file)["model"]
        vocabulary, suffix = held["vocab"], held.get("end_of_word_suffix")
        self._ends_word = bool(suffix)
        # Tokens that end a word, or tokens that begin with a space.
        self._edge = np.zeros(max(vocabulary.values()) + 2, bool)
        self._edge[[i for t, i in vocabulary.items() if (t.endswith(suffix) if suffix else t.startswith("\u0120"))]] = True
        self._line = vocabulary.get("\u010a")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Identifiers of each text as little-endian unsigned 32-bit integers."""
        for cache, limit in zip((self._pieces, self._parts), self._limits, strict=True):
            if len(cache) > limit:
                cache.clear()
        cut = [None if _SPACES.search(t) else t.split(" ") for t in texts]
        held = set(chain.from_iterable(filter(None, cut)))
        self._learn(held.difference(self._pieces))
        heads = iter(self._plain([ps[0] for ps in cut if ps]))
        whole = iter(self._plain([t for t, ps in zip(texts, cut, strict=True) if ps is None]))
        of = self._pieces.__getitem__
        return [next(whole) if ps is None else next(heads) + b"".join(map(of, ps[1:])) for ps in cut]

    def forget(self) -> None:
        """Hands the memory of what is remembered back."""
        self._pieces.clear()
        self._parts.clear()

    def _plain(self, texts: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else ()
        return [array("I", e.ids).tobytes() for e in found]

    def _add(self, cache: dict[str, bytes], before: str, new: list[str]) -> None:
        cache.update(zip(new, self._plain([before + w for w in new]), strict=True))

    def _add_words(self, cache: dict[str, bytes], before: str, new: list[str]) -> None:
        """The same for words of letters, many as one text."""
        runs = [new[i : i + AT_ONCE] for i in range(0, len(new), AT_ONCE)]
        gap = before or "\n"
        texts = [(before if before else "") + gap.join(run) for run in runs]
        for run, e in zip(runs, self._tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else (), strict=True):
            ids = np.array(e.ids, "<u4")
            if self._ends_word:
                ends = np.flatnonzero(self._edge[ids]) + 1
                starts = np.append(0, ends[:-1])
            elif before:
                starts = np.flatnonzero(self._edge[ids])
                ends = np.append(starts[1:], len(ids))
            else:
                lines = np.flatnonzero(ids == self._line)
                starts, ends = np.append(0, lines + 1), np.append(lines, len(ids))
            if len(starts) != len(run):  # another kind of tokenizer
                self._add(cache, before, run)
                continue
            raw = ids.tobytes()
            cache.update(zip(run, [raw[a:b] for a, b in zip((4 * starts).tolist(), (4 * ends).tolist(), strict=True)], strict=True))

    def _learn(self, new: set[str]) -> None:
        pieces, parts = self._pieces, self._parts
        words, marked, lines, rest = set(), [], [], []
        for piece in new:
            word = piece.rstrip(_MARKS)
            if (word.isalpha() and word.isascii()) or _WORD.fullmatch(word):
                words.add(word)
                if len(word) < len(piece):
                    marked.append((piece, word, piece[len(word) :]))
            elif found := _TWO_LINES.fullmatch(piece):
                words.add(found[1])
                lines.append((piece, found[1], found.groups()[1:]))
            else:
                rest.append(piece)
        self._add(pieces, " ", rest)
        self._add_words(pieces, " ", list(words.difference(pieces)))
        self._add_words(parts, "", list({ps[2] for _, _, ps in lines}.difference(parts)))
        marks = {m for _, _, m in marked}.union(*((ps[0], ps[1], ps[3]) for _, _, ps in lines))
        self._add(parts, "", list(marks.difference(parts)))
        pieces.update((piece, pieces[word] + parts[mark]) for piece, word, mark in marked)
        of = parts.__getitem__
        pieces.update((piece, pieces[word] + b"".join(map(of, ps))) for piece, word, ps in lines)


@lru_cache(maxsize=4)
def encoder(path: str) -> TextEncoder:
    """The encoder of this worker; it stays for the worker's next tasks."""
    return TextEncoder(path)


def text_batches(texts: list[str], characters: int = 1 << 20):
    """(from, to) of runs of texts of about so many characters."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= characters:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
