"""Token ids of the `tokenizers` library for many texts, each distinct piece of text encoded once per worker.

Both public vocabularies used here split a text before a single blank or line break that stands between two characters
that are not white space, whatever stands further away. So a text is cut there, and the ids of the pieces joined are
the ids of the text. Most pieces are words met before. A vocabulary that lower-cases and drops white space gives a word
the same ids in any case and place, so there the pieces of ordinary Latin texts are lower-cased words.
"""

from __future__ import annotations

import os
import re
from itertools import repeat

import numpy as np

#: Pieces a worker remembers, and the longest remembered. Others are encoded again.
PIECES = 1_000_000
PIECE_CHARS = 48
RARE = re.compile(r"[\0\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: Characters that lower-casing maps one to one and that normal form C leaves alone.
_PLAIN = re.compile(r"[\0-\x7f\xa1-\u012f\u0131-\u0148\u014a-\u017e]*")
_loaded: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, plain: bool = False) -> Encoder:
    """One per worker and vocabulary file. With `plain`, strings of special tokens inside texts are ordinary text; else they
    get the special tokens' ids, as the library gives them by itself."""
    if (path, plain) not in _loaded:
        _loaded[path, plain] = Encoder(path, plain)
    return _loaded[path, plain]


class Encoder:
    def __init__(self, path: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        #: Texts with one of these are encoded whole.
        self.special = () if plain else tuple({x for t in self.tokenizer.get_added_tokens_decoder().values() for x in (t.content, t.content.lower())})
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.between = self._separator()
        folded = [x.ids for x in self.tokenizer.encode_batch_fast(["the", "The", " The", "\nTHE"], add_special_tokens=False)]
        self.folds = folded == folded[:1] * 4
        self.tails = {x: self.tokenizer.encode(x, add_special_tokens=False).ids[0] for x in ",."}
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str | tuple[str], int] = {"": 0}
        self.begin, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.count, self.used, self.flat = 1, 0, np.zeros(4096, np.uint32)

    def _separator(self) -> tuple[str, int] | None:
        """A string that may stand between pieces without changing their ids, and its own id; None if there is none."""
        probes = [" the", "the", "The,", " a", ".", " ", "\n", "###", " 12", "é", "\nIt's", " x!?", "'"]
        apart = [x.ids for x in self.tokenizer.encode_batch_fast(probes, add_special_tokens=False)]
        for between in ("\0", " \0 "):
            own = self.tokenizer.encode_batch_fast([between.strip()], add_special_tokens=False)[0].ids
            joined = self.tokenizer.encode_batch_fast([between.join(probes)], add_special_tokens=False)[0].ids
            if len(own) == 1 and joined == [k for ids in apart for k in [*own, *ids]][1:]:
                return between, own[0]
        return None

    def encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces one after another, and how many each has. They are encoded joined, but for pieces that end in
        white space: what stands behind it matters."""
        if self.between is None or any("\0" in x for x in pieces):
            return self._apart(pieces)
        if open_ended := [k for k, x in enumerate(pieces) if x[-1:].isspace()]:
            flat, sizes = self._apart([pieces[k] for k in open_ended])
            rest = self.encoded([x for x in pieces if not x[-1:].isspace()]) if len(open_ended) < len(pieces) else (flat[:0], sizes[:0])
            every = np.zeros(len(pieces), np.int64)
            every[open_ended] = sizes
            closed = np.setdiff1d(np.arange(len(pieces)), open_ended)
            every[closed] = rest[1]
            inside = np.zeros(len(pieces), bool)
            inside[open_ended] = True
            out, inside = np.zeros(int(every.sum()), np.uint32), np.repeat(inside, every)
            out[inside], out[~inside] = flat, rest[0]
            return out, every
        text, mark = self.between
        ids = np.array(self.tokenizer.encode_batch_fast([text.join(pieces)], add_special_tokens=False)[0].ids, np.uint32)
        marks = np.concatenate([[-1], np.flatnonzero(ids == mark), [len(ids)]])
        return ids[ids != mark], np.diff(marks) - 1

    def _apart(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((k for ids in found for k in ids), np.uint32, int(sizes.sum())), sizes

    def _learn(self, pieces: list[str | tuple[str]]) -> None:
        """New pieces, each once. A comma or full stop after a letter or digit is a token of its own; a whole text comes as a
        tuple."""
        known, tailed, plain = self.known, [], []
        for piece in pieces:
            if isinstance(piece, tuple):
                ids = np.array(self.tokenizer.encode_batch_fast([*piece], add_special_tokens=False)[0].ids, np.uint32)
                self._store([piece], ids, np.array([len(ids)]))
                continue
            (tailed if len(piece) > 2 and piece[-1] in ",." and piece[-2].isalnum() else plain).append(piece)
        fresh = set(plain)
        stems = [x for x in dict.fromkeys(x[:-1] for x in tailed) if x not in known and x not in fresh]
        if plain or stems:
            self._store(plain + stems, *self.encoded(plain + stems))
        if tailed:
            at = np.fromiter((known[x[:-1]] for x in tailed), np.int64, len(tailed))
            tail = np.fromiter((self.tails[x[-1]] for x in tailed), np.uint32, len(tailed))
            ids, sizes = self._gather(at)
            self._store(tailed, np.insert(ids, np.cumsum(sizes), tail), sizes + 1)

    def _store(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        new, used = self.count + len(pieces), self.used + len(ids)
        if new > len(self.begin):
            self.begin, self.size = np.resize(self.begin, 2 * new), np.resize(self.size, 2 * new)
        if used > len(self.flat):
            self.flat = np.resize(self.flat, 2 * used)
        self.flat[self.used : used] = ids
        self.size[self.count : new] = sizes
        self.begin[self.count : new] = self.used + np.cumsum(sizes) - sizes
        self.known.update(zip(pieces, range(self.count, new), strict=True))
        self.count, self.used = new, used

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.size[at]
        total = np.cumsum(sizes)
        shift = np.repeat(self.begin[at] - total + sizes, sizes)
        shift += np.arange(len(shift))
        return self.flat[shift], sizes

    def _marked(self, text: str) -> bool:
        """Whether a special token's string stands in the text, or would once it is lower-cased."""
        if any(x in text for x in self.special):
            return True
        return self.folds and any(x[0] in text for x in self.special) and any(x in text.lower() for x in self.special)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids (unsigned 32-bit) and the number of ids of each text."""
        pieces: list[str | tuple[str]] = []
        ends = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            if self.special and self._marked(text):
                pieces.append((text,))
            elif self.folds and "\0" not in text and _PLAIN.fullmatch(text):
                pieces += text.lower().replace("\n", " ").split(" ")
            elif "  " in text or "\n\n" in text or " \n" in text or "\n " in text or RARE.search(text):
                pieces += CUT.split(text)
            else:
                pieces += text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
            ends[k] = len(pieces)
        if self.count > PIECES or self.used > 8 * PIECES:
            self._forget()
        at = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(at < 0).tolist()
        self._learn(list(dict.fromkeys(pieces[k] for k in missing)))
        at[missing] = [self.known[pieces[k]] for k in missing]
        ids, sizes = self._gather(at)
        total = np.concatenate([[0], np.cumsum(sizes)])
        for piece in {pieces[k] for k in missing if isinstance(pieces[k], tuple) or len(pieces[k]) > PIECE_CHARS}:
            self.known.pop(piece, None)
            if isinstance(piece, str):
                self.known.pop(piece[:-1], None)
        return ids, np.diff(np.concatenate([[0], total[ends]]))
