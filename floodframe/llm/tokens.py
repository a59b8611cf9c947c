"""Token ids of texts from a public tokenizer file, each distinct piece of text encoded once per worker."""

import os
import re
from functools import cache

import numpy as np

#: Pieces a worker remembers at most before it starts anew.
MEMO = 1_000_000
END = 1  # closes every document
_BATCH = 1000

_PUNCTUATION = r"!-&(-/:-@\[-`{-~"  # ASCII punctuation but the apostrophe, which may begin a token with letters after it
# Texts of ASCII and Latin letters, without an apostrophe beside other punctuation, split at every change to or from punctuation.
_NOT_PLAIN = re.compile(f"[^\t\n -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]|[{_PUNCTUATION}]'|'[{_PUNCTUATION}]|<\\|")
# Texts with rare white space, or with the marks used here, go through the tokenizer whole.
_ODD = re.compile("[\x00-\x08\x0b-\x1f\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f\u2060\u3000\ufeff]|<\\|")


class _Memo(dict):
    """Numbers for pieces; unknown ones get the next number and are listed in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece):
        self[piece] = number = len(self)
        self.new.append(piece)
        return number


class Encoder:
    """Encodes texts piece by piece. Both supported files split text before merging, at white space and between letters and
    punctuation, so a piece that begins and ends at such a split (a blank belongs to the word after it where the file keeps blanks)
    has the ids it has inside the text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.blanks = bool(len(self._plain([" "])[0]))
        blank, space = (" ?", r"|\s+(?!\S)|\s+") if self.blanks else ("", "")
        self.coarse = re.compile(rf"{blank}\S+{space}").findall
        self.fine = re.compile(rf"{blank}[^\s{_PUNCTUATION}]+|{blank}[{_PUNCTUATION}]+{space}").findall
        self.mark = "\n" if self.blanks else " \x01 "
        self.mark_id = self._plain([self.mark])[0]
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self._clear()

    def _clear(self):
        self.memo = _Memo()
        self.flat, self.used = np.zeros(1 << 20, self.kind), 0
        self.ends, self.known = np.zeros(1 << 16, np.int64), 0  # where the ids of each piece end

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _store(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Append the ids of the next ``len(sizes)`` pieces."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.known + len(sizes) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[self.used:self.used + len(ids)] = ids
        self.ends[self.known:self.known + len(sizes)] = self.used + np.cumsum(sizes)
        self.used, self.known = self.used + len(ids), self.known + len(sizes)

    def _learn(self, pieces: list[str]) -> None:
        for i in range(0, len(pieces), _BATCH):
            part = pieces[i:i + _BATCH]
            joined = not any(p.isspace() for p in part) and len(self.mark_id) == 1
            ids = np.array(self._plain([self.mark.join(part)])[0], np.int64) if joined else None
            at = np.flatnonzero(ids == self.mark_id[0]) if joined else ()
            if joined and len(at) == len(part) - 1:
                self._store(np.delete(ids, at), np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1)
            else:
                own = self._plain(part)
                self._store(np.array([t for x in own for t in x], np.int64), np.array([len(x) for x in own]))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, with the closing id; null counts as empty."""
        out: list = [None] * len(texts)
        pieces, counts, split = [], [], []
        for k, text in enumerate(texts):
            text = text or ""
            if not _NOT_PLAIN.search(text):
                found = self.fine(text if self.blanks else text.lower())
            elif not _ODD.search(text):
                found = self.coarse(text)
            else:
                out[k] = np.array([*self._plain([text])[0], END], np.uint32)
                continue
            pieces += found
            counts.append(len(found))
            split.append(k)
        if len(self.memo) > MEMO:
            self._clear()
        which = np.fromiter(map(self.memo.__getitem__, pieces), np.int64, len(pieces))
        if self.memo.new:
            new, self.memo.new = self.memo.new, []
            spaces = [p for p in new if p.isspace()]
            if spaces:  # few; kept apart from the marks of a joined batch
                order = [p for p in new if not p.isspace()] + spaces
                moved = {self.memo[p]: self.known + i for i, p in enumerate(order)}
                number = np.arange(len(self.memo))
                number[list(moved)] = list(moved.values())
                which = number[which]
                self.memo.update(zip(order, range(self.known, self.known + len(order))))
                self._learn(order[:len(order) - len(spaces)])
                self._learn(spaces)
            else:
                self._learn(new)
        end = self.ends[which]
        begin = np.where(which > 0, self.ends[which - 1], 0)
        size = end - begin
        stop = np.cumsum(size)
        ids = self.flat[np.repeat(end - stop, size) + np.arange(stop[-1] if len(stop) else 0)].astype(np.uint32)
        edge = np.concatenate([[0], stop])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        for k, a, b in zip(split, edge[:-1].tolist(), edge[1:].tolist()):
            out[k] = np.append(ids[a:b], np.uint32(END))
        return out


@cache
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    return Encoder(path)
