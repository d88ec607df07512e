"""Token ids of Arrow text columns.

A byte-level BPE tokenizer splits a text into pieces by a fixed pattern and merges inside each piece only, so the ids of
a text are those of its pieces one after the other. Each worker keeps the ids of the pieces it has met in a hash table of
bounded size and asks the tokenizer for new ones only. Pieces of a whole chunk are found and looked up at once. Texts
beyond Latin-1, with an apostrophe (contractions) or with what could be a special token go to the tokenizer whole.
"""

from __future__ import annotations

import numpy as np

from . import text as tx

#: Letter 0, digit 1, white space 2, other 3, by Latin-1 character.
KIND = np.full(256, 3, np.uint8)
KIND[[i for i in range(256) if chr(i).isalpha()]] = 0
KIND[[i for i in range(256) if chr(i).isnumeric()]] = 1
KIND[[9, 10, 11, 12, 13, 32, 0x85, 0xA0]] = 2
SLOTS = 1 << 22
#: Ids of pieces that are kept, about; one text's pieces may go beyond it.
ARENA = 1 << 25
_loaded: dict[str, Encoder] = tx.KEPT.setdefault("tokens", {})


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.wide = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        vocabulary = self.tokenizer.get_vocab()  # its strings have a character for each byte
        self.bytes_per_id = np.zeros(max(vocabulary.values()) + 1, np.int32)
        self.bytes_per_id[list(vocabulary.values())] = [len(x) for x in vocabulary]
        self._forget()

    @staticmethod
    def of(path: str) -> Encoder:
        """This worker's encoder of that file."""
        if path not in _loaded:
            _loaded[path] = Encoder(path)
        return _loaded[path]

    def _forget(self) -> None:
        self.key, self.place, self.size = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)  # where in the arena, and how many ids
        self.arena, self.used, self.filled = np.zeros(1 << 16, self.wide), 0, 0

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.wide)

    def encode(self, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end_id after each, and each text's offsets. Null is empty."""
        plain, fast = [], np.zeros(len(texts), bool)
        for i, t in enumerate(texts):
            t = t or ""
            if "'" not in t and "<|" not in t:
                try:
                    plain.append(t.encode("latin-1"))
                    fast[i] = True
                except UnicodeEncodeError:
                    pass
        size = np.zeros(len(texts), np.int64)
        found, size[fast] = self._plain(plain)
        whole = [self.ids(texts[i]) for i in np.flatnonzero(~fast)]
        size[~fast] = [len(x) for x in whole]
        at = np.concatenate([[0], np.cumsum(size + 1)])
        out = np.full(at[-1], end_id, self.wide)
        if fast.all():
            shift = np.repeat(np.arange(len(texts)), size)
            out[np.arange(len(found)) + shift] = found
        else:
            i = 0
            rest = iter(whole)
            for k, n in enumerate(size.tolist()):
                if fast[k]:
                    out[at[k] : at[k] + n] = found[i : i + n]
                    i += n
                else:
                    out[at[k] : at[k] + n] = next(rest)
        return out, at

    def _plain(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        at = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        buf = np.frombuffer(b"".join(texts), np.uint8)
        if not len(buf):
            return np.zeros(0, self.wide), np.zeros(len(texts), np.int64)
        chunk = tx.Chunk(None, buf, at)
        kind = KIND[buf]
        first = np.ones(len(buf), bool)
        first[1:] = kind[1:] != kind[:-1]
        first[at[:-1][at[:-1] < at[1:]]] = True
        # the last white space before something else begins a piece; a blank takes what follows with it
        stop = np.flatnonzero(first[1:]) + 1
        stop = stop[kind[stop - 1] == 2]
        stop = stop[~np.isin(stop, at, assume_unique=False)] if len(at) > 2 else stop
        first[stop - 1] = True
        first[stop[buf[stop - 1] == 32]] = False
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(buf))
        h = chunk.hashes(starts, ends)
        h[h == 0] = 1
        slot = self._slots(h)
        new = np.flatnonzero(slot < 0)
        if len(new):
            _, one = np.unique(h[new], return_index=True)
            if self.filled + len(one) > SLOTS * 0.6 or self.used > ARENA:
                self._forget()
                _, one = np.unique(h, return_index=True)
                new = np.arange(len(h))
            one = new[one]
            self._learn(buf, starts[one], ends[one], h[one])
            slot[new] = self._slots(h[new])
        n = self.size[slot].astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(n)])
        out = self.arena[np.repeat(self.place[slot].astype(np.int64) - upto[:-1], n) + np.arange(upto[-1])]
        return out, np.diff(upto[np.searchsorted(starts, at)])

    def _slots(self, h: np.ndarray) -> np.ndarray:
        """Each hash's place in the table, or -1."""
        mask = np.uint64(SLOTS - 1)
        at = (h & mask).astype(np.int64)
        there = self.key[at]
        out = np.where(there == h, at, -1)
        left = np.flatnonzero((there != h) & (there != 0))
        while len(left):
            at[left] = (at[left] + 1) & (SLOTS - 1)
            there = self.key[at[left]]
            hit = there == h[left]
            out[left[hit]] = at[left[hit]]
            left = left[~hit & (there != 0)]
        return out

    def _learn(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> None:
        """Ids of new pieces. They go to the tokenizer in one text, which it splits into them again: those with a leading blank as they are, the others on a line each; white space goes alone."""
        begin, size = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        raw = buf.tobytes()
        high = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(buf >> 7, dtype=np.int32, out=high[1:])
        blank = buf[starts] == 32
        spaces = KIND[buf[ends - 1]] == 2
        for chosen, line in ((np.flatnonzero(blank & ~spaces), ""), (np.flatnonzero(~blank & ~spaces), "\n")):
            if len(chosen):
                pieces = [raw[a:b] for a, b in zip(starts[chosen].tolist(), ends[chosen].tolist(), strict=True)]
                joined = line.encode().join(pieces).decode("latin-1")
                ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, self.wide)
                length = ends[chosen] - starts[chosen] + high[ends[chosen]] - high[starts[chosen]]  # in UTF-8
                b = np.cumsum(length + len(line)) - length - len(line)
                upto = np.zeros(len(ids) + 1, np.int32)
                np.cumsum(self.bytes_per_id[ids], dtype=np.int32, out=upto[1:])
                a, b = np.searchsorted(upto, b), np.searchsorted(upto, b + length)
                begin[chosen], size[chosen] = self._keep(ids) + a, b - a
        for k in np.flatnonzero(spaces):
            ids = self.ids(raw[starts[k] : ends[k]].decode("latin-1"))
            begin[k], size[k] = self._keep(ids), len(ids)
        todo, at = np.arange(len(h)), (h & np.uint64(SLOTS - 1)).astype(np.int64)
        while len(todo):
            free = self.key[at[todo]] == 0
            self.key[at[todo[free]]] = h[todo[free]]
            won = self.key[at[todo]] == h[todo]
            done = todo[won]
            self.place[at[done]], self.size[at[done]] = begin[done], size[done]
            todo = todo[~won]
            at[todo] = (at[todo] + 1) & (SLOTS - 1)
        self.filled += len(h)

    def _keep(self, ids: np.ndarray) -> int:
        if self.used + len(ids) > len(self.arena):
            self.arena = np.concatenate([self.arena[: self.used], np.zeros(max(len(ids), len(self.arena)), self.wide)])
        self.arena[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)
