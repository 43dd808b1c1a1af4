"""Token ids of whole texts by a file of the tokenizers library, with a bounded memo of words in each worker.

Texts are cut at ASCII white space on byte arrays, many at a time; a table from word hashes (64 bits) to
ids answers the words met before, and the library encodes the others.  This is exact for tokenizers that
drop white space before they merge, as no piece then crosses it.  Texts that hold the opening of a special
token go to the library whole; so does everything if a first sample of texts differs from the library.
"""

from __future__ import annotations

import functools
import os

import numpy as np

from millrace.llm.shingles import PIECE, word_hashes

#: A character that stands between words while many are encoded at once; words that hold it are encoded alone.
MARK = "\x00"


class Memo:
    """An open-addressing table from 64-bit hashes to runs of ids, for arrays of hashes."""

    def __init__(self, entries: int, ids: np.dtype):
        self.most = entries
        self.mask = np.uint64((1 << (2 * entries - 1).bit_length()) - 1)
        self.type = ids
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(int(self.mask) + 1, np.uint64)
        self.slots = np.zeros(int(self.mask) + 1, np.int32)
        self.n, self.used = 0, 0
        self.starts = np.zeros(self.most + 1, np.int64)
        self.lengths = np.zeros(self.most + 1, np.int64)
        self.pool = np.zeros(8 * self.most, self.type)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The entry of each hash, -1 where there is none."""
        found = np.full(len(hashes), -1, np.int64)
        open_, slot = None, hashes & self.mask
        while True:
            key = self.keys[slot]
            want = hashes if open_ is None else hashes[open_]
            hit = key == want
            if open_ is None:
                found[hit] = self.slots[slot[hit]]
                open_ = np.flatnonzero(~hit & (key != 0))
                slot = slot[open_]
            else:
                found[open_[hit]] = self.slots[slot[hit]]
                on = ~hit & (key != 0)
                open_, slot = open_[on], slot[on]
            if not len(open_):
                return found
            slot = (slot + np.uint64(1)) & self.mask

    def add(self, hashes: np.ndarray, runs: list[np.ndarray]) -> None:
        """Distinct hashes that are not there yet, with their ids."""
        lengths = np.array([len(r) for r in runs], np.int64)
        total = int(lengths.sum())
        while self.used + total > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.pool[self.used : self.used + total] = np.concatenate(runs)
        at = slice(self.n, self.n + len(runs))
        self.lengths[at] = lengths
        self.starts[at] = self.used + np.cumsum(lengths) - lengths
        entries = np.arange(self.n, self.n + len(runs), dtype=np.int32)
        self.n += len(runs)
        self.used += total
        slot = hashes & self.mask
        while len(hashes):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = hashes[free]
            mine = self.keys[slot] == hashes
            self.slots[slot[mine]] = entries[mine]
            hashes, entries, slot = hashes[~mine], entries[~mine], (slot[~mine] + np.uint64(1)) & self.mask


class Encoder:
    def __init__(self, path: str, memo: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.type = np.dtype("<u2") if self.library.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        mark = self.library.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.fold = self.library.encode("AB Cd", add_special_tokens=False).ids == self.library.encode("ab cd", add_special_tokens=False).ids
        self.openings = {t.content[:2] for t in self.library.get_added_tokens_decoder().values()}
        self.memo = Memo(memo, self.type)
        self.checked = 0
        self.by_word = True

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.type) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learned(self, words: list[str]) -> list[np.ndarray]:
        """Ids of single words, many at a time."""
        if self.mark is None:
            return self._whole(words)
        out: list[np.ndarray] = []
        for i in range(0, len(words), 200):
            group = words[i : i + 200]
            plain = [w for w in group if MARK not in w]
            ids = self._whole([f" {MARK} ".join(plain)])[0] if len(plain) == len(group) else None
            ends = np.flatnonzero(ids == self.mark) if ids is not None else []
            if ids is None or len(ends) != len(group) - 1:  # the mark came out of a word as well
                out += self._whole(group)
                continue
            starts = [0, *(ends + 1).tolist()]
            out += [ids[a:b] for a, b in zip(starts, [*ends.tolist(), len(ids)], strict=True)]
        return out

    def _by_words(self, encoded: list[bytes]) -> list[np.ndarray]:
        data = b"\n".join(encoded)
        starts, ends, hashes = word_hashes(np.frombuffer(data, np.uint8), set_apart=self.fold, fold=self.fold)
        entry = self.memo.find(hashes)
        new = np.flatnonzero(entry < 0)
        if len(new):
            _, first = np.unique(hashes[new], return_index=True)
            first = new[first]
            if self.memo.n + len(first) > self.memo.most:
                self.memo.clear()
                _, first = np.unique(hashes, return_index=True)
            step = self.memo.most // 2
            if len(first) > step:  # one text of more distinct words than the memo holds
                return self._whole([b.decode() for b in encoded])
            words = [data[a:b].decode() for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
            self.memo.add(hashes[first], self._learned(words))
            entry = self.memo.find(hashes)
        lengths = self.memo.lengths[entry]
        after = np.cumsum(lengths)
        total = int(after[-1]) if len(after) else 0
        ids = self.memo.pool[np.repeat(self.memo.starts[entry] - (after - lengths), lengths) + np.arange(total)]
        begins = np.cumsum([0] + [len(b) + 1 for b in encoded])
        bounds = np.searchsorted(starts, begins)
        edges = np.concatenate(([0], after))[bounds].tolist()
        return [ids[a:b] for a, b in zip(edges, edges[1:], strict=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if not self.by_word:
            return self._whole(texts)
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            group, size = [], 0
            while at < len(texts) and (not group or size < PIECE):
                group.append(texts[at].encode())
                size += len(group[-1])
                at += 1
            out += self._by_words(group)
        for i, t in enumerate(texts):
            if any(o in t for o in self.openings):
                out[i] = self._whole([t])[0]
        if self.checked < 50:
            some = [i for i, t in enumerate(texts[:50]) if len(t) < 20_000]
            self.checked += max(1, len(some))
            if any(not np.array_equal(out[i], w) for i, w in zip(some, self._whole([texts[i] for i in some]), strict=True)):
                self.by_word = False
                return self._whole(texts)
        return out


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker and file."""
    return Encoder(path)


def ids_with_end(path: str, texts: list[str | None], end: int = 1) -> list[np.ndarray]:
    """Ids of each whole text (null: empty) with the end id after them."""
    e = encoder(path)
    tail = np.array([end], e.type)
    return [np.concatenate((ids, tail)) for ids in e.encode([t or "" for t in texts])]
