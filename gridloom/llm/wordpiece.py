"""Ids of a word-end byte-pair tokenizer for whole buffers of text at once.

The tokenizer file is read with the tokenizers library, which stays the authority: words that hold anything but
ASCII letters, the letters of Latin-1 and ASCII punctuation go to it as they are. The other words are
cut at the border of letters and punctuation, as the file's own pattern does, and the merges of all
distinct pieces run in numpy, the lowest rank of every piece at a time."""

from __future__ import annotations

import json

import numpy as np

from .shared import LOWER, SPACE, span_hashes

NONE = np.int32(1 << 30)
WIDEST = 32


class WordPieces:
    """Only for files whose normalizer is NFC, white space to one space and lower case, whose pattern keeps
    letter runs, single digits, runs of other signs and English contractions, and drops white space."""

    def __init__(self, path: str, most: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        model = json.loads(self.tokenizer.to_str())["model"]
        vocab = model["vocab"]
        shown = _byte_chars()
        self.inner = np.array([vocab[c] for c in shown], np.int32)
        self.last = np.array([vocab[c + "</w>"] for c in shown], np.int32)
        merges = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        a = np.array([vocab[x] for x, _ in merges], np.int64)
        b = np.array([vocab[y] for _, y in merges], np.int64)
        keys = a << 16 | b
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[x + y] for x, y in merges], np.int32)
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.known = np.empty(0, np.uint64)
        self.at = np.empty(0, np.int64)
        self.flat = np.empty(1 << 20, np.uint32)
        self.first = np.zeros(1, np.int64)

    # ------------------------------------------------------------ merges

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = a.astype(np.int64) << 16 | b
        i = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where((self.keys[i] == k) & (b >= 0), self.ranks[i], NONE)

    def _merge(self, s: np.ndarray) -> np.ndarray:
        """s: ids of the bytes, one row a piece, -1 behind the end; merged in place as far as the ranks go."""
        out = s
        rows = np.arange(len(s))
        r = np.full(s.shape, NONE, np.int32)
        r[:, :-1] = self._rank(s[:, :-1], s[:, 1:])
        s = s.copy()
        column = np.arange(s.shape[1])
        while len(rows):
            j = r.argmin(1)
            i = np.arange(len(rows))
            m = r[i, j]
            live = m < NONE
            if not live.all():
                out[rows[~live]] = s[~live]
                rows, s, r, j, m = rows[live], s[live], r[live], j[live], m[live]
                if not len(rows):
                    break
                i = np.arange(len(rows))
            later = column[None, :] > j[:, None]
            s[:, :-1] = np.where(later[:, :-1], s[:, 1:], s[:, :-1])
            s[:, -1] = -1
            r[:, :-1] = np.where(later[:, :-1], r[:, 1:], r[:, :-1])
            r[:, -1] = NONE
            s[i, j] = self.merged[m]
            after = np.minimum(j + 1, s.shape[1] - 1)
            r[i, j] = np.where(j + 1 < s.shape[1], self._rank(s[i, j], s[i, after]), NONE)
            b = np.flatnonzero(j > 0)
            r[b, j[b] - 1] = self._rank(s[b, j[b] - 1], s[b, j[b]])
        return out

    def _pieces(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, number of each) of short pieces of plain bytes."""
        n = np.empty(len(starts), np.int64)
        order = np.argsort(sizes, kind="stable")
        got: list[np.ndarray] = []
        for k in range(0, len(order), 16384):
            some = order[k : k + 16384]
            width = int(sizes[some[-1]])
            at = np.arange(width)
            inside = at[None, :] < sizes[some][:, None]
            raw = data[np.minimum(starts[some][:, None] + at[None, :], len(data) - 1)]
            s = np.where(inside, np.where(at[None, :] == sizes[some][:, None] - 1, self.last[raw], self.inner[raw]), -1).astype(np.int32)
            if width > 1:
                s = self._merge(s)
            n[some] = (s >= 0).sum(1)
            got.append(s[s >= 0])
        flat = np.concatenate(got) if got else np.empty(0, np.int32)
        run = np.concatenate([[0], np.cumsum(n[order])])
        where = np.empty(len(order), np.int64)
        where[order] = run[:-1]
        take = np.repeat(where - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return flat[take].astype(np.uint32), n

    # ------------------------------------------------------------ texts

    def _units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """(bytes in lower case, starts, ends, which units are whole words for the tokenizer, each text's offset into them)."""
        n = len(data)
        low = LOWER[data]
        kind = KIND[data]
        lead = np.flatnonzero(data == 0xC3)
        if len(lead):
            lead = lead[lead + 1 < n]
            second = data[lead + 1]
            fine = (second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)
            kind[lead[fine]] = 1
            kind[lead[fine] + 1] = 1
            big = lead[fine & (second <= 0x9E)] + 1
            low[big] += 0x20
        sign = np.flatnonzero(data[:-1] == 0x3C)
        kind[sign[data[sign + 1] == 0x7C]] = 3
        solid = kind > 0
        edge = np.zeros(n + 1, bool)  # a text begins
        edge[offsets[:-1]] = True
        edge = edge[:n]
        word = solid.copy()
        word[1:] &= ~solid[:-1] | edge[1:]
        begin = np.flatnonzero(word)
        if not len(begin):
            return low, begin, begin, np.empty(0, bool), np.zeros(len(offsets), np.int64)
        odd = np.zeros(n + 1, np.int64)
        np.cumsum(kind == 3, out=odd[1:])
        stop = np.append(begin[1:], n)
        whole_word = odd[stop] > odd[begin]  # no unit between holds white space that counts
        whole = np.zeros(n, bool)
        whole[begin] = whole_word
        opaque = np.repeat(whole_word, stop - begin)
        cut = word.copy()
        inner = np.zeros(n, bool)
        inner[1:] = solid[1:] & solid[:-1] & (kind[1:] != kind[:-1])
        inner[begin[0] :] &= ~opaque
        cut |= inner
        starts = np.flatnonzero(cut)
        close = np.zeros(n, bool)
        close[:-1] = solid[:-1] & (~solid[1:] | cut[1:])
        close[-1] = solid[-1]
        ends = np.flatnonzero(close) + 1
        return low, starts, ends, whole[starts], np.searchsorted(starts, offsets)

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, each text's offset into them)."""
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        low, starts, ends, whole, unit_offsets = self._units(data, offsets)
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        # Words for the tokenizer are told apart by their own bytes and never mistaken for a piece.
        hashes = span_hashes(low, starts, ends)
        odd = np.flatnonzero(whole)
        if len(odd):
            hashes[odd] = ~span_hashes(data, starts[odd], ends[odd])
        distinct, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = self._places(distinct, data, low, starts[where], ends[where], whole[where])[back]
        sizes = self.first[at + 1] - self.first[at]
        run = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.repeat(self.first[at] - run[:-1], sizes) + np.arange(run[-1])
        return self.flat[flat], run[unit_offsets]

    def _places(self, distinct: np.ndarray, data: np.ndarray, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, whole: np.ndarray) -> np.ndarray:
        if len(self.known) + len(distinct) > self.most:
            self.clear()
        i = np.searchsorted(self.known, distinct)
        have = i < len(self.known)
        have[have] = self.known[i[have]] == distinct[have]
        out = np.empty(len(distinct), np.int64)
        out[have] = self.at[i[have]]
        new = np.flatnonzero(~have)
        if not len(new):
            return out
        sizes = ends[new] - starts[new]
        hard = whole[new] | (sizes > WIDEST)
        easy = np.flatnonzero(~hard)
        ids, count = self._pieces(low, starts[new[easy]], sizes[easy])
        order = [new[easy]]
        all_ids, counts = [ids], [count]
        hard = np.flatnonzero(hard)
        if len(hard):
            words = [data[starts[k] : ends[k]].tobytes().decode("utf-8", "replace") for k in new[hard].tolist()]
            got = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch(words, add_special_tokens=False)]
            all_ids += got
            counts.append(np.array([len(x) for x in got], np.int64))
            order.append(new[hard])
        order, ids, counts = np.concatenate(order), np.concatenate(all_ids), np.concatenate(counts)
        base, used = len(self.first) - 1, int(self.first[-1])
        while used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[used : used + len(ids)] = ids
        self.first = np.concatenate([self.first, used + np.cumsum(counts)])
        out[order] = base + np.arange(len(order))
        self.known = np.insert(self.known, i[new], distinct[new])
        self.at = np.insert(self.at, i[new], out[new])
        return out


#: 0 white space, 1 letters, 2 ASCII punctuation, 3 what only the tokenizer decides (digits, apostrophes, other scripts).
KIND = np.full(256, 3, np.uint8)
KIND[np.flatnonzero(SPACE)] = 0
KIND[[*range(65, 91), *range(97, 123)]] = 1
KIND[[c for c in range(33, 127) if not chr(c).isalnum() and c != 39]] = 2


def _byte_chars() -> list[str]:
    """The printable sign that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


_loaded: dict[str, WordPieces] = {}


def word_pieces(path: str) -> WordPieces:
    if path not in _loaded:
        _loaded[path] = WordPieces(path)
    return _loaded[path]
