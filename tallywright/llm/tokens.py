"""Token ids of whole texts by the tokenizers library, with a bounded cache of pieces."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import tables_of, tidy

#: A piece is a union of whole pre-tokens of the byte-level pattern: every place between two pieces is a place where that
#: pattern always parts a text, so the pieces' ids in a row are the text's ids.
PIECE = re.compile(r" ?[^\W_]+(?:'[^\W_]+)*| ?(?:[^\s\w]|_)+[^\W_]*|\s+(?!\S)|\s+")
#: White space for Python and not for the tokenizer.
ODD_SPACE = "\x1c\x1d\x1e\x1f"
LONGEST_CACHED = 48
#: Where white space has this, a blank doesn't part a text as it does before a letter or sign.
WIDE = re.compile(r" \s")
#: Characters of texts that are looked at together.
TOGETHER = 1 << 22


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: itself if it prints, else the next from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(prints)]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}


class Merges:
    """Ids of many short pre-tokens by a byte-pair vocabulary: all lie beside each other in a matrix, and each round merges the first best pair of every row."""

    PROBES, NONE = 0x9E3779B97F4A7C15, np.int32(2**31 - 1)

    def __init__(self, vocabulary: dict[str, int], merges: list, bits: int = 19):
        parts = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.of_byte = np.array([vocabulary[c] for _, c in sorted(_byte_letters().items())], np.int32)
        self.made = np.array([vocabulary[a + b] for a, b in parts], np.int32)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, self.NONE, np.int32)
        pairs = np.array([(vocabulary[a] << 32) + vocabulary[b] for a, b in parts], np.int64)
        for rank, (key, at) in enumerate(zip(pairs.tolist(), self.slots(pairs).tolist())):
            while self.keys[at] not in (-1, key):
                at = (at + 1) & self.mask
            if self.keys[at] == -1:
                self.keys[at], self.ranks[at] = key, rank

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(self.PROBES)) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE for those that don't merge."""
        keys = (left.astype(np.int64) << 32) + right
        at = self.slots(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.ranks[at], self.NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece of a byte at least, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        for low, high in ((0, 8), (8, 12), (12, 16), (16, 32), (32, 1 << 30)):
            rows = np.flatnonzero((lengths > low) & (lengths <= high))
            for i in range(0, len(rows), 4096):
                own = rows[i : i + 4096]
                self._merge([pieces[k] for k in own.tolist()], own, lengths[own], out)
        return out

    def _merge(self, pieces: list[bytes], rows: np.ndarray, n: np.ndarray, out: list[bytes]) -> None:
        filled = np.arange(n.max()) < n[:, None]
        ids = np.zeros(filled.shape, np.int32)
        ids[filled] = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = np.full((len(n), filled.shape[1]), self.NONE)
        pairs = filled[:, 1:]
        ranks[:, :-1][pairs] = self.rank(ids[:, :-1][pairs], ids[:, 1:][pairs])
        while len(n):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(n)), at]
            over = best == self.NONE
            if over.any():
                raw, width = ids[over].astype("<u4").tobytes(), 4 * ids.shape[1]
                for k, (row, size) in enumerate(zip(rows[over].tolist(), n[over].tolist())):
                    out[row] = raw[k * width : k * width + 4 * size]
                go = ~over
                rows, n, ids, ranks, at, best = rows[go], n[go], ids[go], ranks[go], at[go], best[go]
                if not len(n):
                    return
            every = np.arange(len(n))
            ids[every, at] = self.made[best]
            columns, shape = np.arange(ids.shape[1]), (len(n), ids.shape[1] - 1)
            # the token after goes from ids, and the pair from ranks
            ids = ids[columns != at[:, None] + 1].reshape(shape)
            ranks = ranks[columns != at[:, None]].reshape(shape)
            n = n - 1
            for k, some in ((at - 1, at > 0), (at, at + 1 < n)):
                r, c = every[some], k[some]
                ranks[r, c] = self.rank(ids[r, c], ids[r, c + 1])


class _Cache(dict):
    """Ids by piece, as little-endian unsigned 32-bit integers; two generations of at most ``most`` pieces."""

    def __init__(self, tokenizer, most: int):
        self.encode, self.model, self.letters = tokenizer.encode, tokenizer.model, _byte_letters()
        self.most, self.old = most, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            if len(piece) <= LONGEST_CACHED and piece[piece[0] == " " :].isalpha():  # one pre-token
                ids = array("I", [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]).tobytes()
            else:
                ids = array("I", self.encode(piece, add_special_tokens=False).ids).tobytes()
        if len(piece) <= LONGEST_CACHED:
            self.put(piece, ids)
        return ids

    def put(self, piece: str, ids: bytes) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[piece] = ids


class Encoder:
    """encode(text): ids as little-endian unsigned 32-bit integers; null is the empty text."""

    def __init__(self, path: str, cached_pieces: int = 200_000):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made_of = json.load(f)
        before = made_of["pre_tokenizer"] or {}
        self.by_pieces = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not made_of["normalizer"]
        #: Texts that hold one of these are encoded in one go, as the library does with them what it does.
        self.whole = [*ODD_SPACE, *(t["content"] for t in made_of["added_tokens"])]
        self.plain, self.vocabulary = tokenizer.encode, tokenizer.get_vocab_size()
        self.cache = _Cache(tokenizer, cached_pieces)
        model = made_of["model"]
        odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        plain = self.by_pieces and model.get("type") == "BPE" and not any(model.get(k) for k in odd) and all(c in model["vocab"] for c in _byte_letters().values())
        self.merges = Merges(model["vocab"], model["merges"]) if plain else None

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.in_one_go(text):
            return array("I", self.plain(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.cache.__getitem__, PIECE.findall(text)))

    def in_one_go(self, text: str) -> bool:
        return not self.by_pieces or any(c in text for c in self.whole)

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """encode(text) for each text; words that several texts have are looked up once for all of them."""
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text or "")
            if size >= TOGETHER:
                yield from self._together(group)
                group, size = [], 0
        yield from self._together(group)

    def _together(self, texts: list[str | None]) -> Iterator[bytes]:
        heads, ends, data = self._made(texts)
        tidy()
        for head, a, b in zip(heads, ends, ends[1:]):
            yield head + data[a:b]

    def _made(self, texts: list[str | None]) -> tuple[list[bytes], list[int], memoryview]:
        """The ids up to each text's first blank, and those of what follows, with their places.

        A blank before anything but white space begins a pre-token, so what lies between blanks is encoded by itself, with the blank before it.
        """
        heads, rests = [], []
        for text in texts:
            parts = bool(text) and " " in text and not WIDE.search(text) and not self.in_one_go(text)
            head, _, rest = text.partition(" ") if parts else (text, "", None)
            heads.append(self.encode(head))
            rests.append(rest)
        words = pc.split_pattern(pa.array(rests, pa.large_string()), " ")
        del rests
        known = words.flatten().dictionary_encode()
        starts = np.frombuffer(words.buffers()[1], np.int32 if pa.types.is_list(words.type) else np.int64, len(words) + 1).copy()
        del words  # of the texts' copies one at a time
        pieces, ends = [], [0]
        for word in known.dictionary.to_numpy(zero_copy_only=False):
            if word.isalpha():
                pieces.append(" " + word)
            else:
                pieces += PIECE.findall(" " + word)
            ends.append(len(pieces))
        made = pa.array(map(self._looked_up(set(pieces)).__getitem__, pieces), pa.large_binary())
        del pieces
        _, offsets, data = made.buffers()
        ends = np.frombuffer(offsets, np.int64, len(made) + 1)[ends]
        ids = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), data]).take(known.indices)
        _, offsets, data = ids.buffers()
        return heads, np.frombuffer(offsets, np.int64, len(ids) + 1)[starts].tolist(), memoryview(data or b"")

    def _looked_up(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids by piece: the cache's, those of new short ones that are one pre-token made beside each other."""
        cache, out, new = self.cache, {}, []
        for piece in pieces:
            if piece in cache or piece in cache.old:  # those of the old generation go to the new one
                out[piece] = cache[piece]
            elif self.merges and len(piece) <= LONGEST_CACHED and piece[piece[0] == " " :].isalpha():
                new.append(piece)
            else:
                out[piece] = cache[piece]
        if new:
            out.update(zip(new, self.merges.encode([p.encode() for p in new])))
            for piece in new:
                cache.put(piece, out[piece])
        return out


def encoder(path: str) -> Encoder:
    """One for each Python worker, until it works for another operator."""
    known = tables_of("tokens")
    if path not in known:
        known[path] = Encoder(path)
    return known[path]
