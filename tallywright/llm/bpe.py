"""Exact byte-pair encoding by dynamic programming over prefixes, and decoding.

A suffix automaton of the whole vocabulary reads a pre-token byte by byte; its state after a prefix gives, along the suffix
links, all tokens that end there, longest first. Every prefix has one last token: the candidate that is compatible with
the last token of the prefix before it, that is, no merge across their border comes before those that make the two. The
back-pointers from the end then give the ids. Pre-tokens never interact: the new short ones of some texts advance side by
side, a byte at a time, in numpy; longer ones are worked on alone. A bounded cache holds the ids of short pieces of text.

The vocabulary's tables are made once on the driver and broadcast: their size is that of the tokenizer file, whatever
the input's. Texts are encoded where they are read; nothing is shuffled.

Edge cases: a null or empty text has no ids; a special token's name in a text is that token, as the library treats it by
default; a text of any length is encoded whole, in time linear in its length; repeated rows are encoded each; an empty table gives
no rows; columns other than doc_id and text are ignored. Ids that the vocabulary lacks are left out when decoding.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .hashing import PRIME
from .shared import ship
from .tokens import LONGEST_CACHED, ODD_SPACE, PIECE, _byte_letters

ENCODED, DECODED = "doc_id long, ids binary", "doc_id long, ids binary, text string"
NEVER = 1 << 60
#: Pre-tokens of more bytes are worked on alone; so many characters of texts are looked at together.
LANE, CHUNK = 48, 1 << 20
#: Pairs of tokens whose compatibility is kept, in powers of two; rows that are worked on together.
SLOTS, TOGETHER = 21, 512


def suffix_automaton(words: list[bytes]) -> tuple[list[dict[int, int]], list[int], list[int]]:
    """The automaton of all substrings of words: transitions, suffix links and greatest lengths by state; state 0 is the empty string."""
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]

    def state(n: int, to: dict[int, int], up: int) -> int:
        step.append(to)
        length.append(n)
        link.append(up)
        return len(step) - 1

    def parted(p: int, c: int) -> int:
        """The state of p's longest string followed by c, split off where c leads to longer strings too."""
        q = step[p][c]
        if length[q] == length[p] + 1:
            return q
        new = state(length[p] + 1, dict(step[q]), link[q])
        link[q] = new
        while p >= 0 and step[p].get(c) == q:
            step[p][c] = new
            p = link[p]
        return new

    for word in words:
        at = 0
        for c in word:
            if c in step[at]:
                at = parted(at, c)
                continue
            new, p = state(length[at] + 1, {}, 0), at
            while p >= 0 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p >= 0:
                link[new] = parted(p, c)
            at = new
    return step, link, length


@dataclass
class Vocabulary:
    """What encoding and decoding need, in arrays. Token numbers are ids."""

    texts: list[bytes]  #: bytes by id
    special: dict[str, int]  #: names that are tokens wherever they stand in a text
    parts: np.ndarray  #: the two tokens that make a token, -1 for single bytes
    rank: np.ndarray  #: of the merge that makes a token, -1 for single bytes
    moves: np.ndarray  #: state * 256 + byte, and the state it leads to
    link: np.ndarray
    length: np.ndarray
    token: np.ndarray  #: the token that is a state's longest string, or -1
    above: np.ndarray  #: the nearest state along the suffix links that has a token, or -1


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The tables of a tokenizer file of byte-level byte-pair encoding; refuses files whose rules are not just that."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        made_of = json.load(f)
    model, before = made_of["model"], made_of["pre_tokenizer"] or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not made_of["normalizer"]
    odd = [t["content"] for t in made_of["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
    if model["type"] != "BPE" or not plain or odd or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        raise ValueError(f"{path} is not plain byte-level byte-pair encoding")
    byte = {letter: b for b, letter in _byte_letters().items()}
    special = {t["content"]: t["id"] for t in made_of["added_tokens"]}
    ids: dict[str, int] = model["vocab"]
    texts = [b""] * (1 + max([*ids.values(), *special.values()]))
    for letters, i in ids.items():
        texts[i] = bytes(byte[c] for c in letters)
    for name, i in special.items():
        texts[i] = name.encode()
    parts, rank = np.full((len(texts), 2), -1, "i4"), np.full(len(texts), -1, "i4")
    for k, pair in enumerate(model["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        made = ids[a + b]
        if rank[made] >= 0 or max(rank[ids[a]], rank[ids[b]]) >= k:
            raise ValueError(f"{path}: a token is made twice, or before its parts")
        parts[made], rank[made] = (ids[a], ids[b]), k
    if any(b not in texts for b in map(bytes, zip(range(256)))):
        raise ValueError(f"{path}: a byte is no token")
    tokenize = Tokenizer.from_file(path).model.tokenize
    own = [i for letters, i in ids.items() if [t.id for t in tokenize(letters)] == [i]]  # the others never come out
    step, link, length = suffix_automaton([texts[i] for i in own])
    token = np.full(len(step), -1, "i4")
    for i in own:
        at = 0
        for c in texts[i]:
            at = step[at][c]
        token[at] = i
    above = np.full(len(step), -1, "i4")
    for s in np.argsort(length, kind="stable")[1:].tolist():
        above[s] = link[s] if token[link[s]] >= 0 else above[link[s]]
    moves = np.array(sorted((s * 256 + c, q) for s, to in enumerate(step) for c, q in to.items()), "i8").T.copy()
    return Vocabulary(texts, special, parts, rank, moves, np.array(link, "i4"), np.array(length, "i4"), token, above)


class PrefixCoder:
    """Encodes and decodes by a Vocabulary; one for each Python worker."""

    def __init__(self, v: Vocabulary, cached_pieces: int = 200_000):
        from tokenizers.pre_tokenizers import ByteLevel

        self.v, self.most = v, cached_pieces
        self.pre_tokens = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.names = re.compile("|".join(map(re.escape, sorted(v.special, key=len, reverse=True)))) if v.special else None
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.spines: tuple[dict[int, list[tuple[int, int]]], ...] = ({}, {})
        self.sizes = np.array([len(t) for t in v.texts], "i8")
        self.starts, self.blob = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(v.texts), "u1")
        self.slot_keys, self.slot_fits = np.full(1 << SLOTS, -1, "i8"), np.zeros(1 << SLOTS, bool)

    @cached_property
    def _tables(self) -> tuple:
        v = self.v
        merges = {(a, b): k for (a, b), k in zip(v.parts.tolist(), v.rank.tolist()) if k >= 0}
        return dict(zip(*v.moves.tolist())), v.link.tolist(), v.length.tolist(), v.token.tolist(), v.above.tolist(), merges

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens at one end of token while it is made, from the byte on, each with the rank of the merge that takes it in."""
        known = self.spines[side].get(token)
        if known is None:
            known, until, t = [], NEVER, token
            while t >= 0:
                known.append((t, until))
                until, t = int(self.v.rank[t]), int(self.v.parts[t, side])
            known.reverse()
            self.spines[side][token] = known
        return known

    def compatible(self, a: int, b: int) -> bool:
        """Whether a text of a and b is encoded as a and b: no merge over their border comes first.

        At every moment the token before the border and the one after it are on a's and b's spines. Of equal merges the one
        further left is first: one inside a goes before one over the border, and that before one inside b.
        """
        merges = self._tables[5]
        left, right = self._spine(a, 1), self._spine(b, 0)
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = left[i], right[j]
            k = merges.get((x, y), NEVER)
            if k < x_until and k <= y_until and k < NEVER:
                return False
            if x_until == y_until == NEVER:
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def _remembered(self, a: int, b: int) -> bool:
        if len(self.pairs) >= self.most:
            self.pairs.clear()
        fits = self.pairs[a, b] = self.compatible(a, b)
        return fits

    def last_tokens(self, text: bytes) -> list[int]:
        """The last token of every prefix of a pre-token, the empty one first (-1)."""
        moves, link, length, token, above, _ = self._tables
        pairs, remembered = self.pairs, self._remembered
        last = [-1]
        state = matched = 0
        for end, c in enumerate(text, 1):
            while (to := moves.get(state << 8 | c)) is None:  # every byte is a token, so the empty string has a move
                state = link[state]
                matched = length[state]
            state, matched = to, matched + 1
            at = state if token[state] >= 0 and matched == length[state] else above[state]
            while True:  # exactly one candidate fits
                t = token[at]
                before = last[end - length[at]]
                if before < 0 or (fits := pairs.get((before, t))) or (fits is None and remembered(before, t)):
                    last.append(t)
                    break
                at = above[at]
        return last

    def pre_token_ids(self, text: bytes) -> bytes:
        """The ids of one pre-token, from its end back."""
        last, size = self.last_tokens(text), self.v.texts
        ids, end = array("I"), len(text)
        while end:
            ids.append(last[end])
            end -= len(size[last[end]])
        ids.reverse()
        return ids.tobytes()

    def _fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """compatible() of many pairs, through a table that keeps one pair a slot."""
        keys = a.astype("i8") << 32 | b
        slots = (keys.astype("u8") * PRIME >> np.uint64(64 - SLOTS)).astype("i8")
        fits, new = self.slot_fits[slots], np.flatnonzero(self.slot_keys[slots] != keys)
        if len(new):
            own, at, back = np.unique(keys[new], return_index=True, return_inverse=True)
            found = np.fromiter((self.compatible(k >> 32, k & 0xFFFFFFFF) for k in own.tolist()), bool, len(own))
            fits[new] = found[back]
            self.slot_keys[slots[new[at]]], self.slot_fits[slots[new[at]]] = own, found
        return fits

    def lanes(self, words: list[bytes]) -> list[bytes]:
        """The ids of many pre-tokens: last_tokens() and the way back, a byte of all of them at a time."""
        v = self.v
        lengths = np.fromiter(map(len, words), "i8", len(words))
        order = np.argsort(-lengths, kind="stable")
        start, n = (np.cumsum(lengths) - lengths)[order], lengths[order]
        text = np.frombuffer(b"".join(words), "u1").astype("i8")
        last = np.full((len(words), int(n[0]) + 1), -1, "i4")
        state, matched = np.zeros(len(words), "i8"), np.zeros(len(words), "i8")
        for end in range(1, int(n[0]) + 1):
            k = int(np.searchsorted(-n, -end, "right"))
            c, at, m = text[start[:k] + end - 1], state[:k].copy(), matched[:k]
            to, todo = np.empty(k, "i8"), np.arange(k)
            while len(todo):
                keys = at[todo] << 8 | c[todo]
                place = np.minimum(np.searchsorted(v.moves[0], keys), v.moves.shape[1] - 1)
                there = v.moves[0][place] == keys
                to[todo[there]] = v.moves[1][place[there]]
                todo = todo[~there]
                at[todo] = v.link[at[todo]]
                m[todo] = v.length[at[todo]]
            m += 1
            state[:k] = to
            at = np.where((v.token[to] >= 0) & (m == v.length[to]), to, v.above[to])
            todo = np.arange(k)
            while len(todo):
                t, before = v.token[at[todo]], last[todo, end - v.length[at[todo]]]
                fits = before < 0
                pairs = np.flatnonzero(~fits)
                fits[pairs] = self._fits(before[pairs], t[pairs])
                last[todo[fits], end] = t[fits]
                todo = todo[~fits]
                at[todo] = v.above[at[todo]]
        ids, first, at, todo = np.empty_like(last), np.full(len(words), last.shape[1]), n.copy(), np.arange(len(words))
        while len(todo):
            t = last[todo, at[todo]]
            first[todo] -= 1
            ids[todo, first[todo]] = t
            at[todo] -= self.sizes[t]
            todo = todo[at[todo] > 0]
        out = [b""] * len(words)
        for i, k, row in zip(order.tolist(), first.tolist(), ids):
            out[i] = row[k:].tobytes()
        return out

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of pieces of text; those of short ones are kept."""
        parts = {p: [p.encode()] if p[p[0] == " " :].isalpha() else [p[a:b].encode() for _, (a, b) in self.pre_tokens(p)] for p in pieces}
        words = list({w for ws in parts.values() for w in ws})
        short = [w for w in words if len(w) <= LANE]
        ids = dict(zip(short, self.lanes(short))) if short else {}
        ids |= {w: self.pre_token_ids(w) for w in words if len(w) > LANE}
        made = {p: b"".join(map(ids.__getitem__, ws)) for p, ws in parts.items()}
        if len(self.pieces) >= self.most:
            self.older, self.pieces = self.pieces, {}
        self.pieces |= {p: i for p, i in made.items() if len(p) <= LONGEST_CACHED}
        return made

    def _split(self, text: str) -> Iterator[tuple[bytes, list[str]]]:
        """The ids of a special token, or none, and the pieces after it, in turn."""
        head, at = b"", 0
        for m in [*self.names.finditer(text), None] if self.names else [None]:
            part = text[at : m.start() if m else len(text)]
            yield head, ([part] if part else []) if any(c in part for c in ODD_SPACE) else PIECE.findall(part)
            if m:
                head, at = array("I", [self.v.special[m[0]]]).tobytes(), m.end()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers, of each text."""
        out: list[bytes] = []
        some, size = [], 0
        for i, text in enumerate(texts):
            some.append(list(self._split(text)) if text else [])
            size += len(text or "")
            if size < CHUNK and i + 1 < len(texts):
                continue
            wanted = {p for parts in some for _, ps in parts for p in ps}
            known = {p: ids for p in wanted if (ids := self.pieces.get(p) or self.older.get(p))}
            known |= self._learn(wanted - known.keys())
            out += [b"".join([x for head, ps in parts for x in (head, *map(known.__getitem__, ps))]) for parts in some]
            some, size = [], 0
        return out

    def decode(self, ids: bytes | None) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        numbers = np.frombuffer(ids or b"", "<u4").astype("i8")
        numbers = numbers[numbers < len(self.sizes)]
        size = self.sizes[numbers]
        places = np.repeat(self.starts[numbers] + size - np.cumsum(size), size) + np.arange(size.sum())
        return self.blob[places].tobytes().decode("utf-8", "replace")


_CODERS: dict[int, PrefixCoder] = {}


def _coder(shared) -> PrefixCoder:
    """This worker's coder of a broadcast vocabulary."""
    if id(shared.value) not in _CODERS:
        _CODERS.clear()
        _CODERS[id(shared.value)] = PrefixCoder(shared.value)
    return _CODERS[id(shared.value)]


def _mapped(rows: DataFrame, tokenizer_path: str, make: Callable[[PrefixCoder, list], list[pa.Array]], schema: str) -> DataFrame:
    """rows of doc_id and one more column, with what make makes of that one in its place, a few rows at a time."""
    spark = rows.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(vocabulary(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, names = _coder(shared), [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                b = batch.slice(at, TOGETHER)
                yield pa.RecordBatch.from_arrays([b.column(0), *make(coder, b.column(1).to_pylist())], names=names)

    return rows.mapInArrow(run, schema)


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers) of every row of docs."""
    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    return _mapped(rows, tokenizer_path, lambda coder, texts: [pa.array(coder.encode(texts), pa.binary())], ENCODED)


def _texts(coder: PrefixCoder, ids: list[bytes]) -> list[pa.Array]:
    return [pa.array(ids, pa.binary()), pa.array([coder.decode(i) for i in ids], pa.string())]


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids and the text that ids stand for, of every row of doc_id and ids."""
    return _mapped(encoded.select("doc_id", "ids"), tokenizer_path, _texts, DECODED)


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """decode(encode(docs)) in one pass: one Python worker a task does both."""
    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    return _mapped(rows, tokenizer_path, lambda coder, texts: _texts(coder, coder.encode(texts)), DECODED)
