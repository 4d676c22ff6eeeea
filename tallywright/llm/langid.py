"""Language identification by cross-parsing entropy.

A bounded sample of labelled texts gives one suffix automaton per language. A text is parsed against each: from the
start of a phrase the automaton is followed as long as what was read occurs in the sample, which is the longest match,
and where it can't go on the next phrase begins. The language whose sample explains the text in the fewest phrases,
normalised by the sample's length, wins.

Texts are parsed whole, in lower case, letters only with one blank between words. The automata are tables, and many texts
advance through all of them together, one symbol a step, in numpy; the last ``FEW``, the longest, one after another. The samples'
``LETTERS`` most frequent letters are one symbol each, their other letters ``DIGITS`` symbols, and letters of no sample one that
no automaton reads.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; ties go to the language that comes first by
code point; without any labelled text all are ``und``; equal rows get equal results; an empty table gives no rows;
columns other than doc_id, text and (for learning) lang are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from .shared import ship, tables_of, tidied

FEW = 12
#: Symbols of texts that are parsed together.
CHUNK = 1 << 21
#: Rows whose texts are unpacked together.
TOGETHER = 2048
#: Symbols of a piece of a long text, and of its head, in which the true parse meets the piece's.
PIECE, HEAD = 1024, 32
UND = "und"
MADE = ("lang_pred", "lang_score", "lang_rate", "lang_letters")
FLAG = 1 << 30
#: Languages whose automata are one table at a time; letters of a language's sample that stay however many languages there are.
GROUP, LEAST_SAMPLE = 64, 2_500
#: Symbols: 0 is the blank, then the samples' most frequent letters, an unknown letter, and the digits of the other letters' numbers.
LETTERS, DIGITS, BASE = 96, 3, 32


def folded() -> np.ndarray:
    """For each code point of the basic plane its lower-case letter, or 0 for what is no letter."""
    out = np.zeros(1 << 16, "u4")
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


_FOLD: list[np.ndarray] = []


def letters(text: str) -> np.ndarray:
    """Code points of the text: lower-case letters, runs of anything else as one 0, none at either end."""
    if not _FOLD:
        _FOLD.append(folded())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    out = _FOLD[0][np.minimum(points, 0xFFFF)]
    if len(points) and points.max() > 0xFFFF:
        for p in np.unique(points[points > 0xFFFF]).tolist():
            low = chr(p).lower()
            out[points == p] = (ord(low) if len(low) == 1 else p) if chr(p).isalpha() else 0
    blank = out == 0
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    out = out[keep]
    return out[int(len(out) > 0 and out[0] == 0) : len(out) - int(len(out) > 1 and out[-1] == 0)]


def suffix_automaton(symbols: list[int]) -> list[tuple[int, int, int]]:
    """Edges (state, symbol, state) of the automaton that reads all substrings of symbols; state 0 is the start."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p != -1:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and go[p].get(c) == q:
                    go[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return [(s, c, t) for s, out in enumerate(go) for c, t in out.items()]


def edges_of(symbols: np.ndarray) -> np.ndarray:
    return np.array(suffix_automaton(symbols.tolist()), "i4")


def built(spark: SparkSession, symbols: list[np.ndarray]) -> list[np.ndarray]:
    """The automata's edges, each made in a task: their construction takes far more memory than they do."""
    ship(spark)
    rows = spark.createDataFrame([(i, bytearray(s.astype("u1").tobytes())) for i, s in enumerate(symbols)], "i int, symbols binary")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            made = [edges_of(np.frombuffer(s, "u1")).tobytes() for s in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["i", "edges"])

    found = rows.repartition(max(1, len(symbols)), "i").mapInArrow(tidied(run), "i int, edges binary").collect()
    return [np.frombuffer(r["edges"], "i4").reshape(-1, 3) for r in sorted(found, key=lambda r: r["i"])]


class Model:
    """Languages, the alphabet, and the automata's edges; small enough to go with the tasks' code."""

    def __init__(self, samples: dict[str, np.ndarray], build: Callable[[list[np.ndarray]], list[np.ndarray]] | None = None):
        """build makes the edges of the automata of several symbol arrays; without it they are made here."""
        self.langs = sorted(samples)
        counts = Counter(p for s in samples.values() for p in s.tolist() if p)
        ordered = [p for p, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]
        if len(ordered) > LETTERS + BASE**DIGITS:
            raise ValueError(f"more than {LETTERS + BASE**DIGITS} letters in the samples")
        self.known = np.array(sorted(ordered), "u4")
        own = {p: i for i, p in enumerate(ordered)}
        self.number = np.array([own[p] for p in self.known.tolist()], "i8")
        self.unknown = 1 + min(len(ordered), LETTERS)
        self.width = self.unknown + 1 + (DIGITS * BASE if len(ordered) > LETTERS else 0)
        self.lengths = [max(2, len(samples[x])) for x in self.langs]
        symbols = [self.symbols(samples[x]) for x in self.langs]
        self.edges = build(symbols) if build else [edges_of(s) for s in symbols]

    def symbols(self, points: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.where(points == 0, 0, self.unknown).astype("u1")
        at = np.minimum(np.searchsorted(self.known, points), len(self.known) - 1)
        number = np.where(self.known[at] == points, self.number[at], -1)
        out = np.where(points == 0, 0, np.where(number < 0, self.unknown, number + 1))
        if not (rare := number >= LETTERS).any():
            return out.astype("u1")
        times = np.where(rare, DIGITS, 1)
        out = np.repeat(out, times)
        first = (np.cumsum(times) - times)[rare]
        for d in range(DIGITS):
            out[first + d] = self.unknown + 1 + d * BASE + (number[rare] - LETTERS) // BASE**d % BASE
        return out.astype("u1")

    def table(self, group: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
        """Of a group of languages: next state for state + symbol, states being multiples of the width, with FLAG where a new phrase begins there; the start of each language."""
        width = self.width
        parts, starts, base = [], [], 0
        for edges in self.edges[group * GROUP : (group + 1) * GROUP]:
            states = int(edges[:, [0, 2]].max()) + 2  # the last one is where a symbol leads that not even the start can read
            root = np.full(width, (base + states - 1) * width, "i4")
            at_root = edges[edges[:, 0] == 0]
            root[at_root[:, 1]] = (base + at_root[:, 2]) * width
            t = np.tile(root | FLAG, (states, 1))
            t[edges[:, 0], edges[:, 1]] = (base + edges[:, 2]) * width
            parts.append(t.ravel())
            starts.append(base * width)
            base += states
        return np.concatenate(parts), np.array(starts, "i4"), width


def learn(labelled: DataFrame, docs_per_language: int = 64, chars_per_language: int = 20_000, most_chars: int = 160_000) -> Model:
    """A model of a bounded sample of (doc_id, text, lang).

    Every language that has a label; of each the docs_per_language documents with the smallest hash of their id, one sixteenth
    of the sample from each document at most, out of its first characters; chars_per_language letters, or an equal share of most_chars if that is less, but LEAST_SAMPLE.
    """
    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    langs = [r["lang"] for r in rows.select("lang").distinct().collect()]
    if not langs:
        return Model({})
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = rows.select("doc_id", "lang").withColumn("n", F.row_number().over(order)).where(F.col("n") <= docs_per_language)
    ids = F.broadcast(chosen.drop("n").distinct())  # at most docs_per_language rows a language
    texts: dict[str, list] = {}
    share = min(chars_per_language, max(LEAST_SAMPLE, most_chars // len(langs)))
    # of rows with one doc_id one text, and of it what can hold the letters that a document gives at most
    part = F.min(F.substring("text", 1, share)).alias("text")
    for r in rows.join(ids, ["doc_id", "lang"], "left_semi").groupBy("doc_id", "lang").agg(part).collect():
        texts.setdefault(r["lang"], []).append((zlib.crc32(str(r["doc_id"]).encode()), str(r["doc_id"]), r["text"]))
    samples = {}
    for lang, found in texts.items():
        parts, n = [], 0
        for _, _, text in sorted(found):
            part = letters(text)[: max(1, share // 16)]
            parts += [part, np.zeros(1, "u4")]
            n += len(part) + 1
            if n >= share:
                break
        sample = np.concatenate(parts)[:share]
        if sample.any():
            samples[lang] = sample
    return Model(samples, lambda symbols: built(labelled.sparkSession, symbols))


def unpacked(key: str, packed: bytes) -> Model:
    """One for each Python worker, until it works for another operator."""
    known = tables_of("langid")
    if known.get("model", ("",))[0] != key:
        known["model"] = key, pickle.loads(packed)
    return known["model"][1]


def phrases(model: Model, key: str, docs: list[np.ndarray]) -> np.ndarray:
    """Numbers of phrases of each language (rows) in each text's symbols (columns)."""
    return np.concatenate([group_phrases(model, key, g, docs) for g in range(-(-len(model.langs) // GROUP))])


def group_phrases(model: Model, key: str, group: int, docs: list[np.ndarray]) -> np.ndarray:
    known = tables_of("langid")
    if known.get("table", ("",))[0] != (own := f"{key}-{group}"):
        known.pop("table", None)  # one group's table at a time, however many languages
        known["table"] = own, model.table(group)
    table, starts, _ = known["table"][1]
    lengths = np.array([len(d) for d in docs], "i8")
    all_symbols = np.concatenate(docs) if docs else np.zeros(0, "u1")
    first = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    order = np.argsort(-lengths, kind="stable")
    begin, size = first[order], lengths[order]
    lanes, langs = len(order), len(starts)
    state = np.repeat(starts[:, None], lanes, 1)
    count = np.ones((langs, lanes), "i8")
    live = np.searchsorted(-size, -np.arange(1, (size[0] if lanes else 0) + 1), "right")
    done = 0
    for t, n in enumerate(live.tolist()):
        if n <= FEW:
            break
        v = table.take(state[:, :n] + all_symbols[begin[:n] + t].astype("i4"))
        if t:
            count[:, :n] += v >> 30
        state[:, :n] = v & (FLAG - 1)
        done = t + 1
    few = int(live[done]) if done < len(live) else 0
    if few:
        if not done:
            state[:, :few] = table.take(state[:, :few] + all_symbols[begin[:few]].astype("i4")) & (FLAG - 1)
            done = 1
        _long_lanes(table, starts, state[:, :few], count[:, :few], [all_symbols[b + done : b + n] for b, n in zip(begin[:few].tolist(), size[:few].tolist())])
    out = np.zeros((langs, len(docs)), "i8")
    out[:, order] = np.where(size > 0, count, 0)
    return out


def _long_lanes(table: np.ndarray, starts: np.ndarray, state: np.ndarray, count: np.ndarray, rests: list[np.ndarray]) -> None:
    """Adds the phrases of the rests of a few long texts to count.

    Pieces of PIECE symbols are parsed side by side, each as if a phrase began there. The true parse goes into a piece with
    another state and meets that of the piece within a few symbols; from there on they are one.
    """
    lanes = [lane for lane, r in enumerate(rests) for _ in range(len(r) // PIECE)]
    heads, ends = [], None
    if lanes:
        symbols = np.concatenate([r[: len(r) // PIECE * PIECE] for r in rests]).reshape(-1, PIECE).astype("i4")
        own, n = np.repeat(starts[:, None], len(lanes), 1), np.zeros((len(starts), len(lanes)), "i4")
        for t in range(PIECE):
            v = table.take(own + symbols[:, t])
            n += v >> 30
            own = v & (FLAG - 1)
            if t < HEAD:
                heads.append((own, n.astype("u1")))
        ends = own, n
    cells, piece = memoryview(table), 0
    for lane, rest in enumerate(rests):
        whole = len(rest) // PIECE
        for i in range(len(starts)):
            at, total = int(state[i, lane]), int(count[i, lane])
            for k in range(whole + 1):
                part = rest[k * PIECE : (k + 1) * PIECE]
                for t, c in enumerate(part.tolist() if k == whole else part[:HEAD].tolist()):
                    at = cells[at + c]
                    total += at >> 30
                    at &= FLAG - 1
                    if k < whole and at == heads[t][0][i, piece + k]:
                        total += int(ends[1][i, piece + k]) - int(heads[t][1][i, piece + k])
                        at = int(ends[0][i, piece + k])
                        break
                else:
                    for c in part[HEAD:].tolist() if k < whole else ():  # they never met
                        at = cells[at + c]
                        total += at >> 30
                        at &= FLAG - 1
            count[i, lane] = total
        piece += whole


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs, and lang_pred, lang_score, lang_rate (phrases of the best language for each letter or blank; null for ``und``), lang_letters."""
    ship(docs.sparkSession)
    packed = pickle.dumps(model)
    key = hashlib.sha1(packed).hexdigest()
    names = [c for c in docs.columns if c not in MADE]
    rows = docs.select(*[F.col(f"`{c}`") for c in names])
    schema = StructType([*rows.schema.fields, StructField("lang_pred", StringType()), StructField("lang_score", DoubleType()), StructField("lang_rate", DoubleType()), StructField("lang_letters", LongType())])

    def predict(texts: list[str | None]) -> tuple[list, list, list, list]:
        model = unpacked(key, packed)
        pred, score, rate, size = [UND] * len(texts), [0.0] * len(texts), [None] * len(texts), [0] * len(texts)
        bits = np.log2(np.array(model.lengths, "f8"))[:, None]

        def settle(at: list[int], symbols: list[np.ndarray]) -> None:
            found = phrases(model, key, symbols)
            cost = found * bits
            best = cost.argmin(0)
            share = (1 / cost).sum(0)
            for j, i in enumerate(at):
                b = best[j]
                pred[i], score[i] = model.langs[b], float(min(1.0, 1 / cost[b, j] / share[j]))
                rate[i] = float(found[b, j] / len(symbols[j]))

        at, symbols, n = [], [], 0
        for i, text in enumerate(texts):
            if not text or not model.langs:
                continue
            points = letters(text)
            if not len(points) or not points.any():
                continue
            at.append(i)
            size[i] = int(np.count_nonzero(points))
            symbols.append(model.symbols(points))
            n += len(points)
            if n >= CHUNK:
                settle(at, symbols)
                at, symbols, n = [], [], 0
        if at:
            settle(at, symbols)
        return pred, score, rate, size

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(at, TOGETHER)
                pred, score, rate, size = predict(batch.column("text").to_pylist())
                made = [pa.array(pred, "string"), pa.array(score, "float64"), pa.array(rate, "float64"), pa.array(size, "int64")]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *MADE])

    return rows.mapInArrow(tidied(run), schema)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def language_of(docs: DataFrame, **bounds: int) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rate; learns from the labelled documents that aren't held out."""
    model = learn(docs.where(~held_out(F.col("doc_id"))), **bounds)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rate").alias("rate"))

