"""Personal data: patterns, and a linear-chain conditional random field over word-shape features.

Patterns give the base spans (e-mail, IP address, card, phone). The field, trained on a small labelled table by its exact
gradient (forward-backward), labels every white-space token of every text, and adds the spans it finds beside the base
ones: numbers, addresses and names written in ways that no pattern lists. Features are hashes of a token's shape, its
lower-case form and a few counts, with the shapes and forms of its neighbours; all of a chunk of texts are computed
together in numpy, and Viterbi decoding steps through many windows of tokens at once. Windows of ``WINDOW`` tokens share a
margin with their neighbours, and only what lies inside the margins is taken from each, so texts of any length are decoded whole.

Edge cases: a null or empty text has no spans; spans count code points, ends exclusive; equal rows get equal results; an
empty table gives no rows; other columns pass through, and a column named ``pii`` is replaced.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .hashing import PRIME, mixed, slices_hash

KINDS = ("email", "ip", "card", "phone", "name")
BASE = KINDS[:4]
LABELS = ("O", *KINDS)
WINDOW, MARGIN = 192, 16
#: Code points that are worked on together.
CHUNK = 1 << 20
BUCKETS = 1 << 15
PII_TYPE = "array<struct<kind:string,start:int,end:int,base:boolean>>"

# -- patterns ---------------------------------------------------------------------------------------------------------

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
#: Every match of the number patterns lies inside one of these.
ZONE = re.compile(r"[0-9+][0-9 .()+-]*")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Each @ with what can stand before and after it; the same as leftmost matches of the pattern, in linear time."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and not NOT_LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, end := m.end()))
        end = max(end, at + 1) if not out or out[-1][1] <= at else end
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    ips, cards, phones = [], [], []
    for zone in ZONE.finditer(text):
        at, part = zone.start(), zone.group()
        if len(part) < 7:
            continue
        if part.count(".") >= 3:
            ips += [("ip", at + m.start(), at + m.end()) for m in IP.finditer(part) if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m.group().split("."))]
        if len(part) >= 13:
            for m in CARD.finditer(part):
                digits = m.group().replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    cards.append(("card", at + m.start(), at + m.end()))
        if "+" in part:
            phones += [("phone", at + m.start(), at + m.end()) for m in PHONE.finditer(part) if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return out + ips + cards + phones


# -- features ---------------------------------------------------------------------------------------------------------

SPACE, UPPER, LOWER, DIGIT, OTHER = 0, 1, 2, 3, 4
_TABLES: list[tuple[np.ndarray, np.ndarray]] = []


def tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point of the basic plane the class (ASCII marks have one each) and the lower-case letter."""
    if not _TABLES:
        kind, low = np.full(1 << 16, OTHER, "u1"), np.arange(1 << 16, dtype="u4")
        for i in range(1 << 16):
            c = chr(i)
            if c.isspace():
                kind[i] = SPACE
            elif c.isalpha():
                kind[i] = UPPER if c.isupper() else LOWER
                low[i] = ord(c.lower()[0])
            elif "0" <= c <= "9":
                kind[i] = DIGIT
            elif i < 128:
                kind[i] = 5 + i
        _TABLES.append((kind, low))
    return _TABLES[0]


def tokens(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each token of points (0 where there is none), and the classes of points."""
    kind = tables()[0][np.minimum(points, 0xFFFF)]
    word = np.concatenate(([False], kind != SPACE, [False]))
    edges = np.flatnonzero(word[1:] != word[:-1])
    return edges[::2], edges[1::2], kind


FEATURES = 8
#: What a name must be ahead by, in log odds: capital letters alone are common in clean text.
CAUTION = np.float32(3.0)
SALTS = np.arange(1, FEATURES + 1, dtype="u8") * PRIME


def features(points: np.ndarray, start: np.ndarray, end: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Buckets of each token's features (tokens x FEATURES); first: whether a token begins its text."""
    n = len(start)
    low = tables()[1][np.minimum(points, 0xFFFF)]
    digit = kind == DIGIT
    # a run of letters counts as one letter, digits are kept
    kept = np.ones(len(points), bool)
    kept[1:] = digit[1:] | (kind[1:] != kind[:-1])
    kept[start] = True
    at = np.concatenate(([0], np.cumsum(kept)))
    shape = slices_hash(kind[kept], at[start], at[end])
    form = slices_hash(np.where(digit, 48, low), start, end)
    digits = np.concatenate(([0], np.cumsum(digit)))
    n_digits = np.minimum(digits[end] - digits[start], 20)
    length = np.minimum(end - start, 31)
    letters = np.concatenate(([0], np.cumsum((kind == UPPER) | (kind == LOWER))))
    n_letters = np.minimum(letters[end] - letters[start], 3)
    before = lambda x: np.where(first, np.uint64(1), np.concatenate((x[:1], x[:-1])))
    last = np.concatenate((first[1:], [True]))
    after = lambda x: np.where(last, np.uint64(2), np.concatenate((x[1:], x[-1:])))
    count = (n_digits * 128 + length * 4 + n_letters).astype("u8")
    out = np.empty((n, FEATURES), "i4")
    for i, x in enumerate((shape, form, before(shape), after(shape), before(form), after(form), count, before(count) * np.uint64(4099) + n_digits.astype("u8"))):
        out[:, i] = mixed(x + SALTS[i]) % np.uint64(BUCKETS)
    return out


# -- the field --------------------------------------------------------------------------------------------------------


class Field:
    """weights: buckets x labels; moves: from label x to label."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def emissions(self, buckets: np.ndarray) -> np.ndarray:
        out = self.weights[buckets[:, 0]]
        for i in range(1, buckets.shape[1]):
            out += self.weights[buckets[:, i]]
        out[:, LABELS.index("name")] -= CAUTION
        return out

    def decode(self, emissions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Viterbi labels of tokens in sequences of the given lengths, one after another."""
        out = np.zeros(len(emissions), "u1")
        if not len(emissions):
            return out
        ends = np.cumsum(lengths)
        core = WINDOW - 2 * MARGIN
        windows = -(-lengths // core)
        owner = np.repeat(np.arange(len(lengths)), windows)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        base = ends[owner] - lengths[owner]
        take_from, take_to = k * core, np.minimum((k + 1) * core, lengths[owner])
        begin, stop = np.maximum(take_from - MARGIN, 0), np.minimum(take_to + MARGIN, lengths[owner])
        order = np.argsort(begin - stop, kind="stable")
        base, begin, stop, take_from, take_to = (x[order] for x in (base, begin, stop, take_from, take_to))
        size, at = stop - begin, base + begin
        steps = int(size[0])
        live = np.searchsorted(-size, -np.arange(1, steps + 1), "right")
        score = emissions[at]
        back = np.zeros((steps, len(at), len(LABELS)), "u1")
        rows = np.arange(len(at))
        for t in range(1, steps):
            n = live[t]
            paths = score[:n, :, None] + self.moves
            best = paths.argmax(1)
            back[t, :n] = best
            score[:n] = np.take_along_axis(paths, best[:, None, :], 1)[:, 0] + emissions[at[:n] + t]
        label = score.argmax(1)
        for t in range(steps - 1, -1, -1):
            n = live[t]
            inside = (begin[:n] + t >= take_from[:n]) & (begin[:n] + t < take_to[:n])
            out[(at[:n] + t)[inside]] = label[:n][inside]
            if t:
                label[:n] = back[t, rows[:n], label[:n]]
        return out


def train(labelled: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = 45, rate: float = 0.15, shrink: float = 1e-4) -> Field:
    """Maximum likelihood by Adam over (text, spans) rows; gradients by forward-backward over all rows at once."""
    steps = []
    rows = []
    for text, spans in labelled:
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        start, end, kind = tokens(points)
        if not len(start):
            continue
        first = np.zeros(len(start), bool)
        first[0] = True
        gold = np.zeros(len(start), int)
        for k, a, b in spans:
            gold[(start < b) & (end > a)] = LABELS.index(k)
        rows.append((features(points, start, end, kind, first), gold))
    longest, n, labels = max(len(g) for _, g in rows), len(rows), len(LABELS)
    x = np.zeros((n, longest, FEATURES), int)
    y = np.zeros((n, longest), int)
    real = np.zeros((n, longest), bool)
    for i, (f, g) in enumerate(rows):
        x[i, : len(g)], y[i, : len(g)], real[i, : len(g)] = f, g, True
    used, x = np.unique(x, return_inverse=True)
    x = x.reshape(n, longest, FEATURES)
    w, moves = np.zeros((len(used), labels)), np.zeros((labels, labels))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, moves)]
    for step in range(1, rounds + 1):
        e = w[x].sum(2)
        a = np.empty((n, longest, labels))
        b = np.zeros((n, longest, labels))
        a[:, 0] = e[:, 0]
        for t in range(1, longest):
            v = np.logaddexp.reduce(a[:, t - 1, :, None] + moves, 1) + e[:, t]
            a[:, t] = np.where(real[:, t, None], v, a[:, t - 1])
        for t in range(longest - 2, -1, -1):
            v = np.logaddexp.reduce(moves + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2)
            b[:, t] = np.where(real[:, t + 1, None], v, 0)
        total = np.logaddexp.reduce(a[:, -1], 1)
        p = np.exp(a + b - total[:, None, None]) * real[:, :, None]
        off = p - np.eye(labels)[y] * real[:, :, None]
        gw, gm = np.zeros_like(w), np.zeros_like(moves)
        for f in range(FEATURES):
            np.add.at(gw, x[:, :, f].ravel(), off.reshape(-1, labels))
        for t in range(1, longest):
            pair = np.exp(a[:, t - 1, :, None] + moves + (e[:, t] + b[:, t])[:, None, :] - total[:, None, None]) * real[:, t, None, None]
            gm += pair.sum(0)
            np.add.at(gm, (y[real[:, t], t - 1], y[real[:, t], t]), -1)
        for param, g, m in ((w, gw + shrink * n * w, moments[0]), (moves, gm, moments[1])):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            param -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
        steps.append(total.sum())
    weights = np.zeros((BUCKETS, labels), "f4")
    weights[used] = w
    return Field(weights, moves.astype("f4"))


def labelled_rows(n: int = 600, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The small labelled table: invented sentences with personal data in many spellings, and much that only looks like it."""
    r = random.Random(seed)
    parts = "an be cor de el fi ga ho in ja ka lu me no os pa qua ri sa ti un ve wo xi yo za che thi öl üb né ção".split()
    word = lambda: "".join(r.choice(parts) for _ in range(r.randint(1, 4)))
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    name = lambda: r.choice(("{} {}", "{} {}", "{}")).format(word().title(), word().title())

    def card() -> str:
        body = r.choice("3456") + digits(14)
        body += next(d for d in "0123456789" if luhn(body + d))
        return r.choice(("{}{}{}{}", "{} {} {} {}", "{}-{}-{}-{}", "{}.{}.{}.{}")).format(*[body[i : i + 4] for i in range(0, 16, 4)])

    def mail() -> str:
        user = r.choice(("{}.{}", "{}{}", "{}_{}")).format(word(), r.choice((word(), digits(2))))
        return user + r.choice(("@{}.{}", "@{}.{}", " at {} dot {}", " [at] {} [dot] {}", "(at){}.{}")).format(word(), r.choice(("com", "org", "example.com", "net")))

    def phone() -> str:
        return r.choice(("({0}) {1}-{2}", "{0}-{1}-{2}", "{0}.{1}.{2}", "+{3} {0} {1} {2}", "+{3} ({0}) {1}-{2}", "00{4} {0} {1}{2}", "1-{0}-{1}-{2}")).format(digits(3), digits(3), digits(4), r.choice("17"), r.choice(("49", "33", "34")))

    ip = lambda: r.choice((".", ".", ".", "[.]")).join(str(r.randint(0, 255)) for _ in range(4))

    def harmless() -> str:
        return r.choice((
            lambda: digits(r.randint(1, 5)), lambda: f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", lambda: f"v{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", lambda: f"{digits(2)}.{digits(2)}%",
            lambda: f"${digits(3)},{digits(3)}.{digits(2)}", lambda: f'"{r.getrandbits(128):032x}"', lambda: f"{digits(2)}:{digits(2)}", lambda: f"{word()}-{word()}", lambda: f"@{word()}", lambda: f"({word()})", lambda: f"{word()}.{word()}",
            lambda: f"#{digits(4)}", lambda: "|", lambda: word().upper() + "!!", lambda: f"{word()}/{word()}", lambda: f"{word()}_{digits(2)}", lambda: f"{digits(3)} {word()}", lambda: f"{digits(6)}", lambda: digits(r.randint(10, 17)), lambda: "$$$", lambda: "===", lambda: f"<{word()}>", lambda: f"{word().title()} {word().title()}",
        ))()

    makers = {"email": mail, "ip": ip, "card": card, "phone": phone, "name": name}
    cues = {"email": ("mail", "contact", "e-mail:", ""), "ip": ("host", "address", "from", ""), "card": ("card", "card:", "paid with", ""), "phone": ("call", "tel.", "phone:", ""), "name": ("Mr.", "Mrs.", "Dr.", "Ms.", "Prof.")}
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(6, 26)):
            dice = r.random()
            if dice < 0.1:
                kind = r.choice(KINDS)
                cue = r.choice(cues[kind])
                text += cue + " " * bool(cue)
                made = makers[kind]()
                spans.append((kind, len(text), len(text) + len(made)))
                text += made
            elif dice < 0.22:
                text += harmless()
            elif dice < 0.34:  # what cues look like, without anything after them
                text += r.choice((lambda: r.choice(parts).title() + ".", lambda: word().title() + ".", lambda: "at", lambda: "the", lambda: "dot", lambda: word() + ","))()
                text += r.choice((" ", "\n")) + (word().title() if r.random() < 0.7 else word())
            else:
                text += word().title() if r.random() < 0.15 else word()
            text += r.choice((" ", " ", " ", " ", ", ", ". ", ".\n"))
        out.append((text, spans))
    return out


def labelled_table(spark: SparkSession) -> DataFrame:
    """The labelled rows as a table: text, spans (array of kind, start, end)."""
    return spark.createDataFrame(labelled_rows(), "text string, spans array<struct<kind:string,start:int,end:int>>")


def fit(labelled: DataFrame, most_rows: int = 5000) -> Field:
    """A field trained on at most most_rows rows of (text, spans)."""
    rows = labelled.limit(most_rows).collect()
    return train([(r["text"], [tuple(s) for s in r["spans"]]) for r in rows])


TRIM_LEFT, TRIM_RIGHT = "\"'(<[{", "\"'.,;:!?>]}"
LEAST_DIGITS = {"ip": 4, "card": 13, "phone": 7}


#: What a span must hold whatever the field says.
PLAUSIBLE = {
    "email": lambda part: bool(re.search(r"@|[(\[]at[)\]]|\bat\b.+\bdot\b", part)),
    "ip": lambda part: all(int(x) <= 255 for x in re.findall(r"[0-9]{1,9}", part)),
    "card": lambda part: 13 <= len(re.sub(r"[^0-9]", "", part)) <= 19 and luhn(re.sub(r"[^0-9]", "", part)),
    "phone": lambda part: 7 <= len(re.sub(r"[^0-9]", "", part)) <= 15 and len(re.findall(r"[0-9]+", part)) >= 2,
    "name": lambda part: part[:1].isupper() and len(part.split()) <= 4 and not re.search(r"[0-9\n|]", part),
}


def added_spans(text: str, start: list[int], end: list[int], label: list[int], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Runs of equal labels as spans, without marks around them, beside the base spans of any kind."""
    out, i = [], 0
    while i < len(label):
        j = i
        while j + 1 < len(label) and label[j + 1] == label[i] and start[j + 1] - end[j] < 3:
            j += 1
        a, b, kind = start[i], end[j], LABELS[label[i]]
        i = j + 1
        while a < b and text[a] in TRIM_LEFT and not (kind == "phone" and text[a] == "("):
            a += 1
        while a < b and text[b - 1] in TRIM_RIGHT:
            b -= 1
        part = text[a:b]
        if sum("0" <= c <= "9" for c in part) < LEAST_DIGITS.get(kind, 0) or a >= b:
            continue
        if not PLAUSIBLE[kind](part):
            continue
        if not any(x < b and a < y for _, x, y in base):
            out.append((kind, a, b))
    return out


def find_in(texts: list[str | None], field: Field) -> list[list[dict]]:
    """The spans of each text, by kind as in KINDS, then by start."""
    out: list[list[dict]] = [[] for _ in texts]
    rank = {k: i for i, k in enumerate(KINDS)}

    def settle(chosen: list[int]) -> None:
        joined = "\n".join(texts[i] for i in chosen)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        start, end, kind = tokens(points)
        text_start = np.cumsum([0, *[len(texts[i]) + 1 for i in chosen]])
        first_token = np.searchsorted(start, text_start)
        lengths = np.diff(first_token)
        first = np.zeros(len(start) + 1, bool)
        first[first_token] = True
        labels = np.zeros(0, "u1")
        if len(start):
            labels = field.decode(field.emissions(features(points, start, end, kind, first[:-1])), lengths[lengths > 0])
        hits = np.flatnonzero(labels)
        per_text = np.searchsorted(hits, first_token)
        for j, i in enumerate(chosen):
            base = base_spans(texts[i])
            spans = [(*s, True) for s in base]
            h = hits[per_text[j] : per_text[j + 1]]
            if len(h):
                # gaps between hits end a span: neighbours in the list are neighbours in the text only if their tokens are
                groups = np.split(h, np.flatnonzero(np.diff(h) > 1) + 1)
                for g in groups:
                    spans += [(*s, False) for s in added_spans(texts[i], (start[g] - text_start[j]).tolist(), (end[g] - text_start[j]).tolist(), labels[g].tolist(), base)]
            out[i] = [{"kind": k, "start": a, "end": b, "base": is_base} for k, a, b, is_base in sorted(spans, key=lambda s: (rank[s[0]], s[1], s[2]))]

    chosen, n = [], 0
    for i, text in enumerate(texts):
        if text:
            chosen.append(i)
            n += len(text)
            if n >= CHUNK:
                settle(chosen)
                chosen, n = [], 0
    if chosen:
        settle(chosen)
    return out


def find(docs: DataFrame, field: Field) -> DataFrame:
    """All columns of docs but text, and pii: array of (kind, start, end, base)."""
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "pii"])
    kept = [i for i, c in enumerate(rows.columns) if c != "text"]
    schema = StructType([*[rows.schema.fields[i] for i in kept], *StructType.fromDDL(f"pii {PII_TYPE}").fields])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        for batch in batches:
            found = find_in(batch.column("text").to_pylist(), field)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], pa.array(found, kind)], names=[*[batch.schema.names[i] for i in kept], "pii"])

    return rows.mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, base_sha256, spans, n_added."""
    text = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("pii", lambda s: s["base"])
    count = lambda k: F.size(F.filter("pii", lambda s: s["base"] & (s["kind"] == k))).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("pii")).alias("spans"), (F.size("pii") - F.size(base)).cast("long").alias("n_added"))
