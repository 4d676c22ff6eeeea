"""Prefix byte-pair encoding, whitening and the filter audit against the library, exact arithmetic and brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from fractions import Fraction
from itertools import permutations

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallywright.llm import bpe, filteraudit, queries, whitening
from tallywright.llm.queries import tokenizer_file

SF = "/root/testdata/sf0.001"
DOC = "ids string, doc_id long, text string, source string, lang string, mask string, rows int, part string"


@pytest.fixture(scope="module")
def docs(spark):
    """Odd rows, with columns named like results."""
    long = " ".join(f"word{i} The" for i in range(9000))
    texts = [None, "", " \n\t ", "One two # three", long, long, "ünï €\U0001f600 中文 " * 30, "ALL CAPS HERE", "x<|endoftext|>y <|endoftext|>", "a\x1cb\x85c  d'll !'s 12²", "q" * 5000, "clean words " * 40, " ".join(f"w{i}" for i in range(60))]
    rows = [("i", i, t, None if i % 4 == 0 else f"s{i % 3}", "en", "m", 1, "p") for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], ("i", None, long, "s1", None, None, None, None), ("i", None, "", "s1", None, None, None, None), ("i", 90, "clean words " * 40, "s2", None, None, None, None), ("i", -5, "", "", None, None, None, None)]
    rows += [("i", 1000 + i, "the same text in many rows", f"s{i % 2}", None, None, None, None) for i in range(300)]
    return spark.createDataFrame(rows, DOC).repartition(7).cache()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file())


@pytest.fixture(scope="module")
def coder():
    return bpe.PrefixCoder(bpe.vocabulary(tokenizer_file()), cached_pieces=40)


# -- byte-pair encoding


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=60) | st.text(alphabet=" \n\t'.,!_aB1²é中<|>\x1cethin", max_size=80), max_size=4))
def test_lanes_are_the_library(library, coder, texts):
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        ids = np.frombuffer(ids, "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert coder.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False) == text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aehinst", min_size=1, max_size=120) | st.sampled_from("a-= ").flatmap(lambda c: st.integers(1, 400).map(c.__mul__)))
def test_every_prefix_has_the_last_token_of_its_own_encoding(library, coder, text):
    last = coder.last_tokens(text.encode())
    byte = bpe._byte_letters()
    for end in range(1, len(text) + 1, 7):
        letters = "".join(byte[b] for b in text[:end].encode())
        assert last[end] == library.model.tokenize(letters)[-1].id
    (ids,) = coder.lanes([text.encode()])
    assert ids == coder.pre_token_ids(text.encode())


def test_a_pair_is_compatible_if_it_is_its_own_encoding(library, coder):
    r = np.random.default_rng(5)
    byte = bpe._byte_letters()
    texts = coder.v.texts
    own = [i for i in range(len(texts) - 1) if len(texts[i]) < 6]
    for a, b in r.choice(own, (4000, 2)).tolist():
        letters = "".join(byte[c] for c in texts[a] + texts[b])
        if all([t.id for t in library.model.tokenize("".join(byte[c] for c in texts[x]))] == [x] for x in (a, b)):
            assert coder.compatible(a, b) == ([t.id for t in library.model.tokenize(letters)] == [a, b])


def test_decoding_ids_that_are_no_text(library, coder):
    r = np.random.default_rng(6)
    for _ in range(300):
        ids = r.integers(0, 50257, 12).tolist()
        assert coder.decode(np.array([*ids, 999_999], "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_encoded_table(spark, docs, library):
    got = Counter((r.doc_id, bytes(r.ids), r.text) for r in bpe.decode(bpe.encode(docs, tokenizer_file()), tokenizer_file()).collect())
    assert got == Counter((r.doc_id, bytes(r.ids), r.text) for r in bpe.round_trip(docs, tokenizer_file()).collect())
    want = Counter()
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, np.array(ids, "<u4").tobytes(), r.text or ""] += 1
    assert got == want
    assert bpe.encode(docs.limit(0), tokenizer_file()).count() == 0
    plan = queries.op11_prefix_bpe(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "lang" not in plan


def test_query_gives_digests(spark, library):
    got = {r.doc_id: r for r in queries.op11_prefix_bpe(spark, SF).collect()}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert got.keys() == texts.keys()
    for d, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids
        digests = [hashlib.sha256(x).hexdigest() for x in (np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False).encode())]
        assert [got[d].n_tokens, got[d].ids_sha256, got[d].decoded_sha256] == [len(ids), *digests]


# -- whitening


def exact(rows: list[list[float]]) -> tuple[list[list[int]], list[list[int]], np.ndarray, list[int]]:
    xs = [[int(np.floor(64 * c)) + 1_000_000 for c in r] for r in rows]
    distinct = [list(x) for x in sorted(set(map(tuple, xs)))]
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    v = [[float(sum(Fraction(n * x[i] - sums[i], n) * Fraction(n * x[j] - sums[j], n) for x in distinct) / n) for j in range(len(sums))] for i in range(len(sums))]
    return xs, distinct, np.array(v), sums


def test_whitening_against_exact_arithmetic(spark):
    r = np.random.default_rng(1)
    good = [(i, [float(v) for v in r.normal(size=7) * [5, 3, 2, 1, 0.5, 0.1, 0.02] + 3], "z") for i in range(60)]
    odd = [(100, None, "z"), (101, [None] * 7, "z"), (102, [float("nan")] * 7, "z"), (103, [float("inf")] * 7, "z"), (104, [], "z"), (105, [1.0, 2.0], "z"), (None, good[3][1], "z"), (3, good[3][1], "z")]
    odd += [(200 + i, good[5][1], "z") for i in range(40)]
    data = spark.createDataFrame(good + odd, "vec_id long, embedding array<double>, component string").repartition(5)
    got = whitening.whitened(data).collect()
    kept = [(i, x) for i, x, _ in good + odd[6:]]
    xs, distinct, v, sums = exact([x for _, x in kept])
    n = len(distinct)
    assert Counter(r.vec_id for r in got) == Counter({i: 7 * k for i, k in Counter(i for i, _ in kept).items()})
    values = np.linalg.eigvalsh(v)[::-1]
    by_id = {i: x for (i, _), x in zip(kept, xs)}
    for row in got:
        x = by_id[row.vec_id]
        assert row.n == n and row.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums))
        assert row.explained == pytest.approx(values[row.component - 1] / np.trace(v), rel=1e-9)
        assert 0 <= row.identity_error < 1e-9
    fit_rows = np.array(distinct, float) - np.array(sums) / n
    _, vectors = np.linalg.eigh(v)
    for component in range(1, 8):
        direction = vectors[:, -component]
        want = {tuple(x): fit_rows[k] @ direction / np.sqrt(values[component - 1]) for k, x in enumerate(distinct)}
        pairs = [(row.whitened, want[tuple(by_id[row.vec_id])]) for row in got if row.component == component]
        sign = np.sign(sum(a * b for a, b in pairs))
        assert max(abs(a - sign * b) for a, b in pairs) < 1e-8


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(0, 2**32 - 1))
def test_rotations_find_all_eigenvectors(n, seed):
    r = np.random.default_rng(seed)
    m = r.normal(size=(n, n)) * 10.0 ** r.integers(-4, 5, n)
    a = m.T @ m
    values, vectors = whitening.jacobi(a)
    assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-12
    assert (np.diff(values) <= 0).all()
    assert np.abs(vectors * values @ vectors.T - a).max() <= 1e-12 * np.abs(a).max()


def test_rotations_keep_small_eigenvalues_accurate():
    scale = np.array([1e8, 1.0, 1e-8])
    core = np.array([[1, 0.3, 0.1], [0.3, 1, 0.2], [0.1, 0.2, 1]])
    values, _ = whitening.jacobi(core * np.outer(scale, scale))
    product = np.linalg.det(core)
    assert np.prod(values / scale**2) == pytest.approx(product, rel=1e-12)


def test_odd_whitenings(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whitened(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)], schema)
    assert {r.component for r in whitening.whitened(flat).collect()} == {1}


def test_far_values_are_exact_or_refused(spark):
    data = spark.createDataFrame([(i, [3e5 * (i % 5), 7.0 * i]) for i in range(40)], "vec_id long, embedding array<double>")
    xs, distinct, _, sums = exact([r.embedding for r in sorted(data.collect())])
    got = {r.vec_id: r.deviation for r in whitening.whitened(data).collect()}
    assert got == {i: sum((len(distinct) * a - s) ** 2 for a, s in zip(x, sums)) for i, x in enumerate(xs)}
    with pytest.raises(Exception, match="fit a long"):
        whitening.whitened(spark.createDataFrame([(i, [1e9 * i]) for i in range(40)], "vec_id long, embedding array<double>")).collect()


# -- filter audit


def brute_audit(rows, labels) -> dict:
    rows = [(r.doc_id, r.text or "", r.source or "") for r in rows]
    least: dict[str, int] = {}
    for d, t, _ in rows:
        if d is not None:
            least[t] = min(d, least.get(t, d))
    failing = []
    for d, t, part in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(ws) < 50, "B": 100 * len(set(ws)) < 65 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and d > least[t]}
        failing.append((part, d, {f for f in fails if fails[f]}))
    good, toxic = ({x[0] for x in labels if x[k] == 1 and x[0] is not None} for k in (1, 2))
    out = {}
    for order in map("".join, permutations("ABCDE")):
        for part in {r[2] for r in rows}:
            for k, f in enumerate(order):
                out[part, order, k + 1] = [0] * 7
        for part, d, fails in failing:
            gone = False
            for k, f in enumerate(order):
                c = out[part, order, k + 1]
                if f in fails:
                    c[3] += fails == {f}
                    if gone:
                        c[2] += 1
                    else:
                        c[1] += 1
                        c[4] += d in good
                        c[5] += d in toxic
                        gone = True
                elif not gone:
                    c[0] += 1
    shapley = Counter()
    for (part, order, step), c in out.items():
        shapley[part, order[step - 1]] += c[1]
    for (part, order, step), c in out.items():
        c[6] = shapley[part, order[step - 1]]
    return {k: tuple(v) for k, v in out.items()}


LABELS = [(1, 1, 0), (3, None, 1), (4, 1, 1), (4, 0, 0), (6, 0, None), (None, 1, 1), (90, 1, 0), (1007, 1, 1), (1008, 0, 1), (77777, 1, 1)]


def audited(df) -> dict:
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in df.collect()}


def test_audit_against_brute_force(spark, docs, monkeypatch):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    want = brute_audit(docs.collect(), LABELS)
    assert audited(filteraudit.audit(docs, labels)) == want
    monkeypatch.setattr(filteraudit, "HELD", 100)
    assert audited(filteraudit.audit(docs, labels)) == want
    assert audited(filteraudit.audit(docs, labels.limit(0))).keys() == want.keys()
    assert filteraudit.audit(docs.limit(0), labels).count() == 0


def test_colliding_fingerprints_keep_texts_apart():
    chains = filteraudit.Chains()
    assert chains.put(7, "a", {(5, "", 0): 1}) == {} and chains.put(7, "b", {(6, "", 0): 1}) == {}
    assert chains.put(7, "a", {(4, "", 2): 1}) == {(5, "", 16): 1}
    assert chains.put(7, "b", {(9, "", 1): 2}) == {(9, "", 17): 2}
    assert sorted((t, r) for _, t, rows in chains.release() for r in rows) == [("a", (4, "", 2)), ("b", (6, "", 0))]


def test_audit_query_equals_sql(spark):
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.op13_filter_audit(spark, SF)
    sql = c.sql(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLE_SQL['op13_filter_audit']})")
    assert sorted(map(tuple, df.collect())) == sorted(sql.fetchall())
