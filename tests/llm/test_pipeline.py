"""The pipeline's stages: their columns, their decisions, and packing's result against the documents that reach it."""

from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline as p
from tallywright.llm import langid, minhash
from tallywright.llm.queries import tokenizer_file

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    odd = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "1234 !!", "en", "s", 0)], docs.schema)
    before = {r.doc_id: r.text for r in docs.collect()}
    kept = p.language(spark, docs.unionByName(odd), SF)
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == set(before)
    cleaned = p.lines(spark, kept, SF).cache()
    assert cleaned.columns == columns
    for r in cleaned.collect():
        left = iter(before[r.doc_id].split("\n"))
        assert all(line in left for line in r.text.split("\n"))
    single = p.near_duplicates(spark, cleaned, SF).cache()
    groups = {r.doc_id: r.component_id for r in minhash.near_duplicates(cleaned).collect()}
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(groups.values()))
    mixed = p.mixture(spark, single, SF).cache()
    assert mixed.columns == columns
    texts = {r.doc_id: r.text for r in single.collect()}
    assert all(texts[r.doc_id] == r.text for r in mixed.collect())
    packed = p.sequences(spark, mixed, SF)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in mixed.collect()}
    assert langid.UND == "und" and p.ORACLE_SQL is None


def test_documents_of_a_similarity_of_four_fifths_are_near_duplicates(spark):
    long = " ".join(f"w{i}" for i in range(126))
    rows = [(1, " ".join(long.split()[:104])), (2, long), (3, " ".join(f"v{i}" for i in range(60)))]  # 100 of 122 shingles
    single = p.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert {r.doc_id for r in single.collect()} == {1, 3}


#: Columns that operators make themselves, as a caller's own.
CLASHING = "lang_pred string, lang_score string, lang_rate string, lang_letters string, size string, copies string, rate string, target string, source_size string, node string, key string, h1 string, _key_doc string, row string, kept string, line_no string, full string"


def odd_documents(spark):
    """Null and repeated ids, copies, near copies, equal lines, nulls, and columns with clashing names."""
    body = [" ".join(f"{w}{i}{'abcdefg'[(i * k) % 7]}" for i in range(70)) for k, w in enumerate(("the", "and", "of", "to", "in"), 1)]
    common = "a line that stands in many of the documents"
    texts = [body[0], body[0], body[0].replace("the3", "other", 1), f"{body[1]}\n{common}", f"{body[2]}\n{common}\n{common}x", f"{common}\n\n{common}", None, "", "1234", body[3] + "\n" + body[4], body[3] + "\n" + body[4]]
    n = len(CLASHING.split(","))
    rows = [(None if i in (1, 4) else 7 if i > 8 else i, t, "en", None if i % 3 else "s", 0, *["own"] * n) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING)


def similarity(a, b, sets):
    x, y = sets(a), sets(b)
    return len(x & y) / max(1, len(x | y))


def char_shingles(line):
    return {line[i : i + 8] for i in range(max(1, len(line) - 7))}


def word_shingles(text):
    ws = [w for w in re.findall(r"[^\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)}))]
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} or ({tuple(ws)} if ws else set())


def classes(items, linked):
    """The place of the first item of each item's component."""
    root = list(range(len(items)))
    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = sorted((find(root, i), find(root, j)))
                root[b] = a
    return [find(root, i) for i in range(len(items))]


def find(root, i):
    while root[i] != i:
        i = root[i]
    return i


def test_stages_on_odd_documents(spark):
    docs = odd_documents(spark)
    languages = p.language(spark, docs, SF)
    kept = languages.collect()
    assert languages.columns == docs.columns and languages.dtypes == docs.dtypes
    assert Counter(r.text for r in kept) == Counter(r.text for r in docs.collect() if r.text and re.search("[a-z]", r.text))

    cleaned = p.lines(spark, languages, SF)
    after = cleaned.collect()
    assert cleaned.dtypes == docs.dtypes
    # of equal rows one is looked at; each component of lines keeps one line in all
    rows = list({(r.doc_id, r.text): None for r in kept})
    full = [(i, k, line.lower().strip(" ")) for i, (_, text) in enumerate(rows) for k, line in enumerate(text.split("\n")) if line.strip()]
    of = classes([x[2] for x in full], lambda a, b: similarity(a, b, char_shingles) >= 0.8)
    left = [line for r in after for line in r.text.split("\n") if line.strip()]
    assert len(left) == len(set(of))
    assert {of[i] for i, x in enumerate(full) if x[2] in {y.lower().strip(" ") for y in left}} == set(of)
    texts = {text for _, text in rows}
    assert all(any(set(r.text.split("\n")) <= set(t.split("\n")) for t in texts) for r in after)

    single = p.near_duplicates(spark, cleaned, SF)
    found = single.collect()
    assert single.dtypes == docs.dtypes
    of = classes([r.text for r in after], lambda a, b: similarity(a, b, word_shingles) >= 0.8)
    assert len(found) == len({c for c, r in zip(of, after) if word_shingles(r.text)}) + sum(not word_shingles(r.text) for r in after)
    assert {r.text for r in found} <= {r.text for r in after}

    mixed = p.mixture(spark, single, SF)
    taken = Counter((r.doc_id, r.text) for r in mixed.collect())
    assert mixed.dtypes == docs.dtypes and max(taken.values()) <= 3 and set(taken) <= {(r.doc_id, r.text) for r in found}
    words_of = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    total = sum(words_of(r.text) for r in found)
    assert sum(words_of(t) * n for (_, t), n in taken.items()) >= 0.5 * total

    packed = p.sequences(spark, mixed, SF).collect()
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(tokenizer_file()).encode
    assert sum(r.length for r in packed) == sum((len(encode(t, add_special_tokens=False).ids) + 1) * n for (_, t), n in taken.items())
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter({d: sum(n for (x, _), n in taken.items() if x == d) for d, _ in taken})


def test_stages_on_an_empty_table(spark):
    docs = odd_documents(spark).limit(0)
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
    assert p.sequences(spark, docs, SF).count() == 0


def test_run(spark):
    rows = p.run(spark, SF).collect()
    assert rows and max(r.offset + r.length for r in rows) <= 1024
