"""Templates, axes, look-ups, and metrics compiled from their files."""

from __future__ import annotations

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallywright.functions import scalars, templates
from tallywright.operators import contracts
from tallywright.plans import metrics


def shown(spark, template, **values):
    return spark.range(1).select(templates.compiled(template, **{k: F.lit(v) for k, v in values.items()})).first()[0]


def test_templates(spark):
    assert shown(spark, "{a} was {r:.1%} over {n:,} ({n:d}), {x:.2f}, {x:,.1f} {{as is}}", a="NS-1", r=0.1765, n=12345, x=1234.565) == "NS-1 was 17.6% over 12,345 (12345), 1234.56, 1,234.6 {as is}"
    assert shown(spark, "plain") == "plain" and shown(spark, "") == ""
    assert shown(spark, "{r:.0%}{r:.0%}", r=0.125) == "12%12%"
    assert spark.range(1).select(templates.compiled("{a}/{b:.1%}", a=F.lit(None).cast("string"), b=F.lit(None).cast("double"))).first()[0] == "unknown/unknown"
    assert templates.fields("{a} {b:.1%} {a}") == ["a", "b", "a"]


@pytest.mark.parametrize("template", ["{b}", "{a.x}", "{a[0]}", "{}", "{0}", "{a!r}", "{a:>10}", "{a:.1e}", "{a:,.1%}", "{a:{b}}", "{a", "a}"])
def test_other_templates_are_refused(spark, template):
    with pytest.raises(ValueError):
        templates.compiled(template, a=F.lit(1))


@settings(max_examples=40, deadline=None)
@given(st.floats(-1e6, 1e6), st.floats(-1e6, 1e6))
def test_ticks_span_their_values(spark, a, b):
    a, b = round(a, 3), round(b, 3)
    ticks = spark.range(1).select(scalars.nice_ticks(F.lit(a), F.lit(b))).first()[0]
    low, high = min(a, b), max(a, b)
    if a == b:
        assert ticks == [a]
        return
    assert ticks[0] <= low + 1e-9 and ticks[-1] >= high - 1e-9 and 2 <= len(ticks) <= 12
    step = ticks[1] - ticks[0]
    lead = step / 10 ** math.floor(math.log10(step * (1 + 1e-9)))
    assert min(abs(lead - k) for k in (1, 2, 5)) < 1e-5


def test_ticks_of_what_is_unknown(spark):
    for a, b in ((None, 1.0), (1.0, None), (float("nan"), 1.0), (1.0, float("inf"))):
        assert spark.range(1).select(scalars.nice_ticks(F.lit(a).cast("double"), F.lit(b).cast("double"))).first()[0] is None


def test_scales_and_lookups(spark):
    one = lambda *c: spark.range(1).select(*c).first()
    assert one(scalars.linear_unscale(F.lit(15.0), 0.0, 200.0, 10.0, 20.0), scalars.linear_unscale(F.lit(15.0), 3.0, 200.0, 10.0, 10.0)) [:] == (100.0, 3.0)
    assert one(scalars.band_start(F.lit(0), 4, 100.0), scalars.band_start(F.lit(3), 4, 100.0), scalars.band_start(F.lit(1), 0, 10.0))[:] == (2.5, 77.5, 11.0)
    keys = ["a/b/abc.json.gz", "abc", "a/b/", "x.y/z"]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select(scalars.digest_of_key(F.col("k"))).collect()
    assert [r[0] for r in got] == ["abc", "abc", "", "z"]
    dims = F.create_map(F.lit("k"), F.lit("v"))
    assert one(scalars.lookup(dims, "k"), scalars.lookup(dims, "z"), scalars.required(dims, "k"))[:] == ("v", None, "v")
    with pytest.raises(Exception, match="dimension z is missing"):
        one(scalars.required(dims, "z"))


# -- metrics from files


def test_files_are_the_registry_and_nothing_has_drifted():
    registry = contracts.definitions()
    assert registry.metrics == metrics.REGISTRY.metrics
    assert contracts.drift(registry, contracts.DEFINITIONS / "generated") == []


def test_drift_is_found(tmp_path):
    registry = contracts.definitions()
    contracts.generate(registry, tmp_path)
    assert contracts.drift(registry, tmp_path) == []
    (tmp_path / "catalogue.json").write_text("[]")
    (tmp_path / "revenue_v1.sql").unlink()
    (tmp_path / "old.sql").write_text("")
    assert contracts.drift(registry, tmp_path) == ["catalogue.json", "old.sql", "revenue_v1.sql"]


def test_no_formula_in_the_catalogue():
    made = contracts.artefacts(contracts.definitions())
    assert "count_if" not in made["catalogue.json"] and "sum(" not in made["catalogue.json"]
    assert all(":organization" in text for name, text in made.items() if name.endswith(".sql"))


GOOD = "key: m\nversion: 1\nsource: s\ngrain: [a]\nmeasure_expression: sum(x)\nunit: count\n"


@pytest.mark.parametrize(
    ("text", "what"),
    [
        (GOOD + "colour: red\n", "colour"),
        (GOOD.replace("source: s\n", ""), "source"),
        (GOOD.replace("sum(x)", "sum(x); drop table y"), "single expression"),
        (GOOD.replace("version: 1", "version: one"), "version"),
        ("- a\n- b\n", "no definition"),
        ("key: [", "bad.yml"),
        (GOOD + "quality_tests: [fine]\n", "unknown tests"),
        ("key: !!python/object/apply:os.system [ls]\n", "bad.yml"),
    ],
)
def test_bad_files_are_named(tmp_path, text, what):
    (tmp_path / "bad.yml").write_text(text)
    with pytest.raises(ValueError, match="bad.yml") as e:
        contracts.definitions(tmp_path)
    assert what in str(e.value)


def test_one_version_is_live(tmp_path):
    (tmp_path / "a.yml").write_text(GOOD)
    (tmp_path / "b.yml").write_text(GOOD.replace("version: 1", "version: 2"))
    with pytest.raises(ValueError, match="exactly one version is live"):
        contracts.definitions(tmp_path)
    (tmp_path / "a.yml").write_text(GOOD + "valid_to: 2024-01-01\n")
    assert contracts.definitions(tmp_path).get("m").version == 2


def test_compiled_sql_is_the_query(spark):
    data = spark.createDataFrame([("1", "a", 3), ("1", "a", -5), ("1", "b", None), ("2", "a", 9)], "organization_id string, a string, x int")
    data.createOrReplaceTempView("s")
    m = contracts.metric_of({"key": "m", "version": 1, "source": "s", "grain": ["a"], "measure_expression": "sum(x)", "unit": "count", "quality_tests": ["not_null", "non_negative", "monotonic_non_decreasing"]})
    assert sorted(map(tuple, contracts.run(spark, contracts.query_sql(m), "1").collect())) == [("a", -2.0, 2), ("b", None, 1)]
    assert [contracts.run(spark, contracts.test_sql(m, t), "1").count() for t in m.tests] == [1, 1, 0]
    assert contracts.run(spark, contracts.query_sql(m), "' OR 1 = 1 --").count() == 0
    with pytest.raises(ValueError):
        contracts.run(spark, contracts.query_sql(m), "")
