"""Metric definitions as files: one definition is compiled to the query, to its quality tests and to the catalogue's entry.

What is generated lies beside the definitions and is checked against them, so neither can be changed alone. Every refusal names its file.
"""

from __future__ import annotations

import json
from dataclasses import fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .metric import Metric, Registry

DEFINITIONS = Path(__file__).resolve().parents[1] / "metrics"
#: Names in a file, and the metric's own.
NAMES = {"measure_expression": "measure", "allowed_filters": "filters", "quality_tests": "tests"}
#: What a file says besides, for people.
TOLD = ("name", "description")


def metric_of(raw: dict) -> Metric:
    given = {NAMES.get(k, k): tuple(v) if isinstance(v, list) else v for k, v in raw.items() if k not in TOLD}
    known = {f.name for f in fields(Metric)}
    if unknown := set(given) - known:
        raise ValueError(f"unknown names {sorted(unknown)}")
    if lacking := {"key", "version", "measure", "source", "grain"} - set(given):
        raise ValueError(f"{sorted(lacking)} are missing")
    if isinstance(given["version"], bool) or not isinstance(given["version"], int) or given["version"] < 1:
        raise ValueError("version is no positive number")
    return Metric(**given)


def definitions(folder: Path = DEFINITIONS) -> Registry:
    """The registry of all definitions, in the order of their files' names."""
    import yaml

    found = []
    for file in sorted(folder.glob("*.yml")):
        try:
            raw = yaml.safe_load(file.read_text(encoding="utf-8"))
            if not isinstance(raw, dict):
                raise ValueError("no definition")
            found.append(metric_of(raw))
        except (ValueError, TypeError, yaml.YAMLError) as e:
            raise ValueError(f"{file.name}: {e}") from e
    return Registry(found)


def query_sql(m: Metric) -> str:
    """The metric's query; the organization is a bound parameter, never text."""
    grain = ", ".join(m.grain)
    return f"SELECT {grain}, CAST({m.measure} AS DOUBLE) AS value, count(*) AS observations FROM {m.source} WHERE organization_id = :organization GROUP BY {grain}"


def test_sql(m: Metric, test: str) -> str:
    """Rows that break a test."""
    broken = {"not_null": "value IS NULL", "between_0_and_1": "value < 0 OR value > 1", "non_negative": "value < 0", "denominator_min_30": "observations < 30"}
    if test in broken:
        return f"SELECT * FROM ({query_sql(m)}) WHERE {broken[test]}"
    order, per = m.grain[-1], ", ".join(m.grain[:-1])
    before = f"lag(value) OVER ({f'PARTITION BY {per} ' if per else ''}ORDER BY {order})"
    return f"SELECT * EXCEPT (before) FROM (SELECT *, {before} AS before FROM ({query_sql(m)})) WHERE value < before"


def artefacts(registry: Registry) -> dict[str, str]:
    """What is generated, by file name: queries, tests, and the catalogue without any formula."""
    out = {}
    for m in registry.metrics.values():
        name = f"{m.key}_v{m.version}"
        out[f"{name}.sql"] = query_sql(m) + "\n"
        out |= {f"{name}_{t}.sql": test_sql(m, t) + "\n" for t in m.tests}
    entries = [{"metric_key": m.key, "version": m.version, "unit": m.unit, "grain": m.grain, "dimensions": m.dimensions, "tests": sorted(m.tests), "certified": m.certified, "query_hash": m.query_hash()} for m in registry.metrics.values()]
    out["catalogue.json"] = json.dumps(entries, indent=1) + "\n"
    return out


def generate(registry: Registry, folder: Path) -> None:
    folder.mkdir(parents=True, exist_ok=True)
    for name, text in artefacts(registry).items():
        (folder / name).write_text(text, encoding="utf-8")


def drift(registry: Registry, folder: Path) -> list[str]:
    """Generated files that aren't what the definitions give: changed, missing or left over."""
    made = artefacts(registry)
    there = {f.name: f.read_text(encoding="utf-8") for f in folder.glob("*") if f.is_file()}
    return sorted(n for n in made.keys() | there.keys() if made.get(n) != there.get(n))


def run(spark: SparkSession, sql: str, organization: str) -> DataFrame:
    if not organization:
        raise ValueError("a metric query without an organization is refused")
    return spark.sql(sql, args={"organization": organization})
