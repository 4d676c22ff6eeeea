"""A connector for interfaces that answer in pages, as a Python data source: ``spark.read.format("tallywright_pages")``, or readStream.

What the interface answered is recorded below a folder, one folder page=<key> with one JSON document for each page. Styles: ``page_number``
(keys from 1; the first page that is empty or not there ends the resource, and all after it are), ``cursor`` (from ``first`` on each page
names the next one; a cursor that comes again ends the resource) and ``single``. The driver only finds out which pages there
are; tasks read and parse them, ``pages_per_task`` at a time. A stream's offset is the number of pages read.

A record's identity is its ``id_field``, or the sha256 of its JSON with sorted keys. Items that are no objects are skipped; a
document without a list under ``records_path`` is an empty page.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "record_id string, page string, place int, payload string"
STYLES = ("page_number", "cursor", "single")


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def dig(value, path: str):
    """What lies under a dotted path of nested objects, or None."""
    for name in path.split(".") if path else ():
        if not isinstance(value, dict):
            return None
        value = value.get(name)
    return value


@dataclass
class Pages:
    """The recorded pages of one resource."""

    path: str
    style: str = "page_number"
    records_path: str = "data"
    cursor_path: str = "next"
    id_field: str = "id"

    def __post_init__(self) -> None:
        if self.style not in STYLES:
            raise ValueError(f"style {self.style!r} is none of {', '.join(STYLES)}")

    def document(self, key: str) -> dict | None:
        from pyarrow.fs import FileSelector, FileSystem

        fs, top = FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path.removeprefix('file:')}")
        found = sorted(f.path for f in fs.get_file_info(FileSelector(f"{top}/page={key}", allow_not_found=True)) if f.base_name[0] not in "._")
        if not found:
            return None
        with fs.open_input_stream(found[-1]) as f:
            value = json.loads(f.read() or b"null")
        return value if isinstance(value, dict) else {self.records_path: value}

    def items(self, key: str) -> list[dict]:
        """The records of a page, in order."""
        found = dig(self.document(key), self.records_path)
        return [x for x in found if isinstance(x, dict)] if isinstance(found, list) else []

    def keys(self, after: int = 0) -> list[str]:
        """The keys of the pages after the first ``after`` ones."""
        if self.style == "single":
            return ["1"][after:] if self.document("1") is not None else []
        if self.style == "page_number":
            return [str(n) for n in range(after + 1, self.last_number(after) + 1)]
        out, seen, key = [], set(), "first"
        while key and key not in seen:
            page = self.document(key)
            if page is None or not isinstance(dig(page, self.records_path), list):
                break
            out.append(key)
            seen.add(key)
            named = dig(page, self.cursor_path)
            key = str(named) if named else ""
        return out[after:]

    def last_number(self, known: int = 0) -> int:
        """The last page that isn't empty, by doubling steps and bisection."""
        low, step = known, 1
        while self.items(str(low + step)):
            low, step = low + step, 2 * step
        high = low + step
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self.items(str(middle)) else (low, middle)
        return low

    def records(self, key: str) -> list[tuple[str, str, int, str]]:
        out = []
        for place, item in enumerate(self.items(key)):
            text, natural = canonical(item), dig(item, self.id_field)
            identity = str(natural) if natural not in (None, "") else f"sha256:{hashlib.sha256(text.encode()).hexdigest()}"
            out.append((identity, key, place, text))
        return out


@dataclass
class Some(InputPartition):
    """Pages for one task."""

    keys: tuple[str, ...]


class _Reading:
    def __init__(self, pages: Pages, together: int):
        self.pages, self.together = pages, together

    def planned(self, keys: list[str]) -> list[Some]:
        return [Some(tuple(keys[i : i + self.together])) for i in range(0, len(keys), self.together)]

    def read(self, partition: Some) -> Iterator:
        import pyarrow as pa

        kinds = (pa.string(), pa.string(), pa.int32(), pa.string())
        for key in partition.keys:
            rows = self.pages.records(key)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["record_id", "page", "place", "payload"])


class PageReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Some]:
        return self.planned(self.pages.keys()) or [Some(())]


class PageStreamReader(_Reading, DataSourceStreamReader):
    """Offsets count pages; a page is read by the batch whose offsets it lies between, after a restart too."""

    def initialOffset(self) -> dict:
        return {"pages": 0}

    def latestOffset(self) -> dict:
        known = getattr(self, "known", 0)
        self.known = known + len(self.pages.keys(known))
        return {"pages": self.known}

    def partitions(self, start: dict, end: dict) -> list[Some]:
        return self.planned(self.pages.keys(start["pages"])[: end["pages"] - start["pages"]])

    def commit(self, end: dict) -> None:
        """Recorded pages stay where they are."""


class PagedSource(DataSource):
    """Options: path, style, records_path, cursor_path, id_field, pages_per_task."""

    @classmethod
    def name(cls) -> str:
        return "tallywright_pages"

    def schema(self) -> str:
        return SCHEMA

    def _made(self, kind: type):
        given = {k: self.options[k] for k in ("path", "style", "records_path", "cursor_path", "id_field") if k in self.options}
        if "path" not in given:
            raise ValueError("the option path is missing")
        return kind(Pages(**given), max(1, int(self.options.get("pages_per_task", 8))))

    def reader(self, schema: StructType) -> DataSourceReader:
        return self._made(PageReader)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return self._made(PageStreamReader)
