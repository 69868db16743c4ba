"""Sheets of workbooks, parsed by many tasks.

A workbook is a compressed archive, which one task has to unpack. That task does little more: it cuts the sheet behind
ends of rows into fragments of about a megabyte and adds to each the shared texts that its cells name. The fragments
are spread by range, so that rows stay in their order, and parsed by all tasks, a fragment at a time. The driver sees
the headers only, a row a column.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator, Sequence
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAGMENT = 1 << 20
_SHARED = re.compile(rb"""\bt=["']s["'][^>]*>\s*<(?:\w+:)?v[^>]*>\s*(\d+)""")
_OPEN = re.compile(rb"<((?:\w+:)?)worksheet\b[^>]*>")
FRAGMENTS = pa.schema([("file", pa.string()), ("fragment", pa.int64()), ("before", pa.int64()), ("first", pa.int64()), ("header", pa.list_(pa.string())), ("xml", pa.binary()), ("ids", pa.list_(pa.int32())), ("texts", pa.list_(pa.string()))])


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _sheet_part(z: zipfile.ZipFile, sheet: str | int) -> str:
    """The archive's member with a sheet, by name or by place from 1. A sheet that lacks raises ValueError."""
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    found = [s for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if local(s.tag) == "sheet"]
    for place, s in enumerate(found, 1):
        if sheet in (place, s.get("name")):
            target = next(targets[v] for k, v in s.attrib.items() if local(k) == "id" and k != "id")
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    raise ValueError(f"no sheet {sheet!r}; there are {[s.get('name') for s in found]}")


def _text(element) -> str:
    """The text of a shared or inline string: plain or of its runs, without reading aids."""
    runs = [t for part in element if local(part.tag) in ("t", "r") for t in ([part] if local(part.tag) == "t" else part) if local(t.tag) == "t"]
    return "".join(t.text or "" for t in runs)


def _shared_texts(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    out, root = [], None
    for event, element in ElementTree.iterparse(z.open("xl/sharedStrings.xml"), events=("start", "end")):
        root = element if root is None else root
        if event == "end" and local(element.tag) == "si":
            out.append(_text(element))
            root.clear()
    return out


def cells(xml: bytes, texts: dict[int, str], before: int) -> Iterator[tuple[int, list[tuple[str, bool] | None]]]:
    """(number in the sheet, cells as (text, whether it is text and no number), None for holes) of a fragment's rows."""
    number = before
    for row in ElementTree.fromstring(xml).iter():
        if local(row.tag) != "row":
            continue
        number = int(row.get("r") or number + 1)
        out: list[tuple[str, bool] | None] = []
        for cell in row:
            if local(cell.tag) != "c":
                continue
            at = 0
            for ch in re.match(r"[A-Z]*", cell.get("r") or "")[0]:
                at = at * 26 + ord(ch) - 64
            at = at - 1 if at else len(out)
            out += [None] * (at - len(out))
            kind = cell.get("t")
            parts = {local(p.tag): p for p in cell}
            if kind == "inlineStr":
                value = _text(parts["is"]) if "is" in parts else ""
            else:
                value = parts["v"].text or "" if "v" in parts else ""
                if kind == "s" and value:
                    value = texts[int(value)]
                elif kind not in ("str", "e", "b"):
                    value = re.sub(r"\.0$", "", value)
            out.append((value, kind in ("s", "str", "inlineStr")) if value else None)
        yield number, out


def fragments(data: bytes, sheet: str | int) -> Iterator[tuple[int, int, int, list[str], bytes, dict[int, str]]]:
    """(fragment, number of the row before it, number of the header's row, header, XML, shared texts) of one workbook."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = _shared_texts(z)
        stream = z.open(_sheet_part(z, sheet))
        held, root, row_end, k, before, header, first = b"", None, b"", 0, 0, None, 0
        while True:
            chunk = stream.read(FRAGMENT)
            held += chunk
            if root is None and (root := _OPEN.search(held)):
                row_end, row_start = b"</" + root[1] + b"row>", re.compile(rb"<" + root[1] + rb"row\b([^>]*)>")
                held = held[root.end() :]
            cut = held.rfind(row_end) + len(row_end) if root and row_end in held else 0
            if cut:
                body, held = held[:cut], held[cut:]
                begin = row_start.search(body)
                xml = root[0] + body[begin.start() :] + b"</" + root[1] + b"worksheet>"
                texts = {i: shared[i] for i in {int(m) for m in _SHARED.findall(body)}}
                if header is None:  # the first row with a cell
                    filled = next(((n, r) for n, r in cells(xml, texts, before) if any(r)), None)
                    if filled:
                        first, header = filled[0], names([c[0] if c else None for c in filled[1]])
                if header is not None:
                    yield k, before, first, header, xml, texts
                for m in row_start.finditer(body):
                    given = re.search(rb"""\br=["'](\d+)""", m[1])
                    before = int(given[1]) if given else before + 1
                k += 1
            if not chunk:
                return


def names(header: Iterable[str | None]) -> list[str]:
    """Names for all columns: those without one by their place, repeated ones with it."""
    out: list[str] = []
    for k, h in enumerate(header, 1):
        h = h or f"column_{k}"
        out.append(h if h not in out else f"{h}_{k}")
    return out


class Sheet:
    """One sheet of every workbook of a path, or of a table of workbooks (path, content). Columns are matched by the
    workbooks' own headers."""

    def __init__(self, spark: SparkSession, path: str | DataFrame, sheet: str | int = 1):
        self.spark, self.sheet = spark, sheet
        given = spark.read.format("binaryFile").load(path) if isinstance(path, str) else path
        self.books = given.select("path", "content")

        def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for file, content in books(batches):
                header = next(fragments(content, sheet), (0, 0, 0, []))[3]
                yield pa.RecordBatch.from_pydict({"file": pa.array([file], pa.string()), "header": pa.array([header], pa.list_(pa.string()))})

        seen = self.books.mapInArrow(heads, "file string, header array<string>").groupBy("header").agg(F.min("file").alias("file")).orderBy("file")
        self.headers = [r["header"] for r in seen.collect()]  # a row a layout
        self.columns = list(dict.fromkeys(name for header in self.headers for name in header))

    def _fragments(self, beside: DataFrame | None = None) -> DataFrame:
        """In order; with the columns of a table by ``file`` beside them."""
        sheet = self.sheet

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for file, content in books(batches):
                for k, before, first, header, xml, texts in fragments(content, sheet):
                    yield pa.RecordBatch.from_pylist([{"file": file, "fragment": k, "before": before, "first": first, "header": header, "xml": xml, "ids": list(texts), "texts": list(texts.values())}], schema=FRAGMENTS)

        cut = self.books.mapInArrow(unpack, "file string, fragment long, before long, first long, header array<string>, xml binary, ids array<int>, texts array<string>")
        cut = cut.join(beside, "file", "left") if beside is not None else cut
        return cut.repartitionByRange(self.spark.sparkContext.defaultParallelism, "file", "fragment").sortWithinPartitions("file", "fragment")

    def rows(self) -> DataFrame:
        """Text columns in the order of the workbooks and their rows, and ``_row``, counted from the header. Rows without
        any value are left out; a sheet without a header has none."""
        columns = self.columns
        schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in [*columns]) + (", " if columns else "") + "`_row` long"

        def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for header, rows, _ in parsed(batches):
                at = {n: k for k, n in enumerate(header)}
                found = [[r[at[n]][0] if n in at and at[n] < len(r) and r[at[n]] else None for _, r in rows] for n in columns]
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in found], pa.array([n for n, _ in rows], pa.int64())], names=[*columns, "_row"])

        return self._fragments().mapInArrow(parse, schema)

    def records(self, roles: Callable[[list[str]], dict[str, str]], wanted: Sequence[str], named: str) -> DataFrame:
        """A text column for each role that ``roles`` finds in a workbook's header, the other cells as specifications,
        and ``_row``. A workbook without the role ``named`` gives it to its first column with a cell that is text, else
        to its first: such workbooks are looked at twice."""
        beside = self._text_columns(roles, named) if any(named not in roles(h) for h in self.headers) else None
        schema = ", ".join(f"`{r}` string" for r in wanted) + ", specifications map<string,string>, `_row` long"

        def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for header, rows, text in parsed(batches):
                found = roles(header)
                found.setdefault(named, text or header[0])
                at = {n: k for k, n in enumerate(header)}
                get = lambda r, n: r[at[n]][0] if n in at and at[n] < len(r) and r[at[n]] else None
                columns = [pa.array([get(r, found.get(role)) for _, r in rows], pa.string()) for role in wanted]
                rest = [n for n in header if n not in found.values()]
                specs = [[(n, v) for n in rest if (v := get(r, n)) is not None] for _, r in rows]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(specs, pa.map_(pa.string(), pa.string())), pa.array([n for n, _ in rows], pa.int64())], names=[*wanted, "specifications", "_row"])

        return self._fragments(beside).mapInArrow(parse, schema)

    def _text_columns(self, roles: Callable[[list[str]], dict[str, str]], named: str) -> DataFrame:
        """file, text: the first column with a cell that is text, of workbooks without the role."""

        def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k, (header, rows, _) in enumerate(parsed([batch])):
                    places = [] if named in roles(header) else [i for _, r in rows for i, c in enumerate(r[: len(header)]) if c and c[1]]
                    if places:
                        yield pa.RecordBatch.from_pydict({"file": [batch.column("file")[k].as_py()], "at": pa.array([min(places)], pa.int64()), "text": [header[min(places)]]})

        return self._fragments().mapInArrow(kinds, "file string, at long, text string").groupBy("file").agg(F.min_by("text", "at").alias("text"))


def books(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.column("path")[k].as_py(), batch.column("content")[k].as_py()


def parsed(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[str], list[tuple[int, list]], str | None]]:
    """(header, rows below it that hold a value, first text column if one was looked for) of each fragment."""
    for batch in batches:
        for k in range(batch.num_rows):
            one = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
            rows = cells(one["xml"], dict(zip(one["ids"], one["texts"])), one["before"])
            yield one["header"], [(n - one["first"], r) for n, r in rows if n > one["first"] and any(r)], one.get("text")
