"""Records of one large JSON array, read by many tasks.

Spark cuts the file into byte ranges at closing braces, wherever they stand. A first pass says for each range how it
changes the state of a reader: whether it ends within a string, and how much deeper, either way it may have begun. From
these (a row a range) follows the state at every range's start, and a second pass counts the records that begin in
each. The last pass cuts the elements out and maps them at once, in one Python worker a task and a bounded part at a time. A
record that crosses ranges comes in pieces, which are put together by file; the rest never moves.

Nested keys are flattened to their last segment. Fields are mapped record by record: whole names first, then parts of
names, no key twice; keys that nothing takes become specifications. What is no object at the array's level, or no
JSON, is left out; a file whose first character is not a bracket has no records.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .records import ALIASES, number, resolve_aliases

_TOKEN = re.compile(r'\\.|["{\[\]]', re.S)
RANGE = "file string, start long"
#: What a task holds as Python objects at a time: rows, and their bytes.
ROWS, BYTES = 1000, 1 << 20
Records = Iterator[tuple[str, int, str]]  # file, position, text
Batches = Iterator[pa.RecordBatch]


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """file, start (of the range), value: what stands between closing braces, in order within a range."""
    return spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _rows(batches: Batches) -> Iterator[tuple]:
    """The rows in order, made a bounded part of a batch at a time."""
    for batch in batches:
        todo = [batch]
        while todo:
            part = todo.pop()
            if part.num_rows > 1 and (part.num_rows > ROWS or part.nbytes > BYTES):
                half = part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]
            else:
                yield from zip(*(c.to_pylist() for c in part.columns))


def _packed(rows: Iterator[tuple[int, tuple]], columns: dict[str, pa.DataType]) -> Batches:
    """Bounded batches of rows, each given behind its size."""
    part: list[tuple] = []
    held = 0
    made = lambda: pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*part), columns.values())], names=list(columns))
    for size, row in rows:
        part.append(row)
        held += size
        if len(part) >= ROWS or held >= BYTES:
            yield made()
            part, held = [], 0
    if part:
        yield made()


def _effect(batches: Batches) -> Batches:
    """file, start, turns (whether strings begin or end an odd number of times), outside, inside: the change of depth
    if the range begins outside or inside a string."""
    out: dict[tuple[str, int], list] = {}
    for file, start, value in _rows(batches):
        one = out.setdefault((file, start), [False, 0, 0])
        for m in _TOKEN.finditer(value + "}"):
            t = m[0]
            if t == '"':
                one[0] = not one[0]
            elif t in "{[]":
                one[2 if one[0] else 1] += -1 if t == "]" else 1
        one[2 if one[0] else 1] -= 1  # the closing brace behind the fragment
    yield from _packed(((0, (*k, *v)) for k, v in out.items()), {"file": pa.string(), "start": pa.int64(), "turns": pa.bool_(), "outside": pa.int64(), "inside": pa.int64()})


def _cut(batches: Batches, states: dict[tuple[str, int], tuple[bool, int]]) -> Iterator[tuple[str, int, int, str, str]]:
    """file, start, at (records that began in the range before), kind, record: whole ones, and the pieces of those that
    cross ranges: head, middle and tail."""
    here, text = None, []
    for file, start, value in _rows(batches):
        if (file, start) != here:
            if text:  # the range before ends within a record
                yield *here, at, "middle" if kind == "tail" else "head", "".join(text)
                text.clear()
            here, at = (file, start), 0
            inside, depth = states[here]
            kind = "tail" if depth > 1 else "whole"
        keep = 0 if depth > 1 else None  # where the open record's part of this fragment begins
        for m in _TOKEN.finditer(value + "}"):
            t = m[0]
            if t == '"':
                inside = not inside
            elif t in "{[]" and not inside:
                if t == "{" and depth == 1:
                    keep = m.start()
                depth += -1 if t == "]" else 1
        if not inside:
            depth -= 1
        if keep is not None:
            text.append(value[keep:] + "}")
            if depth == 1 and not inside:
                yield file, start, at, kind, "".join(text)
                text.clear()
                at += kind == "whole"
                kind = "whole"
    if text:
        yield *here, at, "middle" if kind == "tail" else "head", "".join(text)


def _states(effects: DataFrame) -> dict[tuple[str, int], tuple[bool, int]]:
    """Whether a range begins within a string, and how deep; one row a range comes to the driver."""
    states, last = {}, None
    for r in sorted(effects.collect(), key=lambda r: (r["file"], r["start"])):
        if r["file"] != last:
            last, inside, depth = r["file"], False, 0
        states[r["file"], r["start"]] = inside, depth
        depth += r["inside"] if inside else r["outside"]
        inside ^= r["turns"]
    return states


def _before(begun: DataFrame) -> dict[tuple[str, int], int]:
    """How many records of its file begin before each range in which some do; one row a range comes to the driver."""
    before, last = {}, None
    for r in sorted(begun.collect(), key=lambda r: (r["file"], r["start"])):
        total = 0 if r["file"] != last else total
        before[r["file"], r["start"]] = total
        last, total = r["file"], total + r["n"]
    return before


def _each(spark: SparkSession, path: str, make: Callable[[Records], Batches], schema: str) -> DataFrame:
    """What ``make`` makes of the objects in the arrays of one file or of a folder's files."""
    raw = _fragments(spark, path)
    states = spark.sparkContext.broadcast(_states(raw.mapInArrow(_effect, f"{RANGE}, turns boolean, outside long, inside long")))

    def begun(batches: Batches) -> Batches:
        n = Counter((file, start) for file, start, _, kind, _ in _cut(batches, states.value) if kind in ("whole", "head"))
        return _packed(((0, (*k, v)) for k, v in n.items()), {"file": pa.string(), "start": pa.int64(), "n": pa.int64()})

    before = spark.sparkContext.broadcast(_before(raw.mapInArrow(begun, f"{RANGE}, n long")))

    def whole(batches: Batches) -> Batches:
        return make((file, before.value[file, start] + at + 1, text) for file, start, at, kind, text in _cut(batches, states.value) if kind == "whole")

    def pieces(batches: Batches) -> Batches:
        cut = ((file, start, kind, before.value.get((file, start), 0) + at + 1, text) for file, start, at, kind, text in _cut(batches, states.value) if kind != "whole")
        return _packed(((len(p[-1]), p) for p in cut), {"file": pa.string(), "start": pa.int64(), "kind": pa.string(), "position": pa.int64(), "record": pa.string()})

    # at most two pieces a range: an end and a beginning
    parts = raw.mapInArrow(pieces, f"{RANGE}, kind string, position long, record string")
    order = F.when(F.col("kind") == "head", 1).otherwise(0)
    w = Window.partitionBy("file").orderBy("start", order)
    parts = parts.withColumn("turn", order).withColumn("one", F.sum((F.col("kind") == "head").cast("int")).over(w)).filter("one > 0")
    joined = parts.groupBy("file", "one").agg(F.array_sort(F.collect_list(F.struct("start", "turn", "position", "record"))).alias("p"), F.max((F.col("kind") == "tail").cast("int")).alias("closed"))
    joined = joined.filter("closed = 1").select("file", F.col("p")[0]["position"].alias("position"), F.array_join(F.col("p.record"), "").alias("record"))
    return raw.mapInArrow(whole, schema).unionByName(joined.mapInArrow(lambda batches: make(_rows(batches)), schema))


def array_elements(spark: SparkSession, path: str) -> DataFrame:
    """file, position (from 1), record (text) of the objects in the arrays of one file or of a folder's files."""
    columns = {"file": pa.string(), "position": pa.int64(), "record": pa.string()}
    return _each(spark, path, lambda records: _packed(((len(r[2]), r) for r in records), columns), "file string, position long, record string")


def flat(value: dict) -> dict[str, str]:
    """Leaves by the last segment of their keys, later ones over earlier; lists as JSON, no nulls."""
    out: dict[str, str] = {}
    for k, v in value.items():
        if isinstance(v, dict):
            out |= flat(v)
        elif v is not None:
            out[k] = v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    return out


_FIELDS = list(ALIASES)
_MAPPED = "file string, position long, " + ", ".join(f"`{f}` string" for f in _FIELDS) + ", specifications map<string,string>"


def _mapped(records: Records) -> Batches:
    """Batches of the records that are valid JSON, under the standard fields."""
    memo: dict[tuple[str, ...], tuple[dict[str, str], list[str]]] = {}

    def rows() -> Iterator[tuple[int, tuple]]:
        for file, position, text in records:
            try:
                record = flat(json.loads(text))
            except ValueError:
                continue
            keys = tuple(record)
            if keys not in memo:
                if len(memo) > 10_000:
                    memo.clear()
                memo[keys] = resolve_aliases(keys)
            mapping, rest = memo[keys]
            yield len(text), (file, position, *[record.get(mapping.get(f)) if f in mapping else None for f in _FIELDS], [(k, record[k]) for k in rest])

    return _packed(rows(), {"file": pa.string(), "position": pa.int64(), **{f: pa.string() for f in _FIELDS}, "specifications": pa.map_(pa.string(), pa.string())})


def mapped_records(elements: DataFrame) -> DataFrame:
    """file, position, the standard fields as text, and specifications (map) of each element that is valid JSON."""
    return elements.select("file", "position", "record").mapInArrow(lambda batches: _mapped(_rows(batches)), _MAPPED)


def price_list_from_json_array(spark: SparkSession, path: str) -> DataFrame:
    """A price list from one large array; records without a name are left out, an id that lacks is the position."""
    rows = _each(spark, path, _mapped, _MAPPED).filter(F.trim(F.coalesce("name", F.lit(""))) != "")
    known = {"id": F.coalesce("id", F.col("position").cast("string")), "price": number(F.col("price"), 0.0), "currency": F.coalesce("currency", F.lit("RUB"))}
    return rows.withColumns({k: v for k, v in known.items() if k in rows.columns}).drop("file", "position")
