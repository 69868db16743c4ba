"""Prices from a remote provider, asked by many tasks at a pace.

A provider is any object with ``quotes(codes)`` that returns what it knows: code to (price, currency). It is made in each
task by a function that is shipped there, so connections and keys never travel. Codes are dealt to ``tasks`` partitions
that own disjoint codes; each asks in batches of at most ``size``, waits ``pause`` seconds between batches and tries a
batch that fails ``tries`` times, waiting longer each time. So no more than ``tasks`` batches run at once, and a
code is asked once (again only where a task is run again). Write the result before using it twice."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Codes of a request, and seconds between two requests of a task.
BATCH, PAUSE = 50, 1.0
QUOTE = "code string, price double, currency string, known boolean, error string"


class Provider(Protocol):
    def quotes(self, codes: list[str]) -> Mapping[str, tuple[float | None, str | None]]: ...


class TableProvider:
    """Quotes from a table that fits in memory: a stand-in for tests and small lists. A large table is joined, see
    ``reports.refresh_prices``."""

    def __init__(self, rows: Mapping[str, tuple[float | None, str | None]]):
        self.rows = rows

    def quotes(self, codes: list[str]) -> dict[str, tuple[float | None, str | None]]:
        return {c: self.rows[c] for c in codes if c in self.rows}


def ask(provider: Provider, codes: list[str], tries: int, pause: float, wait: Callable[[float], None] = time.sleep) -> tuple[Mapping, str | None]:
    """The provider's answer, or nothing and the last error."""
    error = None
    for k in range(tries):
        if k:
            wait(pause * 2**k)
        try:
            return provider.quotes(codes), None
        except Exception as e:  # of any provider
            error = f"{type(e).__name__}: {e}"
    return {}, error


def fetch_quotes(codes: DataFrame, make: Callable[[], Provider], code: str = "code", size: int = BATCH, pause: float = PAUSE, tries: int = 3, tasks: int = 4) -> DataFrame:
    """code, price, currency, known, error of each distinct code that isn't blank. ``known`` is false where the provider
    has no such code or could not be asked; then ``error`` says why."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = None
        held: list[str] = []

        def request(some: list[str]) -> pa.RecordBatch:
            got, error = ask(provider, some, tries, pause)
            rows = [(c, *got.get(c, (None, None)), c in got, error) for c in some]
            types = (pa.string(), pa.float64(), pa.string(), pa.bool_(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=["code", "price", "currency", "known", "error"])

        first = True
        for batch in batches:
            held += batch.column(0).to_pylist()
            while len(held) >= size:
                provider = provider or make()
                if not first:
                    time.sleep(pause)
                first, some, held = False, held[:size], held[size:]
                yield request(some)
        if held:
            provider = provider or make()
            if not first:
                time.sleep(pause)
            yield request(held)

    trimmed = F.trim(F.col(code).cast("string"))
    return codes.select(trimmed.alias("code")).filter("code <> ''").distinct().repartition(tasks, "code").mapInArrow(run, QUOTE)


def refreshed(matches: DataFrame, code: str, make: Callable[[], Provider], **pace) -> DataFrame:
    """``matches`` with new price, currency, availability and shown price; a code that the provider doesn't know is
    'Не найден'."""
    from ..operators.reports import refresh_prices

    quotes = fetch_quotes(matches.select(F.col(code).alias("code")), make, **pace).filter("known").select("code", "price", F.lit(0).alias("seq"))
    return refresh_prices(matches, F.trim(F.col(code).cast("string")), quotes)
