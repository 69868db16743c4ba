"""A provider is asked once for each code, in batches, and failures are tried again."""

import os
from collections import Counter


from kindred.sources.prices import TableProvider, ask, fetch_quotes, refreshed

ROWS = {f"C{k}": (10.0 * k, "RUB") for k in range(0, 130, 2)} | {"C999": (None, "RUB")}


def logged(folder):
    class Logged(TableProvider):  # local, so that it travels to the workers
        def quotes(self, codes):
            with open(os.path.join(folder, f"{os.getpid()}"), "a") as log:
                log.write(" ".join(codes) + "\n")
            return super().quotes(codes)

    return Logged


def test_every_code_is_asked_once_in_batches(spark, tmp_path):
    folder, rows = str(tmp_path), ROWS
    make = logged(folder)
    codes = spark.createDataFrame([(f" C{k % 130} ",) for k in range(400)] + [("",), (None,), ("  ",)], "code string")
    got = {r["code"]: r for r in fetch_quotes(codes, lambda: make(rows), size=7, pause=0.0, tasks=3).collect()}
    asked = [line.split() for name in os.listdir(folder) for line in open(os.path.join(folder, name))]
    assert Counter(c for batch in asked for c in batch) == Counter({f"C{k}": 1 for k in range(130)}) and max(map(len, asked)) == 7
    assert all((r["known"], r["price"]) == ((True, ROWS[c][0]) if c in ROWS else (False, None)) and r["error"] is None for c, r in got.items())


def failing(times):
    class Failing:
        left = times

        def quotes(self, codes):
            self.left -= 1
            if self.left >= 0:
                raise ConnectionError("busy")
            return {c: (1.0, "RUB") for c in codes}

    return Failing


def test_a_failing_batch_is_tried_again_with_longer_waits():
    waits = []
    assert ask(failing(2)(), ["a"], 3, 0.5, waits.append) == ({"a": (1.0, "RUB")}, None) and waits == [1.0, 2.0]
    assert ask(failing(9)(), ["a"], 3, 0.5, waits.append) == ({}, "ConnectionError: busy")


def test_a_provider_that_is_down_leaves_codes_unknown(spark):
    got = fetch_quotes(spark.createDataFrame([("a",), ("b",)], "code string"), failing(99), pause=0.0, tries=2).collect()
    assert {(r["code"], r["known"], r["error"]) for r in got} == {("a", False, "ConnectionError: busy"), ("b", False, "ConnectionError: busy")}
    assert fetch_quotes(spark.createDataFrame([], "code string"), failing(99)).count() == 0


def test_refreshed_matches(spark):
    matches = spark.createDataFrame([("m1", "C4"), ("m2", "C5"), ("m3", " C0 "), ("m4", None), ("m5", "C999")], "material_id string, code_ string")
    rows = ROWS
    got = {r["material_id"]: (r["new_price"], r["availability"], r["shown_price"]) for r in refreshed(matches, "code_", lambda: TableProvider(rows), pause=0.0).collect()}
    assert got == {"m1": (40.0, "В наличии", "40.00"), "m2": (None, "Не найден", "-"), "m3": (0.0, "Нет цены", "-"), "m4": (None, "Не найден", "-"), "m5": (None, "Нет цены", "-")}
