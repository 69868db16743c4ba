"""Selections by table and by stream against a plain fold."""

import random

from kindred.streaming.selections import read_state, selection_stream, selections

SCHEMA = "material_id string, variant_id string, action string, ts timestamp, event_id long"


def log(n=400, seed=3):
    import datetime

    r = random.Random(seed)
    start = datetime.datetime(2024, 1, 1)
    out = []
    for k in range(n):
        action = r.choice(["select"] * 8 + ["reset", "other", None])
        material = None if action == "reset" and r.random() < 0.1 else f"m{r.randrange(25)}"
        # few distinct times: event ids decide between equal ones
        out.append((material, r.choice([None, "v1", "v2", "v3", "v4"]), action, start + datetime.timedelta(hours=r.randrange(60)), k))
    r.shuffle(out)
    return out + out[:50]


def fold(events, variants=None):
    chosen = {}
    for m, v, action, ts, i in sorted(set(events), key=lambda e: (e[3], e[4])):
        if action == "reset":
            chosen = {} if m is None else {k: x for k, x in chosen.items() if k != m}
        elif action == "select" and m is not None and v is not None and (variants is None or (m, v) in variants):
            chosen[m] = (v, ts)
    return sorted((m, v, ts) for m, (v, ts) in chosen.items())


def got(df):
    return sorted((r["material_id"], r["variant_id"], r["selected_at"]) for r in df.collect())


def test_table_equals_fold(spark):
    events = log()
    df = spark.createDataFrame(events, SCHEMA)
    assert fold(events) and got(selections(df)) == fold(events)
    variants = {(f"m{k}", f"v{k % 3 + 1}") for k in range(25)}
    assert got(selections(df, spark.createDataFrame(sorted(variants), "material_id string, variant_id string"))) == fold(events, variants)


def test_without_resets_of_all_and_without_events(spark):
    events = [e for e in log() if e[0] is not None]
    assert got(selections(spark.createDataFrame(events, SCHEMA))) == fold(events)
    assert got(selections(spark.createDataFrame([], SCHEMA))) == []


def test_stream_equals_table(spark, tmp_path):
    """Events come late and twice over several micro-batches."""
    events = log()
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for k in range(5):
        spark.createDataFrame(events[k::5], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        selection_stream(spark.readStream.schema(SCHEMA).parquet(folder), out, state).awaitTermination()
    assert got(read_state(spark.read.parquet(out))) == fold(events)
