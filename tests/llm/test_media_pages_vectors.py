"""Audio, HTML extraction and nearest neighbours."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kindred.llm import ann, audio, html_extract


def test_wave_round_trip():
    data = bytes(range(256)) * 3
    assert audio.read_wave(audio.write_wave(data, 8000)) == (8000, data)
    with pytest.raises(ValueError):
        audio.read_wave(b"nothing")


def test_texts_as_audio(spark):
    texts = [None, "", "ab", "é" * 300, "x" * 50_000, "ab"]
    df = spark.createDataFrame([(k, t, b"x") for k, t in enumerate(texts)], "doc_id long, text string, media binary")
    out = {r["doc_id"]: r for r in audio.media_digest(audio.store_texts(df)).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        assert out[k]["n_bytes"] == len(raw) and out[k]["payload_sha256"] == hashlib.sha256(padded).hexdigest()
        assert out[k]["media_sha256"] == hashlib.sha256(audio.write_wave(padded)).hexdigest()
    assert out[2]["feature"] == out[5]["feature"] and audio.media_digest(audio.store_texts(df.limit(0))).count() == 0


@pytest.mark.parametrize("source, target", [(16000, 8000), (8000, 16000), (11025, 8000), (16000, 11025), (12000, 8000), (8000, 8000)])
def test_resampling_keeps_a_tone(source, target):
    t = np.arange(source) / source
    y = audio.resample(np.sin(2 * np.pi * 440 * t).astype(np.float32), source, target)
    assert abs(len(y) - target) <= 1
    middle = slice(target // 10, -target // 10)
    want = np.sin(2 * np.pi * 440 * np.arange(len(y)) / target)
    shift = max(np.abs(np.correlate(y[middle][:2000], want[middle][:2000], "full"))) / 1000
    assert 0.9 < shift < 1.1 and np.argmax(np.abs(np.fft.rfft(y))) * target / len(y) == pytest.approx(440, abs=2)


def plain_features(samples, cfg, rate):
    """Frames, (first, end) of segments and band means, one output, frame and frequency at a time."""
    g = np.gcd(rate, cfg.rate)
    up, down, taps = cfg.rate // g, rate // g, cfg.taps
    x = (np.frombuffer(samples, np.uint8).astype(float) - 128) / 128
    cutoff, y = min(1.0, up / down), []
    n = 2 * taps * up
    h = [cutoff * np.sinc(cutoff * (k - (n - 1) / 2) / up) * np.hanning(n + 2)[k + 1] for k in range(n)]
    for i in range(-(-len(x) * up // down)):
        phase, at = (i * down) % up, (i * down) // up
        mine = [h[(2 * taps - 1 - k) * up + phase] for k in range(2 * taps)]
        y.append(sum(c * x[at + 1 - taps + k] for k, c in enumerate(mine) if 0 <= at + 1 - taps + k < len(x)) / sum(mine))
    y = np.array(y)
    frames = max(1, -(-(len(y) - cfg.frame) // cfg.hop) + 1)
    y = np.pad(y, (0, max(0, (frames - 1) * cfg.hop + cfg.frame - len(y))))
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = [700 * (10 ** (mel(cfg.rate / 2) * k / (cfg.mels + 1) / 2595) - 1) for k in range(cfg.mels + 2)]
    table, energy = np.zeros((frames, cfg.mels)), []
    for f in range(frames):
        w = y[f * cfg.hop : f * cfg.hop + cfg.frame] * np.hanning(cfg.frame)
        energy.append(10 * np.log10((w**2).sum() / cfg.frame + 1e-9))
        for b in range(cfg.mels):
            total = 0.0
            for k in range(cfg.fft // 2 + 1):
                hz = k * cfg.rate / cfg.fft
                tri = max(0.0, min((hz - edges[b]) / (edges[b + 1] - edges[b]), (edges[b + 2] - hz) / (edges[b + 2] - edges[b + 1])))
                if tri:
                    total += tri * abs((w * np.exp(-2j * np.pi * k * np.arange(cfg.frame) / cfg.fft)).sum()) ** 2
            table[f, b] = np.log(total + 1e-6)
    mean, dev, on, spans = np.mean(energy), np.std(energy), False, []
    for f, e in enumerate([*energy, -np.inf] if dev >= 1e-6 else []):
        if not on and e >= mean + cfg.high * dev:
            spans.append([f, f])
            on = True
        elif on and e < mean + cfg.low * dev:
            on = False
        if on:
            spans[-1][1] = f + 1
    live = [f for a, b in spans for f in range(a, b)]
    return table, [tuple(s) for s in spans], table[live].reshape(len(live), 4, -1).mean((0, 2)) if live else np.zeros(4)


def test_features_equal_a_plain_computation(spark):
    cfg = audio.AudioConfig()
    texts = ["", "Quiet words " * 40 + "~" * 900 + " and more" * 60 + "\u00fc" * 300, "ab c", "z" * 700]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r["feature"] for r in audio.media_digest(audio.store_texts(df)).collect()}
    for k, t in enumerate(texts):
        samples = audio.payload_of(t, 192)[1]
        table, spans, bands = plain_features(samples, cfg, audio.RATE)
        mel, found = audio.analyse(audio.write_wave(samples), cfg)
        assert np.allclose(mel, table, atol=2e-2) and found == spans
        said = dict(x.split("=") for x in out[k].split(";"))
        assert (int(said["frames"]), int(said["segments"]), int(said["active"])) == (len(table), len(spans), sum(b - a for a, b in spans))
        assert np.allclose([float(b) for b in said["bands"].split(",")], bands, atol=2e-2)


def test_segments_have_hysteresis():
    cfg = audio.AudioConfig(high=0.5, low=-0.5)
    energy = np.array([-60, -60, -20, -38, -20, -60, -60, -38, -60.0])
    assert audio.segments(energy, cfg) == [(2, 5)] and audio.segments(np.zeros(5), cfg) == []


def test_tensors_have_a_fixed_shape(spark):
    cfg = audio.AudioConfig()
    loud = bytes(np.where(np.arange(16_000) % 8000 < 2000, np.random.default_rng(0).integers(0, 256, 16_000), 128).astype(np.uint8))
    df = spark.createDataFrame([(1, audio.write_wave(loud)), (2, None)], "doc_id long, media binary")
    out = {r["doc_id"]: r for r in audio.audio_features(df).collect()}
    table = pa.ipc.open_stream(bytes(out[1]["tensors"])).read_all()
    assert table.schema.field("logmel").type == pa.fixed_shape_tensor(pa.float32(), [cfg.block, cfg.mels])
    assert out[1]["spans"] and table["start_us"][0].as_py() == out[1]["spans"][0]["start_us"]
    assert out[2]["n_frames"] == 0 and out[2]["spans"] == []


def page(body, n):
    return f"<html><head><title>t{n}</title><script>var a='<p>no</p>';</script></head><body><div class='top-menu'><a href=/>Home</a></div><div id=x1>Site wide words</div>{body}<div>Same foot on all</div><footer>&copy; me</footer></body></html>"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(k, f"https://Host.example/{k}", page(f"<div class=post><h1>Title {k}</h1><p>Body &amp; text\n {k}<p>Second&nbsp;part {k}<br>line<ul><li>one {k}<li>two</ul><form>in <input></form></div><div class='comments'><p>bad {k}</p></div>", k)) for k in range(6)]
    rows += [(10, "https://one.example/", "<article><header><h1>A</h1></header><p>B <script>x</script>b</article><aside>no</aside>"), (11, None, None), (12, "", ""), (13, "nonsense", "plain &lt;text&gt;"), (14, "u", "<p>" * 3000 + "deep"), (14, "u", "<p>" * 3000 + "deep")]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string").repartition(3)


def test_extraction(pages):
    out = {r["page_id"]: r for r in html_extract.extract_pages(pages).collect()}
    for k in range(6):
        assert out[k]["text"] == f"Title {k}\n\nBody & text {k}\n\nSecond part {k} line\n\none {k}", k  # the same item on all pages is template
    assert out[10]["text"] == "A\n\nB b" and out[11]["text"] == out[12]["text"] == "" and out[13]["text"] == "plain <text>"
    assert out[14]["text"] == "deep" and all(r["n_chars"] == len(r["text"]) for r in out.values())


def test_only_induction_removes_plain_blocks(spark, monkeypatch):
    """Constant blocks without a telling tag, class or place; joined by host and by broadcast."""
    rows = [(k, "http://h/", f"<div class=a{k}><div>Join our letter</div><p>Story {k}</p><div>All rights kept</div><p>More {k}</p></div>") for k in range(5)]
    rows += [(9, "http://alone/", "<div>Join our letter</div><p>x</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for most in (html_extract.BROADCAST, 0):
        monkeypatch.setattr(html_extract, "BROADCAST", most)
        for zones in (True, False):
            got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(df, zones=zones).collect()}
            assert got == {k: f"Story {k}\n\nMore {k}" for k in range(5)} | {9: "Join our letter\n\nx"}


def test_zones_and_regions():
    text = lambda x: html_extract.extract(x).split("\n\n")
    assert text("<div class='search-results'><p>my only text</p></div>") == ["my only text"]
    assert text("<h1>Head</h1><article><p>a</p></article><div>ad</div><article><p>b</p></article>") == ["Head", "a", "b"]
    assert text("<article><h2 id=discussion>D</h2><section id=related-work>r</section><div class=ad>x</div><div id=comments>y</div>z</article>") == ["D", "r", "z"]
    assert text("<nav>n</nav><p>a &lt;b&gt; <i>c</i>d<br>e</p><ul><li><a>l</a><li><a>m</a></ul>") == ["a <b> cd e"]


def test_deep_and_wide_pages_of_one_host(spark):
    deep = lambda k: "<div>" * 3000 + f"<p>deep {k}</p><i>{k}</i>" + "<b>x</b>" * k + "</div>" * 3000
    wide = lambda k: "".join(f"<p>{k} {i}</p>" if (i + k) % 7 else f"<p><i>{i}</i></p>" for i in range(3000 + k))
    rows = [(k, "http://d/", deep(k)) for k in range(3)] + [(10 + k, "http://w/", wide(k)) for k in range(2)] + [(20, "http://v/", "<p>a" * 100_000), (21, "http://v/", "<p>b" * 90_000 + "<i>" * 50_000)]
    out = {r["page_id"]: r for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[2]["text"] == "deep 2\n\n2xx" and out[20]["n_chars"] == 100_000 * 3 - 2 and out[10]["text"].count("\n\n") == 2999


def test_extraction_of_nothing(pages):
    assert html_extract.extract_pages(pages.limit(0)).count() == 0


def brute_weight(a, b):
    """Simple tree matching as it is defined, by recursion over all pairs of children."""
    if a[0] != b[0]:
        return 0
    best = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
    for i, x in enumerate(a[1]):
        for j, y in enumerate(b[1]):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + brute_weight(x, y))
    return 1 + best[-1][-1]


def test_tree_matching_is_the_best_mapping():
    rng = np.random.default_rng(0)

    def tree(depth):
        return (str(rng.choice(list("uvw"))), [tree(depth - 1) for _ in range(rng.integers(0, 5))] if depth else [])

    source = lambda t: f"<{t[0]}>{''.join(map(source, t[1]))}</{t[0]}>"
    for _ in range(60):
        a, b = ("html", [tree(3)]), ("html", [tree(3)])
        m = html_extract.Matcher()
        x, y = (m.number(html_extract.parse(source(t[1][0]))) for t in (a, b))
        pairs = m.align(x[0], y[0])
        assert len(pairs) == brute_weight(a, b) and all(p.tag == r.tag for p, r in pairs)
        assert len({p.index for p, _ in pairs}) == len({r.index for _, r in pairs}) == len(pairs)
        by_page = sorted((p.index, r.index) for p, r in pairs)
        assert [r for _, r in by_page] == sorted(r for _, r in by_page)  # keeps the order


def test_long_alignments_read_off_in_parts():
    rng = np.random.default_rng(1)
    m = html_extract.Matcher()
    for n, k in ((500, 300), (40, 700), (1, 50)):
        x, y = (tuple(m.number(html_extract.parse("".join(f"<{t}>" + f"</{t}>" for t in rng.choice(list("uvwxyz"), size))))[0].kids()) for size in (n, k))
        pairs = m._mid(tuple(c.shape for c in x), tuple(c.shape for c in y))
        best = [[0] * (k + 1) for _ in range(n + 1)]
        for i in range(n):
            for j in range(k):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + (x[i].tag == y[j].tag))
        assert len(pairs) == best[n][k] and all(x[i].tag == y[j].tag for i, j in pairs)


def exact(ids, x, k):
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        out[int(ids[q])] = ids[np.lexsort((ids, -s))[:k]].tolist()
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (3000, 16)).astype(np.float32)
    x[500:900] = x[500]  # copies of one vector
    ids = np.arange(3000)
    rows = [(int(i), v.tolist(), 1) for i, v in zip(ids, x)]
    odd = [(-1, None, 0), (-2, [0.0] * 16, 0), (-20, [float("nan")] + [1.0] * 15, 0), (-40, [None] + [1.0] * 15, 0), (-60, [1.0] * 3, 0), (-80, [float("inf")] * 16, 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, rank int").repartition(4)
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, cfg=ann.AnnConfig(list_size=150)).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = exact(ids, x.astype(float), 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert np.mean([len(set(got[q]) & set(v)) / 20 for q, v in want.items()]) >= 0.9
    assert got[500] == [i for i in range(501, 521)] and got[520] == list(range(500, 520))


def test_uneven_lists_still_give_k(spark):
    """A dense cloud takes nearly all lists; outliers' lists hold next to nothing. Parts are of a few rows."""
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(0, 0.01, (600, 4)), rng.normal(0, 50, (40, 4))]) + 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    cfg = ann.AnnConfig(list_size=8, part=7, probes=2, min_probes=1, probe_ratio=1.01, copies=1)
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, cfg=cfg).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 640, 20)) and all(len({i for i, _ in v}) == 20 for v in got.values())
    assert all(np.isclose(s, x[q] @ x[i]) for q, v in got.items() for i, s in v)


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (20, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in ann.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 2, 0.0)]
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
