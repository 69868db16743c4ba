"""Cases that earlier rounds got wrong."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kindred.llm import ann, html_extract, token_counts
from kindred.llm.registry import tokenizer_file


@pytest.mark.parametrize(
    "html, text",
    [
        ("<article class='post has-comments'><p>body</p></article>", "body"),
        ("<article class='comment'><p>all there is</p></article>", "all there is"),
        ("<div class='content-with-sidebar'><p>the main text</p></div><div>teaser</div>", "the main text\n\nteaser"),
        ("<div class='post no-sidebar'><p>body</p></div>", "body"),
        ("<article><p class='legal'>a</p><div class='social-sciences'>b</div><div class='promo-code'>c</div></article>", "a\n\nb\n\nc"),
        ("<article><p>a</p><div class='ad-slot'>z</div><div class='ad'>z</div><p class='advert'>z</p></article>", "a"),
        ("<p>Intro</p><p><a href=1>One paper</a>, <a href=2>another paper</a></p><p>End</p>", "Intro\n\nOne paper, another paper\n\nEnd"),
        ("<article><p>x</p></article><section class='comments'><article class='comment'><p>c</p></article></section>", "x"),
    ],
)
def test_main_text_is_not_lost(html, text):
    assert html_extract.extract(html) == text


def wide(n, seed):
    r = random.Random(seed)
    return "".join("<div>" + "".join(r.choice(["<b>x</b>", "<i>y</i>", "<u>z</u>"]) for _ in range(8)) + "</div>" for _ in range(n))


def test_thousands_of_different_siblings():
    m = html_extract.Matcher()
    began = time.time()
    page, ref = m.number(html_extract.parse(wide(2000, 1))), m.reference(wide(2000, 2))
    pairs = m.align(page[0], ref[0])
    assert time.time() - began < 20 and len(m.memo) < 5000
    # a mapping: nobody twice, parents with parents, order kept
    assert len({p.index for p, _ in pairs}) == len({r.index for _, r in pairs}) == len(pairs)
    assert sorted(pairs, key=lambda x: x[0].index) == sorted(pairs, key=lambda x: x[1].index)
    assert sum(p.tag == "div" for p, _ in pairs) > 1900


def test_equal_children_are_anchors():
    kinds = ["<div>" + "<b>x</b>" * (k % 50 + 1) + "<i>y</i>" * (k // 50) + "</div>" for k in range(300)]
    m = html_extract.Matcher()
    page, ref = m.number(html_extract.parse("<u>new</u>" + "".join(kinds))), m.reference("".join(kinds[:150] + ["<div><s>odd</s></div>"] + kinds[150:]))
    tops = [(p, r) for p, r in m.align(page[0], ref[0]) if p in page[0].children]
    assert sum(p.shape == r.shape for p, r in tops) == 300


def test_counters_of_one_version_name_are_told_apart(spark):
    """The second call gets workers that hold the first one's counter."""
    import public_tokenizers

    docs = spark.createDataFrame([(k, f"some text of number {k} and its tokens") for k in range(40)], "id long, text string").repartition(4)
    pair = [token_counts.word_counter(tokenizer_file("word_bpe_49k.json")), token_counts.byte_counter(tokenizer_file("byte_bpe_multi_50k.tiktoken"), r"\p{L}"), token_counts.byte_counter(tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)]
    for counter in pair + pair:
        got = {r["id"]: r["tokens"]["v"] for r in token_counts.counted(docs, {"v": counter}).collect()}
        want = counter()(pa.array([f"some text of number {k} and its tokens" for k in range(40)]))
        assert [got[k] for k in range(40)] == np.asarray(want).tolist()


def test_ties_of_long_vectors_go_to_the_smaller_id(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8)) * 1e6
    # permuted coordinates: equal products with the all-equal query, in another order of additions
    rows = [(0, [1e6] * 8)] + [(k + 1, rng.permutation(x[k // 6]).tolist()) for k in range(60)]
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=20).collect())
    exact = sorted(((-float((np.array(v) * 1e6).sum()), i) for i, v in rows[1:]))[:20]
    assert len(got) == 20 and np.allclose([s for _, _, s in got], [-s for s, _ in exact], rtol=1e-12)
