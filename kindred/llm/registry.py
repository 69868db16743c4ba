"""Queries of this subpackage, by name: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, audio, bpe, common, html_extract, lang_id, near_dup, packing, pivot_index, quality, spelling, token_counts, toxicity, whitening
from .common import fold, materialize, table

THRESHOLD = 0.3


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Committed batches: provisional inserts, revisions to the tokenizers' counts, deletes of rows without
    text, a compaction, and the revisions once more, which a committed batch id ignores."""
    import public_tokenizers

    counters = {
        "byte_bpe_multi_50k": token_counts.byte_counter(tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN),
        "word_bpe_49k": token_counts.word_counter(tokenizer_file("word_bpe_49k.json")),
    }
    docs = table(spark, sf_dir, "documents").select("source", "lang", "text", "n_chars")
    exact = materialize(token_counts.counted(docs.withColumn("blank", F.coalesce(F.col("text"), F.lit("")) == ""), counters), "counted")
    rollup = token_counts.Rollup(spark, f"{common.shared_dir(spark)}/rollup-{common.uuid.uuid4().hex}")
    guess = F.ceil(F.coalesce(F.col("n_chars"), F.lit(0)) / 5)
    rollup.apply("0001", *[token_counts.inserted(exact, v, guess) for v in counters])
    revisions = [token_counts.revised(exact, v, guess, F.col("tokens")[v]) for v in counters]
    rollup.apply("0002", *revisions)
    rollup.apply("0003", *[token_counts.deleted(exact.filter("blank"), v, F.col("tokens")[v]) for v in counters])
    rollup.compact()
    rollup.apply("0002", *revisions)
    return rollup.totals()


def op2_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.media_digest(audio.store_texts(table(spark, sf_dir, "documents")))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def labelled(spark: SparkSession, sf_dir: str, modulus: int, held: int) -> DataFrame:
    return table(spark, sf_dir, "labels").filter(fold("doc_id", modulus) != held)


def _scored(scores: DataFrame, modulus: int, held: int) -> DataFrame:
    return scores.select("doc_id", (fold("doc_id", modulus) == held).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, labelled(spark, sf_dir, 5, 0))
    return _scored(quality.score(docs, model), 5, 0)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json")).drop("ids")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, labelled(spark, sf_dir, 4, 2))
    return _scored(toxicity.score(docs, model), 4, 2)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lang_id.fit(docs.filter(fold("doc_id", 4) != 2))
    out = lang_id.predict(docs, model)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op11_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.near_vectors(table(spark, sf_dir, "embeddings"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_audio_features, op3_html_extraction, op4_quality_classifier, op5_near_duplicates, op6_nearest_neighbours, op7_packing, op8_bpe, op9_toxicity, op10_language_id, op11_embedding_near_dup, op12_whitening, op13_spelling_variants)}


def _spelling_sql() -> str:
    """Checksums by a table made in SQL; edits on words whose accented letters are written as one byte each."""
    accented = "".join(map(chr, range(0xC0, 0x100)))
    plain = "".join(c for c in map(chr, range(33, 127)) if not c.islower() and c not in "'\\")[:64]
    capitals = "".join(map(chr, range(65, 91)))
    code = "list_transform(range(256), lambda x: list_reduce(range(8), lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384::bigint) ELSE c >> 1 END, x))"
    bytes_ = "flatten(list_transform(string_split(concat(doc_id, ':', run), ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::bigint] ELSE [195::bigint, unicode(c)::bigint - 64] END))"
    crc = f"xor(list_reduce({bytes_}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295::bigint)"
    near = " UNION ALL ".join(f"SELECT a.word AS word, a.n AS n, b.word AS other, b.n AS m FROM v a JOIN v b ON length(b.word) = length(a.word) + ({gap}) WHERE levenshtein(a.one, b.one) = 1" for gap in (-1, 0, 1))
    return f"""WITH RECURSIVE crc AS (SELECT {code} AS t),
    r AS (SELECT coalesce(doc_id::varchar, '') AS doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{capitals}', '{capitals.lower()}'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents) GROUP BY ALL),
    h AS (SELECT run, n, {crc} AS h FROM r, crc),
    w AS (SELECT CASE WHEN h % 97 = 0 THEN concat(left(run, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word, n FROM h),
    v AS (SELECT word, sum(n)::bigint AS n, translate(word, '{accented}', '{plain}') AS one FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
    p AS ({near}),
    f AS (SELECT word, count(*) AS n_near, min({{'m': -m, 'other': other}}) AS best FROM p GROUP BY word),
    a AS (SELECT v.word, CASE WHEN -best.m >= 2 * n THEN best.other END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 2 * n THEN -best.m END AS form_n FROM v LEFT JOIN f USING (word)),
    roots AS (SELECT word AS root, word FROM a WHERE form IS NULL UNION ALL SELECT root, a.word FROM roots JOIN a ON a.form = roots.word)
    SELECT a.word, form, root, n, n_near, form_n FROM a JOIN roots USING (word)""".replace("\\\\", "\\")


#: Public tokenizers, media, models and searches are beyond SQL: tests compare them with libraries and brute force.
ORACLES: dict[str, str] = {"op13_spelling_variants": _spelling_sql()}
