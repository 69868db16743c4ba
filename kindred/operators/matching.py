"""Matching: candidates, pair scores, threshold, rank, top-N; and the exact / fuzzy / hybrid strategies."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import extract, scores
from ..functions import text as T
from . import candidates, similarity, tiles
from .stored import large, stored


@dataclass(frozen=True)
class MatchConfig:
    threshold: float = 20.0
    top_n: int = 4
    candidates: int = 20
    model_shortcut: bool = True


def prepare_materials(materials: DataFrame) -> DataFrame:
    """What the live scorer needs of a material, normalized once a row."""
    col = F.col
    norm, described = T.fast_normalize(col("name")), T.fast_normalize(col("description"))
    words = F.when(T.text(col("description")) != "", described).otherwise(norm)
    brand = F.coalesce(F.nullif(T.text(col("manufacturer")), F.lit("")), T.text(col("brand"))) if "brand" in materials.columns else T.text(col("manufacturer"))
    return materials.select(
        col("id"), norm.alias("norm"), T.sorted_tokens(norm).alias("sorted"), words.alias("text_norm"), T.sorted_tokens(words).alias("text_sorted"),
        extract.model_codes(col("name")).alias("models"), T.text(col("equipment_code")).alias("code"), brand.alias("brand"),
    )


def prepare_items(items: DataFrame) -> DataFrame:
    col = F.col
    norm, described = T.fast_normalize(col("name")), T.fast_normalize(col("description"))
    return items.select(
        col("id"), norm.alias("norm"), T.sorted_tokens(norm).alias("sorted"), described.alias("description_norm"), T.sorted_tokens(described).alias("description_sorted"),
        F.array_union(extract.model_codes(col("name")), extract.model_codes(col("article"))).alias("models"), T.text(col("article")).alias("article"), T.text(col("brand")).alias("brand"),
    )


PAIR_COLUMNS = ("sim_name", "sim_description", "sim_article", "sim_brand", "pct")


def score_pairs(pairs: DataFrame, materials: DataFrame, items: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """The live scorer on (material_id, price_id) pairs of prepared rows; all pair columns are kept.

    Identical names score 100 and a shared model 95; only the other pairs go through the Python metric,
    so the shortcuts are separated by filters before it."""
    m = materials.select(*[F.col(c).alias(f"m_{c}") for c in materials.columns])
    p = items.select(*[F.col(c).alias(f"p_{c}") for c in items.columns])
    wide = pairs.join(large(m), F.col("material_id") == F.col("m_id")).join(large(p), F.col("price_id") == F.col("p_id"))
    ma, pa_ = (lambda c: F.col(f"m_{c}")), (lambda c: F.col(f"p_{c}"))
    same = scores.identical(ma, pa_)
    model = scores.same_model(ma, pa_) if cfg.model_shortcut else F.lit(False)
    kind = F.when(same, "same").when(model, "model").otherwise("score")
    wide = wide.withColumn("kind", kind)
    keep = pairs.columns
    quick = wide.filter("kind <> 'score'").select(
        *keep,
        F.when(F.col("kind") == "same", 100.0).otherwise(95.0).alias("sim_name"),
        F.when(F.col("kind") == "same", 100.0).otherwise(0.0).alias("sim_description"),
        F.lit(0.0).alias("sim_article"),
        F.when(F.col("kind") == "same", 100.0).otherwise(90.0).alias("sim_brand"),
        F.when(F.col("kind") == "same", 100.0).otherwise(95.0).alias("pct"),
    )
    sides = scores.text_sides(ma, pa_)
    slow = wide.filter("kind = 'score'").select(
        *keep, *[F.col(f"{s}_{c}") for s, cs in (("m", ("norm", "text_norm", "brand", "models")), ("p", ("norm", "description_norm", "brand", "article"))) for c in cs],
        scores.fast_text(*sides["name"]).alias("sim_name"), scores.fast_text(*sides["description"]).alias("sim_description"),
        scores.fast_article(ma, pa_, scores.fast_code(ma("code"), pa_("article"))).alias("sim_article"), scores.fast_brand(ma("brand"), pa_("brand")).alias("sim_brand"),
    )
    total = scores.fast_total(F.col("sim_name"), F.col("sim_description"), F.col("sim_article"), F.col("sim_brand"), ma, pa_)
    return quick.unionByName(slow.select(*keep, *PAIR_COLUMNS[:-1], total.alias("pct")))


def combined_score(pct: Column, retrieval: Column) -> Column:
    """70 % similarity, 30 % retrieval score, which is full from 10 on."""
    return 0.7 * pct + 30.0 * F.least(retrieval / 10, F.lit(1.0))


def top_matches(scored: DataFrame, cfg: MatchConfig = MatchConfig(), retrieval: str = "score", turn: str = "rank") -> DataFrame:
    """Rows at or over the threshold, the best ``top_n`` of each material by combined score; ties keep
    the retrieval order, then the smaller id."""
    kept = scored.filter(F.col("pct") >= cfg.threshold).withColumn("combined", combined_score(F.col("pct"), F.col(retrieval)))
    w = Window.partitionBy("material_id").orderBy(F.desc("combined"), turn, "price_id")
    return kept.withColumn("match_rank", F.row_number().over(w)).filter(F.col("match_rank") <= cfg.top_n)


def keyword_match(materials: DataFrame, items: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """Keyword candidates, live scores, top-N."""
    queries = materials.select(F.col("id").alias("material_id"), candidates.live_query_text(F.col("name"), F.col("equipment_code"), F.col("manufacturer")).alias("query"))
    found = candidates.keyword_topk(queries, items, cfg.candidates)
    return top_matches(score_pairs(found, prepare_materials(materials), prepare_items(items), cfg), cfg)


def search_match(materials: DataFrame, items: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """BM25 candidates, live scores, top-N."""
    queries = materials.select(F.col("id").alias("material_id"), candidates.live_query_text(F.col("name"), F.col("equipment_code"), F.col("manufacturer")).alias("query"))
    found = candidates.search(items, queries, cfg.candidates)
    return top_matches(score_pairs(found, prepare_materials(materials), prepare_items(items), cfg), cfg)


def block_match(materials: DataFrame, items: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """Every pair that shares a word, at or over the threshold, best first: no retrieval cut."""
    m, p = prepare_materials(materials), prepare_items(items)
    scored = tiles.shared_word_scores(m, p, cfg.threshold, cfg.model_shortcut)
    w = Window.partitionBy("material_id").orderBy(F.desc("pct"), "price_id")
    return scored.withColumn("match_rank", F.row_number().over(w))


Strategy = Callable[[DataFrame, DataFrame, MatchConfig], DataFrame]


def exact_strategy(materials: DataFrame, items: DataFrame, cfg: MatchConfig) -> DataFrame:
    """Pairs with a score of at least 95: same normalized name or shared model."""
    m, p = prepare_materials(materials), prepare_items(items)
    names = m.filter("norm <> ''").join(large(p.select(F.col("id").alias("price_id"), "norm")), "norm").select(F.col("id").alias("material_id"), "price_id")
    models = m.select(F.col("id").alias("material_id"), F.explode("models").alias("x")).join(large(p.select(F.col("id").alias("price_id"), F.explode("models").alias("x"))), "x").select("material_id", "price_id")
    pairs = names.unionByName(models) if cfg.model_shortcut else names
    return score_pairs(pairs.distinct(), m, p, cfg).filter("pct >= 95")


def exact_counts(materials: DataFrame, items: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """material_id, n, best of ``exact_strategy`` for the materials that have a hit, without a row for each pair: rows of equal
    name and models are one class with its size, classes meet at the least name or model that both have, and sizes are added up."""

    def classes(rows: DataFrame) -> DataFrame:
        models = F.col("models") if cfg.model_shortcut else F.array().cast("array<string>")
        name = F.when(F.col("norm") != "", F.array(F.struct(F.lit(0).alias("kind"), F.col("norm").alias("x")))).otherwise(F.array().cast("array<struct<kind:int,x:string>>"))
        of = F.transform(models, lambda m: F.struct(F.lit(1).alias("kind"), m.alias("x")))
        return rows.withColumn("keys", F.array_sort(F.array_distinct(F.concat(name, of))))

    m, p = classes(prepare_materials(materials)), classes(prepare_items(items))
    mine = stored(m.select("keys").distinct(), "keys").withColumn("key", F.explode("keys"))
    # of the items' keys only those that a material has tell classes apart
    each = p.groupBy("keys").agg(F.count("*").alias("n")).select("keys", "n", F.explode("keys").alias("key")).join(large(mine.select("key").distinct()), "key", "left_semi")
    theirs = each.groupBy("keys").agg(F.first("n").alias("n"), F.array_sort(F.collect_list("key")).alias("theirs"))
    sizes = theirs.groupBy("theirs").agg(F.sum("n").alias("n")).withColumn("key", F.explode("theirs"))
    # the name sorts before the models, so a pair of equal names meets there
    both = mine.join(large(sizes), "key").filter(F.col("key") == F.array_min(F.array_intersect("keys", "theirs")))
    best = F.max(F.when(F.col("key.kind") == 0, 100.0).otherwise(95.0))
    found = both.groupBy("keys").agg(F.sum("n").alias("n"), best.alias("best"))
    return m.select(F.col("id").alias("material_id"), "keys").join(large(found), "keys").select("material_id", "n", "best")


def fuzzy_strategy(materials: DataFrame, items: DataFrame, cfg: MatchConfig) -> DataFrame:
    return block_match(materials, items, cfg).drop("match_rank")


def hybrid_strategy(materials: DataFrame, items: DataFrame, cfg: MatchConfig) -> DataFrame:
    """Exact matches, and fuzzy ones of the materials that have none."""
    exact = exact_strategy(materials, items, cfg)
    rest = materials.join(large(exact.select(F.col("material_id").alias("id")).distinct()), "id", "left_anti")
    return exact.unionByName(fuzzy_strategy(rest, items, cfg))


def similar_strategy(materials: DataFrame, items: DataFrame, cfg: MatchConfig) -> DataFrame:
    """Pairs whose normalized names reach the threshold by LCS ratio, all of them, with or without a shared word;
    scored, and those at or over it kept."""
    m, p = prepare_materials(materials), prepare_items(items)
    pairs = similarity.similarity_join(m, p, max(1, round(cfg.threshold))).select("material_id", "price_id")
    return score_pairs(pairs, m, p, cfg).filter(F.col("pct") >= cfg.threshold)


STRATEGIES: dict[str, Strategy] = {"exact": exact_strategy, "fuzzy": fuzzy_strategy, "hybrid": hybrid_strategy, "similar": similar_strategy}


def register_strategy(name: str, strategy: Strategy) -> None:
    STRATEGIES[name] = strategy


def criteria_filter(df: DataFrame, criteria: dict[str, object]) -> DataFrame:
    """Rows that equal all criteria; an unknown column matches nothing."""
    out = df
    for name, value in criteria.items():
        out = out.filter(F.col(name) == F.lit(value)) if name in df.columns else out.filter(F.lit(False))
    return out
