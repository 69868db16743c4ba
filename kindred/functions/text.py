"""Text normalizers and analyzers as Column builders; no Python runs on the executors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Look-alike Latin letters and the Cyrillic ones that replace them.
HOMOGLYPHS = ("pPcCoOaAeEyYTHKMB", "рРсСоОаАеЕуУТНКМВ")
# The multi-algorithm scorer also maps x.
HOMOGLYPHS_WITH_X = ("xXpPcCoOaAeEyYTHKMB", "хХрРсСоОаАеЕуУТНКМВ")
# Unit spellings, applied in this order.
UNIT_RULES = (
    (r"(\d+)\s*[xх×]\s*(\d+(?:[.,]\d+)?)\s*(?:мм2?|мм²|кв\.?мм)", "$1x$2мм²"),
    (r"(\d+(?:[.,]\d+)?)\s*(?:мм2|кв\.?мм)", "$1мм²"),
    (r"(\d+(?:[.,]\d+)?)\s*(?:вт|ватт|w)", "$1вт"),
    (r"(\d+(?:[.,]\d+)?)\s*(?:а|ампер)", "$1а"),
    (r"(\d+(?:[.,]\d+)?)\s*(?:в|вольт)", "$1в"),
)
# Synonyms after both directions were entered and later entries replaced earlier ones.
SYNONYMS = {"led": "светодиодный", "светодиодный": "led", "автомат": "выключатель", "выключатель": "автомат", "мм2": "мм²", "кв.мм": "мм²", "квадратных": "мм²", "мм²": "квадратных", "вт": "w", "ватт": "w", "w": "ватт"}
# Unit spellings of the oldest normalizer.
UNIT_RULES_OLD = UNIT_RULES[:1] + ((r"(\d+(?:[.,]\d+)?)\s*(?:мм2?|мм²|кв\.?мм)", "$1мм²"),) + UNIT_RULES[2:] + ((r"с(\d+)", "c$1"),)
SYNONYMS_MULTI = {"led": "светодиодный", "светодиодный": "led", "автомат": "выключатель", "выключатель": "автомат", "мм2": "мм²", "кв.мм": "мм²", "мм²": "кв.мм", "вт": "w", "ватт": "w", "w": "ватт"}
# Word pairs whose order is made canonical.
WORD_ORDER = ("кабельный канал", "автоматический выключатель", "светодиодная лампа")
# Stop words of the semantic comparison, of the multi-algorithm tokens, and of the analyzer.
STOP_SEMANTIC = ("для", "и", "с", "на", "в", "к", "от", "до", "по", "за", "при")
STOP_MULTI = STOP_SEMANTIC + ("или", "но", "а", "что", "как", "это", "все", "еще")
PROTECTED = ("led", "лед", "автомат", "кабель", "провод")


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def squeeze(c: Column) -> Column:
    """One space between words, none around: what splitting on white space and joining gives."""
    return F.trim(F.regexp_replace(c, r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}]+", " "))


def words(c: Column) -> Column:
    """White-space words in order, duplicates kept."""
    return F.filter(F.split(squeeze(text(c)), " "), lambda w: w != "")


def base_normalize(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(text(c)), r"[^\p{L}\p{N}_\s]", " "))


def index_normalize(c: Column) -> Column:
    """Letters of two alphabets, digits and blanks; lower case; other letters become blanks."""
    kept = F.lower(F.regexp_replace(text(c), r"[^a-zA-Zа-яА-Я0-9\s]", " "))
    return F.trim(kept)


def fast_normalize(c: Column) -> Column:
    out = F.translate(F.lower(text(c)), ",х×", ".xx")
    out = F.replace(F.replace(out, F.lit("мм2"), F.lit("мм²")), F.lit("кв.мм"), F.lit("мм²"))
    return squeeze(out)


def fold_homoglyphs(c: Column, table: tuple[str, str] = HOMOGLYPHS) -> Column:
    return F.translate(text(c), *table)


def normalize_units(c: Column, rules: tuple[tuple[str, str], ...] = UNIT_RULES) -> Column:
    return reduce(lambda x, rule: F.regexp_replace(x, "(?iu)" + rule[0], rule[1]), rules, text(c))


def canonical_order(c: Column) -> Column:
    """The first known pair that stands in the other order, or in either, is written canonically; the
    scan goes by position, then by the table, and stops at the first pair."""
    w = F.split(c, " ")
    keys = [tuple(p.split(" ")) for p in WORD_ORDER]

    def pair_at(i: Column) -> Column:
        a, b = F.get(w, i), F.get(w, i + 1)
        out = F.lit(None).cast("string")
        for (x, y), joined in zip(keys, WORD_ORDER):
            out = F.coalesce(out, F.when(((a == x) & (b == y)) | ((a == y) & (b == x)), F.lit(joined)))
        return out

    spots = F.filter(F.sequence(F.lit(0), F.greatest(F.size(w) - 2, F.lit(0))), lambda i: pair_at(i).isNotNull())
    first = F.get(spots, F.lit(0))
    rebuilt = F.array_join(F.concat(F.slice(w, F.lit(1), first), F.array(pair_at(first)), F.slice(w, first + 3, F.greatest(F.size(w) - first - 2, F.lit(0)))), " ")
    return F.when(first.isNull(), c).otherwise(rebuilt)


def replace_synonyms(c: Column, table: dict[str, str] = SYNONYMS) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.array_join(F.transform(F.split(c, " "), lambda w: F.coalesce(F.element_at(pairs, w), w)), " ")


def legacy_normalize(c: Column) -> Column:
    """Homoglyphs, lower case, units, decimal point, odd signs, word order, synonyms. Text is expected
    in NFC (``functions.metrics.nfc`` makes it so)."""
    out = normalize_units(F.lower(fold_homoglyphs(c)))
    out = squeeze(F.regexp_replace(out, r"(\d+),(\d+)", "$1.$2"))
    out = F.regexp_replace(out, r"[^\p{L}\p{N}_\s\-.,()×xх²]", "")
    return replace_synonyms(canonical_order(out))


def backup_normalize(c: Column) -> Column:
    """The oldest normalizer: x is folded too, and a Cyrillic s before digits becomes Latin."""
    out = normalize_units(F.lower(fold_homoglyphs(c, HOMOGLYPHS_WITH_X)), UNIT_RULES_OLD)
    out = squeeze(F.regexp_replace(out, r"(\d+),(\d+)", "$1.$2"))
    out = F.regexp_replace(out, r"[^\p{L}\p{N}_\s\-.,()×x²]", "")
    return replace_synonyms(canonical_order(out))


def multi_normalize(c: Column) -> Column:
    out = F.regexp_replace(F.lower(fold_homoglyphs(c, HOMOGLYPHS_WITH_X)), r"(\d+),(\d+)", "$1.$2")
    out = squeeze(F.regexp_replace(out, r"[^\p{L}\p{N}_\s\-.,()×x²]", ""))
    return replace_synonyms(out, SYNONYMS_MULTI)


def full_process(c: Column) -> Column:
    """What the token ratios compare: Latin-1 signs dropped, other than letters and digits blanked, lower."""
    out = F.regexp_replace(text(c), r"[\x{80}-\x{FF}]", "")
    return F.trim(F.lower(F.regexp_replace(out, r"[^\p{L}\p{N}_]", " ")))


def sorted_tokens(c: Column) -> Column:
    return F.array_join(F.array_sort(words(full_process(c))), " ")


def standard_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(text(c)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def semantic_tokens(c: Column, stop: tuple[str, ...] = STOP_SEMANTIC) -> Column:
    return F.array_except(words(c), F.array(*map(F.lit, stop)))


def edge_ngrams(token: Column, least: int = 2, most: int = 15) -> Column:
    n = F.length(token)
    return F.when(n < least, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(least), F.greatest(F.least(n, F.lit(most)), F.lit(least))), lambda k: F.left(token, k)))


def _piece(token: Column, size: int):
    return lambda i: F.substring(token, i, F.lit(size))


def ngrams(token: Column, least: int = 3, most: int = 4) -> Column:
    n = F.length(token)
    parts = [F.when(n < k, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), _piece(token, k))) for k in range(least, most + 1)]
    return F.concat(*parts)


# Russian stemming by the published Snowball rules, on the part after the first vowel (RV).
_GERUND = r"((?<=[ая])(?:вшись|вши|в)|(?:ившись|ывшись|ивши|ывши|ив|ыв))$"
_ADJECTIVE = "(?:ее|ие|ые|ое|ими|ыми|ей|ий|ый|ой|ем|им|ым|ом|его|ого|ему|ому|их|ых|ую|юю|ая|яя|ою|ею)"
_PARTICIPLE = r"(?:(?<=[ая])(?:ем|нн|вш|ющ|щ)|(?:ивш|ывш|ующ))"
_REFLEXIVE = r"(?:ся|сь)$"
_VERB = r"((?<=[ая])(?:ла|на|ете|йте|ли|й|л|ем|н|ло|но|ет|ют|ны|ть|ешь|нно)|(?:ила|ыла|ена|ейте|уйте|ите|или|ыли|ей|уй|ил|ыл|им|ым|ен|ило|ыло|ено|ят|ует|уют|ит|ыт|ены|ить|ыть|ишь|ую|ю))$"
_NOUN = r"(?:а|ев|ов|ие|ье|е|иями|ями|ами|еи|ии|и|ией|ей|ой|ий|й|иям|ям|ием|ем|ам|ом|о|у|ах|иях|ях|ы|ь|ию|ью|ю|ия|ья|я)$"


def russian_stem(token: Column) -> Column:
    head = F.regexp_extract(token, r"^([^аеиоуыэюя]*[аеиоуыэюя]?)(.*)$", 1)
    rv = F.regexp_extract(token, r"^([^аеиоуыэюя]*[аеиоуыэюя]?)(.*)$", 2)
    # lookbehind needs the letter before the ending to be inside RV
    step = F.regexp_replace(rv, _GERUND, "")
    bare = F.regexp_replace(rv, _REFLEXIVE, "")
    adjective = F.regexp_replace(F.regexp_replace(bare, _ADJECTIVE + "$", "\u0001"), _PARTICIPLE + "\u0001$", "\u0001")
    adjective = F.when(adjective.endswith("\u0001"), F.replace(adjective, F.lit("\u0001"), F.lit("")))
    verb = F.regexp_replace(bare, _VERB, "")
    noun = F.regexp_replace(bare, _NOUN, "")
    one = F.when(step != rv, step).otherwise(F.coalesce(adjective, F.when(verb != bare, verb), noun))
    two = F.regexp_replace(one, "и$", "")
    # R2 begins after the second vowel-consonant group
    r2 = F.length(F.regexp_extract(F.concat(head, two), r"^([^аеиоуыэюя]*[аеиоуыэюя]+[^аеиоуыэюя][^аеиоуыэюя]*[аеиоуыэюя]+[^аеиоуыэюя])", 1))
    whole = F.concat(head, two)
    cut = F.regexp_replace(whole, "ость?$", "")
    three = F.when((r2 > 0) & (F.length(cut) >= r2), cut).otherwise(whole)
    four = F.regexp_replace(three, "нн$", "н")
    superlative = F.regexp_replace(F.regexp_replace(three, "ейше?$", ""), "нн$", "н")
    out = F.when(three.rlike("нн$"), four).when(three.rlike("ейше?$"), superlative).otherwise(F.regexp_replace(three, "ь$", ""))
    return F.when(token.rlike("[а-я]"), out).otherwise(token)


def analyze_russian(c: Column, stop: tuple[str, ...] = STOP_MULTI, protected: tuple[str, ...] = PROTECTED, unique: bool = True) -> Column:
    kept = F.array_except(standard_tokens(c), F.array(*map(F.lit, stop))) if unique else F.filter(standard_tokens(c), lambda t: ~t.isin(*stop))
    stemmed = F.transform(kept, lambda t: F.when(t.isin(*protected), t).otherwise(russian_stem(F.translate(t, "ё", "е"))))
    return F.array_distinct(stemmed) if unique else stemmed
