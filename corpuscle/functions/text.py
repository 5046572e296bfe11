"""Features, masks and canonical forms of texts, all as column expressions inside code generation.

A null text counts as an empty one; ratios over nothing are 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The lexicon of promotional words.
PROMO = ("free", "win", "winner", "prize", "claim", "urgent", "call", "reply", "cash", "award", "bonus", "offer", "txt", "text", "stop")
# Words for money, and those that cue masking takes besides.
MONEY = ("gbp", "pound", "pounds", "dollar", "dollars", "pence")
MONEY_CUES = r"gbp|ukp|pounds?|dollars?|pence|ppm|p/min|p per min|per min"
# The kinds of artifacts.
ARTIFACTS = {
    "html_escape": r"(?i)&(?:amp|lt|gt|quot|apos|#[0-9]+);",
    "replacement_character": "�",
    "mojibake_marker": "(?:â€|Ã|Â|�)",
    "non_ascii": r"[^\x{0}-\x{7f}]",
}
#: Everything Python's str.split() cuts at, as a class for the JVM and for RE2.
BLANKS = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD_CHARS = r"\p{L}\p{N}_"
WORD = rf"[{WORD_CHARS}]+"
URL = rf"(?i)(?:https?://|www\.|[{WORD_CHARS}]\.(?:com|co\.uk|net|org)(?:[^{WORD_CHARS}]|$))"
PHONE = rf"\p{{Nd}}(?:[\p{{Nd}}().-]|{BLANKS}){{6,}}\p{{Nd}}"
DIGIT = r"[\p{Nd}\x{b2}\x{b3}\x{b9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}]"
FEATURES = ("char_count", "token_count", "avg_token_length", "digit_count", "digit_ratio", "uppercase_ratio", "exclamation_count", "currency_count", "has_url", "has_phone", "promo_token_count", "row_position")

_NOT_WORD_BEFORE, _NOT_WORD_AFTER = rf"(?<![{WORD_CHARS}])", rf"(?![{WORD_CHARS}])"


def given(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def collapsed(text: str | Column) -> Column:
    """Runs of blanks made one, none at the ends."""
    return F.trim(F.regexp_replace(given(text), f"{BLANKS}+", " "))


def normalized(text: str | Column) -> Column:
    """Lower case, blanks collapsed; a final sigma is a sigma, as engines differ in where they write it."""
    return collapsed(F.replace(F.lower(given(text)), F.lit("ς"), F.lit("σ")))


def tokens(text: str | Column) -> Column:
    return F.regexp_extract_all(given(text), F.lit(WORD), F.lit(0))


def count_of(text: str | Column, pattern: str) -> Column:
    return F.regexp_count(given(text), F.lit(pattern)).cast("bigint")


def words_among(text: str | Column, words) -> Column:
    """How many words of the text, whatever their case, are among ``words``."""
    return F.size(F.filter(tokens(text), lambda w: F.lower(w).isin(*words))).cast("bigint")


def over(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def shallow(text: str = "text", row: str = "uci_row_number", last_row: str = "last_row") -> dict[str, Column]:
    """The twelve shallow features by name; ``last_row`` is the largest row number of the whole table."""
    ts, length = tokens(text), F.length(given(text)).cast("bigint")
    digits = count_of(text, DIGIT)
    return {
        "char_count": length,
        "token_count": F.size(ts).cast("bigint"),
        "avg_token_length": over(F.aggregate(ts, F.lit(0), lambda n, w: n + F.length(w)).cast("double"), F.size(ts)),
        "digit_count": digits,
        "digit_ratio": over(digits.cast("double"), length),
        "uppercase_ratio": over(count_of(text, r"\p{Lu}").cast("double"), count_of(text, r"\p{L}")),
        "exclamation_count": count_of(text, "!"),
        "currency_count": count_of(text, "[$£€]") + words_among(text, MONEY),
        "has_url": given(text).rlike(URL).cast("bigint"),
        "has_phone": given(text).rlike(PHONE).cast("bigint"),
        "promo_token_count": words_among(text, PROMO),
        "row_position": F.col(row) / F.greatest(F.col(last_row), F.lit(1)),
    }


def mask_promo(text: str | Column) -> Column:
    return F.regexp_replace(given(text), rf"(?i){_NOT_WORD_BEFORE}(?:{'|'.join(PROMO)}){_NOT_WORD_AFTER}", " PROMO_TOKEN ")


def mask_cues(text: str | Column) -> Column:
    """Links, numbers, money and promotional words made tokens, in this order; blanks collapsed."""
    out = given(text)
    out = F.regexp_replace(out, rf"(?i)(?:https?://|www\.|{_NOT_WORD_BEFORE}{WORD}\.(?:com|co\.uk|net|org){_NOT_WORD_AFTER})", " URL_TOKEN ")
    out = F.regexp_replace(out, rf"(?<!\p{{Nd}})\+?{PHONE}(?!\p{{Nd}})", " PHONE_TOKEN ")
    out = F.regexp_replace(out, rf"(?i)(?:[$]|{_NOT_WORD_BEFORE}(?:{MONEY_CUES}){_NOT_WORD_AFTER})", " MONEY_TOKEN ")
    # a number ends where a word begins or ends
    edge = rf"(?:(?<=[{WORD_CHARS}])(?![{WORD_CHARS}])|(?<![{WORD_CHARS}])(?=[{WORD_CHARS}]))"
    out = F.regexp_replace(out, rf"{_NOT_WORD_BEFORE}\p{{Nd}}(?:[\p{{Nd}}()./-]|{BLANKS})+{edge}", " NUMBER_TOKEN ")
    return collapsed(mask_promo(out))


def clip(text: str | Column, limit: int) -> Column:
    """Blanks collapsed and, beyond ``limit`` characters, cut with three dots."""
    flat = collapsed(text)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit - 3)), F.lit("...")))


def blank_words(text: str | Column) -> Column:
    """The distinct words between blanks, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(collapsed(text)), " "), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def pair_key(a: str | Column, b: str | Column) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def ids_of(column: str | Column) -> Column:
    """The ids of an untidily written list, in upper case, each once."""
    return F.array_distinct(F.filter(F.split(F.upper(given(column)), r"[^\p{L}\p{N}]+"), lambda x: x != ""))


def truth(column: str | Column) -> Column:
    """Whether a flag, however written, means yes; null means no."""
    return F.lower(F.trim(given(column))).isin("true", "1", "yes", "y")


def reason_code(word: Column, char: Column, text_a: str = "text_a", text_b: str = "text_b") -> Column:
    """Why a pair of texts may be alike: the first rule that holds. A null similarity holds no rule."""
    # The codes and the bounds of their rules.
    longest = F.greatest(F.length(given(text_a)), F.length(given(text_b)))
    return (
        F.when(longest <= 40, "generic_short_text_review_needed")
        .when((word >= 0.98) & (char < 0.94), "same_words_possible_entity_or_number_change")
        .when((char >= 0.98) & (word < 0.94), "same_character_template_minor_format_change")
        .when((word >= 0.96) & (char >= 0.96), "very_high_similarity_template_review_needed")
        .when(jaccard(blank_words(text_a), blank_words(text_b)) >= 0.75, "high_token_overlap_review_needed")
        .otherwise("threshold_candidate_review_needed")
    )
