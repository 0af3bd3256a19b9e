"""Text functions as Column expressions; everything here stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as Python's ``\s`` sees it; Java's ``\s`` alone is ASCII only.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
LETTER_OR_DIGIT = r"\p{L}\p{N}"

# Function words dropped by `terms` (Bulgarian and English).
# A corpus's own brand name belongs in the `extra` argument.
STOP_WORDS = (
    "като които която което този тази това тези може могат има имат или при през "
    "след преди дори само вече също всички всяка всеки между към над под без със "
    "във един една едно тях него нея своя своите твоите теб българия клиенти "
    "клиентите услуга услуги повече the and for with from that this are you"
).split()


def blank_if_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


# Where upper-then-lower is not case folding: dotless i stays, Cherokee folds upward.
_CHEROKEE = "".join(map(chr, [*range(0xAB70, 0xABC0), *range(0x13F8, 0x13FE)]))
_DOTLESS, _MARK = "\u0131", "\ufffe"


def casefold(text: Column) -> Column:
    """Full Unicode case folding.

    Upper-casing makes every multi-letter expansion and lower-casing takes it back
    down; final sigma and the rare letters above are put right around it.
    """

    def fold(value: Column) -> Column:
        # The capital sharp s has no other upper case, so it is spelled out between
        # the two steps (which also keeps the optimizer from merging them).
        upper = F.replace(F.upper(value), F.lit("ẞ"), F.lit("SS"))
        return F.replace(F.lower(upper), F.lit("ς"), F.lit("σ"))

    kept = F.replace(fold(F.replace(text, F.lit(_DOTLESS), F.lit(_MARK))), F.lit(_MARK), F.lit(_DOTLESS))
    rare = F.translate(kept, _CHEROKEE, _CHEROKEE.upper())
    return F.when(text.rlike(r"[\x{131}\x{13a0}-\x{13fd}\x{ab70}-\x{abbf}]"), rare).otherwise(fold(text))


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(blank_if_null(text), f"{SPACE}+", " "))


def trim_space(text: Column) -> Column:
    """White space off both ends; NULL becomes empty."""
    return F.regexp_replace(blank_if_null(text), rf"^{SPACE}+|{SPACE}+$", "")


def tokenize_ascii(text: Column) -> Column:
    """Case-fold first, then ASCII letter/digit runs."""
    return F.regexp_extract_all(casefold(blank_if_null(text)), F.lit("[a-z0-9]+"), F.lit(0))


def tokenize_unicode(text: Column) -> Column:
    """Letter/digit runs of any script, each case-folded afterwards."""
    spaced = F.trim(F.regexp_replace(blank_if_null(text), f"[^{LETTER_OR_DIGIT}]+", " "))
    return words(casefold(spaced))


def words(spaced: Column) -> Column:
    """Split text whose words are already separated by single spaces."""
    return F.array_remove(F.split(spaced, " "), "")


def norm(text: Column) -> Column:
    """Key for evidence matching: single spaces, trimmed, case-folded."""
    return casefold(collapse_space(text))


def norm_lower(text: Column) -> Column:
    """Key for benchmark questions: as `norm`, but only lower-cased."""
    return F.lower(collapse_space(text))


def normalize(text: Column) -> Column:
    """Key for facts and questions: folded words, underscore kept."""
    folded = casefold(blank_if_null(text))
    return F.trim(F.regexp_replace(folded, f"[^{LETTER_OR_DIGIT}_]+", " "))


def terms(text: Column, extra: tuple[str, ...] = ()) -> Column:
    """Distinct Latin/Cyrillic words of three characters or more, minus stop words."""
    pattern = "[A-Za-zА-Яа-я][A-Za-zА-Яа-я0-9+.-]{2,}"
    found = F.regexp_extract_all(blank_if_null(text), F.lit(pattern), F.lit(0))
    found = words(F.lower(F.array_join(found, " ")))
    stop = F.array(*[F.lit(word) for word in [*STOP_WORDS, *extra]])
    return F.array_except(found, stop)


def sentences(text: Column) -> Column:
    return F.split(text, rf"(?<=[.!?]){SPACE}+")


def paragraphs(text: Column) -> Column:
    return F.split(text, rf"\n{SPACE}*\n")


def word_tokens(text: Column) -> Column:
    """Offline stand-in for a subword tokenizer: whitespace words."""
    return words(collapse_space(text))


def strip_type_suffix(question_type: Column) -> Column:
    return F.replace(question_type, F.lit("_query"), F.lit(""))


def category_for(url: Column) -> Column:
    """Second non-empty path segment, else ``other``."""
    parts = F.filter(
        F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/"), lambda p: p != ""
    )
    return F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("other"))


def title_case(text: Column) -> Column:
    """Capitalise every run of letters, lower-case the rest of the run."""
    runs = F.regexp_extract_all(text, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def drop_leading_title(title: Column, body: Column) -> Column:
    rest = F.regexp_replace(F.substr(body, F.length(title) + 1), r"^[\n ]+", "")
    return F.when((title != "") & body.startswith(title), rest).otherwise(body)


def body_digest(body: Column) -> Column:
    return F.sha2(body, 256)


def query_ordinal_id(position: Column, prefix: str = "q") -> Column:
    return F.format_string(prefix + "%05d", position)


def salvage_json(reply: Column, schema: str) -> Column:
    """Parse a model reply that may carry reasoning, code fences or chatter.

    The cleaned reply is parsed as it stands; failing that, the span from the
    first opening to the last closing brace is parsed. NULL means no JSON object.
    """
    thought = F.regexp_replace(blank_if_null(reply), r"(?s)<think>.*?</think>", "")
    bare = F.regexp_replace(thought, r"(?i)^\s*```(?:json)?\s*|\s*```\s*$", "")
    span = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    whole = F.when(F.try_parse_json(bare).isNotNull(), F.trim(bare))
    picked = F.coalesce(whole, F.when(F.try_parse_json(span).isNotNull(), span))
    return F.when(F.ltrim(picked).startswith("{"), F.from_json(picked, schema))
