"""Stop lists, tokens, n-grams and cleaning, as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# English function words (public list of Spark's StopWordsRemover, without forms that hold
# an apostrophe) and the fragments that tokenisers leave of those.
ENGLISH = tuple(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
    herself it its itself they them their theirs themselves what which who whom this that these those am is are
    was were be been being have has had having do does did doing a an the and but if or because as until while
    of at by for with about against between into through during before after above below to from up down in out
    on off over under again further then once here there when where why how all any both each few more most
    other some such no nor not only own same so than too very s t can will just don should now
    d ll m o re ve y ain aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn
    weren won wouldn""".split()
)
# Words of message headers and threads.
STRUCTURAL = tuple(
    """subject lines organization organisation writes article reply wrote said date from re cc newsgroups path
    distribution keywords summary references sender nntp posting host xref approved followup""".split()
)
# Web and contraction fragments, and words without a topic.
EXTRA = tuple(
    """edu com org net gov www http re cc writes article subject lines like just don use know think time want
    good make look said say way does did got ll ve haven isn aren wasn doesn didn wouldn couldn shouldn""".split()
)
PHRASE_STOPS = tuple(dict.fromkeys(ENGLISH + STRUCTURAL))
WORD_STOPS = tuple(dict.fromkeys(ENGLISH + EXTRA))

ENDERS = r"[.!?,;:\n]"
#: White space and ASCII punctuation.
DELIMITERS = r"[\s!-/:-@\[-`{-~]+"


def strip(text: Column) -> Column:
    """Without leading and trailing white space, as Unicode has it."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def blank(text: Column) -> Column:
    return F.coalesce(~text.rlike(r"(?U)\S"), F.lit(True))


def words(text: Column) -> Column:
    """Lower-cased runs between white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def content_tokens(text: Column) -> Column:
    """Lower-cased words of four ASCII letters and more that no other word character touches."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b([a-z]{4,})\b"), F.lit(1))


def default_tokens(text: Column) -> Column:
    """Lower-cased words of two word characters and more."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b(\w\w+)\b"), F.lit(1))


def bad_token(word: Column) -> Column:
    """Three equal characters in a row, or 26 characters and more."""
    return word.rlike(r"(.)\1{2,}") | (F.length(word) >= 26)


def without(tokens: Column, stops: tuple[str, ...]) -> Column:
    return F.filter(tokens, lambda w: ~w.isin(*stops))


def ngrams(tokens: Column, low: int, high: int) -> Column:
    """All runs of ``low`` to ``high`` tokens, shorter first, each joined by one space."""
    none = F.array().cast("array<string>")
    sizes = [F.when(F.size(tokens) >= n, _runs(tokens, n)).otherwise(none) for n in range(low, high + 1)]
    return F.concat(*sizes)


def _runs(tokens: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " "))


def stops_cut(text: Column, stops: tuple[str, ...], mark: str) -> Column:
    """The lower-cased text with each stop word that no other word character touches replaced by ``mark``."""
    every = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_]+)"), F.lit(1))
    return F.array_join(F.transform(every, lambda w: F.when(w.isin(*stops), F.lit(mark)).otherwise(w)), "")


def stop_pattern(stops: tuple[str, ...]) -> str:
    """A whole stop word, whatever its case; the longest first."""
    return r"(?iU)\b(?:" + "|".join(sorted(stops, key=lambda s: (-len(s), s))) + r")\b"


def clean_phrase(phrase: Column, stops: tuple[str, ...] = PHRASE_STOPS) -> Column:
    """Some token is alphabetic, of two letters and more, and no stop word."""
    return F.exists(F.split(F.lower(phrase), r"\s+"), lambda w: w.rlike(r"^\p{L}{2,}$") & ~w.isin(*stops))


def all_stop(phrase: Column, stops: tuple[str, ...] = PHRASE_STOPS) -> Column:
    """Every token is a stop word or digits; true of nothing at all."""
    tokens = F.filter(F.split(F.lower(phrase), r"\s+"), lambda w: w != "")
    return F.forall(tokens, lambda w: w.isin(*stops) | w.rlike(r"^[0-9]+$"))


def sentences(text: Column, least: int = 15) -> Column:
    """Stripped parts between sentence ends that are longer than ``least``; the whole text if there are none."""
    parts = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), strip), lambda s: F.length(s) > least)
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(text))


def no_contractions(text: Column) -> Column:
    """Contraction endings and then all apostrophes deleted, lower-cased: "don't" becomes "don"."""
    return F.lower(F.replace(F.regexp_replace(text, r"(?i)'(?:t|s|re|ve|ll|d|m)\b", ""), F.lit("'"), F.lit("")))


@F.pandas_udf(StringType())
def _compatible(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if c.isprintable()))


def clean_text(text: Column) -> Column:
    """NFKD, then characters that don't print deleted (line ends too), white space collapsed, stripped.

    NFKD has no built-in, so texts pass through Arrow; null stays null.
    """
    return strip(F.regexp_replace(_compatible(text), r"(?U)\s+", " "))
