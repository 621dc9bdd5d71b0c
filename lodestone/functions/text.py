"""Token and value expressions: JVM-side columns, and the few Arrow functions that Spark has no builtin for."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: one piece of the fallback tokenizer per match.
PIECE = r"(?U)\s{24}|\s{0,23}(?:[A-Za-z]{1,24}|\d{1,24}|[؀-ۿ]{1,24}|[一-鿿]|[^\sA-Za-z\d])|\s+"
#: Arabic vowel marks and the stretching character.
ARABIC_MARKS = r"[ً-ْٰـ]"
WORD = r"[\p{L}\p{N}_]+"

#: Words without content, for overlap and grounding.
STOPWORDS = tuple(
    """
    a an the and or but if then than that this these those of in on at by for with without from to into over under
    between among during about as is are was were be been being am do does did doing have has had having will would
    shall should can could may might must not no nor its it he she they them his her their we you your our i me my us
    who whom whose which what when where why how many much more most less least any all each every both few some other
    another such only own same so too very just also there here please tell show list find give name display return get
    fetch provide total number count sum average avg min max mean number_of
    من في على عن الى إلى ما ماذا كم هل هذا هذه ذلك التي الذي و ال او أو
    """.split()
)


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def pieces(text: Column) -> Column:
    """The pieces of the fallback tokenizer; joined again they give the text."""
    return _all(text, PIECE)


def count_tokens(text: Column) -> Column:
    return F.size(pieces(text))


def truncate_tokens(text: Column, keep: int) -> Column:
    return F.array_join(F.slice(pieces(text), 1, keep), "")


def words(text: Column) -> Column:
    """Lower-cased words for lexical retrieval, without Arabic marks."""
    return _all(F.regexp_replace(F.lower(text), ARABIC_MARKS, ""), WORD)


def nfkc(text: Column) -> Column:
    """Compatibility form; Spark has no builtin for it."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return run(text)


def shortest(value: Column) -> Column:
    """A double as the shortest text that reads back as the same number; whole numbers without a point."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if pd.isna(v) else str(int(v)) if float(v).is_integer() else repr(float(v)))

    return run(value)


def folded(term: Column) -> Column:
    """Lower case, Arabic letters unified, a plural s dropped."""
    bare = F.translate(F.regexp_replace(F.lower(term), ARABIC_MARKS, ""), "أإآةى", "اااهي")
    return F.when((F.length(bare) > 3) & bare.endswith("s") & ~bare.endswith("ss"), F.substring(bare, F.lit(1), F.length(bare) - 1)).otherwise(bare)


def _raw_terms(text: Column) -> Column:
    """Words, with CJK characters one by one."""
    return F.filter(_all(text, r"[぀-ヿ㐀-䶿一-鿿가-힯]|(?:(?![぀-ヿ㐀-䶿一-鿿가-힯])[\p{L}\p{N}_])+"), lambda t: F.length(t) > 0)


def _kept(term: Column) -> Column:
    return ~term.isin(*STOPWORDS) & ((F.length(term) >= 2) | term.rlike(r"^[\d぀-ヿ㐀-䶿一-鿿가-힯]$"))


def terms(text: Column) -> Column:
    """Content terms in order: folded, without stopwords."""
    return F.filter(F.transform(_raw_terms(text), folded), _kept)


def unique_terms(text: Column) -> Column:
    return F.array_sort(F.array_distinct(terms(text)))


def entity_terms(question: Column, caseless_min: int = 4) -> Column:
    """Terms that look like values: with a digit, a capital initial, or long enough where there are no capitals."""

    def like_value(raw: Column) -> Column:
        caseless = F.lower(raw) == F.upper(raw)
        return raw.rlike(r"\d") | F.when(caseless, F.length(folded(raw)) >= caseless_min).otherwise(raw.rlike(r"^\p{Lu}"))

    return F.array_distinct(F.filter(F.transform(F.filter(_raw_terms(question), like_value), folded), _kept))


def script_tag(text: Column) -> Column:
    """ar, mixed or en, by the scripts present."""
    arabic, latin = text.rlike(r"[؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿]"), text.rlike("[A-Za-z]")
    return F.when(arabic & latin, "mixed").when(arabic, "ar").otherwise("en")


def looks_like_date(text: Column) -> Column:
    """ISO dates (with a time), Y/m/d, and YYYYMMDD, if the calendar has that day."""
    t = F.trim(text)
    day = (
        F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"), F.substring(t, 1, 10))
        .when(t.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), F.concat_ws("-", F.split_part(t, F.lit("/"), F.lit(1)), F.lpad(F.split_part(t, F.lit("/"), F.lit(2)), 2, "0"), F.lpad(F.split_part(t, F.lit("/"), F.lit(3)), 2, "0")))
        .when(t.rlike(r"^(19|20)\d{6}$"), F.concat_ws("-", F.substring(t, 1, 4), F.substring(t, 5, 2), F.substring(t, 7, 2)))
    )
    return F.coalesce(F.try_to_date(day, "yyyy-MM-dd").isNotNull(), F.lit(False))
