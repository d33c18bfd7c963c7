"""Text expressions: white space, citations, identifiers, headings' parts. All stay in generated code but ``shorten``."""

from __future__ import annotations

import textwrap
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What marks a citation that already is complete, and the code's own prefix.
CITED = ("smc", "title", "chapter")
CODE_PREFIX = "SMC "


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends; ``trim`` would only take U+0020."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def condense(c: Column) -> Column:
    """Stripped, every run of white space one space."""
    return F.regexp_replace(strip(c), r"(?U)\s+", " ")


def mend_hyphens(c: Column) -> Column:
    """A page's text without carriage returns and with words joined that a hyphen parts at a line end."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "\r", ""), r"(?U)(?<=\w)-\s*\n\s*(?=\w)", "")


def is_footer(c: Column, place: str = "Seattle") -> Column:
    """A page footer such as ``23-4.5 (Place 12-3)``."""
    return strip(c).rlike(rf"(?U)^\d{{2}}-\d+(?:\.\d+)?\s*\({place}\s+\d+-\d+\)$")


def full_citation(c: Column, prefix: str = CODE_PREFIX) -> Column:
    """null and empty give null; complete ones stay; others lose leading zeros and get the prefix."""
    bare = strip(c)
    known = F.lower(bare).rlike("^(" + "|".join(CITED) + ")")
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(None)).when(known, bare).otherwise(F.concat(F.lit(prefix), F.regexp_replace(bare, "^0+", "")))


def sanitize(c: Column) -> Column:
    """Lower-case letters and digits joined by ``-``; nothing left, null and empty give ``unknown``."""
    joined = F.lower(F.regexp_replace(F.regexp_replace(c, "[^0-9a-zA-Z]+", "-"), "^-+|-+$", ""))
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("unknown")).otherwise(F.coalesce(F.nullif(joined, F.lit("")), F.lit("unknown")))


def chunk_id(title: Column, chapter: Column, section: Column | None, index: Column, prefix: str = "smc") -> Column:
    """``smc-{title}-{chapter}-section-{section}-{i}``, or ``…-chapter-intro-{i}`` without a section."""
    suffix = F.when(section.isNull(), F.lit("chapter-intro")).otherwise(F.concat(F.lit("section-"), sanitize(section))) if section is not None else F.lit("chapter-intro")
    return F.concat_ws("-", F.lit(prefix), title.cast("string"), sanitize(chapter), suffix, index.cast("string"))


@F.pandas_udf(StringType())
def shorten(texts: pd.Series) -> pd.Series:
    """At most 1200 characters, cut at a word, with `` …`` where something is missing."""
    return texts.map(lambda t: None if t is None else textwrap.shorten(t, width=1200, placeholder=" …"))


def _without_accents() -> tuple[str, str]:
    """Letters that decompose into one letter and marks, and those letters: a table made by rule."""
    pairs = []
    for point in range(0xC0, 0x2000):
        base = [x for x in unicodedata.normalize("NFD", chr(point)) if not unicodedata.combining(x)]
        if len(base) == 1 and base[0] != chr(point):
            pairs.append((chr(point), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _PLAIN = _without_accents()


def fold(c: Column) -> Column:
    """Lower case without accents, as the full-text tokenizer folds; no Python at run time."""
    return F.lower(F.regexp_replace(F.translate(c, _ACCENTED, _PLAIN), r"\p{Mn}+", ""))
