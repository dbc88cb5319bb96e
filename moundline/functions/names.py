"""Player names: accents, first and last, title case, slugs. Scalars on the driver, and the same as column expressions."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_accents(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def title(text: str) -> str:
    """A capital after everything that is no letter: O'Neill Smith-Jones."""
    return re.sub(r"[^\W\d_]+", lambda m: m[0][0].upper() + m[0][1:].lower(), text)


def slug(text: str) -> str:
    return text.lower().replace(" ", "_")


@cache
def _decomposed() -> tuple[str, str, dict[str, str]]:
    """By the Unicode tables: letters whose plain form is one other letter, these forms, followed by marks that go; and letters with longer forms. Hangul is left out."""
    one, marks, more = {}, [], {}
    for code in (*range(0x80, 0xAC00), *range(0xF900, 0x10000), *range(0x1D400, 0x1F200)):
        letter = chr(code)
        plain = strip_accents(letter)
        if unicodedata.combining(letter):
            marks.append(letter)
        elif plain != letter:
            one.update({letter: plain}) if len(plain) == 1 else more.update({letter: plain})
    return "".join([*one, *marks]), "".join(one.values()), more


def strip_accents_column(name: Column | str) -> Column:
    """As strip_accents, as an expression: letters are translated one by one, and letters with longer plain forms (ligatures) replaced where a name has any. Hangul syllables stay whole."""
    c = F.col(name) if isinstance(name, str) else name
    letters, forms, more = _decomposed()
    known = F.create_map(*[F.lit(x) for pair in more.items() for x in pair])
    # Looked for by the hash table of translate(); a class of a regular expression and a map are gone through letter by letter.
    longer = lambda x: F.translate(x, "".join(more), "") != x
    spelled = F.array_join(F.transform(F.split(c, ""), lambda x: F.when(longer(x), F.try_element_at(known, x)).otherwise(x)), "")
    return F.translate(F.when(longer(c), spelled).otherwise(c), letters, forms)


def title_column(name: Column | str) -> Column:
    """As title, as an expression: runs of letters, each with a capital in front."""
    c = F.col(name) if isinstance(name, str) else name
    runs = F.regexp_extract_all(c, F.lit(r"([\p{L}\p{No}\p{Nl}]+|[^\p{L}\p{No}\p{Nl}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, F.lit(2), F.length(x))))), "")


def first_and_last(name: Column) -> tuple[Column, Column]:
    """The first word and the others; the second is null for a single word."""
    parts = F.split(F.trim(name), r"\s+")
    return F.get(parts, 0), F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 2, 1 << 20), " "))


def slug_column(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("_"))
