"""Column expressions on text: lines, white space, slugs, snippets, counts.

White space is what Java's ``Character.isWhitespace`` says: tabs, line ends and Unicode spaces, but
not the no-break space.  Spark's ``trim`` would strip U+0020 only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters of ``Character.isWhitespace``.
SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2008\u2009\u200a\u2028\u2029\u205f\u3000"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def is_blank(text: Column) -> Column:
    return F.ltrim(F.coalesce(text, F.lit("")), F.lit(SPACE)) == ""


def matches(text: Column, pattern: str) -> Column:
    """Whether the whole text matches; ``rlike`` alone finds a part."""
    return text.rlike(rf"\A(?:{pattern})\z")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def whole_lines(text: Column) -> Column:
    """The text with \\n between its lines only, not at its end.  Uses ``text`` several times."""
    # few texts have a carriage return, and a plain search is cheaper than a pattern
    plain = F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r\n|\r", "\n")).otherwise(text)
    return F.when(F.endswith(text, F.lit("\n")) | F.endswith(text, F.lit("\r")), F.regexp_replace(plain, r"\n\z", "")).otherwise(plain)


def split_lines(text: Column) -> Column:
    """Lines ended by \\n, \\r or \\r\\n; a line end at the very end starts no further line."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(whole_lines(text), "\n"))


def slug(name: Column) -> Column:
    """Lower case, umlauts spelt out, everything else that isn't a letter or digit as single hyphens."""
    spelt = F.lower(name)
    for letter, spelling in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        spelt = F.replace(spelt, F.lit(letter), F.lit(spelling))
    return F.regexp_replace(F.regexp_replace(spelt, "[^a-z0-9]+", "-"), r"\A-|-\z", "")


def snippet(text: Column, length: int = 160) -> Column:
    """What follows the first empty line (all of it if there is none), on one line, cut at ``length``."""
    at = F.instr(text, "\n\n")
    body = F.replace(F.when(at > 0, F.substring(text, at + 2, F.length(text))).otherwise(text), F.lit("\n"), F.lit(" "))
    return F.when(F.length(body) <= length, body).otherwise(F.concat(F.substring(body, 1, length), F.lit(" …")))


def term_count_vector(text: Column, words: list[str]) -> Column:
    """How often each word occurs, without overlaps, as floats: an embedder for tests and dry runs."""
    counts = [((F.length(text) - F.length(F.replace(text, F.lit(w), F.lit("")))) / len(w)).cast("float") for w in words]
    return F.array(*counts)


def number_matches(number: Column, expected: Column) -> Column:
    """``19.2a`` matches ``19`` and ``19.2``; ``16.10`` doesn't match ``16.1``."""
    following = F.substring(number, F.length(expected) + 1, F.lit(1))
    return F.coalesce((number == expected) | (number.startswith(expected) & following.rlike(r"[.\p{L}]")), F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays, in double; 0 where a vector has no length; an error where sizes differ."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length")).cast("double")).otherwise(value)
