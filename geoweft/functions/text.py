"""Text functions: white space, entities, a tokenizer for short posts, and contractions."""

from __future__ import annotations

import html
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named entities that posts carry.
ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " "}


def squash(text: Column) -> Column:
    """White space of any kind as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def unescape(text: Column) -> Column:
    """Named entities replaced, doubly escaped ampersands too."""
    out = F.replace(text, F.lit("&amp;amp;"), F.lit("&amp;"))
    for name, char in list(ENTITIES.items())[1:]:
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def unescape_html(text: Column) -> Column:
    """All named and numeric entities replaced, doubly escaped ones too; null stays null. Texts without an ampersand are not looked at."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None or "&" not in t else html.unescape(t.replace("&amp;", "&")))

    return run(text)


#: Things that stay whole, tried in this order at each place. Marks are told by their Unicode class: quotes, signs that end a phrase, other marks.
_URL_END = r"[^\s<>\p{P}]|[/&=#%_-]"
_QUOTE = r"""["'\p{Pi}\p{Pf}]"""
TOKENS = regex.compile(
    "|".join(
        [
            rf"(?:[a-z][a-z0-9+.-]*://|www\.)[^\s<>]*(?:{_URL_END})",
            r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+",
            r"[@＠#＃]\w+",
            r"(?<!\w)[<>:;=8x]\p{P}*[DPOpo03](?!\w)",  # a face: eyes, perhaps a nose, a mouth that is a letter or a number
            r"(?<!\w)(?!\p{Ps}|\p{Pe})[:;=]\p{P}?[\p{Ps}\p{Pe}/|*\\]+|[\p{Ps}\p{Pe}]\p{P}?[:;=](?!\w)",  # a face whose mouth is a bracket
            r"\d+:\d+(?:am|pm)?",
            r"\p{Sc}?\d+(?:\p{Po}\d+)*%?",
            r"(?:\p{L}\.){2,}",
            r"[\p{L}\p{M}\p{N}]+(?:[\p{Pd}_'’‘′][\p{L}\p{M}\p{N}]+)*",
            r"[\p{Pd}\p{Sm}]{2,}",  # arrows and rules
            rf"{_QUOTE}+",
            r"(?:(?!['\"&@#%*/\\])\p{Po})+",
            r"[^\w\s]",
            r"_+",
        ]
    )
)
#: Endings that are split from a word, and the apostrophes before them.
ENDINGS = "n't 've 'll 'd 're 's 'm"
APOSTROPHES = "'’′"


def tokens(text: str) -> list[str]:
    """The tokens of a post; links, addresses, names, tags, numbers and emoticons stay whole."""
    return TOKENS.findall(html.unescape(text.replace("&amp;", "&")) if "&" in text else text)


def split_contraction(token: str) -> list[str]:
    """A word and the contraction at its end, or the token as it is."""
    plain = token.lower()
    for mark in APOSTROPHES[1:]:
        plain = plain.replace(mark, APOSTROPHES[0])
    for ending in ENDINGS.split():
        word = token[: -len(ending)]
        if plain.endswith(ending) and word and word.replace("_", "").isalnum():
            return [word, token[-len(ending) :]]
    return [token]


def tokenize(text: Column, contractions: bool = False) -> Column:
    """Array of tokens; null stays null."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = [None if t is None else tokens(t) for t in s]
            yield pd.Series([x if x is None or not contractions else [p for t in x for p in split_contraction(t)] for x in out])

    return run(text)
