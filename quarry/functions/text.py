"""Tokens for text ranking: split at white space and ASCII punctuation, sized in bytes, ASCII lower case, without stop words."""

from __future__ import annotations

import json
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

STOP_WORDS = tuple("a all an and are as at be been by could for from has he how i in is it its of on that the their them there these they this those to was we what when where which who why will with would you".split())
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class TokenOptions:
    lowercase: bool = True
    remove_stop_words: bool = True
    remove_punctuation: bool = True
    min_bytes: int = 2
    max_bytes: int = 50


def normalize_term(term: Column) -> Column:
    """ASCII letters in lower case; others as they are."""
    return F.translate(term, UPPER, LOWER)


def is_stop_word(term: Column) -> Column:
    return normalize_term(term).isin(*STOP_WORDS)


def tokens(text: Column, options: TokenOptions = TokenOptions()) -> Column:
    """Array of tokens; a null text has none."""
    out = F.split(F.coalesce(text, F.lit("")), r"[\s\p{Punct}]+" if options.remove_punctuation else r"\s+")
    out = F.filter(out, lambda w: F.octet_length(w).between(options.min_bytes, options.max_bytes))
    if options.lowercase:
        out = F.transform(out, normalize_term)
    if options.remove_stop_words:
        out = F.filter(out, lambda w: ~is_stop_word(w))
    return out


_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())


class TokenCounter:
    """Tokens of texts in UTF-8 and how often each is there, the same as :func:`tokens` for options that leave out empty tokens."""

    def __init__(self, options: TokenOptions = TokenOptions()):
        cut = _PUNCTUATION if options.remove_punctuation else b""
        cased = (UPPER.encode(), LOWER.encode()) if options.lowercase else (b"", b"")
        self.table = bytes.maketrans(cut + cased[0], b" " * len(cut) + cased[1])
        self.least, self.most, self.cased = options.min_bytes, options.max_bytes, not options.lowercase
        self.stop = frozenset(w.encode() for w in STOP_WORDS) if options.remove_stop_words else frozenset()

    def __call__(self, text: bytes | None) -> Counter:
        """bytes.split cuts at the six characters that Java's \\s has."""
        found = Counter((text or b"").translate(self.table).split())
        least, most, stop = self.least, self.most, self.stop
        for w in [w for w in found if not least <= len(w) <= most or (w.lower() if self.cased else w) in stop]:
            del found[w]
        return found


def tokens_sql(text: str) -> str:
    """The same with the default options, for DuckDB."""
    stop = ",".join(f"'{w}'" for w in STOP_WORDS)
    cut = f"string_split_regex(coalesce({text}, ''), '[\\s!-/:-@\\[-`{{-~]+')"
    return f"list_filter(list_transform(list_filter({cut}, lambda w: strlen(w) between 2 and 50), lambda w: translate(w, '{UPPER}', '{LOWER}')), lambda w: w not in ({stop}))"


def valid_json(text: str, limit: int = 65_536) -> bool:
    """Well-formed JSON, in UTF-8 of at most limit bytes."""
    try:
        raw = text.encode("utf-8")
        json.loads(text)
    except (UnicodeEncodeError, ValueError):
        return False
    return len(raw) <= limit
