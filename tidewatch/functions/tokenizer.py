"""Chat text to words, as one regex pass over the text.

Comma, space and tab separate words. Double quotes group text and always close
a word, even an empty one. A backslash makes the next special character (quote,
backslash or separator) a plain one, also when ordinary characters stand in
between; the backslash itself is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ESCAPED = r'\\[^\\", \t]*(?:[\\", \t]|\z)'
_QUOTED = rf'"[^\\"]*+(?:{_ESCAPED}[^\\"]*+)*+(?:"|\z)'
_BARE = rf'(?:[^\\", \t]++|{_ESCAPED})++'
_TOKEN = rf"{_QUOTED}|{_BARE}"


def tokenize(text: Column) -> Column:
    """``array<string>`` of the words of a message."""
    raw = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))
    words = F.transform(raw, _word)
    kept = F.filter(words, lambda w: w["closed"] | (w["word"] != ""))
    return F.transform(kept, lambda w: w["word"])


def _word(token: Column) -> Column:
    is_quoted = token.startswith('"')
    body = F.when(is_quoted, F.regexp_replace(token, rf'(?s)^"([^\\"]*+(?:{_ESCAPED}[^\\"]*+)*+)"?\z', "$1")).otherwise(token)
    # An opening quote that runs to the end of the text leaves nothing after its body.
    closed = is_quoted & token.rlike(rf'(?s)^"[^\\"]*+(?:{_ESCAPED}[^\\"]*+)*+"\z')
    unescaped = F.regexp_replace(body, r'(?s)\\([^\\", \t]*)([\\", \t]?)', "$1$2")
    plain = F.when(F.contains(token, F.lit("\\")), unescaped).otherwise(body)
    return F.struct(plain.alias("word"), closed.alias("closed"))


def is_delimiter(word: Column) -> Column:
    return F.lower(word).isin("with", "and")
