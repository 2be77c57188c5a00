"""Column helpers on text: names, repositories, hosts, dates, quantities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Go's \s class and TrimSpace set, spelled out so that they hold in Java regexes.
SPACE = r"[\t\n\f\r ]"
_TRIM = r"^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$"

# Powers of ten of the decimal suffixes, and the binary suffixes in
# order, each 1024 times the one before.
DECIMAL_EXPONENTS = {"n": "-9", "u": "-6", "m": "-3", "": "0", "k": "3", "M": "6", "G": "9", "T": "12", "P": "15", "E": "18"}
BINARY_UNITS = ["Ki", "Mi", "Gi", "Ti", "Pi", "Ei"]


def quoted(text: str) -> str:
    """``text`` as a literal inside a Java regex."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def trim_space(c: Column) -> Column:
    return F.regexp_replace(c, _TRIM, "")


def required_value(c: Column) -> Column:
    """Empty text counts as missing."""
    return F.nullif(c, F.lit(""))


def or_default(c: Column, default: Column) -> Column:
    return F.coalesce(required_value(c), default)


def resource_name(c: Column) -> Column:
    """Lower-cased name with only ``a-z 0-9 - .`` kept; NULL when nothing is left."""
    return required_value(F.regexp_replace(F.lower(c), r"[^a-z0-9\-.]", ""))


def split_repo(c: Column) -> Column:
    """``owner/name`` to a struct; NULL unless there are exactly two parts."""
    parts = F.split(c, "/", -1)
    return F.when(F.size(parts) == 2, F.struct(parts[0].alias("owner"), parts[1].alias("name")))


def split_host(c: Column) -> Column:
    """``user@host`` at the first ``@``; an address without one has no user."""
    at = F.instr(c, "@")
    return F.struct(
        F.when(at > 0, F.substr(c, F.lit(1), at - 1)).otherwise("").alias("user"),
        F.when(at > 0, F.substr(c, at + 1)).otherwise(c).alias("host"),
    )


def capitalize(c: Column) -> Column:
    """Upper-case the first character and touch nothing else."""
    return F.concat(F.upper(F.left(c, F.lit(1))), F.substr(c, F.lit(2)))


def escape_control(c: Column) -> Column:
    """Quote the text when it holds characters that do not print."""
    escaped = F.regexp_replace(c, r"([\\\"])", r"\\$1")
    for char, code in (("\x07", "a"), ("\x08", "b"), ("\f", "f"), ("\n", "n"), ("\r", "r"), ("\t", "t"), ("\x0b", "v")):
        escaped = F.replace(escaped, F.lit(char), F.lit("\\" + code))
    pieces = F.transform(
        F.regexp_extract_all(escaped, F.lit(r"(?U)(?s)(?:(?![\p{Z}&&[^ ]])\p{Print})+|."), F.lit(0)),
        _escape_piece,
    )
    return F.when(_unprintable(c), F.concat(F.lit('"'), F.array_join(pieces, ""), F.lit('"'))).otherwise(c)


def _unprintable(c: Column) -> Column:
    # Of the space separators only U+0020 counts as printable.
    return c.rlike(r"(?U)[^\p{Print}]") | c.rlike(r"[\p{Z}&&[^ ]]")


def _escape_piece(piece: Column) -> Column:
    code = F.lower(F.conv(F.hex(F.encode(piece, "UTF-32")), 16, 16))
    return F.when(
        (F.char_length(piece) == 1) & _unprintable(piece),
        F.when((piece < " ") | (piece == "\x7f"), F.concat(F.lit("\\x"), F.lpad(code, 2, "0")))
        .when(F.length(code) <= 4, F.concat(F.lit("\\u"), F.lpad(code, 4, "0")))
        .otherwise(F.concat(F.lit("\\U"), F.lpad(code, 8, "0"))),
    ).otherwise(piece)


def with_latest_tag(c: Column) -> Column:
    """Add ``:latest`` to an image name without a tag; digests stay as they are."""
    return F.when(c.contains("@") | c.rlike(r":[^/]+$"), c).otherwise(F.concat(c, F.lit(":latest")))


def status_context(base: Column, context: Column, default_base: str = "ci") -> Column:
    return F.concat_ws("/", or_default(base, F.lit(default_base)), or_default(context, F.lit("status")))


def short_id(*keys: Column) -> Column:
    """Eight hex characters derived from the keys, so reruns give the same id."""
    return F.substr(F.sha2(F.concat_ws("\x1f", *[k.cast("string") for k in keys]), 256), F.lit(1), F.lit(8))


def human_date(ts: Column) -> Column:
    """``Jan _2 15:04 UTC``: the day is padded with a space."""
    day = F.lpad(F.dayofmonth(ts).cast("string"), 2, " ")
    return F.concat(F.date_format(ts, "MMM"), F.lit(" "), day, F.lit(" "), F.date_format(ts, "HH:mm"), F.lit(" UTC"))


def quantity(c: Column) -> Column:
    """``300m``, ``1Gi``, ``2k``, ``1e3`` to a decimal of nine places, which hold a
    nano unit exactly; NULL when malformed or too large."""
    shape = r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))(|[numkMGTPE]|[KMGTPE]i|[eE][+-]?[0-9]+)$"
    number, suffix = F.regexp_extract(c, shape, 1), F.regexp_extract(c, shape, 2)
    exponents = F.create_map(*[F.lit(x) for pair in DECIMAL_EXPONENTS.items() for x in pair])
    # the exponent is read with the digits, so that nothing is multiplied
    exponent = F.when(suffix.rlike("^[eE][+-]?[0-9]+$"), suffix).otherwise(F.concat(F.lit("e"), F.element_at(exponents, suffix)))
    binary = number.try_cast("decimal(33,9)")
    by_suffix = F.lit(None).cast("decimal(38,9)")
    for unit in BINARY_UNITS:
        binary = (binary * F.lit(1024).cast("decimal(4,0)")).try_cast("decimal(33,9)")
        by_suffix = F.when(suffix == unit, binary.cast("decimal(38,9)")).otherwise(by_suffix)
    decimal = F.concat(number, exponent).try_cast("decimal(38,9)")
    return F.when(c.rlike(shape), F.when(suffix.endswith("i"), by_suffix).otherwise(decimal))


def last_updated(committed_at: Column, commented_at: Column) -> Column:
    return F.greatest(committed_at, commented_at)


def go_duration(micros: Column) -> Column:
    """Microseconds as ``1h2m3.5s``, ``1.5ms`` or ``0s``."""
    size = F.abs(micros)
    sign = F.when(micros < 0, "-").otherwise("")

    def trimmed(number: Column) -> Column:
        return F.regexp_replace(number.cast("string"), r"\.?0+$", "")

    hours = F.floor(size / 3_600_000_000).cast("long")
    minutes = F.floor(size / 60_000_000).cast("long") % 60
    seconds = trimmed(((size % 60_000_000).cast("decimal(20,6)") / F.lit(1_000_000)).cast("decimal(20,6)"))
    text = (
        F.when(size == 0, "0s")
        .when(size < 1_000, F.concat(size.cast("string"), F.lit("µs")))
        .when(size < 1_000_000, F.concat(trimmed((size.cast("decimal(20,3)") / F.lit(1_000)).cast("decimal(20,3)")), F.lit("ms")))
        .when(size < 60_000_000, F.concat(seconds, F.lit("s")))
        .when(size < 3_600_000_000, F.concat(minutes.cast("string"), F.lit("m"), seconds, F.lit("s")))
        .otherwise(F.concat(hours.cast("string"), F.lit("h"), minutes.cast("string"), F.lit("m"), seconds, F.lit("s")))
    )
    return F.concat(sign, text)


def go_quoted(c: Column) -> Column:
    """Text in double quotes with quotes and backslashes escaped."""
    return F.concat(F.lit('"'), F.regexp_replace(c, r"([\\\"])", r"\\$1"), F.lit('"'))
