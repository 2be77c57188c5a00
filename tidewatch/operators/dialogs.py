"""Chat commands kept in a table: any number of them, found by joins.

A command is called by its name at the start of a message, alone or before white space. The
table is keyed by name, and a message looks its first word, its first two words and so on
up, as far as any name goes; of what it finds, the command with the lowest position is
called. Each lookup is an equi-join with unique keys, so no list of commands is part
of a plan, and no message is paired with commands it does not name. Messages that begin
alike look up once: what is said is made distinct first, and the messages are joined with
what it means.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import SPACE, trim_space
from tidewatch.plans.ordered import HOT_ROWS, look_up, small_enough
from tidewatch.session import cut

FIELD = "struct<name:string,required:boolean,kind:string,enum:array<string>,defaults:array<string>>"
MEANT = f"struct<position:bigint,n_words:int,command:struct<name:string,confirm:boolean,fields:array<{FIELD}>>>"
_WORD = r"[^\t\n\f\r ]++"
HELP = rf"(?d)\A{SPACE}*help({SPACE}.*)?"
ASKED = "help "


def _trimmed(name: Column) -> Column:
    return F.regexp_replace(name, rf"\A{SPACE}+|{SPACE}+\z", "")


def _field(f: Column) -> Column:
    is_enum = f["kind"] == "enum"
    none = F.array().cast("array<string>")
    enum = F.when(is_enum, F.coalesce(f["enum"], none)).otherwise(none)
    given = F.coalesce(f["default"], none)
    defaults = (
        F.when(F.size(given) > 0, given).when(is_enum & F.coalesce(f["default_all"], F.lit(False)), enum).otherwise(F.array(F.lit("")))
    )
    return F.struct(
        f["name"].alias("name"), F.coalesce(f["required"], F.lit(False)).alias("required"),
        F.when(is_enum, "enum").otherwise("string").alias("kind"), enum.alias("enum"), defaults.alias("defaults"),
    )


def _problem() -> Column:
    names = F.transform("fields", lambda f: F.coalesce(f["name"], F.lit("")))
    return (
        F.when(F.coalesce(_trimmed(F.col("name")), F.lit("")) == "", "a command needs a name")
        .when(F.array_contains(names, "") | (F.size(F.array_distinct(names)) < F.size(names)), "field names must be set and unique")
        .when(F.exists(names, lambda n: F.lower(n).isin("with", "and")), "a field has the name of a delimiter")
    )


def problems(command_defs: DataFrame) -> DataFrame:
    """(position, name, problem) of the rows that define no command."""
    return command_defs.select("position", "name", _problem().alias("problem")).filter("problem is not null")


def definitions(command_defs: DataFrame) -> DataFrame:
    """(name, n_words, position, confirm, fields) from rows of position, name, confirm and fields
    array<struct<name, required, kind, enum, default, default_all>>. Of rows with one name
    the first counts. Rows with ``problems`` define nothing. They are worked out once, as
    every lookup reads them."""
    name = _trimmed(F.col("name"))
    rows = command_defs.repartition("name", "position").filter(_problem().isNull())
    fields = F.coalesce(F.transform("fields", _field), F.array().cast(f"array<{FIELD}>")).cast(f"array<{FIELD}>")
    command = F.struct("position", F.coalesce("confirm", F.lit(False)).alias("confirm"), fields.alias("fields"))
    first = rows.groupBy(name.alias("name")).agg(F.min(command).alias("c"))
    return cut(first.select("name", F.size(F.split("name", f"{SPACE}+")).alias("n_words"), "c.*"))


def _call(n_words: int) -> str:
    """The first words of a message, exactly as they stand, and what follows them."""
    return rf"(?d)\A{SPACE}*((?:{_WORD}{SPACE}++){{{n_words - 1}}}{_WORD})({SPACE}.*)?\z"


def _said(text: Column, most: int) -> Column:
    """What of a message decides the command it means, itself a message that means the same:
    ``help`` and what it asks about, or else up to ``most`` first words. Of a text in several
    lines it is all, as no name is called before a line that ends further on."""
    wanted = trim_space(F.regexp_extract(text, HELP, 1))
    first = F.regexp_extract(text, rf"(?d)\A{SPACE}*((?:{_WORD}{SPACE}++){{0,{most - 1}}}{_WORD})", 1)
    spoken = F.when(text.contains("\n"), text).otherwise(F.nullif(first, F.lit("")))
    return F.when(F.col("__help.requested"), F.concat(F.lit(ASKED), F.nullif(wanted, F.lit("")))).otherwise(spoken)


def dispatched(messages: DataFrame, commands: DataFrame, text: str, limit: int = HOT_ROWS) -> DataFrame:
    """Add ``__help`` (requested, command), ``__command`` (name, confirm, fields; null if no
    command is called) and ``__rest``, what follows its name. ``commands`` are
    ``definitions``."""
    small = small_enough(commands)
    lengths = sorted(row[0] for row in commands.select("n_words").distinct().collect())  # one number per length of a name
    out = messages.withColumn("__help", F.struct(F.col(text).rlike(HELP).alias("requested")))
    out = out.withColumn("__said", _said(F.col(text), max(lengths, default=1)))
    counts = cut(out.groupBy("__said").agg(F.count("*").alias("n_rows")))
    said = counts.select("__said").filter("__said is not null")
    is_asked = F.col("__said").startswith(ASKED)
    calls = _called(said.filter(~is_asked), commands, lengths, limit, small)
    asked = _asked(said.filter(is_asked), commands.select("name", "position"), limit, small)
    meant = cut(calls.unionByName(asked, allowMissingColumns=True))
    out = look_up(out, meant, "__said", limit, counts=counts)
    rest = F.coalesce(*[F.when(F.col("__best.n_words") == n, F.regexp_extract(text, _call(n), 2)) for n in lengths], F.lit(None))
    help_ = F.struct(F.col("__help.requested").alias("requested"), F.col("__about").alias("command"))
    return out.withColumns({"__command": F.col("__best.command"), "__rest": rest, "__help": help_}).drop("__said", "__best", "__about")


def _called(said: DataFrame, commands: DataFrame, lengths: list[int], limit: int, small: bool) -> DataFrame:
    """(__said, __best): the command with the lowest position of those its first words name."""
    names = F.array(*[F.regexp_extract("__said", _call(n), 1) for n in lengths]).cast("array<string>")
    calls = said.select("__said", F.explode(names).alias("name")).filter("name <> ''")
    entry = F.struct("position", "n_words", F.struct("name", "confirm", "fields").alias("command")).cast(MEANT)
    found = look_up(calls, commands.select("name", entry.alias("__entry")), "name", limit, small)
    return found.filter("__entry is not null").groupBy("__said").agg(F.min("__entry").alias("__best"))


def _asked(said: DataFrame, names: DataFrame, limit: int, small: bool) -> DataFrame:
    """(__said, __about): the name that stands first in what a request for help is about;
    of those that start at one place the one with the lowest position.

    A name is met by its head, the largest power of two of characters it has. A place in a
    text looks up a head of each power, and is compared with the names of those it finds, by
    their lengths."""
    size = F.char_length("name")
    power = F.expr("shiftleft(1, char_length(bin(char_length(name))) - 1)")
    measured = names.select(F.substr("name", F.lit(1), power).alias("__head"), power.alias("__power"), size.alias("__size"))
    heads = cut(measured.groupBy("__head").agg(F.first("__power").alias("__power"), F.collect_set("__size").alias("__sizes")))
    # one number per power of two up to the longest name
    powers = F.array(*[F.lit(row[0]) for row in heads.select("__power").distinct().collect()]).cast("array<int>")
    wanted = F.substr("__said", F.lit(len(ASKED) + 1))
    left = F.char_length("__wanted") - F.col("__at") + 1
    places = said.select("__said", wanted.alias("__wanted")).withColumn("__at", F.explode(F.sequence(F.lit(1), F.char_length("__wanted"))))
    places = places.withColumn("__power", F.explode(F.filter(powers, lambda n: n <= left)))
    places = places.withColumn("__head", F.substr("__wanted", "__at", "__power")).drop("__power")
    near = look_up(places, heads.drop("__power"), "__head", limit).filter("__sizes is not null")
    pieces = near.select("__said", "__wanted", "__at", F.explode(F.filter("__sizes", lambda n: n <= left)).alias("__size"))
    pieces = pieces.select("__said", "__at", F.substr("__wanted", "__at", "__size").alias("name"))
    entries = names.select("name", F.struct("position").alias("__entry"))
    met = look_up(pieces, entries, "name", limit, small).filter("__entry is not null")
    first = met.groupBy("__said").agg(F.min(F.struct("__at", "__entry.position", "name")).alias("first"))
    return first.select("__said", F.col("first.name").alias("__about"))


def filled_values(parsed: DataFrame, commands: DataFrame, limit: int = HOT_ROWS) -> DataFrame:
    """The called commands with ``values`` for every field, defaults where none were given."""
    called = parsed.filter(F.col("command").isNotNull() & F.col("error_class").isNull())
    known = commands.select(F.col("name").alias("command"), F.col("fields").alias("__fields"))
    value = lambda f: F.struct(f["name"], F.coalesce(F.element_at("values", f["name"]), f["defaults"]))
    values = F.map_from_entries(F.transform("__fields", value))
    small = small_enough(known)
    if not small:  # else they would be parsed again to be counted
        called = cut(called)
    return look_up(called, known, "command", limit, small).withColumn("values", values).select(*parsed.columns)
