"""Chat commands: message routing, parsing against a dialog, help, and the
state of each conversation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.predicates import confirm_kind, from_bot, mention, mentions
from tidewatch.functions.text import SPACE, capitalize, quoted, trim_space
from tidewatch.functions.tokenizer import is_delimiter, tokenize
from tidewatch.operators import dialogs
from tidewatch.plans.ordered import HOT_ROWS, OrderedGroups, join_same, latest, running_max, running_sum

STRING, ENUM = "string", "enum"

# Texts of the replies.
UNRECOGNIZED_THREAD = "I'm sorry, I did not recognize this conversation. You can type `help` to get a help blurb."
HELP_HEADER = "Here are the supported commands:\n"
HELP_LINES = ["* `help` to print this help message", "* `help <command>` to get help on individual command"]
NOT_PARSED = "could not parse the command"
NOT_QUEUED = "Failed to confirm command - internal error. Check logs for details."


@dataclass(frozen=True)
class Field:
    """One parameter of a command: a single string or words out of ``enum``."""

    name: str
    required: bool = False
    help: str = ""
    enum: tuple[str, ...] | None = None
    default: tuple[str, ...] = ()
    default_all: bool = False

    @property
    def kind(self) -> str:
        return STRING if self.enum is None else ENUM

    def help_text(self) -> str:
        shape = "string" if self.enum is None else f"one of {','.join(self.enum)}"
        return self.help or f"`{self.name}` {shape}"

    def default_values(self) -> list[str]:
        if self.default:
            return list(self.default)
        if self.enum is not None and self.default_all:
            return list(self.enum)
        return [""]


@dataclass(frozen=True)
class Command:
    name: str
    fields: tuple[Field, ...] = field(default_factory=tuple)
    help: str = ""
    confirm: bool = False

    def __post_init__(self) -> None:
        names = [f.name for f in self.fields]
        if not self.name:
            raise ValueError("a command needs a name")
        if "" in names or len(set(names)) != len(names):
            raise ValueError(f"field names of {self.name!r} must be set and unique")
        if any(n.lower() in ("with", "and") for n in names):
            raise ValueError(f"a field of {self.name!r} has the name of a delimiter")

    def help_text(self) -> str:
        if self.help:
            return f"`{self.name}` {self.help}"
        return f"`{self.name}`, parameters: {','.join(f.help_text() for f in self.fields)}"


def general_help(commands: list[Command]) -> str:
    lines = [*HELP_LINES, *[f"* {c.help_text()}" for c in commands]]
    return HELP_HEADER + "\n".join(lines) + "\n"


def help_lines(command_defs: DataFrame) -> DataFrame:
    """Help text per row of a command table: position, name, help and
    fields array<struct<name, help, kind, enum>> in display order."""
    own = F.transform(
        "fields",
        lambda f: F.when(F.coalesce(f["help"], F.lit("")) != "", f["help"]).otherwise(
            F.concat(
                F.lit("`"),
                f["name"],
                F.lit("` "),
                F.when(f["kind"] == ENUM, F.concat(F.lit("one of "), F.array_join(f["enum"], ","))).otherwise("string"),
            )
        ),
    )
    with_help = F.concat(F.lit("`"), "name", F.lit("` "), "help")
    with_fields = F.concat(F.lit("`"), "name", F.lit("`, parameters: "), F.array_join(own, ","))
    text = F.when(F.coalesce("help", F.lit("")) != "", with_help).otherwise(with_fields)
    return command_defs.select("position", "name", text.alias("help_text"))


def command_schema(command: Command) -> T.StructType:
    """Columns of a command's event: capitalised field names, text or list."""
    types = {STRING: T.StringType(), ENUM: T.ArrayType(T.StringType())}
    return T.StructType([T.StructField(_column_name(f), types[f.kind]) for f in command.fields])


def _column_name(f: Field) -> str:
    return f.name[:1].upper() + f.name[1:]


# --- routing -----------------------------------------------------------------


def route_messages(messages: DataFrame, self_id: str) -> DataFrame:
    """Messages that concern the bot, with ``thread`` and ``route``.

    opens: a mention outside a thread starts one, named after its own time.
    known / unknown: a reply in a thread opened (or not) at or before it.
    """
    human = messages.filter(~F.coalesce(from_bot(F.col("user"), F.col("bot_id"), self_id), F.lit(True)))
    outside = F.col("thread_ts").isNull()
    addressed = human.filter(~outside | mentions(F.col("text"), self_id))
    openers = (
        addressed.filter(outside)
        .select("channel", F.col("ts").alias("thread_ts"), F.lit(True).alias("__opened"))
        .distinct()
    )
    replies = addressed.filter(~outside).join(openers, ["channel", "thread_ts"], "left")
    known = F.col("__opened").isNotNull() & (F.col("thread_ts") <= F.col("ts"))
    opened = addressed.filter(outside).withColumns({"thread": F.col("ts"), "route": F.lit("opens")})
    replied = replies.withColumns({"thread": F.col("thread_ts"), "route": F.when(known, "known").otherwise("unknown")})
    return opened.unionByName(replied.drop("__opened"))


# --- parsing -----------------------------------------------------------------


def _dialog(commands: list[Command]) -> Column:
    """The command definitions as one constant array column."""
    strings = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<string>")

    def one(f: Field) -> Column:
        return F.struct(
            F.lit(f.name).alias("name"),
            F.lit(f.required).alias("required"),
            F.lit(f.kind).alias("kind"),
            strings(f.enum or ()).alias("enum"),
            strings(f.default_values()).alias("defaults"),
        )

    field_type = "array<struct<name:string,required:boolean,kind:string,enum:array<string>,defaults:array<string>>>"
    return F.array(
        *[
            F.struct(F.lit(c.name).alias("name"), F.lit(c.confirm).alias("confirm"), F.array(*[one(f) for f in c.fields]).cast(field_type).alias("fields"))
            for c in commands
        ]
    )


def _first_match(conditions: list[Column]) -> Column:
    """1-based number of the first condition that holds, else NULL."""
    return F.coalesce(*[F.when(cond, i + 1) for i, cond in enumerate(conditions)], F.lit(None))


def _invocation(name: str) -> str:
    return rf"(?d)\A{SPACE}*{quoted(name)}({SPACE}.*)?\z"


def requested_help(text: Column, commands: list[Command]) -> Column:
    """struct(requested boolean, command): the first command name found after
    ``help``; NULL asks for general help."""
    rest = trim_space(F.coalesce(F.regexp_extract(text, dialogs.HELP, 1), F.lit("")))
    names = "|".join(quoted(c.name) for c in commands) or r"\z."
    return F.struct(
        text.rlike(dialogs.HELP).alias("requested"), F.nullif(F.regexp_extract(rest, names, 0), F.lit("")).alias("command")
    )


def _group_starts(words: Column) -> Column:
    """Positions of the delimiters, and of the first word."""
    every = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(every, lambda i: (i == 0) | is_delimiter(F.get(words, i)))


def _groups(words: Column, starts: Column) -> Column:
    """Words cut before every delimiter, each with the word that follows it."""

    def one(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get(starts, k + 1), F.size(words))
        return F.struct(F.slice(words, start + 1, end - start).alias("words"), F.get(words, end).alias("next"))

    return F.transform(starts, one)


def _group_result(group: Column, command: Column) -> Column:
    """struct(name, values, error) of one ``with <field> <values>`` group."""
    words = group["words"]
    name, values = F.get(words, F.lit(1)), F.slice(words, 3, F.greatest(F.size(words) - 2, F.lit(0)))
    spec = F.get(F.filter(command["fields"], lambda f: f["name"] == name), F.lit(0))
    ticked = lambda names: F.array_join(F.transform(names, lambda n: F.concat(F.lit("`"), n, F.lit("`"))), ", ")
    supported = ticked(F.transform(command["fields"], lambda f: f["name"]))
    unknown = F.array_except(values, spec["enum"])
    prefix = F.concat(F.lit("for command `"), command["name"], F.lit("` parameters, expected `with` followed by "))

    def unrecognized(field_name: Column) -> Column:
        return F.concat(F.lit("could not recognize parameter `"), field_name, F.lit("`, supported parameters are "), supported)

    error = (
        F.when((F.size(words) < 2) & group["next"].isNull(), F.concat(prefix, F.lit("parameter names")))
        .when(
            ~is_delimiter(F.get(words, F.lit(0))),
            F.concat(prefix, F.lit("the field name, for example `with version 2.2.3`")),
        )
        .when(F.size(words) < 2, unrecognized(group["next"]))
        .when(spec.isNull(), unrecognized(name))
        .when(F.size(values) == 0, F.concat(F.lit("parameter `"), name, F.lit("` has no value")))
        .when((spec["kind"] == STRING) & (F.size(values) != 1), F.concat(F.lit("expected a single value, got "), _go_list(values)))
        .when(
            (spec["kind"] == ENUM) & (F.size(unknown) > 0),
            F.concat(
                F.lit("parameter `"), F.get(unknown, F.lit(0)), F.lit("` is not recognized, supported values are "), ticked(spec["enum"])
            ),
        )
    )
    return F.struct(name.alias("name"), values.alias("values"), error.alias("error"))


def _go_list(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(values, " "), F.lit("]"))


def _dispatched(messages: DataFrame, commands: list[Command], text: str) -> DataFrame:
    """As ``dialogs.dispatched``, for a dialog that is part of the plan."""
    body = F.col(text)
    number = _first_match([body.rlike(_invocation(c.name)) for c in commands])
    rest = [F.when(F.col("__number") == i + 1, F.regexp_extract(body, _invocation(c.name), 1)) for i, c in enumerate(commands)]
    return (
        messages.withColumn("__help", requested_help(body, commands))
        .withColumn("__number", F.when(~F.col("__help.requested"), number))
        .withColumn("__rest", F.coalesce(*rest, F.lit(None)))
        .withColumn("__command", F.when(F.col("__number").isNotNull(), F.get(_dialog(commands), F.col("__number") - 1)))
        .drop("__number")
    )


def parse_commands(messages: DataFrame, commands: list[Command] | DataFrame, text: str = "text", limit: int = HOT_ROWS) -> DataFrame:
    """Messages with ``command``, ``values`` (map of field to words),
    ``error_class`` (NOT_FOUND, BAD_PARAMETER or NULL), ``error``,
    ``requested_help`` and ``help_command``. Commands are tried in order. They may
    be a table (``dialogs.definitions``), tried by position."""
    if isinstance(commands, DataFrame):
        dispatched = dialogs.dispatched(messages, commands, text, limit)
    else:
        dispatched = _dispatched(messages, commands, text)
    staged = (
        dispatched.withColumn("__words", tokenize(F.col("__rest")))
        .withColumn("__starts", _group_starts(F.col("__words")))
        .withColumn("__groups", _groups(F.col("__words"), F.col("__starts")))
    )
    results = staged.withColumn("__results", F.transform("__groups", lambda g: _group_result(g, F.col("__command"))))
    failed = F.get(F.filter("__results", lambda r: r["error"].isNotNull()), F.lit(0))["error"]
    given = F.transform("__results", lambda r: r["name"])
    missing = F.get(
        F.filter("__command.fields", lambda f: f["required"] & ~F.array_contains(F.col("__given"), f["name"])), F.lit(0)
    )["name"]
    missing_error = F.when(
        missing.isNotNull(),
        F.concat(F.lit("provide required parameter `"), missing, F.lit("`, for example `"), F.col("__command.name"), F.lit(" with "), missing, F.lit(" <value>`")),
    )
    judged = (
        results.withColumn("__given", given)
        .withColumn("__error", F.when(F.col("__command").isNotNull(), F.coalesce(failed, missing_error)))
    )
    # The last repeat of a field wins: keep a result when no later one has its name.
    kept = F.filter(
        F.col("__results"),
        lambda r, i: ~F.array_contains(F.slice("__given", i + 2, F.size("__given")), r["name"]),
    )
    values = F.map_from_entries(F.transform(kept, lambda r: F.struct(r["name"], r["values"])))
    is_help = F.col("__help.requested")
    error = F.when(~is_help & F.col("__command").isNull(), NOT_PARSED).otherwise(F.col("__error"))
    error_class = F.when(~is_help & F.col("__command").isNull(), "NOT_FOUND").when(F.col("__error").isNotNull(), "BAD_PARAMETER")
    parsed = F.struct(
        F.col("__command.name").alias("command"),
        F.col("__command.confirm").alias("confirm"),
        F.when(F.col("__command").isNotNull() & F.col("__error").isNull(), values).alias("values"),
        error_class.alias("error_class"),
        error.alias("error"),
        is_help.alias("requested_help"),
        F.col("__help.command").alias("help_command"),
    )
    # inline() keeps later filters from being merged into the expressions above,
    # which would parse every text many times over
    return judged.select(*messages.columns, F.inline(F.array(parsed)))


def command_errors(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("error_class").isNotNull())


def command_values(parsed: DataFrame, command: Command) -> DataFrame:
    """Typed event columns of one command: a column per field under its
    capitalised name, defaults where the field was not given."""
    rows = parsed.filter((F.col("command") == command.name) & F.col("error_class").isNull())
    base = [c for c in parsed.columns if c not in ("values", "error", "error_class", "confirm", "requested_help", "help_command")]
    return rows.select(*base, *[_field_value(f).alias(_column_name(f)) for f in command.fields])


def _field_value(f: Field) -> Column:
    given = F.element_at("values", F.lit(f.name))
    defaults = F.array(*[F.lit(v) for v in f.default_values()])
    return F.coalesce(given, defaults) if f.kind == ENUM else F.get(F.coalesce(given, defaults), F.lit(0))


# --- conversations -----------------------------------------------------------


def _shown_values(commands: list[Command], brackets: bool) -> Column:
    """Values in name order: ``map[a:[x y] b:z]``, or ``a: [x y], b: z``."""
    enums = F.array(*[F.lit(f"{c.name}\x1f{f.name}") for c in commands for f in c.fields if f.kind == ENUM]).cast("array<string>")
    entries = F.array_sort(F.map_entries(F.coalesce("values", F.create_map().cast("map<string,array<string>>"))))
    separator = ":" if brackets else ": "

    def one(e: Column) -> Column:
        is_list = F.array_contains(enums, F.concat("command", F.lit("\x1f"), e["key"]))
        return F.concat(e["key"], F.lit(separator), F.when(is_list, _go_list(e["value"])).otherwise(F.get(e["value"], F.lit(0))))

    shown = F.array_join(F.transform(entries, one), " " if brackets else ", ")
    return F.concat(F.lit("map["), shown, F.lit("]")) if brackets else shown


def coded_messages(messages: DataFrame, commands: list[Command], self_id: str = "", text: str = "text") -> DataFrame:
    """Messages with what each would do to a thread: ``__asks`` (a command that
    needs confirming), ``__runs`` (one that does not) and ``__answer``."""
    clean = trim_space(F.replace(text, mention(self_id), F.lit("")) if self_id else F.col(text))
    parsed = parse_commands(messages.withColumn("__clean", clean), commands, "__clean")
    runnable = F.col("error_class").isNull() & ~F.col("requested_help")
    return parsed.withColumns(
        {
            "__asks": runnable & F.col("confirm"),
            "__runs": runnable & ~F.col("confirm"),
            "__answer": confirm_kind(F.col("__clean")),
            "__shown": _shown_values(commands, True),
            "__listed": _shown_values(commands, False),
        }
    )


#: What a command of a thread is remembered by, and the state of a thread between batches:
#: whether it waits for a command or for a yes, or is done, with the command it is about.
CHAT = "struct<command:string,values:map<string,array<string>>,__shown:string,__listed:string>"
STATE = f"struct<phase:string,chat:{CHAT}>"


def _seeded(coded: DataFrame) -> DataFrame:
    """Where a row is the state of a thread (``__state``), let it move the thread there:
    to its phase, asking what was asked, or ending with what was started."""
    phase, chat = F.col("__state.phase"), F.col("__state.chat")
    is_state = F.col("__state").isNotNull()
    done = phase == "confirmed"
    return coded.withColumns(
        {
            "__fixed": F.when(is_state, (phase == "confirm").cast("int")).otherwise(F.col("__fixed")),
            "__swap": F.when(is_state, 0).otherwise(F.col("__swap")),
            "__held": F.when(phase == "confirm", chat),
            "__over": F.when(done, chat),
        }
    )


def settled_conversations(
    messages: DataFrame, commands: list[Command], *, thread: list[str], order: list[str], self_id: str = "", text: str = "text", limit: int = HOT_ROWS
) -> DataFrame:
    """Coded messages with the phase each met: ``__phase`` (0 init, 1 confirm), ``__pending``
    (what was asked), ``__confirmed`` (what was started before, if anything) and ``__final``
    (what this message starts). A column ``__state`` marks rows that are no messages but
    the state in which a thread is from there on."""
    yes, no = F.col("__answer").eqNullSafe("CONFIRM"), F.col("__answer").eqNullSafe("ABORT")
    asks, runs = F.col("__asks"), F.col("__runs")
    idle = ~asks & ~runs
    # Moves between the waiting phases (0 init, 1 confirm). Where a message ends
    # the thread from one of them, the phase after it no longer matters.
    to_init = (idle & (no | yes)) | (runs & no)
    to_confirm = (asks & ~no) | (runs & ~no & ~yes)
    chat = F.struct("command", "values", "__shown", "__listed")
    ends = ((F.col("__phase") == 0) & runs) | ((F.col("__phase") == 1) & yes)
    first_end = (F.coalesce("__done", F.lit(0)) == 0) & F.col("__ends")
    if "__state" not in messages.columns:
        messages = messages.withColumn("__state", F.lit(None).cast(STATE))
    is_message = F.col("__state").isNull()
    return (
        OrderedGroups.split(messages, thread, order, limit)
        .transform(lambda d: coded_messages(d, commands, self_id, text))
        .transform(lambda d: _seeded(d.withColumns({"__swap": (asks & no).cast("int"), "__fixed": F.when(to_init, 0).when(to_confirm, 1)})))
        .running({"__swaps": running_sum(F.col("__swap"))})
        .transform(lambda d: d.withColumn("__base", (F.col("__fixed") + F.col("__swaps")) % 2))
        .running({"__last": latest(F.col("__base"))})
        .transform(lambda d: d.withColumn("__phase", (F.coalesce("__last", F.lit(0)) + F.col("__swaps")) % 2))
        .transform(
            lambda d: d.withColumns(
                {
                    "__ends": (is_message & ends) | F.col("__over").isNotNull(),
                    "__asked": F.coalesce("__held", F.when(is_message & (F.col("__phase") == 0) & asks, chat)),
                }
            )
        )
        .running({"__pending": latest(F.col("__asked")), "__done": running_max(F.col("__ends").cast("int"))})
        .transform(
            lambda d: d.withColumn(
                "__final", F.coalesce("__over", F.when(first_end, F.when(F.col("__phase") == 1, F.col("__pending")).otherwise(chat)))
            )
        )
        .running({"__confirmed": latest(F.col("__final"))})
        .rows()
    )


def thread_states(settled: DataFrame, thread: list[str], order: list[str]) -> DataFrame:
    """The ``__state`` each thread is in after its last row, and ``__last``, the place of
    that row: one pass with a partial aggregate, no sort."""
    after = (F.coalesce("__fixed", F.col("__phase")) + F.col("__swap")) % 2
    # a fixed move and a swap exclude each other
    waits = F.when(after == 1, F.struct(F.lit("confirm").alias("phase"), F.coalesce("__asked", "__pending").alias("chat"))).otherwise(
        F.struct(F.lit("init").alias("phase"), F.lit(None).cast(CHAT).alias("chat"))
    )
    over = F.coalesce("__confirmed", "__final")
    state = F.when(over.isNotNull(), F.struct(F.lit("confirmed").alias("phase"), over.alias("chat"))).otherwise(waits).cast(STATE)
    place = F.struct(*order)
    return settled.groupBy(*thread).agg(F.max_by(state, place).alias("__state"), F.max(place).alias("__last"))


def conversations(
    messages: DataFrame,
    commands: list[Command],
    *,
    thread: list[str],
    order: list[str],
    self_id: str = "",
    text: str = "text",
    limit: int = HOT_ROWS,
) -> DataFrame:
    """Each message of a thread with the phase it met, the reply and whether it
    starts a run (``is_event``, with ``command`` and ``values`` of that run).

    A thread waits for a command (init), for a yes or no (confirm), or is done
    (confirmed). What a message does to a waiting thread is one of four moves:
    to init, to confirm, swap the two, or none. The phase before a message is
    therefore the last fixed move, swapped once per swap since; the first message
    that confirms or runs unconfirmed ends it. Only running sums and last
    values are needed, which hold for threads of any size.
    """
    settled = settled_conversations(messages, commands, thread=thread, order=order, self_id=self_id, text=text, limit=limit)
    return with_replies(settled, commands, messages.columns)


def with_replies(settled: DataFrame, commands: list[Command], columns: list[str]) -> DataFrame:
    """Phase, reply and started run of coded messages whose phase is known."""
    done = F.col("__confirmed").isNotNull()
    phase = F.when(done, "confirmed").when(F.col("__phase") == 1, "confirm").otherwise("init")
    help_by_command = F.create_map(*[F.lit(x) for c in commands for x in (c.name, c.help_text())])
    help_reply = F.coalesce(F.element_at(help_by_command, F.col("help_command")), F.lit(general_help(commands)))
    sentence = capitalize(F.concat("error", F.lit(".")))

    def about(prefix: str, chat: str | None) -> Column:
        name = F.col(f"{chat}.command") if chat else F.col("command")
        shown = F.col(f"{chat}.__shown") if chat else F.col("__shown")
        return F.concat(F.lit(f"{prefix} command: "), name, F.lit(" with values "), shown)

    def prompt(name: Column, listed: Column) -> Column:
        return F.concat(
            F.lit("Please confirm that you want to execute command `"),
            name,
            F.lit("`"),
            F.when(listed != "", F.concat(F.lit(" with parameters `"), listed, F.lit("`"))).otherwise(""),
            F.lit(" (yes/no)."),
        )

    in_init = (
        F.when(F.col("error_class") == "NOT_FOUND", F.concat(sentence, F.lit("\n" + general_help(commands))))
        .when(F.col("error_class").isNotNull(), sentence)
        .when(F.col("requested_help"), help_reply)
        .when(F.col("confirm"), prompt(F.col("command"), F.col("__listed")))
        .otherwise(about("Executing", None))
    )
    in_confirm = (
        F.when(F.col("__answer") == "CONFIRM", about("Confirmed and executing", "__pending"))
        .when(F.col("__answer") == "ABORT", about("Aborted", "__pending"))
        .otherwise(prompt(F.col("__pending.command"), F.col("__pending.__listed")))
    )
    reply = F.when(done, about("Already executing", "__confirmed")).when(F.col("__phase") == 1, in_confirm).otherwise(in_init)
    return settled.select(
        *columns,
        phase.alias("phase"),
        reply.alias("reply"),
        F.col("__final").isNotNull().alias("is_event"),
        F.col("__final.command").alias("command"),
        F.col("__final.values").alias("values"),
    )


def conversation_events(handled: DataFrame) -> DataFrame:
    return handled.filter("is_event").drop("reply", "phase", "is_event")


def with_failures(handled: DataFrame, dropped: DataFrame, keys: list[str]) -> DataFrame:
    """Handled messages where the run of some could not be queued: ``dropped`` holds the
    ``keys`` of those. Their reply says so and they start nothing; the thread stays confirmed."""
    lost = dropped.select(*keys).distinct().withColumn("__lost", F.lit(True))
    joined = join_same(handled, lost, keys, "left")
    failed = F.col("is_event") & F.col("__lost").isNotNull()
    none = {c: F.when(~failed, F.col(c)) for c in ("command", "values")}
    return joined.withColumns({"reply": F.when(failed, NOT_QUEUED).otherwise(F.col("reply")), "is_event": ~failed & F.col("is_event"), **none}).drop("__lost")


def outgoing_messages(routed: DataFrame, handled: DataFrame) -> DataFrame:
    """Replies with the channel and thread they go to; a reply to a thread that
    was never opened says so."""
    strangers = routed.filter(F.col("route") == "unknown").select(
        "channel", "thread", "ts", F.lit(UNRECOGNIZED_THREAD).alias("reply")
    )
    return handled.select("channel", "thread", "ts", "reply").unionByName(strangers)
