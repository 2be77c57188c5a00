"""Chat commands on the driver tables.

documents are tokenized whole; events say one of a fixed set of phrases each, so
that every outcome of the parser and every move of a conversation occurs (a user
is a thread); conversations are routed to threads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.catalog.registry import query, table
from tidewatch.functions.tokenizer import tokenize
from tidewatch.operators import chat, dialogs, routing
from tidewatch.operators.chat import Command, Field
from tidewatch.session import cut

TAGS = ("a", "b", "c")
DIALOG = [
    Command("deploy", (Field("target", required=True), Field("tags", enum=TAGS, default_all=True)), confirm=True),
    Command("status", (Field("kind", enum=("x y", "z"), default=("z",)), Field("format", default=("text",)))),
]

# Fixed phrases by event type and value band: text, command, values, error class, error.
PHRASES = [
    ("click", 60, "deploy with target web, with tags a, b", "deploy", "tags=a|b;target=web", None, None),
    ("click", 120, 'deploy  with target "web one" and target "two, three"', "deploy", "target=two, three", None, None),
    ("click", 9999, "deploy", "deploy", None, "BAD_PARAMETER", "provide required parameter `target`, for example `deploy with target <value>`"),
    ("view", 60, "deploy with target one two", "deploy", None, "BAD_PARAMETER", "expected a single value, got [one two]"),
    ("view", 9999, "deploy with target x with tags q, a", "deploy", None, "BAD_PARAMETER", "parameter `q` is not recognized, supported values are `a`, `b`, `c`"),
    ("signup", 60, "status", "status", "", None, None),
    ("signup", 9999, 'status AND kind "x y" With format json', "status", "format=json;kind=x y", None, None),
    ("purchase", 60, "deploy with colour red", "deploy", None, "BAD_PARAMETER", "could not recognize parameter `colour`, supported parameters are `target`, `tags`"),
    ("purchase", 9999, "status now please", "status", None, "BAD_PARAMETER", "for command `status` parameters, expected `with` followed by the field name, for example `with version 2.2.3`"),
    ("error", 60, "help me deploy it", None, None, None, None),
    ("error", 120, "helper", None, None, None, None),
    ("error", 9999, "deployment", None, None, "NOT_FOUND", "could not parse the command"),
]


def _phrase_column(position: int) -> Column:
    out = F.lit(None).cast("string")
    for row in reversed(PHRASES):
        out = F.when((F.col("event_type") == row[0]) & (F.col("value") < row[1]), F.lit(row[position]).cast("string")).otherwise(out)
    return out


def _phrase_sql(position: int) -> str:
    def literal(value: str | None) -> str:
        return "NULL" if value is None else "'" + value.replace("'", "''") + "'"

    whens = " ".join(f"WHEN event_type = '{row[0]}' AND value < {row[1]} THEN {literal(row[position])}" for row in PHRASES)
    return f"CASE {whens} END"


def spoken(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("text", _phrase_column(2))


def flat_values(values: str) -> Column:
    entries = F.array_sort(F.map_entries(values))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "|"))), ";")


@query(
    "chat_tokenize",
    """WITH t AS (SELECT doc_id, regexp_extract_all(translate(text, '"' || chr(92), ''), '[^, \\t]+') AS plain FROM documents),
    w AS (SELECT doc_id, list_transform(plain, lambda w, i: CASE i % 4 WHEN 1 THEN w WHEN 2 THEN w || ', ' || chr(92) || w WHEN 3 THEN '' ELSE '"' || w || ' ' END) AS words FROM t)
    SELECT doc_id, len(words) AS n_words, md5(array_to_string(words, chr(31))) AS digest FROM w""",
)
def tokens(spark, sf):
    """Messages written from the words of whole texts: plain, quoted with separators
    and a backslash, empty, and escaped. The words must come back."""
    plain = F.regexp_extract_all(F.translate("text", '"\\', ""), F.lit(r"[^, \t]+"), F.lit(0))

    def written(word: Column, i: Column) -> Column:
        quoted = F.concat(F.lit('"'), word, F.lit(", \\\\"), word, F.lit('"'))
        escaped = F.concat(F.lit('\\"'), word, F.lit("\\ "))
        return F.when(i % 4 == 0, word).when(i % 4 == 1, quoted).when(i % 4 == 2, F.lit('""')).otherwise(escaped)

    message = F.array_join(F.transform(plain, written), ", ")
    docs = table(spark, sf, "documents").select("doc_id", tokenize(message).alias("words"))
    return docs.select("doc_id", F.size("words").cast("long").alias("n_words"), F.md5(F.array_join("words", "\x1f").cast("binary")).alias("digest"))


def parsed(spark: SparkSession, sf: str) -> DataFrame:
    return chat.parse_commands(spoken(spark, sf).select("event_id", "text"), DIALOG)


@query(
    "chat_parse_commands",
    f"SELECT event_id, {_phrase_sql(3)} AS command, {_phrase_sql(4)} AS given, {_phrase_sql(5)} AS error_class FROM events",
)
def parse(spark, sf):
    return parsed(spark, sf).select("event_id", "command", flat_values("values").alias("given"), "error_class")


@query("chat_command_errors", f"SELECT * FROM (SELECT event_id, {_phrase_sql(5)} AS error_class, {_phrase_sql(6)} AS error FROM events) WHERE error_class IS NOT NULL")
def errors(spark, sf):
    return chat.command_errors(parsed(spark, sf)).select("event_id", "error_class", "error")


@query(
    "chat_command_values",
    """SELECT event_id, CASE WHEN value < 60 THEN 'z' ELSE 'x y' END AS Kind, CASE WHEN value < 60 THEN 'text' ELSE 'json' END AS Format FROM events WHERE event_type = 'signup'""",
)
def values(spark, sf):
    typed = chat.command_values(parsed(spark, sf), DIALOG[1])
    return typed.select("event_id", F.array_join("Kind", "|").alias("Kind"), "Format")


@query(
    "chat_command_values_all_enum",
    """SELECT event_id, CASE WHEN value < 60 THEN 'a|b' ELSE 'a|b|c' END AS Tags, CASE WHEN value < 60 THEN 'web' ELSE 'two, three' END AS Target FROM events WHERE event_type = 'click' AND value < 120""",
)
def values_all(spark, sf):
    typed = chat.command_values(parsed(spark, sf), DIALOG[0])
    return typed.select("event_id", F.array_join("Tags", "|").alias("Tags"), "Target")


@query(
    "chat_help_requests",
    "SELECT event_id, event_type = 'error' AND value < 120 AS requested, CASE WHEN event_type = 'error' AND value < 60 THEN 'deploy' END AS command FROM events",
)
def help_requests(spark, sf):
    help_of = chat.requested_help(F.col("text"), DIALOG)
    return spoken(spark, sf).select("event_id", help_of["requested"].alias("requested"), help_of["command"].alias("command"))


@query(
    "chat_help_lines",
    """SELECT p_partkey AS position, p_name AS name, '`' || p_name || CASE WHEN p_size > 40 THEN '` makes ' || p_type
      ELSE '`, parameters: `size` string,' || CASE WHEN p_size % 2 = 0 THEN 'pick a brand' ELSE '`brand` one of ' || p_brand || ',any' END END AS help_text FROM part""",
)
def help_text(spark, sf):
    part = table(spark, sf, "part")
    field = lambda name, help_, kind, enum: F.struct(
        F.lit(name).alias("name"), help_.alias("help"), F.lit(kind).alias("kind"), enum.cast("array<string>").alias("enum")
    )
    defs = part.select(
        F.col("p_partkey").alias("position"),
        F.col("p_name").alias("name"),
        F.when(F.col("p_size") > 40, F.concat(F.lit("makes "), "p_type")).otherwise("").alias("help"),
        F.array(
            field("size", F.lit(""), "string", F.array()),
            field("brand", F.when(F.col("p_size") % 2 == 0, "pick a brand").otherwise(""), "enum", F.array(F.col("p_brand"), F.lit("any"))),
        ).alias("fields"),
    )
    return chat.help_lines(defs)


# --- a dialog kept in a table


def part_commands(spark: SparkSession, sf: str) -> DataFrame:
    """A command per part, with names of one to three words. Some names stand at the
    head of others, and some occur more than once."""
    strings = lambda c: c.cast("array<string>")
    none = strings(F.lit(None))
    name = (
        F.when(F.col("p_partkey") % 4 == 0, F.col("p_name"))
        .when(F.col("p_partkey") % 4 == 1, F.concat_ws(" ", "p_brand", "p_name"))
        .when(F.col("p_partkey") % 4 == 2, F.concat_ws(" ", "p_name", "p_partkey"))
        .otherwise(F.concat(F.lit("part"), "p_partkey"))
    )
    size = (F.lit("size"), F.col("p_size") % 2 == 0, F.lit("string"), none, none, F.lit(False))
    brand = (F.lit("brand"), F.lit(False), F.lit("enum"), F.array("p_brand", F.lit("any")), none, F.col("p_size") % 3 == 0)
    names = ("name", "required", "kind", "enum", "default", "default_all")
    fields = F.array(*[F.struct(*[c.alias(n) for c, n in zip(f, names, strict=True)]) for f in (size, brand)])
    return table(spark, sf, "part").select(F.col("p_partkey").alias("position"), name.alias("name"), (F.col("p_size") > 25).alias("confirm"), fields.alias("fields"))


# What a line item says of its part, by line number; ``quantity`` stands for its own.
ORDERS_SAID = {
    1: " with size quantity",
    2: ' with brand any, with size "quantity units"',
    3: "",
    4: " please",
    5: "x with size 3",
    6: " with colour red",
}


def part_messages(spark: SparkSession, sf: str) -> DataFrame:
    named = part_commands(spark, sf).select(F.col("position").alias("l_partkey"), "name")
    lines = table(spark, sf, "lineitem").join(named, "l_partkey")
    quantity = F.col("l_quantity").cast("int").cast("string")
    text = F.concat(F.lit("help me with "), "name")
    for number, said in ORDERS_SAID.items():
        lead = F.lit("  " if number == 3 else "")
        text = F.when(F.col("l_linenumber") == number, F.concat(lead, "name", F.replace(F.lit(said), F.lit("quantity"), quantity))).otherwise(text)
    return lines.select("l_orderkey", "l_partkey", "l_linenumber", text.alias("text"))


_ORDERS_SQL = " ".join(
    f"WHEN {n} THEN '{'  ' if n == 3 else ''}' || c.name || replace('{said}', 'quantity', CAST(CAST(l_quantity AS INTEGER) AS VARCHAR))" for n, said in ORDERS_SAID.items()
)
PART_SQL = f"""
defs AS (
  SELECT p_partkey AS position, p_size, p_brand, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_brand || ' ' || p_name
    WHEN 2 THEN p_name || ' ' || p_partkey ELSE 'part' || p_partkey END AS name FROM part
), firsts AS MATERIALIZED (SELECT * FROM defs QUALIFY row_number() OVER (PARTITION BY name ORDER BY position) = 1),
said AS MATERIALIZED (
  SELECT row_number() OVER () AS r, l_orderkey, l_partkey, l_linenumber, c.name AS own, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS quantity,
    CASE l_linenumber {_ORDERS_SQL} ELSE 'help me with ' || c.name END AS text
  FROM lineitem JOIN defs c ON c.position = l_partkey
), called AS (
  SELECT s.r, min_by(f.name, f.position) AS command, min_by(f.p_size, f.position) AS p_size, min_by(f.p_brand, f.position) AS p_brand
  FROM (SELECT r, ltrim(text) || ' ' AS t, split_part(ltrim(text), ' ', 1) AS word FROM said WHERE l_linenumber < 7) s
  JOIN (SELECT *, name || ' ' AS n, split_part(name, ' ', 1) AS word FROM firsts) f ON f.word = s.word AND starts_with(s.t, f.n) GROUP BY s.r
), helped AS (
  SELECT r, arg_min(name, row(spot, position)) AS about
  FROM (SELECT s.r, f.name, f.position, instr(substr(s.text, 6), f.name) AS spot FROM said s, firsts f WHERE s.l_linenumber = 7) WHERE spot > 0 GROUP BY r
), judged AS (
  SELECT s.*, c.command, c.p_size, c.p_brand, h.about, s.l_linenumber = 7 AS asked,
    CASE WHEN s.l_linenumber = 7 THEN NULL WHEN c.command IS NULL THEN 'NOT_FOUND'
      WHEN c.command <> s.own OR s.l_linenumber IN (4, 5, 6) OR (s.l_linenumber = 3 AND c.p_size % 2 = 0) THEN 'BAD_PARAMETER' END AS error_class,
    CASE s.l_linenumber WHEN 1 THEN quantity WHEN 2 THEN quantity || ' units' END AS size
  FROM said s LEFT JOIN called c USING (r) LEFT JOIN helped h USING (r)
)"""


def part_calls(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    commands = dialogs.definitions(part_commands(spark, sf))
    return chat.parse_commands(part_messages(spark, sf), commands), commands


@query(
    "chat_table_commands",
    f"""WITH {PART_SQL} SELECT l_orderkey, l_partkey, l_linenumber, text, command,
      CASE WHEN command IS NOT NULL AND error_class IS NULL THEN CASE l_linenumber WHEN 1 THEN 'size=' || size WHEN 2 THEN 'brand=any;size=' || size ELSE '' END END AS given,
      error_class, asked, about FROM judged""",
)
def table_commands(spark, sf):
    """Commands and messages both from tables: which part's command is called, with what."""
    calls, _ = part_calls(spark, sf)
    return calls.select(
        "l_orderkey", "l_partkey", "l_linenumber", "text", "command", flat_values("values").alias("given"), "error_class",
        F.col("requested_help").alias("asked"), F.col("help_command").alias("about"),
    )


@query(
    "chat_table_command_values",
    f"""WITH {PART_SQL} SELECT l_orderkey, l_partkey, l_linenumber, command,
      'brand=' || CASE WHEN l_linenumber = 2 THEN 'any' WHEN p_size % 3 = 0 THEN p_brand || '|any' ELSE '' END || ';size=' || coalesce(size, '') AS given
      FROM judged WHERE command IS NOT NULL AND error_class IS NULL""",
)
def table_command_values(spark, sf):
    calls, commands = part_calls(spark, sf)
    return dialogs.filled_values(calls, commands).select("l_orderkey", "l_partkey", "l_linenumber", "command", flat_values("values").alias("given"))


@query(
    "chat_table_problems",
    """SELECT p_partkey AS position, CASE WHEN p_size % 5 = 0 THEN ' ' ELSE p_name END AS name,
      CASE WHEN p_size % 5 = 0 THEN 'a command needs a name' WHEN p_size % 5 = 1 THEN 'field names must be set and unique' ELSE 'a field has the name of a delimiter' END AS problem
      FROM part WHERE p_size % 5 < 3""",
)
def table_problems(spark, sf):
    """Rows of a table of commands that define none."""
    part = table(spark, sf, "part")
    second = F.when(F.col("p_size") % 5 == 1, "brand").when(F.col("p_size") % 5 == 2, "With").otherwise("size")
    fields = F.array(F.struct(F.lit("brand").alias("name")), F.struct(second.alias("name")))
    rows = part.select(F.col("p_partkey").alias("position"), F.when(F.col("p_size") % 5 == 0, " ").otherwise(F.col("p_name")).alias("name"), fields.alias("fields"))
    return dialogs.problems(rows)


# --- conversations

TALK = [
    Command("deploy", (Field("target"),), confirm=True),
    Command("notify", (), confirm=True),  # holds "no": asks when idle, aborts when asked
    Command("run", ()),
]

# What is said, by event type and value band: text, asked command, answer.
LINES = [
    ("click", 60, "<@BOT> deploy with target web", "deploy", None),
    ("click", 70, "deploy with target a b", None, None),
    ("click", 9999, "hm", None, None),
    ("view", 9999, "notify", "notify", "ABORT"),
    ("signup", 5, "yes", None, "CONFIRM"),
    ("signup", 9999, "help deploy", None, None),
    ("purchase", 100, "cancel", None, "ABORT"),
    ("purchase", 250, "what", None, None),
    ("purchase", 9999, "run", "run", None),
    ("error", 9999, "nope", None, "ABORT"),
]


def talk(spark: SparkSession, sf: str) -> DataFrame:
    return as_talk(table(spark, sf, "events"))


def as_talk(ev: DataFrame) -> DataFrame:
    text = F.lit(None).cast("string")
    for kind, below, line, _, _ in reversed(LINES):
        text = F.when((F.col("event_type") == kind) & (F.col("value") < below), line).otherwise(text)
    return ev.select(F.col("user_id").alias("thread"), "ts", "event_id", text.alias("text"))


def _line_sql(position: int) -> str:
    whens = " ".join(
        f"WHEN event_type = '{row[0]}' AND value < {row[1]} THEN " + ("NULL" if row[position] is None else f"'{row[position]}'") for row in LINES
    )
    return f"CASE {whens} END"


_HELP = chat.general_help(TALK).replace("'", "''").replace("\n", "' || chr(10) || '")

TALK_SQL = f"""
said AS (
  SELECT user_id AS thread, event_id, ts, {_line_sql(2)} AS text, {_line_sql(3)} AS asked, {_line_sql(4)} AS answer,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
walk AS (
  SELECT DISTINCT thread, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS event_id, '' AS text, CAST(NULL AS VARCHAR) AS said_asked, CAST(NULL AS VARCHAR) AS said_answer,
    'init' AS before, CAST(NULL AS VARCHAR) AS before_chat, 'init' AS phase, CAST(NULL AS VARCHAR) AS chat FROM said
  UNION ALL
  SELECT s.thread, s.n, s.event_id, s.text, s.asked, s.answer, w.phase, w.chat,
    CASE WHEN w.phase = 'init' AND s.asked = 'run' THEN 'confirmed' WHEN w.phase = 'init' AND s.asked IS NOT NULL THEN 'confirm'
      WHEN w.phase = 'confirm' AND s.answer = 'CONFIRM' THEN 'confirmed' WHEN w.phase = 'confirm' AND s.answer = 'ABORT' THEN 'init' ELSE w.phase END,
    CASE WHEN w.phase = 'init' THEN s.asked ELSE w.chat END
  FROM walk w JOIN said s ON s.thread = w.thread AND s.n = w.n + 1),
told AS (
  SELECT thread, event_id, text, said_asked, said_answer, before AS phase, phase AS after, chat,
    CASE chat WHEN 'deploy' THEN 'deploy with values map[target:web]' ELSE chat || ' with values map[]' END AS shown,
    'Please confirm that you want to execute command `' || chat || '`' || CASE WHEN chat = 'deploy' THEN ' with parameters `target: web`' ELSE '' END || ' (yes/no).' AS prompt
  FROM walk WHERE n > 0)
"""

REPLY_SQL = f"""CASE
  WHEN phase = 'confirmed' THEN 'Already executing command: ' || shown
  WHEN phase = 'confirm' AND said_answer = 'CONFIRM' THEN 'Confirmed and executing command: ' || shown
  WHEN phase = 'confirm' AND said_answer = 'ABORT' THEN 'Aborted command: ' || shown
  WHEN phase = 'confirm' THEN prompt
  WHEN said_asked = 'run' THEN 'Executing command: run with values map[]'
  WHEN said_asked IS NOT NULL THEN prompt
  WHEN starts_with(text, 'help') THEN '`deploy`, parameters: `target` string'
  WHEN text = 'deploy with target a b' THEN 'Expected a single value, got [a b].'
  ELSE 'Could not parse the command.' || chr(10) || '{_HELP}' END"""


def handled(spark: SparkSession, sf: str) -> DataFrame:
    return chat.conversations(talk(spark, sf), TALK, thread=["thread"], order=["ts", "event_id"], self_id="BOT")


@query("chat_conversations", f"WITH RECURSIVE {TALK_SQL} SELECT thread, event_id, phase, {REPLY_SQL} AS reply, phase <> 'confirmed' AND after = 'confirmed' AS is_event FROM told")
def conversations(spark, sf):
    return handled(spark, sf).select("thread", "event_id", "phase", "reply", "is_event")


@query(
    "chat_conversation_events",
    f"""WITH RECURSIVE {TALK_SQL} SELECT thread, event_id, chat AS command, CASE WHEN chat = 'deploy' THEN 'target=web' ELSE '' END AS given
    FROM told WHERE phase <> 'confirmed' AND after = 'confirmed'""",
)
def conversation_events(spark, sf):
    return chat.conversation_events(handled(spark, sf)).select("thread", "event_id", "command", flat_values("values").alias("given"))


@query(
    "chat_queue_failures",
    f"""WITH RECURSIVE {TALK_SQL}, started AS (
      SELECT thread, event_id, row_number() OVER (PARTITION BY chat, e.ts::DATE ORDER BY e.ts, event_id) > 2 AS lost
      FROM told JOIN events e USING (event_id) WHERE phase <> 'confirmed' AND after = 'confirmed')
    SELECT t.thread, t.event_id, t.phase, CASE WHEN s.lost THEN 'Failed to confirm command - internal error. Check logs for details.' ELSE {REPLY_SQL} END AS reply,
      coalesce(NOT s.lost, false) AS is_event, CASE WHEN NOT s.lost THEN chat END AS command
    FROM told t LEFT JOIN started s USING (event_id)""",
)
def queue_failures(spark, sf):
    """Runs of a command that find its queue of the day full."""
    talked = cut(handled(spark, sf))
    _, dropped = routing.admit(talked.filter("is_event"), ["command"], "1 day", ["ts", "event_id"], 2)
    return chat.with_failures(talked, dropped, ["thread", "event_id"]).select("thread", "event_id", "phase", "reply", "is_event", "command")


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as channel messages: the first turn opens the thread where
    it mentions the bot."""
    c = table(spark, sf, "conversations")
    first = F.col("turn") == 0
    text = (
        F.when(first & (F.col("conv_id") % 4 != 0), F.concat(F.lit("<@BOT> "), "text"))
        .when(F.col("turn") == 1, "help deploy")
        .when(F.col("turn") == 2, "run")
        .otherwise(F.col("text"))
    )
    return c.select(
        F.concat(F.lit("c"), F.col("conv_id") % 3).alias("channel"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("ts"),
        F.when(~first, F.col("conv_id") * 1000).alias("thread_ts"),
        F.when(F.col("role") == "system", "BOT").otherwise(F.col("role")).alias("user"),
        F.lit(None).cast("string").alias("bot_id"),
        text.alias("text"),
    )


ROUTE_SQL = """
routed AS (
  SELECT 'c' || (c.conv_id % 3) AS channel, c.conv_id * 1000 + c.turn AS ts, c.conv_id * 1000 AS thread, c.turn,
    CASE WHEN c.turn = 0 THEN 'opens' WHEN o.conv_id IS NULL THEN 'unknown' ELSE 'known' END AS route
  FROM conversations c LEFT JOIN (SELECT conv_id FROM conversations WHERE turn = 0 AND role <> 'system' AND conv_id % 4 <> 0) o ON o.conv_id = c.conv_id
  WHERE c.role <> 'system' AND (c.turn > 0 OR c.conv_id % 4 <> 0))
"""


@query("chat_route_messages", f"WITH {ROUTE_SQL} SELECT channel, ts, thread, route FROM routed")
def route(spark, sf):
    return chat.route_messages(messages(spark, sf), "BOT").select("channel", "ts", "thread", "route")


@query(
    "chat_outgoing_messages",
    f"""WITH {ROUTE_SQL}, ran AS (SELECT thread FROM routed WHERE route = 'known' AND turn = 2)
    SELECT channel, thread, ts, CASE WHEN route = 'unknown' THEN 'I''m sorry, I did not recognize this conversation. You can type `help` to get a help blurb.'
      WHEN turn > 2 AND thread IN (FROM ran) THEN 'Already executing command: run with values map[]'
      WHEN turn = 2 THEN 'Executing command: run with values map[]'
      WHEN turn = 1 THEN '`deploy`, parameters: `target` string'
      ELSE 'Could not parse the command.' || chr(10) || '{_HELP}' END AS reply FROM routed""",
)
def outgoing(spark, sf):
    routed = chat.route_messages(messages(spark, sf), "BOT")
    talked = chat.conversations(
        routed.filter(F.col("route") != "unknown"), TALK, thread=["channel", "thread"], order=["ts"], self_id="BOT"
    )
    return chat.outgoing_messages(routed, talked)
