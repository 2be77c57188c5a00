"""Chat words, commands and conversations."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidewatch.functions.predicates import confirm_kind
from tidewatch.functions.tokenizer import tokenize
from tidewatch.operators import chat, dialogs
from tidewatch.operators.chat import Command, Field
from tidewatch.plans import ordered
from tidewatch.streaming.conversations import stream_conversations
from tidewatch.streaming.jobs import stream_table

GO = ("go-build", "go-check")
LETTERS = 'xyz\\", \t\né𝒳'


def quoted(word):
    return '"' + word.replace("\\", "\\\\").replace('"', '\\"') + '"'


def escaped(word):
    return re.sub(r'([\\", \t])', r"\\\1", word)


def random_words(seed, n, least):
    draw = random.Random(seed)
    return [["".join(draw.choices(LETTERS, k=draw.randint(least, 6))) for _ in range(draw.randint(0, 7))] for _ in range(n)]


def tokens(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.w for r in df.select("i", tokenize(F.col("t")).alias("w")).orderBy("i").collect()]


@pytest.mark.parametrize("write,least", [(quoted, 0), (escaped, 1)])
def test_written_words_are_read_back(spark, write, least):
    lists = random_words(5, 600, least)
    draw = random.Random(6)
    between = [", ", ",", " ", "\t", " ,,\t "]
    texts = ["".join(draw.choice(between) + write(w) for w in words) + draw.choice(["", " ,"]) for words in lists]
    assert tokens(spark, texts) == lists


def test_word_rules(spark):
    cases = {
        # separators alone, and words without any
        "\t,, ,": [], "stop": ["stop"], "a\nb": ["a\nb"],
        # a quote ends the word before it and closes its own, even an empty one
        'up"and"down': ["up", "and", "down"], 'x "" y': ["x", "", "y"],
        # an open quote takes all that is left; with nothing left there is no word
        'say "to, the end': ["say", "to, the end"], 'end "': ["end"],
        # a backslash frees the next special character, also one that stands apart
        "one\\ word": ["one word"], "no\\pe, but": ["nope,", "but"], '"a\\"b" c': ['a"b', "c"],
        # a backslash at the very end is dropped
        "last\\": ["last"],
    }
    assert tokens(spark, list(cases)) == list(cases.values())


def test_a_long_message(spark):
    assert [len(w) for w in tokens(spark, ["word " * 5000 + quoted("x, " * 5000)])] == [5001]


SIZE = Field("size", enum=("small", "very large"))
REGION = Field("region")
PARSES = [
    # a command alone, and one that only begins alike
    ("open shop", (SIZE, REGION), {}, None),
    ("open shopping", (), None, "NOT_FOUND"),
    ("please open shop", (), None, "NOT_FOUND"),
    # enum fields take several of their values, quoted where they have spaces
    ('open shop with size "very large", small', (SIZE,), {"size": ["very large", "small"]}, None),
    ("open shop with size huge", (SIZE,), None, "BAD_PARAMETER"),
    # other fields take one value, and any value
    ("open shop with region north-1", (REGION,), {"region": ["north-1"]}, None),
    ("open shop with region north, south", (REGION,), None, "BAD_PARAMETER"),
    # fields in any order, joined by either delimiter
    ("open shop with region x and size small", (SIZE, REGION), {"region": ["x"], "size": ["small"]}, None),
    ("open shop with colour red", (SIZE, REGION), None, "BAD_PARAMETER"),
    ("open shop with size small", (SIZE, Field("region", required=True)), None, "BAD_PARAMETER"),
    # a field without values, repeated fields, a second line, a doubled delimiter
    ("open shop with region with size small", (SIZE, REGION), None, "BAD_PARAMETER"),
    ("open shop with region a and region b", (REGION,), {"region": ["b"]}, None),
    ("open shop with region a\nmore", (REGION,), None, "NOT_FOUND"),
    ("open shop with with region a", (REGION,), None, "BAD_PARAMETER"),
    ("open shop region", (REGION,), None, "BAD_PARAMETER"),
]


@pytest.mark.parametrize("text,fields,values,error_class", PARSES)
def test_parse(spark, text, fields, values, error_class):
    df = spark.createDataFrame([(text,)], "text string")
    row = chat.parse_commands(df, [Command("open shop", fields)]).first()
    assert (row["values"], row["error_class"]) == (values, error_class)


FLAGS, VERSION = Field("flags", enum=GO), Field("version")


def test_parse_messages(spark):
    texts = {
        "go x": "for command `go` parameters, expected `with` followed by parameter names",
        "go x y": "for command `go` parameters, expected `with` followed by the field name, for example `with version 2.2.3`",
        "go with with": "could not recognize parameter `with`, supported parameters are `flags`, `version`",
        "go with flags a": "parameter `a` is not recognized, supported values are `go-build`, `go-check`",
        "go with version a b": "expected a single value, got [a b]",
        "hello": "could not parse the command",
    }
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = chat.parse_commands(df, [Command("go", (FLAGS, VERSION))]).collect()
    assert {r.text: r.error for r in rows} == texts


def test_confirm_words(spark):
    cases = {"yes": "CONFIRM", "yep": "CONFIRM", "no": "ABORT", "cancel": "ABORT", "maybe": None, "not ok": "CONFIRM"}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.k for r in df.select("t", confirm_kind(F.col("t")).alias("k")).collect()} == cases


def test_help(spark):
    commands = [Command("open shop", (SIZE, REGION)), Command("close", help="shuts the doors")]
    asked = {"help": None, "help me to close": "close", "helpful": None, "help with nothing": None, "help open shop": "open shop"}
    df = spark.createDataFrame([(t,) for t in asked], "text string")
    rows = chat.parse_commands(df, commands).collect()
    assert {r.text: r.help_command for r in rows} == asked
    assert all(r.requested_help for r in rows)
    lines = chat.general_help(commands).splitlines()
    assert len(lines) == 5 and lines[3].startswith("* `open shop`, parameters: `size` one of small,very large")
    assert "`region`" in lines[3] and "shuts the doors" in lines[4]


def test_command_values(spark):
    command = Command("go", (Field("flags", enum=GO, default_all=True), Field("version", default=("9",)), Field("other", enum=GO)))
    df = spark.createDataFrame([("go",), ("go with version 1 and flags go-build",)], "text string")
    rows = chat.command_values(chat.parse_commands(df, [command]), command).orderBy("text").collect()
    assert [(r.Flags, r.Version, r.Other) for r in rows] == [(list(GO), "9", [""]), (["go-build"], "1", [""])]


TABLE = "position int, name string, help string, confirm boolean, fields array<struct<name:string,required:boolean,help:string,kind:string,enum:array<string>,default:array<string>,default_all:boolean>>"
SHOP = [
    Command("go far", (Field("flags", True, "", ("a", "b"), (), True),)),
    Command("stop", (), confirm=True),
    Command("go", (Field("version", False, "v", None, ("9",)), Field("flags", enum=("a", "b"), default_all=True))),
    Command("go far away", (Field("version"),)),
    Command("a.b*c"),
]


def command_table(spark, commands, **more):
    rows = [
        (i, c.name, c.help, c.confirm, [(f.name, f.required, f.help, f.kind, f.enum and list(f.enum), list(f.default), f.default_all) for f in c.fields])
        for i, c in enumerate(commands)
    ]
    return spark.createDataFrame(rows, TABLE)


@pytest.mark.parametrize("small", [True, False])
def test_commands_from_a_table(spark, small, monkeypatch):
    """A dialog in a table does what the same dialog in the plan does, for hot names too."""
    monkeypatch.setattr(dialogs, "small_enough", lambda df: small)
    if not small:
        monkeypatch.setattr(ordered, "small_enough", lambda df: False)
    texts = [
        "go", "  go\tfar with flags a", "go far", "go farther", "go far away with version 1", "go  far", "stop", "stop now", "gone", "", None,
        "go with version 2 and flags b", "go\nwith version 2", "go with\nversion\n2", "a.b*c", "aXb*c", "help", "help go far", "helper stop",
        "help me to stop and go", "please stop", "help nothing", "stop with x",
    ]
    rows = [(i % len(texts), texts[i % len(texts)]) for i in range(3 * len(texts))] + [(99, "stop")] * 40
    df = spark.createDataFrame(rows, "id int, text string").repartition(3)
    doubled = command_table(spark, [*SHOP, Command("stop", (Field("never"),))])
    found = chat.parse_commands(df, dialogs.definitions(doubled), limit=10)
    wanted = chat.parse_commands(df, SHOP)
    assert found.columns == wanted.columns
    key = lambda r: (r.id, r.text or "")
    assert sorted(found.collect(), key=key) == sorted(wanted.collect(), key=key)
    filled = dialogs.filled_values(found, dialogs.definitions(doubled), limit=10).filter("text = 'go' or text like '% and flags b'")
    assert {(r.text, tuple(sorted((k, tuple(v)) for k, v in r["values"].items()))) for r in filled.collect()} == {
        ("go", (("flags", ("a", "b")), ("version", ("9",)))), ("go with version 2 and flags b", (("flags", ("b",)), ("version", ("2",))))
    }


def test_large_command_tables_read_the_messages_once(spark, monkeypatch):
    """With commands too many to send, a message is not read again for each length of a name."""
    monkeypatch.setattr(dialogs, "small_enough", lambda df: False)
    monkeypatch.setattr(ordered, "small_enough", lambda df: False)
    messages = spark.range(60).select("id", F.element_at(F.array(*[F.lit(t) for t in ("go", "go far", "help stop", "a b c d")]), (F.col("id") % 4 + 1).cast("int")).alias("text"))
    found = chat.parse_commands(messages, dialogs.definitions(command_table(spark, SHOP)))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    assert {(r.text, r.command, r.help_command) for r in found.collect()} == {
        ("go", "go", None), ("go far", "go far", None), ("help stop", None, "stop"), ("a b c d", None, None)
    }
    filled = dialogs.filled_values(found, dialogs.definitions(command_table(spark, SHOP)))
    assert "Range (" not in filled._jdf.queryExecution().optimizedPlan().toString()  # parsed and written down
    assert {(r.text, tuple(sorted((k, tuple(v)) for k, v in r["values"].items()))) for r in filled.collect()} == {("go", (("flags", ("a", "b")), ("version", ("9",))))}


@pytest.mark.parametrize("small", [True, False])
def test_help_finds_names_of_any_length(spark, small, monkeypatch):
    monkeypatch.setattr(dialogs, "small_enough", lambda df: small)
    if not small:
        monkeypatch.setattr(ordered, "small_enough", lambda df: False)
    names = ["a", "ab", "abc", "abcd", "wxyz12345", "wxyz1234", "wxyz12", "q" * 16, "q" * 15, "\u00e9t\u00e9", "no no"]
    texts = [f"help {t}" for t in ("a", "xab", "zabcd", "wxyz1234", "wxyz123456", "wxyz1", "q" * 14, "q" * 15, "pq" + "q" * 20, "un \u00e9t\u00e9", "no  no", "no no", "%")]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 3)], "id int, text string")
    table = dialogs.definitions(command_table(spark, [Command(n) for n in names]))
    help_of = chat.requested_help(F.col("text"), [Command(n) for n in names])
    wanted = {r.id: r.c for r in df.select("id", help_of["command"].alias("c")).collect()}
    assert {r.id: r.help_command for r in chat.parse_commands(df, table, limit=5).collect()} == wanted


def test_no_commands(spark):
    df = spark.createDataFrame([(1, "go"), (2, "help go")], "id int, text string")
    none = dialogs.definitions(command_table(spark, []))
    found = chat.parse_commands(df, none).orderBy("id").collect()
    assert [(r.error_class, r.requested_help, r.help_command) for r in found] == [("NOT_FOUND", False, None), (None, True, None)]


def test_rows_that_define_no_command(spark):
    assert chat.command_schema(SHOP[2]).simpleString() == "struct<Version:string,Flags:array<string>>"
    with pytest.raises(ValueError):
        Command("go", (Field("and"),))
    none = lambda name: (name, None, None, None, None, None, None)
    rows = [
        (1, " ", "", False, []), (2, None, "", None, []), (3, "x", "", None, [none("a"), none("a")]),
        (4, "y", "", None, [none(None)]), (5, "z", "", None, [none("And")]), (6, "fine", None, None, None),
    ]
    df = spark.createDataFrame(rows, TABLE)
    assert sorted(r.position for r in dialogs.problems(df).collect()) == [1, 2, 3, 4, 5]
    assert [(r.name, r.confirm, r.fields) for r in dialogs.definitions(df).collect()] == [("fine", False, [])]


DIALOG = [
    Command("deploy", (Field("target"),), confirm=True),
    Command("notify", (), confirm=True),  # its name holds "no": swaps the phases
    Command("run", ()),
    Command("runok", ()),
    Command("run not", ()),
]


def replay(texts):
    """Phase before each message and the command it starts, by hand."""
    out, phase, pending = [], "init", None
    for text in texts:
        name = next((c.name for c in DIALOG if text == c.name or text.startswith(c.name + " ")), None)
        if text.startswith("help") or (name == "deploy" and "with bad" in text) or (name == "run" and text != "run"):
            name = None
        asks = name in ("deploy", "notify")
        yes = any(w in text for w in ("yes", "yep", "yeah", "confirm", "ok"))
        no = not yes and any(w in text for w in ("no", "abort", "cancel"))
        event = None
        before = phase
        if phase == "init" and name:
            phase, pending, event = ("confirm", name, None) if asks else ("confirmed", None, name)
        elif phase == "confirm":
            if yes:
                phase, event = "confirmed", pending
            elif no:
                phase = "init"
        out.append((before, event))
    return out


@pytest.mark.parametrize("limit", [10**6, 40])
def test_conversations_against_replay(spark, limit):
    rng = random.Random(3)
    vocabulary = ["deploy", "deploy with target a", "deploy with bad x", "notify", "yes", "no", "hm", "help", "help deploy", "cancel"]
    rare = ["run", "runok", "run not"]
    threads = {}
    for t in range(60):
        n = 400 if t == 0 else rng.randint(1, 25)
        pool = [w for w in vocabulary if w != "yes"] if t < 10 else vocabulary + rare
        threads[t] = [rng.choice(pool) for _ in range(n)]
    rows = [(t, i, text) for t, texts in threads.items() for i, text in enumerate(texts)]
    df = spark.createDataFrame(rows, "thread int, ts int, text string").repartition(5)
    got = chat.conversations(df, DIALOG, thread=["thread"], order=["ts"], limit=limit)
    by_thread = {}
    for r in got.orderBy("thread", "ts").collect():
        by_thread.setdefault(r.thread, []).append((r.phase, r.command if r.is_event else None))
    assert by_thread == {t: replay(texts) for t, texts in threads.items()}


def test_replies(spark):
    texts = ["hi", "deploy with target a", "what", "cancel", "deploy", "<@BOT> yes", "again"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "thread int, ts int, text string")
    rows = chat.conversations(df, DIALOG, thread=["thread"], order=["ts"], self_id="BOT").orderBy("ts").collect()
    replies = [r.reply for r in rows]
    assert replies[0].startswith("Could not parse the command.\nHere are the supported commands:\n")
    assert replies[1:] == [
        "Please confirm that you want to execute command `deploy` with parameters `target: a` (yes/no).",
        "Please confirm that you want to execute command `deploy` with parameters `target: a` (yes/no).",
        "Aborted command: deploy with values map[target:a]",
        "Please confirm that you want to execute command `deploy` (yes/no).",
        "Confirmed and executing command: deploy with values map[]",
        "Already executing command: deploy with values map[]",
    ]


def test_routing(spark):
    rows = [
        ("c", 1, None, "u", None, "hello"),
        ("c", 2, None, "u", None, "<@BOT> run"),
        ("c", 3, 2, "u", None, "yes"),
        ("c", 4, 99, "u", None, "yes"),
        ("c", 5, 2, "BOT", None, "mine"),
        ("c", 6, 2, "u", "b1", "other bot"),
        ("c", 7, None, "", None, "<@BOT>"),
        ("c", 1, 2, "u", None, "before it opened"),
    ]
    df = spark.createDataFrame(rows, "channel string, ts int, thread_ts int, user string, bot_id string, text string")
    got = chat.route_messages(df, "BOT").orderBy("ts").collect()
    assert [(r.ts, r.thread, r.route) for r in got] == [(1, 2, "unknown"), (2, 2, "opens"), (3, 2, "known"), (4, 99, "unknown")]
    handled = chat.conversations(chat.route_messages(df, "BOT").filter("route <> 'unknown'"), DIALOG, thread=["channel", "thread"], order=["ts"], self_id="BOT")
    out = chat.outgoing_messages(chat.route_messages(df, "BOT"), handled)
    assert out.filter(F.col("reply") == chat.UNRECOGNIZED_THREAD).count() == 2


def talk(rng, n_threads, n_hot):
    pool = ["deploy", "deploy with target a", "deploy with bad x", "notify", "yes", "no", "hm", "help deploy", "cancel", "run", "run not"]
    quiet = [w for w in pool if w not in ("yes", "run")]
    return {t: [rng.choice(quiet if t < n_threads // 2 else pool) for _ in range(n_hot if t == 0 else rng.randint(1, 20))] for t in range(n_threads)}


@pytest.mark.parametrize("limit", [10**6, 50])
def test_streamed_conversations_go_on_where_they_stopped(spark, tmp_path, limit):
    rng = random.Random(8)
    threads = talk(rng, 30, 300)
    rows = [(t or None, i, text) for t, texts in threads.items() for i, text in enumerate(texts)]
    df = spark.createDataFrame(rows, "thread int, n int, text string").withColumn("ts", F.timestamp_seconds(F.col("n") * 60))
    state, keys = f"{tmp_path}/state", {"thread": ["thread"], "order": ["ts", "n"]}
    for begin in (0, 1, 4, 15, 150):
        end = {0: 1, 1: 4, 4: 15, 15: 150, 150: 1000}[begin]
        df.filter((F.col("n") >= begin) & (F.col("n") < end)).write.mode("append").parquet(f"{tmp_path}/in")
        found = stream_conversations(stream_table(spark, f"{tmp_path}/in", df.schema), DIALOG, state, limit=limit, **keys)
    shown = lambda handled: sorted((str(r.thread), r.n, r.phase, r.reply, r.is_event, r.command) for r in handled.collect())
    assert shown(found) == shown(chat.conversations(df, DIALOG, **keys))
    assert len([f for f in (tmp_path / "state" / "threads").iterdir()]) <= 2


def test_threads_are_forgotten(spark, tmp_path):
    days = [[(1, 0, "deploy"), (2, 0, "deploy")], [(2, 9, "hm"), (3, 9, "run")], [(1, 10, "yes"), (2, 10, "yes"), (3, 10, "hm")]]
    kept = []
    for rows in days:
        df = spark.createDataFrame(rows, "thread int, day int, text string").withColumn("ts", F.timestamp_seconds(F.col("day") * 86400))
        df.write.mode("append").parquet(f"{tmp_path}/in")
        messages = stream_table(spark, f"{tmp_path}/in", df.schema)
        found = stream_conversations(messages, DIALOG, f"{tmp_path}/state", thread=["thread"], order=["ts"], forget="8 days")
        kept.append({r.thread for r in spark.read.parquet(f"{tmp_path}/state/threads/batch={len(kept)}").collect()})
    assert kept == [{1, 2}, {2, 3}, {1, 2, 3}]
    got = {(r.thread, r.day): (r.phase, r.is_event) for r in found.collect()}
    # thread 1 had been silent for nine days when the second batch came: its question is gone
    assert got[1, 10] == ("init", False) and got[2, 10] == ("confirm", True) and got[3, 10] == ("confirmed", False)
