"""Copy plans and transfer records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import escape_control
from tidewatch.plans.ordered import HOT_ROWS, OrderedGroups, bounded_broadcast, join_same, latest, running_max, running_sum
from tidewatch.session import cut

#: Directories of a session that are walked in one row.
LIGHT_DIRECTORIES = 500


def clean_path(path: Column) -> Column:
    """Slashes and ``.`` elements collapsed, ``..`` resolved, as a file path join does."""
    rooted = path.startswith("/")
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    # only paths that hold a ".." element are walked
    walked = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, p: F.when(
            (p == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        )
        .when((p == "..") & rooted, done)
        .otherwise(F.concat(done, F.array(p))),
    )
    resolved = F.when(F.array_contains(parts, ".."), walked).otherwise(parts)
    text = F.array_join(resolved, "/")
    return F.when(rooted, F.concat(F.lit("/"), text)).otherwise(F.when(text == "", ".").otherwise(text))


def join_path(*parts: Column) -> Column:
    return clean_path(F.concat_ws("/", *[F.nullif(p, F.lit("")) for p in parts]))


def upload_plan(listing: DataFrame, bucket: str, key: str, recursive: bool = True) -> DataFrame:
    """One row per local file (root, rel_path, length, is_dir_root) with the
    object it goes to. A directory needs ``recursive``."""
    from_dir = F.col("is_dir_root")
    target = F.when(from_dir, join_path(F.lit(key), F.col("rel_path"))).otherwise(F.lit(key))
    source = F.when(from_dir, join_path(F.col("root"), F.col("rel_path"))).otherwise(F.col("root"))
    error = F.when(from_dir & ~F.lit(recursive), F.concat(F.lit("path "), F.col("root"), F.lit(" is a directory, use RecursiveCopy")))
    return listing.select(
        source.alias("src"), F.when(error.isNull(), F.concat(F.lit(f"s3://{bucket}/"), target)).alias("dest"), "length", error.alias("error")
    )


def download_plan(objects: DataFrame, path: str, prefix: str = "", recursive: bool = True, into_dir: bool = True) -> DataFrame:
    """One row per object (bucket, key, length) below ``prefix`` with the local
    file it goes to: the whole key is kept below ``path``."""
    wanted = objects.filter(F.col("key").startswith(prefix)) if prefix else objects
    target = join_path(F.lit(path), F.col("key")) if into_dir else F.lit(path)
    error = F.lit(f"path {path} is a directory, use RecursiveCopy" if into_dir and not recursive else None).cast("string")
    return wanted.select(
        F.concat(F.lit("s3://"), F.col("bucket"), F.lit("/"), F.col("key")).alias("src"),
        F.when(error.isNull(), target).alias("dest"),
        "length",
        error.alias("error"),
    )


def parse_transfer_records(lines: DataFrame) -> DataFrame:
    """Typed records of transfer lines: C file, D directory, T times, E end of a
    directory, and error text behind the bytes 1 and 2. ``error`` says what is
    wrong with a line. A T record is accepted."""
    line = F.col("line")
    kind = F.substr(line, F.lit(1), F.lit(1))
    rest = F.substr(line, F.lit(2))
    parts = F.split(rest, " ", 3)
    mode, length, name = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    is_entry = kind.isin("C", "D")
    octal = mode.rlike(r"^[+-]?[0-7]+$")
    # a sign counts, leading zeros do not, and what is longer is out of range anyway
    bare = F.regexp_replace(mode, r"^[+-]?0*", "")
    size = F.when(F.length(bare) <= 11, F.coalesce(F.conv(F.when(bare != "", bare), 8, 10), F.lit("0")).try_cast("long"))
    mode_value = F.when(mode.startswith("-"), -size).otherwise(size)
    length_value = F.when(length.rlike(r"^[0-9]+$"), F.regexp_replace(length, r"^0+(?=.)", "").try_cast("decimal(20,0)"))
    bad_name = name.isin("", ".", "..") | name.startswith("/")
    entry_error = (
        F.when(F.size(parts) < 3, "broken command")
        .when(~octal | mode_value.isNull() | ~mode_value.between(-2147483648, 2147483647), "invalid mode")
        .when(length_value.isNull() | (length_value > F.lit("18446744073709551615").cast("decimal(20,0)")), "invalid length")
        .when(bad_name, "invalid name")
    )
    times = F.split(rest, " ", 4)
    numbers = F.transform(times, lambda t: F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("long")))

    def micros(seconds: int, nanos: int) -> Column:
        """Null beyond what a timestamp can hold."""
        whole = F.try_multiply(F.get(numbers, F.lit(seconds)), F.lit(1_000_000).cast("long"))
        return F.try_add(whole, F.call_function("div", F.get(numbers, F.lit(nanos)) - F.pmod(F.get(numbers, F.lit(nanos)), F.lit(1000)), F.lit(1000)))

    def at(seconds: int, nanos: int) -> Column:
        return F.timestamp_micros(micros(seconds, nanos))

    time_error = F.when(F.size(times) < 4, "broken mtime command").when(F.exists(numbers, lambda n: n.isNull()), "invalid time").when(
        F.exists(F.array(micros(0, 1), micros(2, 3)), lambda m: m.isNull()), "time out of range"
    )

    remote = kind.isin("\x01", "\x02")
    error = (
        F.when(remote, rest)
        .when(is_entry, entry_error)
        .when(kind == "T", time_error)
        .when(kind == "E", None)
        .otherwise(F.concat(F.lit("got unrecognized command: "), escape_control(kind)))
    )
    good_entry, good_time = is_entry & entry_error.isNull(), (kind == "T") & time_error.isNull()
    return lines.select(
        *[c for c in lines.columns if c != "line"],
        kind.alias("record"),
        F.when(good_entry, mode_value).alias("mode"),
        F.when(good_entry, length_value).alias("length"),
        F.when(good_entry, name).alias("name"),
        F.when(good_time, at(0, 1)).alias("mtime"),
        F.when(good_time, at(2, 3)).alias("atime"),
        error.alias("error"),
    )


def transfer_manifest(records: DataFrame, target: str = ".", *, limit: int = HOT_ROWS) -> DataFrame:
    """Every file and directory of a session with its full path.

    ``records``: session, seq_no (unique in it), record, length, name, error. A
    session ends at
    its first error, or at the second end-of-directory beyond the outermost one.
    The directory a record lies in is the last one opened a level above it, so
    the nesting is resolved with running values per (session, level). Paths are put
    together in one walk over the directories of a session; where it has more than
    ``LIGHT_DIRECTORIES``, by a number of joins that grows with the logarithm of the depth.
    """
    is_end, failed = F.col("record") == "E", F.col("error").isNotNull()
    step = F.when(failed, 0).when(F.col("record") == "D", 1).when(is_end, -1).otherwise(0)
    # The outermost level may be left once; leaving it again is tolerated one
    # time (and changes nothing), any later end of directory ends the session.
    sessions = OrderedGroups.split(
        records.filter(F.col("record").isin("C", "D", "E") | failed), ["session"], ["seq_no"], limit, sizes=records
    )
    walked = (
        sessions.running({"__depth": running_sum(step)})
        .transform(lambda d: d.withColumn("__spare", (is_end & ~failed & (F.col("__depth") == -1)).cast("int")))
        .running({"__finished": running_max(F.col("__spare"))})
        .transform(lambda d: d.withColumn("__finished", F.coalesce("__finished", F.lit(0))))
        .transform(lambda d: d.withColumn("__ends", (failed | (is_end & (F.col("__finished") == 1))).cast("int")))
        .running({"__ended": running_max(F.col("__ends"))})
        .rows()
    )
    live = walked.filter((F.greatest(F.col("__ends"), F.col("__ended")) == 0) & ~is_end).select(
        "session", "seq_no", "record", "name", "length", (F.col("__depth") + F.col("__finished")).alias("__level")
    )

    # every record looks for the last directory opened into its own level
    own = F.col("seq_no").cast("long")
    members = live.withColumns({"__inside": F.col("__level"), "__opens": F.lit(False), "__dir": F.lit(None).cast("long")})
    opened = live.filter(F.col("record") == "D").withColumns({"__inside": F.col("__level") + 1, "__opens": F.lit(True), "__dir": own})
    levels = members.unionByName(opened)
    by_level = (["session", "__inside"], ["seq_no", "__opens"])
    if sessions.heavy is None:  # then no level of a session is large either
        nested = OrderedGroups.of_light(levels, *by_level)
    else:
        nested = OrderedGroups.split(levels, *by_level, limit)
    placed = nested.running({"__parent": latest(F.col("__dir"))}).rows()
    tree = placed.filter(~F.col("__opens")).select("session", own.alias("seq_no"), "record", "name", "length", "__parent", "__level")
    return _with_paths(cut(tree), target)


def _with_paths(tree: DataFrame, target: str) -> DataFrame:
    """Full paths of a tree of records: those of the directories, and then files take the
    path of theirs."""
    root = F.lit(target)
    opened = tree.filter(F.col("record") == "D")
    sizes = opened.groupBy("session").agg(F.count("*").alias("n"))
    heavy = cut(sizes.filter(F.col("n") > LIGHT_DIRECTORIES).select("session"))
    n_heavy = heavy.count()
    if n_heavy == 0:
        folders = _walked_paths(opened)
    else:
        heavy = bounded_broadcast(heavy, n_heavy)
        light, rest = join_same(opened, heavy, ["session"], "left_anti"), join_same(opened, heavy, ["session"], "left_semi")
        folders = _walked_paths(light).unionByName(_doubled_paths(rest))
    resolved = folders.select("session", F.col("__dir").alias("__parent"), join_path(root, F.col("__path")).alias("parent"))
    placed = join_same(tree, resolved, ["session", "__parent"], "left").withColumn("parent", F.coalesce("parent", clean_path(root)))
    return placed.select("session", "seq_no", "record", join_path(F.col("parent"), F.col("name")).alias("path"), "parent", "length")


def _walked_paths(opened: DataFrame) -> DataFrame:
    """Paths of the directories of small sessions: one walk over each session's
    directories in order, with the path of the last directory opened on every level. The
    lowest level is the one reached by leaving the outermost directory, -1."""
    listed = opened.groupBy("session").agg(
        F.array_sort(F.collect_list(F.struct("seq_no", (F.col("__level") + 1).cast("int").alias("level"), "name"))).alias("dirs")
    )
    nothing = F.struct(F.array(F.lit(None).cast("string")).alias("stack"), F.array().cast("array<struct<__dir:bigint,__path:string>>").alias("paths"))

    def opens(state: Column, d: Column) -> Column:
        path = F.concat_ws("/", F.get(state["stack"], d["level"] - 1), d["name"])
        return F.struct(
            F.concat(F.slice(state["stack"], F.lit(1), d["level"]), F.array(path)).alias("stack"),
            F.concat(state["paths"], F.array(F.struct(d["seq_no"].alias("__dir"), path.alias("__path")))).alias("paths"),
        )

    return listed.select("session", F.inline(F.aggregate("dirs", nothing, opens, lambda state: state["paths"])))


def _doubled_paths(opened: DataFrame) -> DataFrame:
    """Paths of directories by joins: every round, each one that does not yet reach the top
    puts the path of the directory it has reached before its own, which doubles the
    part resolved."""
    folders = opened.select("session", F.col("seq_no").alias("__dir"), F.col("name").alias("__path"), F.col("__parent").alias("__up"))
    while not folders.filter(F.col("__up").isNotNull()).isEmpty():
        above = folders.select("session", F.col("__dir").alias("__up"), F.col("__path").alias("__above"), F.col("__up").alias("__next"))
        joined = join_same(folders, above, ["session", "__up"], "left")
        path = F.concat_ws("/", "__above", "__path")
        folders = cut(joined.select("session", "__dir", path.alias("__path"), F.col("__next").alias("__up")))
    return folders.select("session", "__dir", "__path")


def directory_bytes(manifest: DataFrame) -> DataFrame:
    """Files and bytes directly in each directory of a session."""
    files = manifest.filter(F.col("record") == "C")
    return files.groupBy("session", F.col("parent").alias("dir")).agg(F.count("*").alias("n_files"), F.sum("length").alias("bytes"))
