"""Defaults, typed conversion, partial structs and layered (scoped) values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.text import or_default
from tidewatch.session import cut

# Defaults of each kind of setting.
DEFAULTS = {
    "copy": {"mode": "0640"},
    "image": {"context": ".", "dockerfile": "Dockerfile"},
    "git": {"user": "git"},
    "watch": {
        "branch_pattern": "master",
        "approval_pattern": ".*ok to test.*",
        "retest_pattern": ".*retest this.*",
        "skip_pattern": ".*skip ci.*",
    },
    "log": {"level": "info"},
}


def with_rule_defaults(rules: DataFrame) -> DataFrame:
    """Watch rules with their patterns filled in; absent columns are added."""
    filled = rules
    for name, default in DEFAULTS["watch"].items():
        current = F.col(name) if name in rules.columns else F.lit(None).cast("string")
        filled = filled.withColumn(name, or_default(current, F.lit(default)))
    return filled


def matches_pattern(text: Column, pattern: Column, name: str) -> Column:
    """Whether the text matches a rule's pattern. Most rules have the default, which
    is compiled once as a literal instead of once per row."""
    default = F.lit(DEFAULTS["watch"][name])
    return F.when(pattern == default, F.rlike(text, default)).otherwise(F.rlike(text, pattern))


def with_image_defaults(images: DataFrame) -> DataFrame:
    """Build context ``.`` and the Dockerfile inside the context."""
    context = or_default(F.col("context"), F.lit(DEFAULTS["image"]["context"]))
    inside = F.regexp_replace(F.concat_ws("/", context, F.lit(DEFAULTS["image"]["dockerfile"])), r"^(?:\./)+", "")
    return images.withColumns({"dockerfile": or_default(F.col("dockerfile"), inside), "context": context})


def with_git_defaults(configs: DataFrame) -> DataFrame:
    """User ``git`` when a key file is given and no user is."""
    has_key = F.coalesce("private_key_file", F.lit("")) != ""
    user = F.when(has_key, or_default(F.col("user"), F.lit(DEFAULTS["git"]["user"]))).otherwise(F.col("user"))
    return configs.withColumn("user", user)


def apply_defaults(specs: DataFrame, kind: str = "kind", defaults: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """Fill empty fields of each row with the defaults of its kind."""
    table = DEFAULTS if defaults is None else defaults
    fields: dict[str, Column] = {}
    for name in sorted({f for values in table.values() for f in values}):
        if name not in specs.columns:
            continue
        default = F.lit(None).cast("string")
        for kind_name, values in table.items():
            if name in values:
                default = F.when(F.col(kind) == kind_name, F.lit(values[name])).otherwise(default)
        fields[name] = F.coalesce(F.nullif(F.col(name), F.lit("")), default, F.col(name))
    return specs.withColumns(fields)


def zero(data_type: T.DataType) -> Column:
    """Value of a field that was not given."""
    match data_type:
        case T.StringType():
            value = F.lit("")
        case T.BooleanType():
            value = F.lit(False)
        case T.ArrayType():
            value = F.array()
        case T.MapType():
            value = F.create_map()
        case T.StructType():
            return F.struct(*[zero(f.dataType).alias(f.name) for f in data_type.fields])
        case T.NumericType():
            value = F.lit(0)
        case _:
            value = F.lit(None)
    return value.cast(data_type)


def fill_struct(partial: Column, given: T.StructType, schema: T.StructType) -> Column:
    """A partially given struct as the full one, absent or NULL fields zero."""
    known = {f.name: f.dataType for f in given.fields}
    extra = set(known) - set(schema.names)
    if extra:
        raise ValueError(f"unknown fields {sorted(extra)}")
    fields = []
    for f in schema.fields:
        if f.name not in known:
            value = zero(f.dataType)
        elif isinstance(f.dataType, T.StructType) and isinstance(known[f.name], T.StructType):
            value = fill_struct(partial[f.name], known[f.name], f.dataType)
        else:
            value = F.coalesce(partial[f.name].cast(f.dataType), zero(f.dataType))
        fields.append(value.alias(f.name))
    return F.struct(*fields)


def _converted(value: Column, given: T.DataType, wanted: T.DataType) -> Column:
    """The value cast to the wanted type, NULL where it cannot be.

    A plain value becomes a struct whose embedded field (``embedded`` in the
    field's metadata) it fits; the other fields are zero.
    """
    if isinstance(wanted, T.StructType) and not isinstance(given, T.StructType):
        for inner in wanted.fields:
            if (inner.metadata or {}).get("embedded"):
                cast = _converted(value, given, inner.dataType)
                others = [(cast if f is inner else zero(f.dataType)).alias(f.name) for f in wanted.fields]
                return F.when(cast.isNotNull(), F.struct(*others))
    return value.try_cast(wanted)


def conform(df: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Rows cast to ``schema`` and the cells that could not be cast.

    Unknown columns are an error; absent ones and NULLs take the zero value; a
    plain value may stand for a struct with an embedded field.
    The second DataFrame has one row per bad cell: the source row's columns,
    ``field`` and ``problem``.
    """
    extra = [c for c in df.columns if c not in schema.names]
    if extra:
        raise ValueError(f"unknown fields {extra}")
    casts = {f.name: _converted(F.col(f.name), df.schema[f.name].dataType, f.dataType) for f in schema.fields if f.name in df.columns}
    bad = {name: F.col(name).isNotNull() & cast.isNull() for name, cast in casts.items()}
    checks = F.array(
        *[
            F.when(flag, F.struct(F.lit(name).alias("field"), F.lit(f"cannot convert to {schema[name].dataType.simpleString()}").alias("problem")))
            for name, flag in bad.items()
        ]
    )
    checked = df.withColumn("__bad", F.array_compact(checks))
    rows = checked.filter(F.size("__bad") == 0).select(
        *[F.coalesce(casts[f.name], zero(f.dataType)).alias(f.name) if f.name in casts else zero(f.dataType).alias(f.name) for f in schema.fields]
    )
    errors = checked.select(*df.columns, F.inline("__bad"))
    return rows, errors


def get_path(df: DataFrame, path: str) -> Column:
    """Nested field by dotted path; a missing field is an error right away."""
    data_type: T.DataType = df.schema
    column: Column | None = None
    for part in path.split("."):
        if not isinstance(data_type, T.StructType) or part not in data_type.names:
            raise ValueError(f"field {part!r} of {path!r} is not defined")
        data_type = data_type[part].dataType
        column = F.col(f"`{part}`") if column is None else column.getField(part)
    return column


def scope_ancestors(scopes: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(scope_id, ancestor_id, depth) for each scope, or each of ``start``, and all
    that enclose it.

    Every round doubles the distance looked up, so the rounds grow with the
    logarithm of the depth. Scopes that enclose themselves are an error.
    """
    jumps = scopes.filter(F.col("parent_id").isNotNull()).select(
        F.col("scope_id").alias("ancestor_id"), F.col("parent_id").alias("__up")
    )
    first = (scopes if start is None else start).select("scope_id").distinct()
    closure = first.select("scope_id", F.col("scope_id").alias("ancestor_id"), F.lit(0).alias("depth"))
    distance, n_scopes = 1, scopes.count()
    while not jumps.isEmpty():
        if distance > n_scopes:  # no chain without a repeated scope is that long
            raise ValueError("the scopes form a cycle")
        farther = closure.join(jumps, "ancestor_id").select(
            "scope_id", F.col("__up").alias("ancestor_id"), (F.col("depth") + distance).alias("depth")
        )
        closure = cut(closure.unionByName(farther))
        above = jumps.select(F.col("ancestor_id").alias("__up"), F.col("__up").alias("__next"))
        jumps = cut(jumps.join(above, "__up").select("ancestor_id", F.col("__next").alias("__up")))
        distance *= 2
    return closure


def _enclosing(scopes: DataFrame, start: DataFrame) -> DataFrame:
    """The scopes of ``start`` and all that enclose one of them, each once. Every round
    doubles the distance looked up."""
    jumps = scopes.filter(F.col("parent_id").isNotNull()).select("scope_id", F.col("parent_id").alias("__up"))
    found, n = cut(start.select("scope_id").distinct()), -1
    while (now := found.count()) != n:
        n = now
        farther = found.join(jumps, "scope_id").select(F.col("__up").alias("scope_id"))
        found = cut(found.union(farther).distinct())
        jumps = cut(_twice(jumps))
    return found


def _twice(jumps: DataFrame) -> DataFrame:
    """(scope_id, __up) of a jump and one more of the same distance."""
    return jumps.join(jumps.select(F.col("scope_id").alias("__up"), F.col("__up").alias("__next")), "__up").select("scope_id", F.col("__next").alias("__up"))


def resolve_scoped(scopes: DataFrame, values: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """Value of each name in each scope: the nearest enclosing definition.

    With ``requests`` (scope_id, name) only those are answered; undefined ones
    come back with status NOT_FOUND.

    A scope takes the definitions known to the scope that its jump leads to, for names it has
    none of yet, and the jumps double: after k rounds every scope knows what is defined
    less than 2^k levels above it. A pair of scope and name is settled at its first
    definition and never looked at again. With requests, only the names asked for and
    the scopes that enclose one asked for take part. Scopes that enclose themselves are an error.
    """
    owned = values.groupBy("scope_id", "name").agg(F.min("value").alias("value"))
    if requests is not None:
        asked = requests.select("scope_id", "name").distinct()
        inside = _enclosing(scopes, asked)
        scopes = scopes.join(inside, "scope_id", "left_semi")
        owned = owned.join(asked.select("name").distinct(), "name", "left_semi").join(inside, "scope_id", "left_semi")
    found = cut(owned.select("scope_id", "name", "value", F.lit(0).alias("depth")))
    jumps = cut(scopes.filter(F.col("parent_id").isNotNull()).select("scope_id", F.col("parent_id").alias("__up")).distinct())
    distance, n_scopes = 1, scopes.count()
    while not jumps.isEmpty():
        if distance > n_scopes:  # no chain without a repeated scope is that long
            raise ValueError("the scopes form a cycle")
        above = found.select(F.col("scope_id").alias("__up"), "name", "value", (F.col("depth") + distance).alias("depth"))
        farther = jumps.join(above, "__up").select("scope_id", "name", "value", "depth")
        found = cut(found.unionByName(farther.join(found, ["scope_id", "name"], "left_anti")))
        jumps = cut(_twice(jumps))
        distance *= 2
    if requests is None:
        return found.join(scopes.select("scope_id"), "scope_id", "left_semi").withColumn("status", F.lit("OK"))
    answered = asked.join(found, ["scope_id", "name"], "left")
    return answered.withColumn("status", F.when(F.col("depth").isNull(), "NOT_FOUND").otherwise("OK"))


def duplicate_definitions(values: DataFrame) -> DataFrame:
    """Names defined more than once in one scope; shadowing a parent is fine."""
    counted = values.groupBy("scope_id", "name").agg(F.count("*").alias("n_definitions"))
    return counted.filter(F.col("n_definitions") > 1)


def visible_names(scopes: DataFrame, values: DataFrame) -> DataFrame:
    """Own names, and names of enclosing scopes wrapped ``p(...)`` per level."""
    owned = values.select(F.col("scope_id").alias("ancestor_id"), "name").distinct()
    seen = scope_ancestors(scopes).join(owned, "ancestor_id")
    return seen.select(
        "scope_id", F.concat(F.repeat(F.lit("p("), F.col("depth")), "name", F.repeat(F.lit(")"), F.col("depth"))).alias("name")
    )
