"""Boolean and branching Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that confirm or abort a pending command.
CONFIRM_WORDS = "yes|yep|yeah|yep|confirm|ok|confirmed"
ABORT_WORDS = "no|not|abort|cancel"

# Log levels from the quietest to the most verbose.
LEVELS = ["panic", "fatal", "error", "warning", "info", "debug", "trace"]


def contains(array: Column, item: Column) -> Column:
    """True or false, never NULL, also for arrays that hold NULLs."""
    return F.coalesce(F.array_contains(array, item), F.lit(False))


def matches_branch(ref: Column, pattern: Column | str) -> Column:
    """Unanchored regex match; an empty pattern means ``master``."""
    if isinstance(pattern, str):
        return ref.rlike(pattern or "master")
    return F.rlike(ref, F.coalesce(F.nullif(pattern, F.lit("")), F.lit("master")))


def mention(user: Column | str) -> Column:
    return F.concat(F.lit("<@"), user if isinstance(user, Column) else F.lit(user), F.lit(">"))


def mentions(text: Column, user: Column | str) -> Column:
    return F.contains(text, mention(user))


def from_bot(user: Column, bot_id: Column, self_id: str) -> Column:
    empty_user = F.coalesce(user, F.lit("")) == ""
    return empty_user | (user == self_id) | (F.coalesce(bot_id, F.lit("")) != "")


def confirm_kind(text: Column) -> Column:
    """CONFIRM, ABORT or NULL; substrings count and CONFIRM is checked first."""
    lowered = F.lower(text)
    return F.when(lowered.rlike(CONFIRM_WORDS), "CONFIRM").when(lowered.rlike(ABORT_WORDS), "ABORT")


def if_else(condition: Column, then: Column, otherwise: Column | None = None) -> Column:
    """``then`` where the condition holds; without an else branch, false."""
    return F.when(condition, then).otherwise(F.lit(False) if otherwise is None else otherwise)


def level_rank(level: Column) -> Column:
    """Position of a level from the quietest; NULL when unknown."""
    lowered = F.lower(level)
    ranks = F.create_map(*[F.lit(x) for i, name in enumerate(LEVELS) for x in (name, i)])
    return F.element_at(ranks, F.when(lowered == "warn", "warning").otherwise(lowered))


def at_level(level: Column, minimum: str = "info", debug: bool = False) -> Column:
    """Entries at or above ``minimum``; debug overrides it."""
    wanted = "debug" if debug else (minimum or "info").lower().replace("warning", "warn").replace("warn", "warning")
    if wanted not in LEVELS:
        raise ValueError(f"unknown log level {minimum!r}")
    return level_rank(level) <= LEVELS.index(wanted)
