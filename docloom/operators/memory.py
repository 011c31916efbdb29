"""Conversation memory and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.config import SETTINGS, VOCABULARY, Vocabulary
from docloom.functions import text as tx

from .retrieve import resolve_alias

# What makes a question hang on an earlier turn.
DANGLING = "(?i)(?<![a-z0-9_])(?:its|it|it's|this|that|these|those|they|them|their|theirs|he|she|her|his)(?![a-z0-9_])"
ABOUT = "(?i)^\\s*(?:and\\s+)?(?:what|how)\\s+about(?![a-z0-9_])"
ELIDED = "(?i)^\\s*(?:and|also|so|okay\\s+and|ok\\s+and|and\\s+then|then)(?![a-z0-9_])"


def rolling_window(turns: DataFrame, keep: int = SETTINGS.memory_max_messages, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The last ``keep`` messages of each conversation with ``place`` (1 is the newest); blank ones take no place."""
    said = turns.where(tx.strip(tx.text_of("text")) != "")
    place = F.row_number().over(Window.partitionBy(conv).orderBy(F.desc(turn)))
    return said.withColumn("place", place).where(F.col("place") <= keep)


def subject(scheme: Column, plan: Column, vocabulary: Vocabulary = VOCABULARY) -> Column:
    """Readable name of what a turn is about; a plan alone is none."""
    named = lambda names: F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    name = F.try_element_at(named(vocabulary.scheme_titles), scheme)
    detail = F.try_element_at(named(vocabulary.plan_titles), plan)
    return F.when(F.coalesce(detail, F.lit("")) != "", F.concat(name, F.lit(" ("), detail, F.lit(")"))).otherwise(name)


def last_subject(turns: DataFrame, found: Column, keep: int = SETTINGS.memory_max_messages, conv: str = "conv_id", turn: str = "turn") -> Column:
    """Last non-null ``found`` of a user's turns among the turn's last ``keep`` messages, its own included."""
    frame = Window.partitionBy(conv).orderBy(turn).rowsBetween(-(keep - 1), 0)
    return F.last(F.when(F.col("role") == "user", found), ignorenulls=True).over(frame)


def is_followup(question: Column, vocabulary: Vocabulary = VOCABULARY) -> Column:
    """Whether a question hangs on an earlier turn; one that names its scheme does not."""
    value = tx.strip(tx.text_of(question))
    hangs = value.rlike(DANGLING) | value.rlike(ABOUT) | value.rlike(ELIDED)
    return (value != "") & resolve_alias(value, vocabulary.scheme_aliases).isNull() & hangs


def rewrite(question: Column, about: Column, vocabulary: Vocabulary = VOCABULARY) -> Column:
    """A follow-up with its subject in front; other questions as they are."""
    value = tx.strip(tx.text_of(question))
    return F.when(is_followup(question, vocabulary) & about.isNotNull(), F.concat_ws(": ", about, value)).otherwise(value)


def rewritten_turns(turns: DataFrame, vocabulary: Vocabulary = VOCABULARY, keep: int = SETTINGS.memory_max_messages) -> DataFrame:
    """``turns`` with ``subject``, ``recent_subject``, ``followup`` and the ``standalone`` question of user turns."""
    own = subject(resolve_alias(F.col("text"), vocabulary.scheme_aliases), resolve_alias(F.col("text"), vocabulary.plan_aliases), vocabulary)
    said = turns.where(tx.strip(tx.text_of("text")) != "").withColumn("subject", F.when(F.col("role") == "user", own))
    seen = said.withColumn("recent_subject", last_subject(said, F.col("subject"), keep))
    user = F.col("role") == "user"
    return seen.withColumns(
        {
            "followup": user & is_followup(F.col("text"), vocabulary),
            "standalone": F.when(user, rewrite(F.col("text"), F.col("recent_subject"), vocabulary)),
        }
    )


def describe(n: Column, keep: int = SETTINGS.memory_max_messages) -> Column:
    return F.format_string(f"%d/{keep} messages", n)


def valid_session(session_id: Column) -> Column:
    return F.coalesce(session_id.rlike("^[0-9a-f]{32}$"), F.lit(False))


def sessionize(events: DataFrame, ttl_s: int = SETTINGS.session_ttl_s, user: str = "user_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """``events`` with ``session_no`` of each user: idle for over ``ttl_s`` seconds starts another."""
    order = Window.partitionBy(user).orderBy(ts, tie)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    idle = (micros - F.lag(micros).over(order)) > ttl_s * 1_000_000
    flagged = events.withColumn("_new", F.when(F.coalesce(idle, F.lit(True)), 1).otherwise(0))
    return flagged.withColumn("session_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def live_sessions(events: DataFrame, cap: int = SETTINGS.max_sessions, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """The ``cap`` users seen last, ``lru_rank`` 1 the latest: a global order, limited in every task before they meet."""
    seen = events.groupBy(user).agg(F.max(ts).alias("last_seen"), F.count("*").alias("n_events"))
    top = seen.orderBy(F.desc("last_seen"), F.asc(user)).limit(cap)
    return top.withColumn("lru_rank", F.row_number().over(Window.orderBy(F.desc("last_seen"), F.asc(user))))
