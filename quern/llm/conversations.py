"""Ordered conversations from message rows: problem 4.

Messages are range-partitioned by session, time and id, so a task holds a stretch of the order, of one long session or of
many short ones, and numbers its turns. The automaton's table maps each state to the next for each kind of turn; a
stretch of turns folds into one such map, maps of neighbouring stretches compose, and a session is kept if its map takes
the start to an accepting state. No session is read in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.session import kept, table

#: Turns, or maps, that are folded at once.
STRETCH = 4096

# Roles as they are written, lower case and without blanks around.
ROLES = {"user": "user", "human": "user", "assistant": "assistant", "ai": "assistant", "bot": "assistant", "system": "system", "tool": "tool"}
_BLANKS = r"^[\s\p{Z}]+|[\s\p{Z}]+$"

#: The automaton: its states, what a turn does in them (what isn't here breaks the conversation), and where it may end.
STATES = ("start", "asked", "answered", "broken")
MOVES = {("start", "user"): "asked", ("asked", "assistant"): "answered", ("answered", "user"): "asked"}
ENDS = ("answered",)
#: Kinds of turns; an empty one, or a row without time or role, is a fault.
KINDS = ("user", "assistant", "fault")


def speaker(role: Column) -> Column:
    """The role's canonical name, or null if it isn't recognised."""
    plain = F.lower(F.regexp_replace(role, _BLANKS, ""))
    return F.coalesce(*[F.when(plain.isin([k for k, v in ROLES.items() if v == to]), F.lit(to)) for to in dict.fromkeys(ROLES.values())])


def _maps() -> Column:
    """The automaton's table: for each kind the next of each state, by number."""
    return F.array(*[F.array(*[F.lit(STATES.index(MOVES.get((s, k), "broken"))) for s in STATES]) for k in KINDS])


def _composed(maps: Column) -> Column:
    """One map for a list of maps (arrays: state to state), the first applied first."""
    same = F.array(*[F.lit(i) for i in range(len(STATES))])
    return F.aggregate(maps, same, lambda at, m: F.transform(at, lambda s: F.element_at(m, s + 1)))


def _folded(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys and map: the maps of rows (keys, order, map) with the same keys, composed by order; at most STRETCH at once."""
    part = F.floor(F.col(order) / STRETCH)
    small = rows.groupBy(*keys, part.alias("part")).agg(F.array_sort(F.collect_list(F.struct(order, "map"))).alias("l"))
    small = small.select(*keys, "part", _composed(F.transform("l", lambda x: x["map"])).alias("map"))
    whole = small.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("part", "map"))).alias("l"))
    return whole.select(*keys, _composed(F.transform("l", lambda x: x["map"])).alias("map"))


def messages_once(messages: DataFrame) -> DataFrame:
    """session_id, created_at, message_id, speaker, blank, calls: rows alike in session, role, content and time once, with
    the smallest id. Contents meet by 128 bits of hash, so no text is shuffled."""
    hashes = [F.xxhash64(F.lit(seed), "content").alias(f"h{seed}") for seed in (1, 2)]
    m = messages.where(F.col("session_id").isNotNull()).select(
        "session_id", "created_at", "role", "id", F.col("content").isNull().alias("absent"), *hashes,
        (F.length(F.regexp_replace(F.coalesce("content", F.lit("")), _BLANKS, "")) == 0).alias("blank"), F.col("tool_calls_json").isNotNull().alias("calls"),
    )
    one = m.groupBy("session_id", "created_at", "role", "absent", "h1", "h2", "blank").agg(F.min("id").alias("message_id"), F.min_by("calls", "id").alias("calls"))
    return one.select("session_id", "created_at", "message_id", speaker(F.col("role")).alias("speaker"), "blank", "calls")


def conversations(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """session_id, turn_no, message_id, speaker of the turns of every kept conversation.

    messages: id, session_id, role, content, tool_calls_json, created_at; sessions: id. Other columns are ignored.
    Rows alike in session_id, role, content and created_at are one, with the smallest id. A session is left out
    if sessions lacks it, if a row of it has no created_at or no recognised role, if a turn is blank (null,
    empty, white space), if it has no turns, or if they don't go user, assistant, ..., assistant. Rows without
    session_id belong to none. Empty tables give no rows.
    """
    m = messages_once(messages)
    faulty = F.col("created_at").isNull() | F.col("speaker").isNull()
    turn = F.col("speaker").isin("user", "assistant") & ~((F.col("speaker") == "assistant") & F.col("calls"))
    kind = F.when(faulty | F.col("blank"), len(KINDS) - 1).when(F.col("speaker") == "user", 0).otherwise(1)
    m = m.where(faulty | turn).select("session_id", "created_at", "message_id", "speaker", kind.cast("byte").alias("kind"))
    # a slice is what one task holds of the order; written, so that it stays the same
    m = kept(m.repartitionByRange("session_id", "created_at", "message_id").withColumn("slice", F.spark_partition_id()), "turns")
    order = Window.partitionBy("session_id", "slice").orderBy("created_at", "message_id")
    m = m.withColumn("n", F.row_number().over(order))
    slices = _folded(m.withColumn("map", F.element_at(_maps(), F.col("kind").cast("int") + 1)).select("session_id", "slice", "n", "map"), ["session_id", "slice"], "n")
    sizes = m.groupBy("session_id", "slice").agg(F.max("n").alias("size"))
    slices = kept(slices.join(sizes, ["session_id", "slice"]), "slices")
    ends = F.array(*[F.lit(STATES.index(s)) for s in ENDS])
    known = sessions.select(F.col("id").alias("session_id")).dropna().distinct()
    whole = _folded(slices, ["session_id"], "slice").where(F.array_contains(ends, F.element_at("map", STATES.index("start") + 1))).join(known, "session_id", "left_semi")
    before = Window.partitionBy("session_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # a row a slice
    good = slices.join(whole.select("session_id"), "session_id").select("session_id", "slice", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("earlier"))
    out = m.join(good, ["session_id", "slice"])
    return out.select("session_id", (F.col("n") + F.col("earlier")).cast("int").alias("turn_no"), "message_id", "speaker")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "chat_messages").select("id", "session_id", "role", "content", "tool_calls_json", "created_at")
    return conversations(m, table(spark, folder, "chat_sessions")).select("session_id", "turn_no", "message_id")
