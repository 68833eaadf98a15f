"""Chat formatting by quotation linking.

A line that starts with quote signs is a quoted passage; the number of signs is its level.
Passages are normalised (signs off, lower case, single spaces) and hashed (128 bits), and
so are the lines that messages wrote themselves. Each quoted passage is joined with the
message that wrote it first in the conversation, if that is an earlier one, and else counts
as linked when another conversation has a message that wrote it. A message replies
to the latest of the earlier messages that its passages of the first level come from;
replies form threads, and a conversation is read thread by thread and turn by turn, each
message without quotes and after the one it replies to. One row per message is returned,
with its place as (conv_id, thread, turn): no conversation gathers in one task.

Who wrote a passage first is an aggregate over (conversation, passage), so a passage that
very many messages share is one row before it is joined. Threads are found by pointer
doubling over replies, a round for each doubling of the longest chain.

Only DataFrame functions are used. Defined results: a null or empty text has no passages
and an empty text; a message without a conversation or turn replies to none and is its own
thread (null); repeated rows get the same result each; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.shared import materialize

SIGNS = "^[ ]*(?:>[ ]?)+"


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, f"({SIGNS})", 1), "[^>]", ""))


def normal(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, SIGNS, ""), "[ \\t\\r]+", " ")))


def _lines() -> Column:
    return F.split(F.coalesce("text", F.lit("")), "\n")


def unquoted() -> Column:
    """The lines a message wrote itself, without empty lines around them."""
    own = F.array_join(F.filter(_lines(), lambda x: ~x.rlike(SIGNS)), "\n")
    return F.regexp_replace(own, "^\\n+|\\n+$", "")


def link(messages: DataFrame) -> DataFrame:
    """``messages``: conv_id, turn, role, text. Per message conv_id, turn, role, text
    without quotes, n_quotes (passages), n_linked (those whose writer is known), reply_to,
    thread (the turn of the thread's first message), depth, formatted."""
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                           F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("role", "text"))
    message = ["conv_id", "turn", "mark"]
    lines = rows.select(*message, F.posexplode(_lines()).alias("number", "line"))
    passages = lines.select(*message, "number", level(F.col("line")).alias("level"),
                            normal(F.col("line")).alias("said")).where("said <> ''").select(
        *message, "number", "level", F.unhex(F.md5("said")).alias("passage"))
    # By the lines' numbers, so that a repeated row counts no line twice.
    quoted = passages.where("level > 0").groupBy(*message, "level", "passage").agg(
        F.size(F.collect_set("number")).alias("times"))
    # The first to write a passage in a conversation.
    wrote = passages.where("level = 0 and conv_id is not null and turn is not null").groupBy(
        "conv_id", "passage").agg(F.min("turn").alias("own_turn"))
    earlier = F.when(F.col("own_turn") < F.col("turn"), F.col("own_turn"))
    found = materialize(quoted.join(wrote, ["conv_id", "passage"], "left").withColumn("writer", earlier).drop(
        "own_turn"), "quotes-found")
    # Passages that no earlier message of the conversation wrote: who did elsewhere?
    open_ = found.where("writer is null").select("passage").distinct()
    elsewhere = wrote.join(open_, "passage", "left_semi").groupBy("passage").agg(
        F.min("conv_id").alias("low"), F.max("conv_id").alias("high"))
    asked = found.where("writer is null").join(elsewhere, "passage", "left")
    other = F.coalesce((F.col("low") != F.col("conv_id")) | (F.col("high") != F.col("conv_id")), F.col("low").isNotNull())
    columns = [*message, "level", "times", "writer"]
    known = found.where("writer is not null").select(*columns, F.lit(True).alias("linked")).unionByName(
        asked.select(*columns, other.alias("linked")))
    links = materialize(known.groupBy(*message).agg(
        F.sum("times").alias("n_quotes"), F.sum(F.when(F.col("linked"), F.col("times")).otherwise(0)).alias("n_linked"),
        F.max(F.when(F.col("level") == 1, F.col("writer"))).alias("reply_to")), "quotes-links")
    threads = _threads(links)
    answer = links.select(*[F.col(c).alias(f"q_{c}") for c in links.columns])
    same = (rows.conv_id.eqNullSafe(answer.q_conv_id) & rows.turn.eqNullSafe(answer.q_turn)
            & (rows.mark == answer.q_mark))
    placed = rows.join(answer, same, "left").join(
        threads, (rows.conv_id == threads.t_conv_id) & (rows.turn == threads.t_turn), "left")
    thread = F.when(F.col("conv_id").isNotNull(), F.coalesce("root", "turn"))
    text = unquoted()
    return placed.select(
        "conv_id", "turn", "role", text.alias("text"),
        F.coalesce("q_n_quotes", F.lit(0)).cast("long").alias("n_quotes"),
        F.coalesce("q_n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.col("q_reply_to").alias("reply_to"), thread.alias("thread"),
        F.coalesce("steps", F.lit(0)).cast("long").alias("depth"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), text, F.lit("\n")).alias("formatted"))


def _threads(links: DataFrame) -> DataFrame:
    """(t_conv_id, t_turn, root, steps) for each message that replies to another."""
    up = links.where("reply_to is not null and conv_id is not null").groupBy(
        F.col("conv_id").alias("t_conv_id"), F.col("turn").alias("t_turn")).agg(
        F.max("reply_to").alias("root")).withColumn("steps", F.lit(1).cast("long"))
    open_, done = materialize(up, "quotes-threads"), None
    while True:
        # Messages whose root is known rest; they only answer those still looking.
        every = open_ if done is None else open_.union(done)
        over = every.select(F.col("t_conv_id").alias("o_conv"), F.col("t_turn").alias("o_turn"),
                            F.col("root").alias("o_root"), F.col("steps").alias("o_steps"))
        joined = open_.join(over, F.expr("t_conv_id = o_conv and root = o_turn"), "left")
        moved = materialize(joined.select(
            "t_conv_id", "t_turn", F.coalesce("o_root", "root").alias("root"),
            (F.col("steps") + F.coalesce("o_steps", F.lit(0))).alias("steps"),
            F.col("o_turn").isNotNull().alias("moved")), "quotes-threads")
        rest = moved.where("not moved").drop("moved")
        done = rest if done is None else done.union(rest)
        open_ = moved.where("moved").drop("moved")
        if open_.isEmpty():
            return done


def as_replies(messages: DataFrame) -> DataFrame:
    """Messages as mail programs send them: each quotes the one before it line by line, and
    that one's quote of its own predecessor's first line one level deeper."""
    turns = messages.groupBy("conv_id", "turn").agg(F.min_by("text", F.struct("role", "text")).alias("text"))
    one = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("one"))
    two = turns.select("conv_id", (F.col("turn") + 2).alias("turn"), F.split("text", "\n")[0].alias("two"))
    rows = messages.join(one, ["conv_id", "turn"], "left").join(two, ["conv_id", "turn"], "left")
    quote = F.array_join(F.transform(F.split("one", "\n"), lambda x: F.concat(F.lit("> "), x)), "\n")
    text = F.concat_ws("\n", F.concat(F.lit("> > "), F.when(F.col("one").isNotNull(), F.col("two"))), quote,
                       F.col("text"))
    return rows.select("conv_id", "turn", "role", text.alias("text"))


#: The queries' result from the messages as they were before they were quoted.
ORACLE = """
WITH RECURSIVE first AS (
  SELECT conv_id, turn, min_by(text, (role, text)) AS text FROM conversations GROUP BY conv_id, turn),
said AS (SELECT conv_id, turn, lower(trim(regexp_replace(line, '[ \\t\\r]+', ' ', 'g'))) AS said, number FROM (
  SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS number FROM first)),
wrote AS (SELECT conv_id, said, min(turn) AS own FROM (
  SELECT conv_id, turn, lower(trim(regexp_replace(line, '[ \\t\\r]+', ' ', 'g'))) AS said FROM (
    SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM conversations))
  WHERE said <> '' GROUP BY conv_id, said),
quoted AS (
  SELECT conv_id, turn + 1 AS turn, 1 AS level, said FROM said
  UNION ALL SELECT a.conv_id, a.turn + 2, 2, a.said FROM said a
  JOIN first b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE number = 0),
links AS (
  SELECT q.conv_id, q.turn, count(*) AS n_quotes, max(CASE WHEN level = 1 AND own < turn THEN own END) AS reply_to
  FROM quoted q JOIN wrote w ON q.conv_id = w.conv_id AND q.said = w.said WHERE q.said <> '' GROUP BY ALL),
thread AS (
  SELECT conv_id, turn, reply_to AS root, 1 AS depth FROM links WHERE reply_to IS NOT NULL
  UNION ALL SELECT t.conv_id, t.turn, l.reply_to, depth + 1 FROM thread t
  JOIN links l ON t.conv_id = l.conv_id AND t.root = l.turn WHERE l.reply_to IS NOT NULL),
deepest AS (SELECT conv_id, turn, min(root) AS root, max(depth) AS depth FROM thread GROUP BY ALL)
SELECT c.conv_id, c.turn, role, regexp_replace(text, '^\\n+|\\n+$', '', 'g') AS text,
       coalesce(n_quotes, 0) AS n_quotes, coalesce(n_quotes, 0) AS n_linked, reply_to,
       coalesce(root, c.turn) AS thread, coalesce(depth, 0) AS depth,
       '<|' || role || '|>' || chr(10) || regexp_replace(text, '^\\n+|\\n+$', '', 'g') || chr(10) AS formatted
FROM conversations c LEFT JOIN links l ON c.conv_id = l.conv_id AND c.turn = l.turn
LEFT JOIN deepest d ON c.conv_id = d.conv_id AND c.turn = d.turn"""
