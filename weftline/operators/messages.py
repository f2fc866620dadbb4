"""Chat payloads, threads, attached files and message lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.coerce import TIME_KEYS, first_truthy, strip, text_moment
from weftline.operators.rows import unpack
from weftline.session import Rounds

MAX_MESSAGE_CHARS = 20000
MODEL_ROLES = ("user", "assistant", "system")


def _field(payload: Column, path: str) -> Column:
    return F.try_variant_get(payload, path, "variant")


def _is_shape(payload: Column, shape: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(payload), F.lit(shape)), F.lit(False))


def _entries(payload: Column) -> Column:
    """Object entries of a list or map in source order, as array<variant>.

    Variants order object keys by name, so a map is re-read from its text.
    """
    listed = F.from_json(payload, "array<variant>")
    mapped = F.transform(F.map_entries(F.from_json(payload, "map<string,variant>")), lambda e: e["value"])
    entries = F.when(F.startswith(F.ltrim(payload), F.lit("[")), listed).otherwise(mapped)
    return F.filter(entries, lambda e: _is_shape(e, "OBJECT"))


def chat_messages(chats: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per message of each chat, whichever of the five shapes it uses.

    ``messages`` as list or map, ``history`` as list, ``history.messages`` as
    map or list; a wrapping ``chat`` object is looked through. Entries that
    are not objects are dropped. Needs no shuffle.
    """
    raw = F.col(payload)
    wrapped = F.get_json_object(raw, "$.chat")
    body = F.when(F.startswith(F.ltrim(wrapped), F.lit("{")), wrapped).otherwise(raw)
    messages = F.get_json_object(body, "$.messages")
    history = F.get_json_object(body, "$.history")
    inner = F.get_json_object(body, "$.history.messages")

    def container(text: Column) -> Column:
        return F.coalesce(F.ltrim(text).rlike(r"^[\[{]"), F.lit(False))

    chosen = (
        F.when(container(messages), messages)
        .when(F.startswith(F.ltrim(history), F.lit("[")), history)
        .when(F.startswith(F.ltrim(history), F.lit("{")) & container(inner), inner)
    )
    picked = chats.withColumn("_source", chosen).withColumn("_entries", _entries(F.col("_source")))
    kept = [c for c in chats.columns if c != payload]
    rows = unpack(picked, kept, F.col("_entries"), "pos", "_m")

    def text(path: str) -> Column:
        return F.try_variant_get("_m", path, "string")

    moments = [text_moment(text(f"$.{key}")) for key in TIME_KEYS]
    return rows.select(
        *kept, "pos",
        text("$.id").alias("message_id"), text("$.role").alias("role"),
        first_truthy(text("$.content"), text("$.text"), default="").alias("content"),
        text("$.parentId").alias("parent_id"),
        F.try_variant_get("_m", "$.childrenIds", "array<string>").alias("children_ids"),
        F.coalesce(*moments).alias("message_ts"),
    )


def effective_time(messages: DataFrame) -> DataFrame:
    """A message without a time takes the time of its chat."""
    return messages.withColumn("ts", F.coalesce("message_ts", "chat_ts"))


def thread_page(replies: DataFrame, limit: int, skip: int = 0) -> DataFrame:
    """Replies ``skip + 1`` to ``skip + limit`` of each thread, numbered, and whether ``more`` follow.

    The rank filter is applied before the shuffle, so a huge thread sends at
    most ``skip + limit + 1`` rows per input partition.
    """
    order = Window.partitionBy("parent_id").orderBy("seq")
    ranked = replies.select(
        "parent_id", "seq", F.col("id").cast("string").alias("id"), "content",
    ).withColumn("reply_no", F.row_number().over(order)).filter(F.col("reply_no") <= skip + limit + 1)
    more = F.max("reply_no").over(Window.partitionBy("parent_id")) > skip + limit
    return ranked.withColumn("more", more).filter((F.col("reply_no") > skip) & (F.col("reply_no") <= skip + limit))


def attach_threads(messages: DataFrame, replies: DataFrame, limit: int | None = None, skip: int = 0) -> DataFrame:
    """Nest the replies into the parent message: all of them, or one page with a ``thread_more`` flag.

    Without a limit a message holds its whole thread; for threads of unbounded
    length give a limit, or keep ``replies`` as rows.
    """
    if limit is None:
        order = F.array_sort(F.collect_list(F.struct("seq", F.col("id").cast("string").alias("id"), "content")))
        nested = replies.groupBy("parent_id").agg(order.alias("_t"), F.lit(False).alias("thread_more")).select(
            "parent_id", "thread_more", F.transform("_t", lambda t, i: F.struct((i + 1).alias("reply_no"), t["id"].alias("id"), t["content"].alias("content"))).alias("thread"))
    else:
        nested = thread_page(replies, limit, skip).groupBy("parent_id").agg(
            F.max("more").alias("thread_more"), F.array_sort(F.collect_list(F.struct("reply_no", "id", "content"))).alias("thread")
        )
    joined = messages.join(nested, messages["id"] == nested["parent_id"], "left").drop("parent_id")
    empty = F.array().cast("array<struct<reply_no:int,id:string,content:string>>")
    return joined.withColumns({"thread": F.coalesce("thread", empty), "thread_more": F.coalesce("thread_more", F.lit(False))})


def file_ids(messages: DataFrame, files: str = "files") -> DataFrame:
    """Attached file ids, one row each, in order; empty ids are dropped."""
    ids = F.filter(F.transform(files, lambda f: f["id"].cast("string")), lambda x: x.isNotNull() & (x != ""))
    return unpack(messages, ["id"], ids, "file_pos", "file_id")


def completion_messages(messages: DataFrame, pending: DataFrame | None = None) -> DataFrame:
    """Model-ready turns per chat as rows, plus the pending user turn.

    The pending text is appended unless the last turn already holds it. Rows,
    not arrays: a chat of any length stays spread out.
    """
    usable = messages.filter(
        F.col("role").isin(*MODEL_ROLES) & (F.coalesce("content", F.lit("")) != "")
    ).select("chat_id", "seq", "role", "content")
    if pending is None:
        return usable
    last = usable.groupBy("chat_id").agg(
        F.max(F.struct("seq", "content")).alias("last")
    )
    added = (
        pending.join(last, "chat_id", "left")
        .filter(F.col("last").isNull() | (F.col("last.content") != F.col("pending")))
        .select(
            "chat_id", (F.coalesce("last.seq", F.lit(-1)) + 1).alias("seq"),
            F.lit("user").alias("role"), F.col("pending").alias("content"),
        )
    )
    return usable.unionByName(added)


def append_turn(messages: DataFrame, heads: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add a user turn and its assistant placeholder to chat trees: the messages and the heads after it.

    ``messages``: chat_id, id, parent_id, children_ids, role, content.
    ``heads``: chat_id, current_id, where each chat stands; a chat without a
    head, or with an empty one, begins anew. ``turns``: chat_id, user_id,
    assistant_id, content; blank turns are left out. The new user id joins the
    children of the current message, and the head moves to the reply.
    """
    now = F.nullif("current_id", F.lit(""))
    usable = turns.filter(strip(F.coalesce("content", F.lit(""))) != "").join(heads.select("chat_id", now.alias("current_id")), "chat_id", "left")
    fresh_user = usable.select(
        "chat_id", F.col("user_id").alias("id"), F.col("current_id").alias("parent_id"),
        F.array("assistant_id").alias("children_ids"), F.lit("user").alias("role"), "content",
    )
    fresh_reply = usable.select(
        "chat_id", F.col("assistant_id").alias("id"), F.col("user_id").alias("parent_id"),
        F.array().cast("array<string>").alias("children_ids"), F.lit("assistant").alias("role"),
        F.lit("").alias("content"),
    )
    links = usable.select("chat_id", F.col("current_id").alias("id"), F.col("user_id").alias("_child"))
    linked = messages.join(links, ["chat_id", "id"], "left")
    children = F.coalesce("children_ids", F.array().cast("array<string>"))
    grown = F.when(F.col("_child").isNull(), F.col("children_ids")).otherwise(
        F.when(F.array_contains(children, F.col("_child")), children).otherwise(F.array_append(children, F.col("_child")))
    )
    updated = linked.withColumn("children_ids", grown).select(*fresh_user.columns)
    moved = usable.select("chat_id", F.col("assistant_id").alias("_moved"))
    after = heads.join(moved, "chat_id", "full").select("chat_id", F.coalesce("_moved", "current_id").alias("current_id"))
    return updated.unionByName(fresh_user).unionByName(fresh_reply), after


def tree_links(messages: DataFrame) -> DataFrame:
    """(chat_id, id, parent_id, up, reason): the parent a message can be reached from, and why not.

    A link holds if the parent exists in the chat and lists the message. Roots
    have neither ``up`` nor a reason.
    """
    listed = messages.select("chat_id", F.col("id").alias("parent_id"), F.explode("children_ids").alias("id")).distinct().withColumn("_listed", F.lit(True))
    known = messages.select("chat_id", F.col("id").alias("parent_id")).distinct().withColumn("_known", F.lit(True))
    child = messages.select("chat_id", "id", F.nullif("parent_id", F.lit("")).alias("parent_id"))
    joined = child.join(listed, ["chat_id", "id", "parent_id"], "left").join(known, ["chat_id", "parent_id"], "left")
    reason = F.when(F.col("parent_id").isNull(), None).when(F.col("_known").isNull(), "unknown parent").when(F.col("_listed").isNull(), "not listed by parent")
    return joined.select("chat_id", "id", "parent_id", F.when(reason.isNull(), F.col("parent_id")).alias("up"), reason.alias("reason"))


class ChatTrees:
    """What can be reached in chat trees of any depth, by pointer doubling.

    Round k joins every message with the one 2^k links above it, so trees of
    depth n take about log2(n) joins, whatever the shape, and no chat is
    gathered in one place. Rounds are tables in the shared folder.
    """

    def __init__(self, messages: DataFrame) -> None:
        self._rounds = Rounds(messages.sparkSession)
        start = tree_links(messages)
        # top: the message a chain ends at; steps: links up to it
        state = start.select("chat_id", "id", "up", F.coalesce("up", "id").alias("top"), F.col("up").isNotNull().cast("bigint").alias("steps"))
        self.links = self._rounds.keep("links", start)
        self.jumps = [self._rounds.keep("jump-0", state)]
        largest = messages.groupBy("chat_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        while self.jumps[-1].filter("up is not null").limit(1).count():
            if 1 << len(self.jumps) > 2 * largest:
                break  # longer chains than messages: only loops are left
            here = self.jumps[-1]
            above = here.select("chat_id", F.col("id").alias("up"), F.col("up").alias("_up"), F.col("top").alias("_top"), F.col("steps").alias("_steps"))
            next_ = here.join(above, ["chat_id", "up"], "left").select(
                "chat_id", "id", F.col("_up").alias("up"), F.coalesce("_top", "top").alias("top"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"))
            self.jumps.append(self._rounds.keep(f"jump-{len(self.jumps)}", next_))

    def hidden(self) -> DataFrame:
        """(chat_id, id, parent_id, reason, broken_at): messages that no chain of links joins with a root.

        ``broken_at`` is the nearest message with a broken link, the message
        itself or one above; in a loop it is null.
        """
        last = self.jumps[-1]
        breaks = self.links.filter("reason is not null").select("chat_id", F.col("id").alias("top"), F.lit(True).alias("_broken"))
        found = last.join(breaks, ["chat_id", "top"], "left").filter(F.col("_broken") | F.col("up").isNotNull())
        joined = self.links.join(found.select("chat_id", "id", F.when(F.col("up").isNull(), F.col("top")).alias("broken_at")), ["chat_id", "id"])
        inherited = F.when(F.col("broken_at").isNull(), "parents form a loop").otherwise("under a broken link")
        return joined.select("chat_id", "id", "parent_id", F.coalesce("reason", inherited).alias("reason"), "broken_at")

    def visible(self, heads: DataFrame) -> DataFrame:
        """(chat_id, id, place): the branch from the first message in reach (place 0) to the chat's head.

        ``heads``: chat_id, current_id. A head that is no message shows nothing;
        above a broken link nothing is shown; a loop shows each message once, from 0 at the head.
        """
        first = heads.select("chat_id", F.col("current_id").alias("id")).join(self.jumps[0].select("chat_id", "id"), ["chat_id", "id"])
        path = first.withColumn("below", F.lit(0).cast("bigint"))
        for k in range(len(self.jumps) - 1, -1, -1):
            step = self.jumps[k].filter("up is not null").select("chat_id", "id", "up")
            further = path.join(step, ["chat_id", "id"]).select("chat_id", F.col("up").alias("id"), (F.col("below") + (1 << k)).alias("below"))
            path = self._rounds.keep("path", path.unionByName(further))
        once = path.groupBy("chat_id", "id").agg(F.min("below").alias("below"))
        length = self.jumps[-1].select("chat_id", "id", F.when(F.col("up").isNull(), F.col("steps")).alias("_steps"))
        return once.join(length, ["chat_id", "id"]).select("chat_id", "id", F.coalesce("_steps", -F.col("below")).alias("place"))

    def close(self) -> None:
        """Delete the tables of the rounds; results are void then."""
        self._rounds.close()


def broken_links(messages: DataFrame) -> DataFrame:
    """Messages hidden by a bad link of their own or of a message above them; see :meth:`ChatTrees.hidden`."""
    return ChatTrees(messages).hidden()


def publishable(posts: DataFrame, limit: int = MAX_MESSAGE_CHARS) -> DataFrame:
    """Verdict per post: blank or over-long content is rejected with a reason."""
    blank = strip(F.coalesce("content", F.lit(""))) == ""
    reason = F.when(blank, "content is required").when(
        F.length("content") > limit, f"content exceeds {limit} characters"
    )
    return posts.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())
