"""Display labels and links of message, chat and knowledge rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.coerce import first_truthy, strip

# Labels shown when a record carries none.
UNKNOWN_USER = "unknown"
UNTITLED_CHAT = "タイトル未設定"
UNNAMED_KNOWLEDGE = "名称未設定"

UUID_SHAPE = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
ID_SHAPE = r"^[A-Za-z0-9][A-Za-z0-9_.:-]{15,}$"


def user_label(user: Column, user_id: Column) -> Column:
    """Poster of a message: name, e-mail, id, then the flat user id."""
    nested = [user.getField(name) for name in ("name", "email", "id")]
    return first_truthy(*nested, user_id, default=UNKNOWN_USER)


def chat_owner(user: Column, flat: list[Column], user_id: Column) -> Column:
    """Owner of a chat: nested user where present, else the flat aliases."""
    nested = first_truthy(*[user.getField(n) for n in ("name", "email", "id")], user_id, default=UNKNOWN_USER)
    return F.when(user.isNotNull(), nested).otherwise(first_truthy(*flat, default=UNKNOWN_USER))


def chat_title(inner_title: Column, title: Column, name: Column, chat_id: Column) -> Column:
    return first_truthy(inner_title, title, name, chat_id, default=UNTITLED_CHAT)


def knowledge_name(name: Column, title: Column, item_id: Column) -> Column:
    return first_truthy(name, title, item_id, default=UNNAMED_KNOWLEDGE)


def quoted(col: Column) -> Column:
    """Percent-encode everything outside the unreserved set."""
    encoded = F.url_encode(col.cast("string"))
    encoded = F.replace(encoded, F.lit("+"), F.lit("%20"))
    encoded = F.replace(encoded, F.lit("*"), F.lit("%2A"))
    return F.replace(encoded, F.lit("%7E"), F.lit("~"))


def channel_url(channel_id: Column, base_url: str = "") -> Column:
    return F.concat(F.lit(base_url.strip().rstrip("/") + "/channels/"), quoted(channel_id))


def channel_label(name: Column, channel_id: Column) -> Column:
    bare = F.ltrim(strip(F.coalesce(name, F.lit(""))), F.lit("#"))
    return F.concat(F.lit("#"), first_truthy(bare, channel_id, default=""))


def channel_link(name: Column, channel_id: Column, base_url: str = "") -> Column:
    """Markdown link of a channel; never names a message."""
    return F.concat(
        F.lit("["), channel_label(name, channel_id), F.lit("]("), channel_url(channel_id, base_url), F.lit(")")
    )


def bare_channel_name(text: Column) -> Column:
    return strip(F.ltrim(strip(text), F.lit("#")))


def looks_like_channel_id(text: Column) -> Column:
    value = strip(text)
    return value.rlike(UUID_SHAPE) | value.rlike(ID_SHAPE)
