"""Functions on what trackers and chats deliver, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# trackers' own keys of status categories, and names that stand for one where there's no key.
CATEGORIES = {"new": "todo", "indeterminate": "in_progress", "done": "done"}
DONE_NAMES = ["done", "closed", "resolved"]
TODO_NAMES = ["to do", "todo", "open", "backlog"]
CATEGORY_ORDER = ["todo", "in_progress", "done"]
# Fixed value: the namespace of conversation ids.
CONVERSATIONS = "6f0c3c0e-3b1a-4f5e-9d47-1a9a5c1d2b77"


def status_category(key: Column, name: Column) -> Column:
    """todo, in_progress or done: by the tracker's key, else by the name; anything unknown is in progress."""
    low = F.lower(F.coalesce(name, F.lit("")))
    known = F.element_at(F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv]), F.coalesce(key, F.lit("")))
    return F.coalesce(known, F.when(low.isin(DONE_NAMES), "done").when(low.isin(TODO_NAMES), "todo").otherwise("in_progress"))


def column_id(name: Column) -> Column:
    """A board column's id: stable while its name is, whatever its case and blanks at the ends."""
    return F.concat(F.lit("col_"), F.left(F.sha1(F.lower(F.trim(name))), F.lit(10)))


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based UUID as 32 hexadecimal digits: SHA-1 of namespace and name with version and variant set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3), variant, F.substring(digest, 18, 15))


def conversation_id(workspace: Column, channel: Column, root: Column, read_before: Column) -> Column:
    """The id that a conversation was read under before, else one made from its root."""
    return F.coalesce(read_before, uuid5(CONVERSATIONS, F.concat_ws(":", workspace, channel, root)))


def permalink(address: Column, channel: Column, ts: Column) -> Column:
    """Where a message opens, from the workspace's address; null without one."""
    return F.concat(F.regexp_replace(address, "/+$", ""), F.lit("/archives/"), channel, F.lit("/p"), F.replace(ts, F.lit("."), F.lit("")))


def current_sprint(sprints: Column) -> Column:
    """Of an array of struct<id, state, start>: an active one, else the next future one, by start and id; null if none is open."""
    open_ = F.filter(sprints, lambda x: x["state"].isin("active", "future"))
    ranked = F.array_sort(F.transform(open_, lambda x: F.struct((x["state"] != "active").alias("a"), F.coalesce(x["start"], F.lit("")).alias("s"), F.coalesce(x["id"], F.lit(0)).alias("i"), x.alias("x"))))
    return F.get(ranked, F.lit(0))["x"]


def link_label(outward: Column, inward: Column, name: Column, is_outward: Column) -> Column:
    """How a link reads from this issue's side."""
    return F.when(is_outward, F.coalesce(outward, name)).otherwise(F.coalesce(inward, name))


def retry_minutes(failures: Column, base: int = 10, most: int = 3) -> Column:
    """Minutes until a failed read is tried again, doubling each time; null when it's given up."""
    return F.when(failures < most, (F.lit(base) * F.pow(F.lit(2), failures - 1)).cast("long"))


def due_day(now: Column, offset_zone: Column, at_minute: Column, connected: Column, sent_on: Column, catch_up_minutes: int = 60) -> Column:
    """The local day whose digest is due: today once its time has passed, yesterday if its time passed `catch_up_minutes` ago
    at most; null if its time came before the connection, or if that day's was sent. now and connected are UTC moments."""
    local = F.from_utc_timestamp(now, offset_zone)
    minute = F.hour(local) * 60 + F.minute(local)
    today = F.to_date(local)
    yesterday_ago = minute + 1440 - at_minute
    day = F.when(minute >= at_minute, today).when(yesterday_ago * 60 + F.second(local) <= catch_up_minutes * 60, F.date_sub(today, 1))
    slot = F.to_utc_timestamp(F.timestamp_seconds(F.unix_seconds(day.cast("timestamp")) + at_minute * 60), offset_zone)
    return F.when(connected.isNull() | (slot >= connected), F.when(sent_on.isNull() | (sent_on != day.cast("string")), day.cast("string")))
