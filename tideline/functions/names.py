"""Object, event, channel and topic names, as column expressions.

A blank name has no result: the lenient forms give NULL, so the row can go to
the dead letters, and ``strict=True`` fails the job instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The naming rules of the change-event bus.
TOPIC_PREFIX = "/data/"
EVENT_SUFFIX = "ChangeEvent"
CUSTOM_EVENT_SUFFIX = "__ChangeEvent"
CUSTOM_SUFFIX = "__c"
CHANNEL_PREFIX = "ChangeEvents_"
BASE_OF_OBJECT = r"(?i)^(.+?)(__c)?$"
BASE_OF_EVENT = r"^(.*?)(?:__)?ChangeEvent$"
BASE_OF_EVENT_STRICT = r"(?i)^(.+?)(?:__)?ChangeEvent$"
OBJECT_AFTER_FROM = r"(?iU)FROM\s+([a-zA-Z0-9_]+)\b"


def is_blank(name: Column) -> Column:
    return name.isNull() | name.rlike(r"^(?U)\s*$")


def _named(name: Column, result: Column, strict: bool, problem: str, valid: Column | None = None) -> Column:
    ok = ~is_blank(name) if valid is None else ~is_blank(name) & valid
    if strict:
        return F.when(ok, result).otherwise(F.raise_error(F.lit(problem)))
    return F.when(ok, result)


def is_custom(name: Column) -> Column:
    return F.lower(name).endswith(CUSTOM_SUFFIX)


def object_to_event(name: Column, strict: bool = False) -> Column:
    """``X__c`` to ``X__ChangeEvent`` and ``X`` to ``XChangeEvent``."""
    base = F.regexp_extract(name, BASE_OF_OBJECT, 1)
    suffix = F.when(is_custom(name), CUSTOM_EVENT_SUFFIX).otherwise(EVENT_SUFFIX)
    return _named(name, F.concat(base, suffix), strict, "blank object name")


def strip_topic(name: Column) -> Column:
    return F.regexp_replace(name, "^" + TOPIC_PREFIX, "")


def event_to_object(name: Column, strict: bool = False) -> Column:
    """Lenient inverse: a name that is no change event is returned as it is."""
    event = strip_topic(name)
    base = F.when(event.rlike(BASE_OF_EVENT), F.regexp_extract(event, BASE_OF_EVENT, 1)).otherwise(event)
    custom = event.contains(CUSTOM_EVENT_SUFFIX)
    return _named(name, F.when(custom, F.concat(base, F.lit(CUSTOM_SUFFIX))).otherwise(base), strict, "blank event name")


def event_to_object_strict(name: Column, strict: bool = False) -> Column:
    """Strict inverse: any case, and a name that is no change event has no result."""
    event = strip_topic(name)
    base = F.regexp_extract(event, BASE_OF_EVENT_STRICT, 1)
    custom = F.lower(event).endswith(CUSTOM_EVENT_SUFFIX.lower())
    return _named(
        name,
        F.when(custom, F.concat(base, F.lit(CUSTOM_SUFFIX))).otherwise(base),
        strict,
        "not a change event name",
        valid=event.rlike(BASE_OF_EVENT_STRICT),
    )


def channel_member(name: Column) -> Column:
    """Member name in the channel; the suffix test ignores case, its removal does not."""
    custom = F.concat(F.lit(CHANNEL_PREFIX), F.replace(name, F.lit(CUSTOM_SUFFIX), F.lit("")), F.lit("_" + EVENT_SUFFIX))
    plain = F.concat(F.lit(CHANNEL_PREFIX), name, F.lit(EVENT_SUFFIX))
    return F.when(~is_blank(name), F.when(is_custom(name), custom).otherwise(plain))


def topic_path(name: Column, fallback: Column | None = None) -> Column:
    """``/data/`` and the event name; an empty name gives way to the fallback."""
    chosen = F.coalesce(F.nullif(name, F.lit("")), fallback) if fallback is not None else name
    return F.concat(F.lit(TOPIC_PREFIX), object_to_event(chosen))


def entity_topic(entity: Column) -> Column:
    """Topic of a selected entity, which is an event name already."""
    return F.concat(F.lit(TOPIC_PREFIX), F.coalesce(entity, F.lit("")))


def object_of_query(text: Column) -> Column:
    """The object a query text reads: the first word after FROM, or NULL."""
    return F.nullif(F.regexp_extract(text, OBJECT_AFTER_FROM, 1), F.lit(""))
