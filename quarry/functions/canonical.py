"""Strict JSON of any shape: repeated keys, unsafe and non-finite numbers are seen; digests do not depend on how keys are ordered or numbers spelled.

JSON of unknown depth has no schema that an expression could walk, so texts go to Python in
Arrow batches, each row on its own.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.records import POSITIONAL_ID

#: Integers beyond this are not exact in every reader; the fields of an event that are content, of its source and of an artifact.
SAFE_INTEGER = 2**53 - 1
EVENT_FIELDS = ("schema", "event_id", "trajectory_id", "event_type", "timestamp", "started_at", "turn_id", "actor", "relations")
SOURCE_FIELDS = ("system", "session_id", "record_type", "origin", "interaction_direction")
ARTIFACT_FIELDS = ("kind", "original_name", "media_type", "size_bytes", "sha256", "created_by_event")
EVENT_NEEDS = {"event_id", "event_type", "payload", "source"}


class Refused(ValueError):
    """Why a text is no strict JSON: the code is the message."""


def _once(pairs: list[tuple[str, object]]) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise Refused("duplicate_key")
    return found


def _constant(name: str) -> float:
    raise Refused("non_finite")


def read(text: str) -> object:
    try:
        return json.loads(text, object_pairs_hook=_once, parse_constant=_constant)
    except RecursionError:
        raise Refused("too_deep") from None
    except json.JSONDecodeError:
        raise Refused("not_json") from None


def written(value: object) -> str:
    """Compact JSON, keys by their UTF-8 bytes, letters not escaped."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{written(value[k])}" for k in sorted(value, key=str.encode)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(written, value)) + "]"
    if isinstance(value, float) and not math.isfinite(value):
        raise Refused("non_finite")
    return json.dumps(value, ensure_ascii=False, allow_nan=False)


def normal(value: object) -> list:
    """A value as nested lists of kind and content; a number by its value, whole or as the bits of a double."""
    if value is None:
        return ["null"]
    if isinstance(value, bool):
        return ["boolean", value]
    if isinstance(value, str):
        return ["string", value]
    if isinstance(value, list):
        return ["array", [normal(x) for x in value]]
    if isinstance(value, dict):
        return ["object", [[k, normal(value[k])] for k in sorted(value, key=str.encode)]]
    if not math.isfinite(value):
        raise Refused("non_finite")
    if value != int(value):
        return ["number", "f:" + struct.pack(">d", value).hex()]
    if abs(value) > SAFE_INTEGER:
        raise Refused("unsafe_integer")
    return ["number", f"i:{int(value)}"]


def content(event: object) -> object:
    """What an event says, without the marks of how it was extracted; other values as they are."""
    if not isinstance(event, dict) or not EVENT_NEEDS <= event.keys():
        return event
    picked = lambda of, names: {k: of[k] for k in names if k in of}
    source = event["source"] if isinstance(event["source"], dict) else {}
    kept = picked(source, SOURCE_FIELDS)
    record = source.get("record_id")
    if isinstance(record, str) and record and not re.fullmatch(POSITIONAL_ID.strip("^$"), record):
        kept["record_id"] = record
    payload = event["payload"]
    if event["event_type"] == "artifact" and isinstance(payload, dict):
        payload = picked(payload, ARTIFACT_FIELDS)
    return picked(event, EVENT_FIELDS) | {"source": kept, "payload": payload}


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _told(text: str | None) -> tuple:
    if text is None:
        return None, None, None, None, None
    try:
        value = read(text)
        plain = written(value)
        return plain, _sha(plain), _sha(written(normal(value))), _sha(written(normal(content(value)))), None
    except Refused as e:
        return None, None, None, None, str(e)
    except RecursionError:
        return None, None, None, None, "too_deep"


FIELDS = ("canonical", "digest", "normal_digest", "content_digest", "code")


def _strict(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_told(t) for t in texts], columns=list(FIELDS))


def strict_json(text: Column) -> Column:
    """(canonical, digest, normal_digest, content_digest, code) of a JSON text.

    code: duplicate_key, non_finite, unsafe_integer, too_deep or not_json, with all else null; a null text is
    null everywhere. ``normal_digest`` is equal for equal values however they are spelled;
    ``content_digest`` is that of the ``content`` of an event.
    """
    return F.pandas_udf(_strict, ", ".join(f"{f} string" for f in FIELDS))(text)
