"""Strict canonical JSON and JSON Pointer, as Arrow-batched functions.

Spark's JSON parsers accept duplicate keys and turn integers into doubles, so a
receipt's bytes are parsed here.  Limits on depth and nodes keep hostile input
from exhausting a worker.
"""

from __future__ import annotations

import hashlib
import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_DEPTH, MAX_NODES = 128, 100_000


class StrictError(ValueError):
    """The error code is the message."""


def _object(pairs: list[tuple[str, Any]]) -> dict:
    """The parser's hook for objects: a name that comes twice is refused."""
    made = dict(pairs)
    if len(made) < len(pairs):
        place: dict[str, int] = {}
        raise StrictError(f"duplicate_json_key:{next(k for i, (k, _) in enumerate(pairs) if place.setdefault(k, i) != i)}")
    return made


class _Float(str):
    """A number that is no integer, as it stands in the text."""


_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*+"\s*+(:?)|([{\[])|([}\]])|[^\s,:{}\[\]"]++')


def _limits(text: str) -> str | None:
    """The limit that a document breaks, from one scan of its brackets and values."""
    depth = deepest = values = 0
    for m in _TOKEN.finditer(text):
        if m[3]:
            depth -= 1
        elif not m[1]:
            values, deepest = values + 1, max(deepest, depth)
            depth += m[2] is not None
    return "json_depth_limit_exceeded" if deepest > MAX_DEPTH else "json_node_limit_exceeded" if values > MAX_NODES else None


def _first_float(value: Any, path: str = "$") -> str | None:
    """Where the first number stands that is no integer."""
    if isinstance(value, _Float):
        return path
    parts = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    name = "{}.{}" if isinstance(value, dict) else "{}[{}]"
    return next(filter(None, (_first_float(x, name.format(path, k)) for k, x in parts)), None)


def _may_be_large(text: str) -> bool:
    """Few documents come near the limits: the marks tell before any scan of values."""
    return text.count("[") + text.count("{") > MAX_DEPTH or text.count(",") + text.count(":") >= MAX_NODES // 2


def loads(raw: bytes) -> Any:
    """The value of JSON bytes: unique names, integers, bounded depth and size.

    A limit is reported before a number that is no integer, whichever comes first.  Half
    a surrogate pair, which no canonical bytes can hold, is invalid.
    """
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        raise StrictError("invalid_json") from None
    broken = _limits(text) if _may_be_large(text) else None
    if broken == "json_depth_limit_exceeded":
        raise StrictError(broken)
    floats: list[_Float] = []

    def number(x: str) -> _Float:
        floats.append(_Float(x))
        return floats[-1]

    try:
        value = json.loads(text, object_pairs_hook=_object, parse_float=number, parse_constant=number)
    except StrictError:
        raise
    except (ValueError, RecursionError):
        raise StrictError("invalid_json") from None
    if broken:
        raise StrictError(broken)
    if floats:
        raise StrictError(f"float_unsupported:{_first_float(value)}")
    if "\\u" in text:
        try:
            _encoded(value).encode()
        except UnicodeEncodeError:
            raise StrictError("invalid_json") from None
    return value


class _Odd(Exception):
    """A number that is no integer: the plain parse leaves such a text to ``loads``."""


def _odd(number: str) -> Any:
    raise _Odd(number)


_PLAIN = json.JSONDecoder(parse_float=_odd, parse_constant=_odd)


def read(raw: bytes) -> tuple[Any, str]:
    """The value of JSON bytes, as ``loads`` has it, and its canonical text.

    Text that a plain parse and canonical writing give back as it stands names nothing
    twice and holds integers only; all other text goes through ``loads``.
    """
    try:
        text = raw.decode("utf-8")
        if "\\u" not in text and not _may_be_large(text):
            value = _PLAIN.decode(text)
            if _encoded(value) == text:
                return value, text
    except (_Odd, ValueError, RecursionError):
        pass  # which error it is, ``loads`` tells
    value = loads(raw)
    return value, _encoded(value)


def plain(text: str) -> Any:
    """The value of JSON that Spark wrote, without numbers that are no integers; else a ``ValueError``."""
    try:
        return _PLAIN.decode(text)
    except _Odd as e:
        raise ValueError(f"float_unsupported:{e}") from None


def check(value: Any, path: str = "$") -> None:
    """Raise for a Python value that is no strict JSON: floats, other types, names that are no text, exceeded limits."""
    foreign = lambda x, at: StrictError(f"unsupported_type:{at}:{type(x).__name__}")

    def plain(x: Any, at: str) -> Any:
        match x:
            case None | bool() | int() | str():
                return x
            case float():
                raise StrictError(f"float_unsupported:{at}")
            case dict():
                if not all(isinstance(k, str) for k in x):
                    raise StrictError(f"non_string_key:{at}")
                return {k: plain(v, f"{at}.{k}") for k, v in x.items()}
            case list() | tuple():
                return [plain(v, f"{at}[{i}]") for i, v in enumerate(x)]
        raise foreign(x, at)

    try:
        text = json.dumps(plain(value, path))
    except RecursionError:
        raise StrictError("json_depth_limit_exceeded") from None
    if broken := _limits(text):
        raise StrictError(broken)


_encoded = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode


def _refuse(number: str) -> Any:
    raise ValueError(number)


def dumps(value: Any, known: bool = False) -> bytes:
    """Canonical bytes of the receipts' profile: sorted keys, no spaces, UTF-8.

    A value that is ``known`` comes from ``loads`` and is not checked again.  Any other is
    sound if its text is read back as the same value; only one that is not is walked for
    the reason.
    """
    if known:
        return _encoded(value).encode()
    try:
        text = _encoded(value)
        sound = not _may_be_large(text) and json.loads(text, parse_float=_refuse) == value
    except (TypeError, ValueError, RecursionError):
        sound = False
    if not sound:
        check(value)
        text = _encoded(value)
    return text.encode()


def dumps_ascii(value: Any) -> bytes:
    """Canonical bytes of the trial's profile: as above in ASCII, not validated."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False).encode()


def pretty(value: Any) -> str:
    """Indented text of the receipts' profile, with a line end."""
    check(value)
    return json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True) + "\n"


def object_hash(value: Any, known: bool = False) -> str:
    return hashlib.sha256(dumps(value, known)).hexdigest()


def object_hash_ascii(value: Any) -> str:
    """The hash of the trial's profile."""
    return hashlib.sha256(dumps_ascii(value)).hexdigest()


def resolve(value: Any, pointer: str) -> Any:
    """The value an RFC 6901 pointer names; raises with an error code."""
    if pointer == "":
        return value
    if not pointer.startswith("/"):
        raise StrictError("json_pointer_invalid")
    for part in pointer[1:].split("/"):
        if re.search(r"~(?![01])", part):
            raise StrictError("json_pointer_escape_invalid")
        key = part.replace("~1", "/").replace("~0", "~")
        if isinstance(value, dict):
            if key not in value:
                raise StrictError("json_pointer_missing")
            value = value[key]
        elif isinstance(value, list):
            if not re.fullmatch("0|[1-9][0-9]{0,8}", key, re.ASCII):
                raise StrictError("json_pointer_index_invalid")
            if int(key) >= len(value):
                raise StrictError("json_pointer_missing")
            value = value[int(key)]
        else:
            raise StrictError("json_pointer_not_container")
    return value


def canonical(raw: Column | str) -> Column:
    """(canonical, error) of JSON bytes or text: canonical text or an error code; null stays null."""
    return F.pandas_udf(_canonical, "struct<canonical:string, error:string>")(raw)


def _canonical(raw: pd.Series) -> pd.DataFrame:
    def one(x: Any) -> tuple[str | None, str | None]:
        if x is None:
            return None, None
        try:
            return dumps(loads(x.encode() if isinstance(x, str) else bytes(x)), known=True).decode(), None
        except StrictError as e:
            return None, str(e)

    return pd.DataFrame([one(x) for x in raw], columns=["canonical", "error"])


def pointed(raw: Column | str, pointer: Column | str) -> Column:
    """(found, error): canonical text of the value a pointer names in JSON, or an error code."""
    return F.pandas_udf(_pointed, "struct<found:string, error:string>")(raw, pointer)


def _pointed(raw: pd.Series, pointer: pd.Series) -> pd.DataFrame:
    def one(x: Any, p: str) -> tuple[str | None, str | None]:
        if x is None or p is None:
            return None, None
        try:
            return dumps(resolve(loads(x.encode() if isinstance(x, str) else bytes(x)), p), known=True).decode(), None
        except StrictError as e:
            return None, str(e)

    return pd.DataFrame([one(x, p) for x, p in zip(raw, pointer, strict=True)], columns=["found", "error"])
