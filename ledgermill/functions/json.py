"""JSON texts: recovery of replies, reading from several places, updating, and the instructions of chunks."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _closed(part: str) -> str | None:
    """A cut-off JSON object, closed after its last whole member, or null."""
    stack, inside, escaped, cuts = [], False, False, []
    for i, c in enumerate(part):
        if inside:
            inside, escaped = escaped or c != '"', not escaped and c == "\\"
        elif c == '"':
            inside = True
        elif c in "[{":
            stack.append("]" if c == "[" else "}")
            cuts.append((i + 1, "".join(reversed(stack))))
        elif c in "]}" and stack:
            stack.pop()
            cuts.append((i + 1, "".join(reversed(stack))))
        elif c == ",":
            cuts.append((i, "".join(reversed(stack))))
    cuts.append((len(part), ('"' if inside else "") + "".join(reversed(stack))))
    # the whole part as far as it goes, unless it ends within a string; else up to an earlier member
    for at, end in reversed(cuts[:-1] if inside else cuts):
        try:
            return _plain(json.loads(part[:at].rstrip().rstrip(",") + end))
        except ValueError:
            continue
    return None


def _plain(value) -> str:
    return json.dumps(value if isinstance(value, dict) else {"data": value}, ensure_ascii=False, separators=(",", ":"))


def _recovered(text: str | None) -> tuple[str, str]:
    said = (text or "").strip()
    if not said:
        return '{"error":"Empty response","raw":""}', "empty"
    fenced = said.split("```")[1].strip().removeprefix("json") if said.count("```") > 1 else None
    outer = said[said.find("{") : said.rfind("}") + 1]
    for state, part in (("plain", said), ("fenced", fenced), ("outer", outer)):
        try:
            return _plain(json.loads(part or "")), state
        except ValueError:
            continue
    closed = _closed(said[said.find("{") :]) if "{" in said else None
    return (closed, "repaired") if closed else (_plain({"error": "Invalid JSON response", "raw": said[:500]}), "invalid")


def reply(text: Column) -> Column:
    """Struct (json, state): the object in a reply that is JSON, or holds it between fences or within other words, or is cut off; else an error object."""

    def recover(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_recovered(t) for t in texts], columns=["json", "state"])

    return F.pandas_udf(recover, "json string, state string")(text)


def first_of(text: Column, *paths: str) -> Column:
    """The value at the first path that has one; null for what isn't JSON."""
    value = F.try_parse_json(text)
    return F.coalesce(*[F.try_variant_get(value, p, "string") for p in paths])


def with_value(text: Column, key: str, value: Column) -> Column:
    """The JSON object with the key set to the value; what isn't an object counts as empty."""
    old = F.from_json(F.coalesce(F.when(F.try_parse_json(text).isNotNull(), text), F.lit("{}")), "map<string,variant>")
    kept = F.map_filter(F.coalesce(old, F.create_map().cast("map<string,variant>")), lambda k, _: k != key)
    return F.to_json(F.map_concat(kept, F.create_map(F.lit(key), F.parse_json(F.to_json(F.array(value)).substr(F.lit(2), F.length(F.to_json(F.array(value))) - 2)))))


def chunk_instruction(base: Column, index: Column, total: Column) -> Column:
    """The instruction of a chunk of a text, with its place before it where there are several."""
    place = F.when(index == 0, "INITIAL CHUNK (first part)").when(index == total - 1, "FINAL CHUNK (last part)").otherwise(F.format_string("MIDDLE CHUNK (part %d of %d)", index + 1, total))
    return F.when(total <= 1, base).otherwise(F.concat(place, F.lit(" of "), total.cast("string"), F.lit(": "), base))
