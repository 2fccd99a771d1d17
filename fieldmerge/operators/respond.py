"""The response to a submission as JSON text, character by character as the service writes it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters that JSON text escapes, and how.
_SHORT = {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
_ESCAPED = _SHORT | {chr(i): f"\\u{i:04x}" for i in range(32) if chr(i) not in _SHORT}


def quoted(text: Column) -> Column:
    """Text as a JSON string: quotes, backslashes and control characters are escaped, all else stands as it is."""
    escaped = reduce(lambda t, c: F.replace(t, F.lit(c[0]), F.lit(c[1])), _ESCAPED.items(), text)
    return F.concat(F.lit('"'), F.when(text.rlike(r'[\x00-\x1f"\\]'), escaped).otherwise(text), F.lit('"'))


def decimal2(value: Column) -> Column:
    """A number of at most 2 decimals without zeros at its end: 40, 0.5, -3.07."""
    parts = F.abs(F.round(value * 100)).cast("bigint")
    rest = parts % 100
    tail = F.when(rest == 0, "").when(rest % 10 == 0, F.concat(F.lit("."), (rest / 10).cast("int").cast("string"))).otherwise(F.concat(F.lit("."), F.lpad(rest.cast("string"), 2, "0")))
    return F.concat(F.when((value < 0) & (parts > 0), "-").otherwise(""), F.floor(parts / 100).cast("string"), tail)


def _object(**members: Column) -> Column:
    """A JSON object of members that are JSON text, in the order given."""
    parts = [F.concat(F.lit(f'{"," if i else ""}"{name}":'), text) for i, (name, text) in enumerate(members.items())]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def _array(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def _number(value: Column) -> Column:
    return value.cast("string")


def _observation(o: Column) -> Column:
    return _object(fieldIndex=_number(o["fieldIndex"]), fieldName=quoted(o["fieldName"]), particleId=quoted(o["particleId"]), localX=_number(o["localX"]), localY=_number(o["localY"]), filterX=_number(o["filterX"]), filterY=_number(o["filterY"]))


def _particle(p: Column) -> Column:
    place = p["representative"]
    links = F.transform(p["links"], lambda e: _object(a=quoted(e["a"]), b=quoted(e["b"]), manhattan=_number(e["manhattan"])))
    return _object(category=quoted(p["category"]), representative=_object(x=decimal2(place["x"]), y=decimal2(place["y"])), observations=_array(F.transform(p["observations"], _observation)), links=_array(links), id=_number(p["id"]))


def responses(outcomes: DataFrame) -> DataFrame:
    """(submission_id, status, response) of process_submissions' outcomes; response is the document that is sent back. Members
    stand in the service's order: an object's id comes last. A lone surrogate was read as its escape, so its backslash is
    escaped here."""
    r = F.col("result")
    particles = F.coalesce(r["particles"], F.array().cast(outcomes.schema["result"].dataType["particles"].dataType))
    solved = _object(tolerance=_number(r["tolerance"]), fieldCount=_number(r["fieldCount"]), observationCount=_number(r["observationCount"]), linkCount=_number(r["linkCount"]), totalParticles=_number(r["totalParticles"]), particles=_array(F.transform(particles, _particle)))
    issues = _array(F.transform("issues", lambda i: _object(path=quoted(i["path"]), message=quoted(i["message"]))))
    message = quoted(F.col("error_message"))
    text = F.when(F.col("status") == 200, solved).when(F.col("status") == 400, _object(error=_object(message=message, issues=issues))).otherwise(_object(error=_object(message=message)))
    return outcomes.select("submission_id", "status", text.alias("response"))
