"""The validation rules on parsed JSON (VARIANT), as expressions: no Python process sees a body that the parser can read.

A body is read with a marker after it, so that anything behind its end is seen. The parser interns every name that it reads, for
all tasks of a process, so the marker is the same name for all bodies but those that may hold it. What this parser can't tell apart or won't
read (repeated keys, very long numbers, deep nesting, escaped surrogates, invalid JSON) is left to validate.inspect, which
says the same of any body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmerge.functions.text import trimmed, utf16_length
from fieldmerge.operators import validate as v
from fieldmerge.plans.settled import settled

#: The shape of most bodies, read at once; one of any other shape is read member by member.
_SHAPE = "array<struct<name:variant,offset:struct<x:variant,y:variant>,particles:array<struct<id:variant,x:variant,y:variant,category:variant>>>>"
_EVENT = "array<struct<at:bigint,kind:string,path:string,text:string>>"
#: The name after a body that can't hold it.
MARKER = "behind"


def _part(value: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, f"$.{name}", kind)


def _is_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>").isNotNull()


def _items(value: Column) -> Column:
    """The items of an array; null for anything else."""
    return F.try_variant_get(value, "$", "array<variant>")


def _text(value: Column) -> Column:
    """The trimmed text of a string; null for anything else."""
    return F.when(F.schema_of_variant(value) == "STRING", trimmed(F.try_variant_get(value, "$", "string")))


def _whole(value: Column, least: int, most: int) -> Column:
    """A number that is whole as a double and within the limits."""
    number = F.array(F.try_variant_get(value, "$", "double"))
    fits = F.coalesce(F.get(F.transform(number, lambda n: (n >= least) & (n <= most) & (n % 1 == 0)), 0), F.lit(False))
    return fits & ~F.schema_of_variant(value).isin("STRING", "BOOLEAN")  # only asked of what fits


def _longer(text: Column, most: int) -> Column:
    """More UTF-16 code units than `most`; a text never has fewer bytes than these."""
    return (F.octet_length(text) > most) & (utf16_length(text) > most)


def _at(i: Column, j: Column | int, slot: int) -> Column:
    """Places in traversal order: field, particle from 1 on (0: the field itself), member. A body's limit keeps them apart."""
    return i.cast("bigint") * 1_000_000_000 + j * 10 + slot


def _here(i: Column, j: Column | None = None) -> Column:
    particle = [] if j is None else [F.lit(".particles["), j.cast("string"), F.lit("]")]
    return F.concat(F.lit("fields["), i.cast("string"), F.lit("]"), *particle)


def _events(*found: tuple[Column, Column, str, Column, Column | str]) -> Column:
    """Those of (condition, place, kind, path, text) whose condition holds."""
    said = lambda text: F.lit(text) if isinstance(text, str) else text
    made = [F.when(when, F.struct(at.cast("bigint").alias("at"), F.lit(kind).alias("kind"), path.alias("path"), said(text).alias("text"))) for when, at, kind, path, text in found]
    return F.array_compact(F.array(*made))


def _numbered(template: str, number: Column) -> Column:
    before, after = template.split("{}")
    return F.concat(F.lit(before), number.cast("string"), F.lit(after))


def _read_particle(shaped: Column, own: Column, x: Column, y: Column, category: Column) -> Column:
    coordinate = lambda v_: _whole(v_, -v.MOST_COORDINATE, v.MOST_COORDINATE)
    return F.struct(shaped.alias("shaped"), _text(own).alias("id"), coordinate(x).alias("x"), coordinate(y).alias("y"), _text(category).alias("category"))


def _judged(p: Column, i: Column, j: Column) -> Column:
    """A particle with its place and what is wrong with its texts."""
    said = lambda text, blank, most, long: F.when(F.coalesce(text == "", F.lit(True)), blank).when(_longer(text, most), long)
    return F.struct(
        i.alias("i"), j.alias("j"), p["shaped"].alias("shaped"), p["id"].alias("id"), p["x"].alias("x"), p["y"].alias("y"),
        said(p["id"], v.SAY_ID, v.LONGEST_ID, v.SAY_ID_LENGTH).alias("id_said"), said(p["category"], v.SAY_CATEGORY, v.LONGEST_CATEGORY, v.SAY_CATEGORY_LENGTH).alias("category_said"),
    )


def _read_field(i: Column, shaped: Column, name: Column, placed: Column, x: Column, y: Column, particles: Column) -> Column:
    coordinate = lambda v_: _whole(v_, -v.MOST_COORDINATE, v.MOST_COORDINATE)
    misnamed = name.isNotNull() & F.coalesce(_longer(_text(name), v.LONGEST_NAME), F.lit(True))
    return F.struct(F.coalesce(shaped, F.lit(False)).alias("shaped"), misnamed.alias("misnamed"), F.coalesce(placed, F.lit(False)).alias("placed"), coordinate(x).alias("x"), coordinate(y).alias("y"), F.transform(particles, lambda p, j: _judged(p, i, j)).alias("particles"))


def _shaped_field(f: Column, i: Column) -> Column:
    particles = F.transform(f["particles"], lambda p: _read_particle(p.isNotNull(), p["id"], p["x"], p["y"], p["category"]))
    return _read_field(i, f.isNotNull(), f["name"], f["offset"].isNotNull(), f["offset"]["x"], f["offset"]["y"], particles)


def _any_field(f: Column, i: Column) -> Column:
    particles = F.transform(_items(_part(f, "particles")), lambda p: _read_particle(_is_object(p), *(_part(p, m) for m in ("id", "x", "y", "category"))))
    offset = _part(f, "offset")
    return _read_field(i, _is_object(f), _part(f, "name"), _is_object(offset), _part(offset, "x"), _part(offset, "y"), particles)


def _field_events(f: Column, i: Column) -> Column:
    at, here = lambda slot: _at(i, 0, slot), _here(i)
    member = lambda name: F.concat(here, F.lit("." + name))
    n = F.size(f["particles"])
    own = _events(
        (f["misnamed"], at(1), "issue", member("name"), v.SAY_NAME),
        (~f["placed"], at(2), "issue", member("offset"), v.SAY_OFFSET),
        *((f["placed"] & ~f[axis], at(3 + k), "issue", member(f"offset.{axis}"), v.SAY_OFFSET_VALUE) for k, axis in enumerate("xy")),
        (f["particles"].isNull(), at(5), "issue", member("particles"), v.SAY_PARTICLES),
        (n > v.MOST_IN_FIELD, at(6), "issue", member("particles"), _numbered(v.SAY_IN_FIELD, n)),
    )
    return F.when(f["shaped"], own).otherwise(_events((F.lit(True), at(0), "issue", here, v.SAY_FIELD)))


def _particle_events(p: Column) -> Column:
    at, here = lambda slot: _at(p["i"], p["j"] + 1, slot), _here(p["i"], p["j"])
    member = lambda name: F.concat(here, F.lit("." + name))
    own = _events(
        (p["id_said"].isNotNull(), at(0), "issue", member("id"), p["id_said"]),
        *((~p[axis], at(1 + k), "issue", member(axis), v.SAY_COORDINATE) for k, axis in enumerate("xy")),
        (p["category_said"].isNotNull(), at(3), "issue", member("category"), p["category_said"]),
    )
    return F.when(p["shaped"], own).otherwise(_events((F.lit(True), at(0), "issue", here, v.SAY_PARTICLE)))


def _is_named(p: Column) -> Column:
    return p["shaped"] & p["id_said"].isNull()


def _read(bodies: DataFrame) -> DataFrame:
    """Parsed bodies with own, the events of the body and its fields, and particles, all of them, as read and judged. Each
    step is a column of its own, so it is taken once however often later ones use it."""
    members = bodies.withColumn("shaped", F.try_variant_get("doc", "$.fields", _SHAPE)).withColumn("usual", F.col("shaped").isNotNull())
    # what has the shape isn't copied a second time, item by item
    members = members.withColumn("fields", F.when(~F.col("usual"), _items(_part(F.col("doc"), "fields"))))
    known = F.when(F.col("usual"), F.transform("shaped", _shaped_field)).otherwise(F.transform("fields", _any_field))
    read = members.withColumn("fields", known).withColumn("n", F.size("fields")).drop("shaped")
    read = read.withColumn("particles", F.coalesce(F.flatten(F.filter(F.transform("fields", lambda f: f["particles"]), lambda p: p.isNotNull())), F.array()))
    first = lambda slot: F.lit(slot - 10)
    own = _events(
        (~_whole(_part(F.col("doc"), "tolerance"), 0, v.MOST_TOLERANCE), first(0), "issue", F.lit("tolerance"), v.SAY_TOLERANCE),
        (F.col("fields").isNull(), first(1), "issue", F.lit("fields"), v.SAY_FIELDS),
        (~F.col("n").between(v.FEWEST_FIELDS, v.MOST_FIELDS), first(1), "issue", F.lit("fields"), _numbered(v.SAY_FIELD_COUNT, F.col("n"))),
        (F.size("particles") > v.MOST_PARTICLES, _at(F.col("n") + 1, 0, 0), "issue", F.lit("fields"), _numbered(v.SAY_TOTAL, F.size("particles"))),
    )
    inner = F.coalesce(F.flatten(F.transform("fields", _field_events)), F.array().cast(_EVENT))
    no_object = _events((F.lit(True), first(0), "issue", F.lit(""), v.SAY_BODY))
    return read.withColumn("own", F.when(F.col("usual") | _is_object(F.col("doc")), F.concat(own, inner)).otherwise(no_object)).drop("usual")


def _marker(body: Column) -> Column:
    """MARKER, or for a body that may hold it, as it stands or by escapes, a name of its own: none holds its own hash."""
    return F.when(body.contains("\\u") | body.contains(MARKER), F.sha2(body, 256)).otherwise(F.lit(MARKER))


def parsed(bodies: DataFrame) -> DataFrame:
    """Bodies (submission_id, body) with doc, the parsed body, which is null where it is left to validate.inspect."""
    whole = F.try_variant_get(F.try_parse_json(F.concat(F.lit('{"d":'), F.col("body"), F.lit(',"'), F.col("marker"), F.lit('":0}'))), "$", "map<string,variant>")
    alone = (F.size("whole") == 2) & F.map_contains_key("whole", F.col("marker")) & ~F.col("body").rlike(r"\\u[dD][89a-fA-F]")
    made = bodies.withColumn("marker", _marker(F.col("body"))).withColumn("whole", whole)
    return made.withColumn("doc", F.when(alone, F.try_element_at("whole", F.lit("d")))).drop("marker", "whole")


def inspected(bodies: DataFrame) -> DataFrame:
    """(submission_id, ord, kind, path, text) of bodies (submission_id, body) of which none is too large: all issues and ids
    in traversal order, unread bodies, and the document of those without issues of these kinds."""
    both = settled(parsed(bodies))
    named = F.transform(F.filter("particles", _is_named), lambda p: F.struct(_at(p["i"], p["j"] + 1, 0).alias("at"), F.lit("id").alias("kind"), F.concat(_here(p["i"], p["j"]), F.lit(".id")).alias("path"), p["id"].alias("text")))
    found = F.sort_array(F.concat("own", F.flatten(F.transform("particles", _particle_events)), named))
    read = _read(both.where("doc is not null")).select("submission_id", "body", found.alias("events"))
    document = F.struct(F.lit(None).cast("bigint").alias("at"), F.lit("document").alias("kind"), F.lit("").alias("path"), F.col("body").alias("text"))
    good = ~F.exists("events", lambda e: e["kind"] == "issue")
    listed = F.when(good, F.concat("events", F.array(document))).otherwise(F.col("events"))
    rows = read.select("submission_id", F.posexplode(listed).alias("ord", "e")).select("submission_id", F.col("ord").cast("bigint").alias("ord"), "e.kind", "e.path", "e.text")
    return rows.unionByName(v.inspected(both.where("doc is null").select("submission_id", "body")))


def _path_of(at: Column) -> Column:
    return F.concat(_here((at / 1_000_000_000).cast("bigint"), (at % 1_000_000_000 / 10).cast("bigint") - 1), F.lit(".id"))


def concluded(bodies: DataFrame) -> DataFrame:
    """Bodies (any columns, body) with issues: the first MOST_ISSUES in traversal order, repeated ids among them; null where
    the body is left to validate.conclude. A body's row is looked at by itself: nothing is shuffled, and only what may be
    among the first issues gets a path and a message."""
    most = v.MOST_ISSUES
    bad = F.slice(F.filter("particles", lambda p: ~p["shaped"] | p["id_said"].isNotNull() | ~p["x"] | ~p["y"] | p["category_said"].isNotNull()), 1, most)
    named = F.transform(F.filter("particles", _is_named), lambda p: F.struct(p["id"].alias("id"), _at(p["i"], p["j"] + 1, 0).alias("at")))
    others = [c for c in bodies.columns if c != "body"]
    read = _read(parsed(bodies.select(F.struct(*others).alias("of"), "body"))).withColumn("bad", bad).withColumn("named", named).drop("particles").withColumn("names", F.col("named.id"))
    # in order of id, then place, all but the first of an id are repeats
    read = read.withColumn("ranked", F.when(F.size(F.array_distinct("names")) < F.size("names"), F.sort_array("named")))
    repeats = F.filter("ranked", lambda e, k: (k > 0) & (F.get("ranked", k - 1)["id"] == e["id"]))
    read = read.withColumn("repeats", F.slice(F.sort_array(F.transform(repeats, lambda e: F.struct(e["at"].alias("at"), e["id"].alias("id")))), 1, most))
    first = lambda e: F.get("named", (F.array_position("names", e["id"]) - 1).cast("int"))["at"]
    twice = F.transform("repeats", lambda e: F.struct(e["at"].alias("at"), F.lit("issue").alias("kind"), _path_of(e["at"]).alias("path"), v.twice_message(e["id"], _path_of(first(e))).alias("text")))
    found = F.concat("own", F.flatten(F.transform("bad", _particle_events)), F.coalesce(twice, F.array().cast(_EVENT)))
    said = F.transform(F.slice(F.sort_array(found), 1, most), lambda e: F.struct(e["path"].alias("path"), e["text"].alias("message")))
    return read.withColumn("issues", F.when(F.col("doc").isNotNull(), said)).select("of.*", "body", "issues")
