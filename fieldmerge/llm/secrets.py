"""Secrets in text, by assignments: source and configuration syntax is read as pairs of a name and the literals that flow
into it, and literals are scored by how sensitive the names are that they reach.

A pair is a name, a sign of assignment, and an expression: strings, references to other names, calls, joined by operators.
References are resolved to the last assignment of that name before (or the first after) them, so a literal that reaches a
sensitive name through constants is found where it stands. Beside these, three fixed patterns are always reported.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, namedtuple
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The patterns that are always reported, with what they need (characters of the group), in the order of kinds.
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]{24,}"), 0, 24),  # runs of less can't be long enough
}
#: All kinds in order: then literals assigned to a sensitive name, and literals that reach one through constants.
KINDS = (*BASE, "literal", "constant")

#: A literal is reported if the sensitivity of the name times its own likeness to a secret reaches this.
LEAST_SCORE = 0.5

# How sensitive the words of a name are, pairs of words that are so together, and words by which a name tells
# of something other than the secret itself.
WORDS = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.8, "passcode": 0.8, "secret": 1.0, "secrets": 0.8, "token": 0.9, "credential": 0.9, "credentials": 0.9, "apikey": 1.0, "bearer": 0.8, "authorization": 0.8, "auth": 0.6, "pin": 0.5, "jwt": 0.8, "salt": 0.6, "dsn": 0.6, "psk": 0.8}
TOGETHER = {("api", "key"): 1.0, ("access", "key"): 0.9, ("private", "key"): 1.0, ("secret", "key"): 1.0, ("signing", "key"): 0.9, ("encryption", "key"): 0.9, ("master", "key"): 0.9, ("account", "key"): 0.8, ("shared", "key"): 0.8, ("service", "key"): 0.7, ("connection", "string"): 0.7, ("web", "hook"): 0.6}
OTHER = frozenset("public count length len size max min limit name field label type url uri path file dir expires expiry expire ttl timeout regex pattern prompt hint policy enabled required reset placeholder column index format header input form text message error title description id ids hash algorithm version endpoint issuer env var".split())
PLACEHOLDER = re.compile(r"^(?:<.*>|\$\{[^}]*\}|\$\([^)]*\)|\{\{.*\}\}|%[^%]*%|\[.*\]|[x*.•_-]+|your[\W_].*|.*\b(?:change[ _-]?me|placeholder|redacted|todo|dummy|insert|replace)\b.*|example.*|none|null|nil|true|false|undefined|empty|default|test|string|password|secret|token)$", re.I | re.S)

_NAME = r"[A-Za-z_$][\w$]*+(?:(?:\.|->|::|-)[A-Za-z_$][\w$]*+)*+"
#: A name with a sign of assignment, or a quoted name with a comma in a call; tags of XML and options of commands below.
_PAIR = re.compile(
    rf"""(?<![\w$.-])(?:--)?(?:
      (?P<quoted>["'])(?P<key>[^"'\n=:,]{{1,80}})(?P=quoted)\]?[ \t]*+(?P<sign1>:=|=>|:(?!:)|=(?![=~])|,)
    | var[ \t]+(?P<var>[A-Za-z_]\w*+)[ \t]+[\w*.\[\]]{{1,30}}[ \t]*+(?P<sign3>=(?!=))
    | (?P<name>{_NAME})(?:\[\])?(?:[ \t]*+:[ \t]*+[A-Za-z_][\w.\[\]<>|, ?]{{0,40}}?(?==))?[ \t]*+(?P<sign2>:=|\?=|\+=|=>|:(?![:/])|=(?![=~]))
    )[ \t]*+""",
    re.X,
)
_TAG = re.compile(r"<([A-Za-z_][\w.-]{0,80})>([^<>\n]{6,400})</\1>")
_OPTION = re.compile(r"(?<!\S)--?([A-Za-z][\w-]{2,60})[ \t]+(?![-|>&])([^\s\"']{6,400}|\"[^\"\n]{6,400}\"|'[^'\n]{6,400}')")
_STRING = re.compile(r"""[rRbBuUfFL@]{0,2}(?:(\"\"\"|''')(?P<long>.*?)\1|"(?P<double>(?:[^"\\\n]|\\.)*+)"|'(?P<single>(?:[^'\\\n]|\\.)*+)'|`(?P<tick>[^`]*+)`)""", re.S)
_REFERENCE = re.compile(rf"(?:\$\{{)?(?P<ref>{_NAME})\}}?[ \t]*+(?P<call>\()?")
_BARE = re.compile(r"[^\s\"'`;,(){}\[\]<>]+")
_JOIN = re.compile(r"[ \t]*+(?:\+|\.\.?(?=[ \t\"'$])|\|\||\?\?|\bor\b|,(?=[ \t]*+[\"'(]))?(?:[ \t]*+\\?\r?\n(?=[ \t]*+[\"'+]))?[ \t]*+")
_INSIDE = re.compile(rf"\$\{{({_NAME})\}}|\$([A-Za-z_]\w*)|(?<!\$)\{{({_NAME})\}}|%\(({_NAME})\)s")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_LOOKUP = frozenset("getenv env get getproperty environ lookup config getstring".split())
_SENSITIVE = re.compile("|".join(sorted({*(w for w in WORDS), "key", "hook", "string"}, key=len, reverse=True)), re.I)
#: An expression of more operands than this, or a longer reach, is read up to there; its other literals are pairs of their own.
_OPERANDS, _BARE_REACH = 200, 400

Literal = namedtuple("Literal", "start end text quoted")
Assigned = namedtuple("Assigned", "name start literals references")
Finding = namedtuple("Finding", "kind start end name score")


def sensitivity(name: str) -> float:
    """How sensitive a name is, from 0 to 1, by its words in camel, snake or kebab case."""
    parts = [p.lower() for p in _PART.findall(name)]
    if not parts:
        return 0.0
    best = max((WORDS.get(p, 0.0) for p in parts), default=0.0)
    for pair in zip(parts, parts[1:]):
        best = max(best, TOGETHER.get(pair, 0.0), WORDS.get("".join(pair), 0.0))
    return best * (0.3 if parts[-1] in OTHER or parts[0] in ("public", "max", "min", "num", "no", "is", "has") else 1.0)


def likeness(text: str, quoted: bool) -> float:
    """How much a literal is like a secret, from 0 to 1: by its length, kinds of characters and spread, not for what only
    stands for a value."""
    text = text.strip()
    if len(text) < 6 or PLACEHOLDER.match(text):
        return 0.0
    counts = Counter(text)
    if len(counts) < 4:
        return 0.0
    spread = -sum(c / len(text) * math.log2(c / len(text)) for c in counts.values())
    digit, upper, lower = (any(f(c) for c in text) for f in (str.isdigit, str.isupper, str.islower))
    sign = any(not c.isalnum() and not c.isspace() for c in text)
    kinds = digit + upper + lower + sign
    score = (0.45 if quoted else 0.35) + 0.15 * (kinds - 1) + 0.1 * (spread >= 3) + 0.1 * (len(text) >= 16)
    if any(c.isspace() for c in text):
        score -= 0.2 if digit else 0.5
    return max(0.0, min(1.0, score))


def _string(text: str, at: int) -> tuple[Literal, int] | None:
    m = _STRING.match(text, at)
    if m is None:
        return None
    group = next(g for g in ("long", "double", "single", "tick") if m[g] is not None)
    return Literal(m.start(group), m.end(group), m[group], True), m.end()


def _expression(text: str, at: int) -> tuple[list[Literal], list[str], int]:
    """The literals of an expression, the names it refers to, and its end."""
    literals, references, depth = [], [], 0
    for _ in range(_OPERANDS):
        found = _string(text, at)
        if found:
            literal, at = found
            literals.append(literal)
            references += [next(g for g in m if g) for m in _INSIDE.findall(literal.text)]
        else:
            m = _REFERENCE.match(text, at)
            if m is None:
                if text[at : at + 1] in ("(", ")") and (depth or text[at] == "("):
                    depth += 1 if text[at] == "(" else -1
                    at += 1
                    continue
                break
            at = m.end()
            if m["call"]:
                depth += 1
                inner = _string(text, at)
                if inner and re.split(r"\W+", m["ref"])[-1].lower() in _LOOKUP:
                    # a variable's name, not a value; what may follow is its default
                    references.append(inner[0].text)
                    at = inner[1]
            else:
                references.append(m["ref"])
        while depth and text[at : at + 1] == ")":
            depth, at = depth - 1, at + 1
        m = _JOIN.match(text, at)
        if m.end() == at and not depth:
            break
        if "," in m[0] and not depth:
            break
        at = m.end()
    return literals, references, at


def pairs(text: str) -> Iterator[Assigned]:
    """The assignments of a text in source or configuration syntax, in order of their names' places."""
    for m in _PAIR.finditer(text):
        name, sign = m["name"] or m["key"] or m["var"], m["sign1"] or m["sign2"] or m["sign3"]
        if not name.strip() or sign == "," and text[m.start() - 1 : m.start()] not in ("(", ","):
            continue
        literals, references, end = _expression(text, m.end())
        if not literals:
            bare = _BARE.match(text, m.end(), m.end() + _BARE_REACH)
            if bare:
                # without quotes: a whole line's value, or one that follows its sign at once
                tail = text[bare.end() : bare.end() + 1]
                line = text.rfind("\n", max(0, m.start() - 40), m.start()) + 1 or max(0, m.start() - 40)
                alone = tail in ("", "\n", "\r", ";", ",") and not text[line : m.start()].strip(" \t#/-").removeprefix("export").removeprefix("set").strip()
                if alone or sign == "=" and text[m.end() - 1] == "=" or bare[0].count("$"):
                    literals = [Literal(bare.start(), bare.end(), bare[0], False)]
                references = references + [next(g for g in x if g) for x in _INSIDE.findall(bare[0])]
        yield Assigned(name, m.start(), literals, references)
    for pattern in (_TAG, _OPTION):
        for m in pattern.finditer(text):
            start, end = m.span(2)
            quoted = text[start] in "\"'"
            yield Assigned(m[1], m.start(), [Literal(start + quoted, end - quoted, text[start + quoted : end - quoted], True)], [])


def _key(name: str) -> str:
    return re.split(r"\.|->|::", name)[-1].lstrip("$").strip()


def flowing(assigned: list[Assigned]) -> Iterator[tuple[Literal, str, float, bool]]:
    """(literal, sensitive name, sensitivity, direct) of the literals that flow into sensitive names. Assignments are walked
    from the most sensitive names on, each once, so cycles end and long chains cost their length."""
    places: dict[str, list[int]] = {}
    for i, a in enumerate(assigned):
        places.setdefault(_key(a.name), []).append(i)
    ranked = sorted(((sensitivity(a.name), i) for i, a in enumerate(assigned)), key=lambda x: (-x[0], x[1]))
    seen: set[int] = set()
    for weight, first in ranked:
        if weight <= 0:
            break
        stack = [(first, True)]
        while stack:
            i, direct = stack.pop()
            if i in seen:
                continue
            seen.add(i)
            for literal in assigned[i].literals:
                yield literal, assigned[first].name, weight, direct
            for reference in assigned[i].references:
                known = places.get(_key(reference))
                if known:
                    before = bisect_left(known, i)
                    source = known[before - 1] if before else known[0]
                    stack.append((source, False))


def findings(text: str) -> list[Finding]:
    """Everything found in a text, by start, then kind in the order of KINDS; places in code points."""
    found = [Finding(kind, m.start(), m.end(), m[1].lower() if kind == "assign" else kind, 1.0) for kind, (pattern, group, least) in BASE.items() for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    if _SENSITIVE.search(text):
        assigned = sorted(pairs(text), key=lambda a: a.start)
        known = sorted((f.start, f.end) for f in found)
        ends = []
        for _, end in known:
            ends.append(max(end, ends[-1] if ends else 0))
        taken: dict[tuple[int, int], Finding] = {}
        for literal, name, weight, direct in flowing(assigned):
            score = weight * likeness(literal.text, literal.quoted)
            place = (literal.start, literal.end)
            covered = bisect_left(known, (literal.start + 1,)) - 1
            if score >= LEAST_SCORE and place not in taken and not (covered >= 0 and ends[covered] >= literal.end):
                taken[place] = Finding("literal" if direct else "constant", *place, name, round(score, 3))
        found += taken.values()
    return sorted(found, key=lambda f: (f.start, KINDS.index(f.kind), f.end))


FINDING = "struct<kind:string,start:int,end:int,name:string,score:double>"
_FINDING = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("name", pa.string()), ("score", pa.float64())]))


def secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, findings) for each row of docs (doc_id, text): kind, start and end (code points, end exclusive) of each span,
    the name that makes it a secret and its score.

    The kinds assign, access and hex are the fixed patterns' matches, whatever the rest finds; literal and constant are the
    values (without quotes) that reach a sensitive name at once or through constants and that no fixed match covers. Null
    and empty texts have no findings; rows are independent. Names are taken from the same document only."""

    def read(batches):
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                own = b.slice(i, 1000)
                found = [[f._asdict() for f in findings(t.as_py() or "")] for t in own.column(1)]
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(found, _FINDING)], ["doc_id", "findings"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(read, f"doc_id {kind}, findings array<{FINDING}>")


def secret_digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of secrets: counts of the fixed patterns, SHA-256 of their
    kind:start:end joined by commas, and those of all findings."""
    said = lambda rows: F.concat_ws(",", F.transform(rows, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))))
    base = F.filter("findings", lambda f: f["kind"].isin(*BASE))
    kinds = F.transform("findings", lambda f: f["kind"])
    counts = [(F.size("findings") - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("findings")).alias("spans"))
