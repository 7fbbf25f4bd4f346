"""License scan: notices and identifier tags found by Aho-Corasick, expressions by shunting-yard.

A text is lowered (A-Z) and cut into words; one automaton over the words, joined by single spaces, finds the
words of every notice wherever they stand consecutively, whatever stands between them, and the words of the tag
``SPDX-License-Identifier:``. What follows a tag on its line is read as an expression: identifiers, AND,
OR, WITH (binding in the order WITH, AND, OR) and brackets become postfix by the shunting-yard method, and the postfix is
evaluated to how strictly it binds: the laxer side of OR, the stricter of AND, and WITH an exception
makes a strong copyleft a weak one. Everything is linear in the text; nothing is shuffled.

Defined cases: null and empty texts have no words and no labels. Very long texts are scanned whole. Repeated rows are scanned
one by one; an empty table has no rows. A tag whose expression is not well formed gives the label ``malformed``;
an identifier that is not known is labelled as it is and binds strictly. ``scan`` keeps the columns of its input, but
replaces those that bear the names of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import read, shipped, text_bytes, tidy

# Phrases that count as base places.
BASE = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
#: Further notices.
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "apache software license": "apache",
    "gnu gpl": "gpl",
    "lesser general public license": "lgpl",
    "library general public license": "lgpl",
    "gnu lgpl": "lgpl",
    "affero general public license": "agpl",
    "gnu agpl": "agpl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "isc license": "isc",
    "boost software license": "bsl",
    "released into the public domain": "public-domain",
    "free and unencumbered software": "public-domain",
    "all rights reserved": "reserved",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0": "public-domain",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons zero": "public-domain",
}
TAG = "spdx license identifier"

#: How strictly a licence binds, by the beginning of its identifier; the longest beginning holds.
STRICT = {
    "0bsd": 0,
    "cc0": 0,
    "unlicense": 0,
    "wtfpl": 0,
    "apache": 1,
    "artistic": 1,
    "bsd": 1,
    "bsl": 1,
    "cc-by": 1,
    "isc": 1,
    "mit": 1,
    "psf": 1,
    "python": 1,
    "zlib": 1,
    "cc-by-sa": 2,
    "cddl": 2,
    "epl": 2,
    "eupl": 2,
    "lgpl": 2,
    "mpl": 2,
    "agpl": 3,
    "gpl": 3,
    "cc-by-nc": 4,
    "cc-by-nd": 4,
}
LEVELS = ("public-domain", "permissive", "weak-copyleft", "strong-copyleft", "restricted")
#: Levels that WITH relaxes, and to what.
RELAXED = {3: 2}

BINDING = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(rb"[ \t]*([()]|[A-Za-z0-9.+:_-]+)")
_COLON = re.compile(rb"[ \t]*:")
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Lowers A-Z and makes a space of what is in no word.
_PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)

PLACE = "struct<label:string,phrase:string,word:bigint,base:boolean>"
TAGGED = "struct<word:bigint,expression:string,licences:array<string>,level:string>"


class Malformed(ValueError):
    """An expression that is not well formed."""


def postfix(tokens: Iterable[str]) -> list[str]:
    """Tokens of an expression in postfix order, by the shunting-yard method."""
    out: list[str] = []
    waiting: list[str] = []
    wants_operand = True
    for token in tokens:
        word = token.lower()
        if word in BINDING:
            if wants_operand:
                raise Malformed(token)
            while waiting and waiting[-1] != "(" and BINDING[waiting[-1]] >= BINDING[word]:
                out.append(waiting.pop())
            waiting.append(word)
            wants_operand = True
        elif token == "(":
            if not wants_operand:
                raise Malformed(token)
            waiting.append(token)
        elif token == ")":
            if wants_operand:
                raise Malformed(token)
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                raise Malformed(token)
            waiting.pop()
        else:
            if not wants_operand:
                raise Malformed(token)
            out.append(token)
            wants_operand = False
    if wants_operand or "(" in waiting:
        raise Malformed("end")
    return out + waiting[::-1]


def strictness(licence: str) -> int:
    name = licence.lower()
    known = [k for k in STRICT if name.startswith(k)]
    return STRICT[max(known, key=len)] if known else len(LEVELS) - 1


def evaluated(order: list[str]) -> tuple[int, list[str]]:
    """How strictly a postfix expression binds, and its licences in order of appearance."""
    values: list[int] = []
    names: list[str] = []
    # the right side of WITH names an exception: a single identifier before the operator
    exceptions = {i - 1 for i, token in enumerate(order) if token == "with"}
    for i, token in enumerate(order):
        if token in BINDING:
            right, left = values.pop(), values.pop()
            if token == "with":
                if order[i - 1] in BINDING:
                    raise Malformed(token)
                values.append(RELAXED.get(left, left))
            else:
                values.append(min(left, right) if token == "or" else max(left, right))
        elif i in exceptions:
            values.append(0)
        else:
            values.append(strictness(token))
            if token.lower() not in names:
                names.append(token.lower())
    return values.pop(), names


def expression_at(text: bytes, at: int) -> str:
    """The expression from ``at`` on its line: it ends where neither operator nor bracket joins what follows."""
    taken: list[str] = []
    depth = 0
    while found := _TOKEN.match(text, at):
        token, at = found.group(1).decode("ascii"), found.end()
        joins = token.lower() in BINDING or token == ")"
        after = bool(taken) and taken[-1] != "(" and taken[-1].lower() not in BINDING
        if (after and not joins) or (token == ")" and depth == 0):
            break
        depth += {"(": 1, ")": -1}.get(token, 0)
        taken.append(token)
    if taken and taken[-1] not in "()":
        taken[-1] = taken[-1].rstrip(".:")  # the end of a sentence is not part of an identifier
    return " ".join(t for t in taken if t)


def parsed(expression: str) -> tuple[str, list[str]]:
    """Level and licences of an expression; ``malformed`` and none if it is not well formed."""
    try:
        level, names = evaluated(postfix(expression.split()))
    except Malformed:
        return "malformed", []
    return LEVELS[level], names


@cache
def automaton() -> ahocorasick.Automaton:
    """All phrases, each between spaces."""
    built = ahocorasick.Automaton()
    for phrase in [*BASE, *NOTICES, TAG]:
        built.add_word(f" {phrase} ", phrase)
    built.make_automaton()
    return built


def _places(plain: bytes) -> list[tuple[int, str]]:
    """(byte of the first letter, phrase) of every place in words between single spaces."""
    # one character a byte, so places are bytes
    return [(end - len(phrase), phrase) for end, phrase in automaton().iter(plain.decode("latin-1"))]


def scanned(text: bytes) -> dict:
    """Words, places and tags of one text."""
    lowered = text.translate(_PLAIN)
    words = lowered.split()
    plain = b" " + b" ".join(words) + b" "
    places, tags = [], []
    found = sorted(_places(plain))
    if found:
        spaces = np.flatnonzero(np.frombuffer(plain, np.uint8) == 32)
        number = np.searchsorted(spaces, [at for at, _ in found]) - 1
        # of further notices that begin at one word the longest holds
        longest = {at: phrase for at, phrase in found if phrase in NOTICES}
        ends = None
        for (at, phrase), word in zip(found, number.tolist()):
            if phrase in BASE:
                places.append({"label": BASE[phrase], "phrase": phrase, "word": word, "base": True})
            elif phrase != TAG:
                if longest[at] == phrase:
                    places.append({"label": NOTICES[phrase], "phrase": phrase, "word": word, "base": False})
            else:
                if ends is None:
                    ends = [m.end() for m in _WORD.finditer(lowered)]
                colon = _COLON.match(text, ends[word + TAG.count(" ")])
                if colon:
                    expression = expression_at(text, colon.end())
                    level, names = parsed(expression)
                    tags.append({"word": word, "expression": expression, "licences": names, "level": level})
    return {"n_words": len(words), "places": places, "tags": tags}


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, ``places`` of notices and ``tags`` with their expressions, licences and level."""
    own = {"n_words": "bigint", "places": f"array<{PLACE}>", "tags": f"array<{TAGGED}>"}
    rest = [c for c in docs.columns if c not in own]
    kept = docs.select(*(f"`{c}`" for c in rest))
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + [f"{n} {t}" for n, t in own.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = pa.struct([("label", pa.string()), ("phrase", pa.string()), ("word", pa.int64()), ("base", pa.bool_())])
        strings = pa.list_(pa.string())
        tag = pa.struct([("word", pa.int64()), ("expression", pa.string()), ("licences", strings), ("level", pa.string())])
        types = {"n_words": pa.int64(), "places": pa.list_(place), "tags": pa.list_(tag)}
        for batch in batches:
            rows = [scanned(t) for t in text_bytes(batch.column("text"))]
            made = {name: pa.array([r[name] for r in rows], kind) for name, kind in types.items()}
            yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in rest} | made)

    return kept.transform(shipped).mapInArrow(tidy(run), out)


def summary(found: DataFrame) -> DataFrame:
    """One row a document: counts and places of the base phrases, all labels, and a score.

    The score is 1 - 2 ** -(labels of notices + 2 for each distinct well-formed expression): 0 without any, 0.5 for one
    notice, nearer to 1 the more agree that the text states a licence.
    """
    base = F.filter("places", lambda p: p["base"])
    notices = F.array_distinct(F.transform("places", lambda p: p["label"]))
    sound = F.filter("tags", lambda t: t["level"] != "malformed")
    tagged = F.flatten(F.transform("tags", lambda t: F.concat(t["licences"], F.array(t["level"]))))
    names = F.array_sort(F.array_distinct(F.concat(notices, tagged)))
    evidence = F.size(notices) + 2 * F.size(F.array_distinct(F.transform(sound, lambda t: F.lower(t["expression"]))))
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(F.transform(base, lambda p: p["word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda p: p["word"])).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(base, lambda p: p["label"]))), ",").alias("base_labels"),
        F.array_join(names, ",").alias("labels"),
        (1 - F.pow(F.lit(2.0), -evidence)).alias("score"),
        F.array_join(F.array_distinct(F.transform("tags", lambda t: t["expression"])), "; ").alias("expressions"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices and tags of every document."""
    return summary(scan(read(spark, sf_dir, "documents").select("doc_id", "text")))
