"""Licence scans: Aho-Corasick finds phrases and identifier tags, a shunting-yard parser evaluates expressions.

Texts are lower-cased (A-Z) and cut into words of digits, letters and non-ASCII characters; phrases are
matched on whole words: notices, and identifiers such as GPL-3.0 that stand outside a tag. Null and empty texts have no words, no labels and
the score 0; texts are scanned whole, however long. Equal rows give equal results, an empty table none; other columns are not read.
A tag ``SPDX-License-Identifier: <expression>`` is parsed as ids joined by and / or / with and
parentheses; a malformed expression gives the label ``spdx-malformed`` and scores 0.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlab.llm.common import read_table

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Further notice phrases, as words, and their labels.
NOTICES = {
    "mit license": "mit",
    "mit licence": "mit",
    "license mit": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "apache license": "apache",
    "apache licence": "apache",
    "apache software license": "apache",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc",
    "cc by nc nd": "cc-by-nc",
    "cc0": "cc0",
    "cc zero": "cc0",
    "creative commons": "creative-commons",
    "creative commons zero": "cc0",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution share alike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution non commercial": "cc-by-nc",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons attribution noderivs": "cc-by-nd",
    "gnu gpl": "gpl",
    "gnu general public licence": "gpl",
    "lesser general public license": "lgpl",
    "library general public license": "lgpl",
    "gnu lgpl": "lgpl",
    "affero general public license": "agpl",
    "gnu agpl": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "european union public licence": "eupl",
    "common development and distribution license": "cddl",
    "artistic license": "artistic",
    "boost software license": "boost",
    "bsd license": "bsd",
    "bsd licence": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "zlib license": "zlib",
    "python software foundation license": "python",
    "postgresql license": "postgresql",
    "sil open font license": "ofl",
    "open database license": "odbl",
    "do what the fuck you want to public license": "wtfpl",
    "public domain": "public-domain",
    "dedicated to the public domain": "public-domain",
    "this is free and unencumbered software released into the public domain": "public-domain",
    "do not redistribute": "reserved",
    "do not copy or distribute": "reserved",
    "proprietary and confidential": "reserved",
    "no part of this publication may be reproduced": "reserved",
    "may not be reproduced without permission": "reserved",
    "alle rechte vorbehalten": "reserved",
    "tous droits reserves": "reserved",
    "tous droits réservés": "reserved",
    "todos los derechos reservados": "reserved",
}
# Licence identifiers that stand for themselves outside a tag, and their labels.
IDENTIFIERS = {
    "GPL-1.0": "gpl", "GPL-2.0": "gpl", "GPL-3.0": "gpl", "GPLv2": "gpl", "GPLv3": "gpl", "LGPL-2.0": "lgpl", "LGPL-2.1": "lgpl", "LGPL-3.0": "lgpl", "LGPLv2": "lgpl", "LGPLv3": "lgpl",
    "AGPL-1.0": "agpl", "AGPL-3.0": "agpl", "AGPLv3": "agpl", "Apache-1.1": "apache", "Apache-2.0": "apache", "MPL-1.1": "mpl", "MPL-2.0": "mpl", "EPL-1.0": "epl", "EPL-2.0": "epl",
    "EUPL-1.1": "eupl", "EUPL-1.2": "eupl", "CDDL-1.0": "cddl", "Artistic-2.0": "artistic", "BSL-1.0": "boost", "BSD-2-Clause": "bsd", "BSD-3-Clause": "bsd", "BSD-4-Clause": "bsd", "0BSD": "bsd",
    "MIT-0": "mit", "OFL-1.1": "ofl", "ODbL-1.0": "odbl", "PSF-2.0": "python", "CC0-1.0": "cc0", "Unlicense": "unlicense", "WTFPL": "wtfpl",
}
# How freely a label lets a text be used, from 0 (not at all) to 1.
FREEDOM = {
    "public-domain": 1.0, "unlicense": 1.0, "cc0": 1.0, "wtfpl": 1.0, "mit": 0.9, "isc": 0.9, "bsd": 0.9, "zlib": 0.9, "boost": 0.9, "postgresql": 0.9, "python": 0.9, "apache": 0.9, "cc-by": 0.8, "artistic": 0.7,
    "ofl": 0.7, "mpl": 0.6, "lgpl": 0.6, "epl": 0.6, "cddl": 0.6, "eupl": 0.5, "odbl": 0.5, "creative-commons": 0.5, "cc-by-sa": 0.5, "gpl": 0.4, "agpl": 0.3, "cc-by-nd": 0.2, "cc-by-nc": 0.2, "reserved": 0.0,
}
UNKNOWN_FREEDOM = 0.3
# Beginnings of SPDX ids, longest first, and their labels. What follows one is no letter.
FAMILIES = (
    ("cc-by-nc", "cc-by-nc"), ("cc-by-nd", "cc-by-nd"), ("cc-by-sa", "cc-by-sa"), ("cc-by", "cc-by"), ("cc-pddc", "public-domain"), ("cc0", "cc0"), ("unlicense", "unlicense"), ("wtfpl", "wtfpl"),
    ("apache", "apache"), ("agpl", "agpl"), ("lgpl", "lgpl"), ("gpl", "gpl"), ("agplv", "agpl"), ("lgplv", "lgpl"), ("gplv", "gpl"), ("mpl", "mpl"), ("epl", "epl"), ("eupl", "eupl"), ("cddl", "cddl"),
    ("artistic", "artistic"), ("bsl", "boost"), ("0bsd", "bsd"), ("bsd", "bsd"), ("mit", "mit"), ("mitnfa", "mit"), ("isc", "isc"), ("zlib", "zlib"), ("ofl", "ofl"), ("odbl", "odbl"), ("psf", "python"),
    ("python", "python"), ("postgresql", "postgresql"),
)
TAG = "spdx license identifier"
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_EXPRESSION = re.compile(r"spdx-license-identifier\s*:[ \t]*([^\r\n]*)")
_ITEM = re.compile(r"[()]|[a-z0-9][a-z0-9.+\-:]*")


def lower_ascii(text: str) -> str:
    """Lower case for A-Z alone, which bytes have."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(lower_ascii(text or ""))


def family(spdx_id: str) -> str:
    """The label of a lower-case SPDX id; an unknown one is its own label."""
    return next((label for begin, label in FAMILIES if spdx_id.startswith(begin) and not spdx_id[len(begin) : len(begin) + 1].isalpha()), spdx_id)


def to_postfix(expression: str) -> list[str]:
    """Shunting-yard: a lower-case licence expression in postfix order. Raises ValueError where it is malformed.

    The expression ends at the first word that can't continue it, such as the end of a comment.
    """
    return parse_expression(expression)[0]


def parse_expression(expression: str) -> tuple[list[str], int]:
    """The postfix order, and where the expression ends in the text."""
    out, held, operand, end = [], [], True, 0
    for found in _ITEM.finditer(expression):
        item = found[0]
        if item == "(":
            if not operand:
                break
            held.append(item)
        elif item == ")":
            if operand or "(" not in held:
                break
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        elif item in PRECEDENCE:
            if operand:
                raise ValueError(expression)
            while held and held[-1] != "(" and PRECEDENCE[held[-1]] >= PRECEDENCE[item]:
                out.append(held.pop())
            held.append(item)
            operand = True
        else:
            if not operand:
                break
            out.append(item)
            operand = False
        end = found.end()
    if operand or "(" in held:
        raise ValueError(expression)
    return out + held[::-1], end


def evaluate(postfix: list[str]) -> tuple[set[str], float]:
    """Labels in use and freedom: ``or`` takes the freer side, ``and`` the stricter, ``with`` keeps the licence and adds a little."""
    stack: list[tuple[set[str], float]] = []
    for item in postfix:
        if item not in PRECEDENCE:
            label = family(item)
            stack.append(({label}, FREEDOM.get(label, UNKNOWN_FREEDOM)))
            continue
        right, left = stack.pop(), stack.pop()
        if item == "with":
            stack.append((left[0], min(1.0, left[1] + 0.1)))
        else:
            stack.append((left[0] | right[0], (max if item == "or" else min)(left[1], right[1])))
    return stack.pop()


def phrases() -> dict[str, str]:
    """Every phrase looked for, as words, and its label; the tag has none."""
    return {**{" ".join(words_of(x)): label for x, label in IDENTIFIERS.items()}, **NOTICES, **BASE, TAG: ""}


@lru_cache(1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase, label in phrases().items():
        found.add_word(f" {phrase} ", (phrase, label, phrase in BASE))
    found.make_automaton()
    return found


def _tagged(low: str) -> dict[str, float]:
    """Labels and their freedom in a text with tags. What an expression names counts by its value there, not as a notice of its own."""
    labels: dict[str, float] = {}

    def read(m: re.Match) -> str:
        try:
            postfix, end = parse_expression(m[1])
            found, freedom = evaluate(postfix)
        except ValueError:
            found, freedom, end = {"spdx-malformed"}, 0.0, 0
        for x in found:
            labels[x] = min(freedom, labels.get(x, 1.0))
        return " spdxexpression " + m[1][end:]

    rest = _EXPRESSION.sub(read, low)
    for _, (_, label, _) in _automaton().iter(f" {' '.join(_WORD.findall(rest))} "):
        if label:
            labels[label] = min(FREEDOM[label], labels.get(label, 1.0))
    return labels


def scan(text: str | None) -> tuple:
    """The values of RESULT for one text."""
    low = lower_ascii(text or "")
    words = _WORD.findall(low)
    if not words:
        return 0, 0, None, None, "", "", 0.0
    line = f" {' '.join(words)} "
    found = [(end - len(phrase) - 1, label, is_base) for end, (phrase, label, is_base) in _automaton().iter(line)]
    starts, base = [s for s, _, is_base in found if is_base], {label for _, label, is_base in found if is_base}
    if all(label for _, label, _ in found):
        labels = {label: FREEDOM[label] for _, label, _ in found}
    else:
        labels = _tagged(low)
        for label in base:
            labels.setdefault(label, FREEDOM[label])
    at = [line.count(" ", 0, s + 1) - 1 for s in ({min(starts), max(starts)} if starts else ())]
    score = min(labels.values()) if labels else 0.0
    return len(words), len(starts), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def license_scan(text: Column) -> Column:
    """A struct of RESULT for each text; ``score`` is the freedom of the strictest licence found, 0 without any."""

    @F.pandas_udf(RESULT)
    def scanned(texts: pd.Series) -> pd.DataFrame:
        names = [x.split()[0] for x in RESULT.split(", ")]
        found = pd.DataFrame([scan(t) for t in texts], columns=names)
        return found.astype({"first_word": "Int64", "last_word": "Int64"})

    return scanned(text)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", license_scan(F.col("text")).alias("s")).select("doc_id", "s.*")
