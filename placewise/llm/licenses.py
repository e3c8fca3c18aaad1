"""License scan: an Aho-Corasick automaton finds notice phrases and identifier tags, a shunting-yard parser evaluates
the expressions behind the tags.

Words are lower-cased runs of ASCII digits, ASCII letters and non-ASCII characters; phrases match whole words that stand
consecutively, whatever separates them. Null counts as empty text: no words, no labels, score 0. Every occurrence
counts, also overlapping ones; repeated rows give repeated results.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from placewise.llm import common as C

SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double, expressions string, permissive boolean")

# The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Notice phrases beyond the base ones; the label is the licence's short identifier in lower case.
NOTICES = {
    "released under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit-notice",
    "apache license version 2 0": "apache-2.0",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "boost software license": "bsl-1.0",
    "cc0 1 0": "cc0-1.0",
    "cc by 4 0": "cc-by-4.0",
    "cc by sa 4 0": "cc-by-sa-4.0",
    "cc by nc 4 0": "cc-by-nc-4.0",
    "cc by nd 4 0": "cc-by-nd-4.0",
    "cc by nc sa 4 0": "cc-by-nc-sa-4.0",
    "cc by nc nd 4 0": "cc-by-nc-nd-4.0",
    "all rights reserved": "reserved",
}
# Identifiers of the public SPDX licence list and its exceptions in common use, in lower case.
IDENTIFIERS = frozenset("""
0bsd aal afl-1.1 afl-1.2 afl-2.0 afl-2.1 afl-3.0 agpl-1.0-only agpl-1.0-or-later agpl-3.0 agpl-3.0-only agpl-3.0-or-later
apache-1.0 apache-1.1 apache-2.0 apsl-2.0 artistic-1.0 artistic-2.0 beerware blueoak-1.0.0 bsd-1-clause bsd-2-clause
bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear bsd-3-clause-lbnl bsd-4-clause bsd-4-clause-uc bsl-1.0 busl-1.1
cc-by-1.0 cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-4.0 cc-by-nc-1.0 cc-by-nc-2.0 cc-by-nc-3.0 cc-by-nc-4.0 cc-by-nc-nd-3.0
cc-by-nc-nd-4.0 cc-by-nc-sa-3.0 cc-by-nc-sa-4.0 cc-by-nd-3.0 cc-by-nd-4.0 cc-by-sa-1.0 cc-by-sa-2.0 cc-by-sa-2.5
cc-by-sa-3.0 cc-by-sa-4.0 cc0-1.0 cddl-1.0 cddl-1.1 cecill-2.1 cecill-b cecill-c cpal-1.0 cpl-1.0 curl ecl-2.0 efl-2.0
epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 ftl gfdl-1.1-only gfdl-1.2-only gfdl-1.3-only gfdl-1.3-or-later gpl-1.0 gpl-1.0-only
gpl-1.0-or-later gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only gpl-3.0-or-later hpnd icu ijg ipl-1.0 isc
lgpl-2.0 lgpl-2.0-only lgpl-2.0-or-later lgpl-2.1 lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only
lgpl-3.0-or-later libpng libpng-2.0 lppl-1.3c mit mit-0 mit-modern-variant mpl-1.0 mpl-1.1 mpl-2.0
mpl-2.0-no-copyleft-exception ms-pl ms-rl mulanpsl-2.0 naist-2003 ncsa nist-pd odbl-1.0 ofl-1.0 ofl-1.1 openssl osl-1.0
osl-2.0 osl-2.1 osl-3.0 pddl-1.0 php-3.0 php-3.01 postgresql psf-2.0 python-2.0 qpl-1.0 ruby sgi-b-2.0 sleepycat spl-1.0
sspl-1.0 tcl unicode-3.0 unicode-dfs-2016 unlicense upl-1.0 vim w3c wtfpl x11 xnet zlib zpl-2.0 zpl-2.1
autoconf-exception-2.0 autoconf-exception-3.0 bison-exception-2.2 classpath-exception-2.0 font-exception-2.0
gcc-exception-3.1 linux-syscall-note llvm-exception openvpn-openssl-exception qt-gpl-exception-1.0
""".split())
OWN = ("licenseref-", "documentref-")  # fixed values: how the list lets a text name a licence of its own
UNKNOWN = "unknown"
TAG = "spdx license identifier"
# from a tag to the next one or the end of its line; quotes around the tag or the expression do not count
TAG_START = rb"spdx-license-identifier[\"'`]?\s*:"
TAG_LINE = re.compile(rb"(?i)" + TAG_START + rb"[ \t\"'`]*((?:(?!" + TAG_START + rb")[^\r\n])*+)")
TOKEN = re.compile(r"\(|\)|[a-z0-9][a-z0-9.+:-]*")
WHOLE_TOKEN = re.compile(r"\s*+(\(|\)|[a-z0-9][a-z0-9.+:-]*+(?![\w/]))")  # not the beginning of another word
PERMISSIVE = {"mit", "mit-notice", "mit-0", "apache-2.0", "apache", "bsd", "bsd-2-clause", "bsd-3-clause", "0bsd", "isc",
              "bsl-1.0", "cc0-1.0", "cc-by-4.0", "unlicense", "zlib"}
RANK = {"or": 1, "and": 2, "with": 3}
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
TAG_SCORE, NOTICE_SCORE, BASE_SCORE, UNKNOWN_SCORE = 1.0, 0.9, 0.6, 0.3


@dataclass(frozen=True)
class Terms:
    """What an expression comes to: its licences, whether it can be met by permissive ones alone, and its spelling."""

    labels: frozenset[str]
    permissive: bool
    text: str


def evaluate(expression: str) -> Terms | None:
    """Value of an and/or/with expression, or null if it is malformed.

    ``with`` binds tighter than ``and``, ``and`` tighter than ``or``. An alternative is permissive if either side is, a
    conjunction if both are; an exception adds its own label and leaves the licence as strict as it is.
    """
    values: list[Terms] = []
    waiting: list[str] = []
    operand_next = True

    def apply(op: str) -> None:
        right, left = values.pop(), values.pop()
        permissive = {"or": left.permissive or right.permissive, "and": left.permissive and right.permissive,
                      "with": left.permissive}[op]
        values.append(Terms(left.labels | right.labels, permissive, f"({left.text} {op} {right.text})"))

    tokens = TOKEN.findall(expression)
    if "".join(tokens) != re.sub(r"\s", "", expression):
        return None
    for token in tokens:
        if token == "(" or token not in RANK and token != ")":
            if not operand_next:
                return None
            if token == "(":
                waiting.append(token)
            else:
                values.append(Terms(frozenset([token]), token in PERMISSIVE, token))
                operand_next = False
        elif operand_next:
            return None
        elif token == ")":
            while waiting and waiting[-1] != "(":
                apply(waiting.pop())
            if not waiting:
                return None
            waiting.pop()
        else:
            while waiting and waiting[-1] != "(" and RANK[waiting[-1]] >= RANK[token]:
                apply(waiting.pop())
            waiting.append(token)
            operand_next = True
    if operand_next or "(" in waiting:
        return None
    while waiting:
        apply(waiting.pop())
    return values[0]


def identified(token: str) -> str:
    """The token if it is a licence or an exception of the list, or of the text's own; else ``unknown``."""
    return token if token.removesuffix("+") in IDENTIFIERS or token.startswith(OWN) else UNKNOWN


def leading(line: str) -> Terms | None:
    """Value of the longest expression that ``line`` begins with, or null if there is none.

    It ends before the first token that cannot continue it, or with a full stop. A line that breaks off inside an
    expression (after an operator, in brackets) is malformed as a whole. What is no identifier is ``unknown``; behind an
    operator a word of letters alone, with more text after it, is taken for running text, which ends the expression.
    """
    tokens: list[str] = []
    at = depth = whole = 0  # ``whole`` tokens are well-formed
    operand_next = True
    while m := WHOLE_TOKEN.match(line, at):
        token = m[1].rstrip(".:-")
        stopped = token != m[1]
        if token == "(" or token not in RANK and token != ")":
            if not operand_next:
                break
            if token != "(" and identified(token) == UNKNOWN:
                if tokens and token.isalpha() and line[m.end():].strip(" \t)"):
                    break
                token = UNKNOWN
            depth += token == "("
            operand_next = token == "("
        elif operand_next or token == ")" and not depth:
            break
        else:
            depth -= token == ")"
            operand_next = token != ")"
        tokens.append(token)
        if not operand_next and not depth:
            whole = len(tokens)
        at = m.end()
        if stopped:
            break
    if not line[at:].strip() and whole < len(tokens):
        return None
    return evaluate(" ".join(tokens[:whole]))


def automaton(base: dict[str, str], notices: dict[str, str]) -> ahocorasick.Automaton:
    """Finds every phrase, bounded by blanks; a value is (label, words, kind)."""
    found: dict[str, list] = {}
    for kind, phrases in (("base", base), ("notice", notices), ("tag", {TAG: ""})):
        for phrase, label in phrases.items():
            found.setdefault(f" {phrase} ", []).append((label, kind))
    out = ahocorasick.Automaton()
    for phrase, uses in found.items():
        out.add_word(phrase.encode().decode("latin-1"), (len(phrase), uses))
    out.make_automaton()
    return out


def scan(text: bytes, finder: ahocorasick.Automaton) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, permissive) of one text."""
    words = text.translate(WORDS).split()
    plain = (b" " + b" ".join(words) + b" ").decode("latin-1")
    base, labels, starts, score, tagged = set(), set(), [], 0.0, False
    seen = blanks = 0  # blanks before ``seen``: one pass over the text however many phrases it holds
    hits = sorted((end + 1 - length, uses) for end, (length, uses) in finder.iter(plain))
    for start, uses in hits:
        blanks += plain.count(" ", seen, start)
        seen = start
        for label, kind in uses:
            if kind == "tag":
                tagged = True
                continue
            labels.add(label)
            if kind == "base":
                base.add(label)
                starts.append(blanks)
            score = max(score, BASE_SCORE if kind == "base" else NOTICE_SCORE)
    terms = []
    if tagged:
        terms = [t for t in (leading(_expression(m)) for m in TAG_LINE.findall(text)) if t]
        for t in terms:
            score = max(score, TAG_SCORE if t.labels - {UNKNOWN} else UNKNOWN_SCORE)
    permissive = labels <= PERMISSIVE and all(t.permissive for t in terms)  # notices and expressions alike
    labels = labels.union(*(t.labels for t in terms))
    permissive = permissive if labels else None
    return (len(words), len(starts), starts[0] if starts else None, starts[-1] if starts else None,
            ",".join(sorted(base)), ",".join(sorted(labels)), score, ";".join(sorted({t.text for t in terms})),
            permissive)


def _expression(line: bytes) -> str:
    """What a tag's line holds behind it, up to the end of a comment around it."""
    return re.sub(r"(\*/|-->|#}).*", "", line.decode("utf-8", "replace").lower()).strip()


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] | None = None,
                 notices: dict[str, str] | None = None) -> DataFrame:
    """One row per document: words, places of base phrases, base and all labels (sorted, comma-joined), a score.

    ``score`` is 1 for a well-formed expression with a licence of the list behind an identifier tag, 0.9 for a notice, 0.6
    for a base phrase alone, 0.3 for a tag that names no licence of the list (label ``unknown``), else 0. ``expressions``
    has the evaluated expressions, fully bracketed. ``permissive`` holds if every notice and every expression can be met by
    permissive licences alone; it is null without a label.
    """
    phrases = (BASE if base is None else base, NOTICES if notices is None else notices)
    names = [part.split()[0] for part in SCHEMA.split(",")][1:]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string(), pa.bool_()]
    built = []

    def one(batch):
        if not built:
            built.append(automaton(*phrases))
        rows = [scan(t, built[0]) for t in C.raw_texts(batch.column("text"))]
        cols = {n: pa.array([r[i] for r in rows], kind) for i, (n, kind) in enumerate(zip(names, kinds))}
        return {"doc_id": batch.column("doc_id"), **cols}

    return C.per_chunk(C.narrow(df, doc_id=df[id_col].cast("long"), text=text_col), SCHEMA, one)
