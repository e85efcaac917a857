"""Licence signs in texts: Aho-Corasick for tags and notices, a shunting-yard parser for expressions.

A text is brought to its lower-case words, one space around each, and one automaton over
that string finds all notice phrases and identifier tags in a single pass, however many
phrases there are. Where a tag was met, a second automaton finds the tag in the text
itself, as brackets and dots matter there, and what follows on its line is read as a
licence expression: identifiers with `and`, `or` and `with`, in which `with` binds
strongest and `or` weakest. The parser turns it into postfix order, and evaluating that gives
the licences named, those that have to be followed together, and how far they restrict use.
"""

from __future__ import annotations

import re
from functools import cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Notices of the base scan: words that have to stand one after another, and their label.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Notices the method adds.
MORE_PHRASES = {
    "mit license": "mit",
    "apache license 2 0": "apache-2",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl-3",
    "mozilla public license version 2": "mpl-2",
    "mozilla public license 2 0": "mpl-2",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by 4 0": "cc-by",
    "all rights reserved": "all-rights-reserved",
}
# Identifier tags, as words and as they are written; the first takes identifiers not listed below as well.
TAGS = {
    "spdx license identifier": "spdx-license-identifier:",
    "license expression": "license-expression:",
    "license": "license:",
    "licence": "licence:",
}
OPEN_TAG = "spdx-license-identifier:"
# Identifiers of expressions and their label; a trailing + , -only or -or-later does not change it.
IDENTIFIERS = {
    "mit": "mit", "isc": "isc", "zlib": "zlib", "0bsd": "0bsd", "unlicense": "unlicense", "cc0-1.0": "cc0",
    "apache-2.0": "apache-2", "bsd-2-clause": "bsd-2-clause", "bsd-3-clause": "bsd-3-clause",
    "gpl-2.0": "gpl-2", "gpl-3.0": "gpl-3", "lgpl-2.1": "lgpl", "lgpl-3.0": "lgpl", "agpl-3.0": "agpl-3",
    "mpl-2.0": "mpl-2", "epl-2.0": "epl-2", "cc-by-4.0": "cc-by", "cc-by-sa-4.0": "cc-by-sa",
    "cc-by-nc-4.0": "cc-by-nc", "cc-by-nd-4.0": "cc-by-nd",
}
# How far a label restricts use, 1 to 4 of 4; labels not listed count as 4.
RESTRICTS = {
    "mit": 1, "isc": 1, "zlib": 1, "0bsd": 1, "unlicense": 1, "cc0": 1, "apache-2": 1, "bsd-2-clause": 1,
    "bsd-3-clause": 1, "cc-by": 1, "lgpl": 2, "mpl-2": 2, "epl-2": 2, "gpl-2": 3, "gpl-3": 3, "agpl-3": 3,
    "cc-by-sa": 3, "cc-by-nc": 4, "cc-by-nd": 4, "all-rights-reserved": 4,
}
MOST = 4

# A-Z to a-z; what is neither letter, digit nor beyond ASCII to a space.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_LOWER = {c: c + 32 for c in range(65, 91)}
_TOKEN = re.compile(r"[ \t]*([()]|[a-z0-9][a-z0-9.+:-]*)")
_BINDS = {"or": 1, "and": 2, "with": 3}

FINDINGS = "array<struct<label:string,word:bigint,base:boolean>>"
EXPRESSIONS = "array<struct<tag:string,postfix:string,labels:array<string>,needed:array<string>,restricts:int,whole:boolean>>"


class Expression(NamedTuple):
    postfix: list[str]  # operands and operators in postfix order
    end: int  # where reading stopped
    whole: bool  # nothing was left open: no operator or bracket without its other half


class Value(NamedTuple):
    labels: frozenset  # every licence named
    needed: frozenset  # those of the choice that restricts least
    restricts: int


def plain_identifier(name: str) -> str:
    for tail in ("-or-later", "-only", "+"):
        if name.endswith(tail):
            return name[: -len(tail)]
    return name


def parse(text: str, at: int = 0, known=None) -> Expression:
    """Shunting-yard over the tokens of lower-case `text` from `at` to the end of the line.

    Reading stops at the first token that cannot go on with the expression, or at an
    identifier that `known` refuses. An operator left without its right side is dropped,
    and brackets left open are closed; `whole` is false then.
    """
    out, stack = [], []
    operand_next, whole, end = True, True, at
    while True:
        token = _TOKEN.match(text, end)
        if token is None:
            break
        word = token[1].rstrip(".:") if token[1] not in "()" else token[1]
        if operand_next:
            if word == "(":
                stack.append(word)
            elif word == ")" or word in _BINDS or not word:
                break
            elif stack and stack[-1] == "with":
                out.append(word)  # an exception's name, whatever it is
                operand_next = False
            elif known is not None and not known(word):
                break
            else:
                out.append(word)
                operand_next = False
        elif word in _BINDS:
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[word]:
                out.append(stack.pop())
            stack.append(word)
            operand_next = True
        elif word == ")" and "(" in stack:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        else:
            whole &= word != ")"
            break
        end = token.end()
    if operand_next:
        # Open brackets and the operator before them have no right side.
        while stack and stack[-1] == "(":
            stack.pop()
            whole = False
        if stack:
            stack.pop()
            whole = False
    while stack:
        top = stack.pop()
        if top == "(":
            whole = False
        else:
            out.append(top)
    return Expression(out, end, whole)


def evaluate(postfix: list[str], unlisted: bool) -> Value | None:
    """Licences and restriction of an expression in postfix order; None if it is empty.

    `or` chooses the side that restricts less, the left on a tie; `and` needs both and
    restricts like the stricter; `with` takes one step off a copyleft licence. Identifiers not listed
    keep their own name as label if `unlisted`, and restrict most.
    """
    named, stack = set(), []

    def licence():
        """Restriction and label of the topmost operand; what is needed stays a tree until the end."""
        top = stack.pop()
        if isinstance(top, tuple):
            return top
        label = IDENTIFIERS.get(plain_identifier(top)) or (top if unlisted else None)
        if label:
            named.add(label)
        return RESTRICTS.get(label, MOST), label

    for token in postfix:
        if token not in _BINDS:
            stack.append(token)
        elif token == "with":
            stack.pop()  # the exception's name
            restricts, label = licence()
            stack.append((restricts - (restricts in (2, 3)), label))
        else:
            right, left = licence(), licence()
            if token == "and":
                stack.append((max(left[0], right[0]), [left[1], right[1]]))
            else:
                stack.append(right if right[0] < left[0] else left)
    if not stack:
        return None
    restricts, tree = licence()
    needed, branches = set(), [tree]
    while branches:
        branch = branches.pop()
        if isinstance(branch, list):
            branches += branch
        elif branch:
            needed.add(branch)
    return Value(frozenset(named), frozenset(needed), restricts)


@cache
def _automata():
    words, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    found: dict[str, list] = {}
    for phrases, base in ((BASE_PHRASES, True), (MORE_PHRASES, False)):
        for phrase, label in phrases.items():
            found.setdefault(f" {phrase} ", []).append((label, base))
    for phrase in TAGS:
        found.setdefault(f" {phrase} ", [])
    for phrase, labels in found.items():
        words.add_word(phrase, (phrase.count(" ") - 1, labels, phrase.strip() in TAGS))
    for tag in TAGS.values():
        tags.add_word(tag, tag)
    words.make_automaton()
    tags.make_automaton()
    return words, tags


def scan(text: bytes):
    """(number of words, findings, expressions) of one text in UTF-8."""
    automaton, tags = _automata()
    words = text.translate(_WORD_BYTES).split()
    line = " " + b" ".join(words).decode() + " "
    findings, tagged, counted, upto = [], False, 0, 0
    for end, (length, labels, is_tag) in automaton.iter(line):
        # Ends ascend, so spaces are counted once; the match ends on the space after its last word.
        counted += line.count(" ", upto, end)
        upto = end
        tagged |= is_tag
        findings += [(label, counted - length, base) for label, base in labels]
    return len(words), findings, _expressions(text, tags) if tagged else []


def _expressions(text: bytes, tags):
    lower = text.decode().translate(_LOWER)
    found, done = [], 0
    for end, tag in tags.iter(lower):
        begin = end + 1 - len(tag)
        before = lower[begin - 1] if begin else " "
        # `license:` also ends longer words, and tags may stand inside what was read already.
        if begin < done or before == "-" or before.isalnum():
            continue
        unlisted = tag == OPEN_TAG
        known = None if unlisted else lambda word: plain_identifier(word) in IDENTIFIERS
        read = parse(lower, end + 1, known)
        value = evaluate(read.postfix, unlisted)
        if value is not None:
            done = read.end
            found.append((
                tag.rstrip(":"), " ".join(read.postfix), sorted(value.labels), sorted(value.needed),
                value.restricts, read.whole,
            ))
    return found


def _scanner(batches):
    finding = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("base", pa.bool_())]))
    expression = pa.list_(pa.struct([
        ("tag", pa.string()), ("postfix", pa.string()), ("labels", pa.list_(pa.string())),
        ("needed", pa.list_(pa.string())), ("restricts", pa.int32()), ("whole", pa.bool_()),
    ]))
    names = [("label", "word", "base"), ("tag", "postfix", "labels", "needed", "restricts", "whole")]
    for batch in batches:
        counts, findings, expressions = [], [], []
        for value in batch.column(1).cast(pa.binary()):
            n, found, read = scan(value.as_py() or b"")
            counts.append(n)
            findings.append([dict(zip(names[0], f)) for f in found])
            expressions.append([dict(zip(names[1], e)) for e in read])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(findings, finding),
             pa.array(expressions, expression)],
            names=["id", "n_words", "findings", "expressions"],
        )


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_words, findings, expressions) of every document.

    Words are stretches of ASCII letters, digits and characters beyond ASCII, with A-Z in
    lower case. `findings` are all places of all notice phrases, overlapping ones
    too: label, number of the first word, and whether the phrase is one of the base.
    `expressions` are the licence expressions after identifier tags: postfix order,
    labels named, labels needed for the least restricted choice, restriction (1 to 4), and
    whether the expression was complete. After a tag other than the first of TAGS
    only listed identifiers are read, so that plain prose after `license:` gives nothing.

    Every row gives one row, whatever its id. A NULL or empty text has no words and no
    findings. Other columns are ignored. An empty table gives no rows. Texts are read whole, one at a
    time, without a shuffle.
    """
    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(
        _scanner, f"id bigint, n_words bigint, findings {FINDINGS}, expressions {EXPRESSIONS}"
    )


def license_columns(scanned: DataFrame) -> DataFrame:
    """scan_licenses() as counts, places, label lists and a score.

    `score` is the greatest restriction among the expressions and the phrases, in quarters: 0 for no
    licence sign, 0.25 for licences that ask for a notice only, up to 1 for no commercial use, no
    changes, all rights reserved, or a licence not listed.
    """
    base = F.filter("findings", lambda f: f["base"])
    places = F.transform(base, lambda f: f["word"])
    levels = F.create_map(*[F.lit(x) for item in RESTRICTS.items() for x in item])
    by_phrase = F.array_max(F.transform("findings", lambda f: F.coalesce(levels[f["label"]], F.lit(MOST))))
    by_tag = F.array_max(F.transform("expressions", lambda e: e["restricts"]))

    def joined(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    phrase_labels = F.transform("findings", lambda f: f["label"])
    tag_labels = F.flatten(F.transform("expressions", lambda e: e["labels"]))
    return scanned.select(
        "id", "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"), joined(F.transform(base, lambda f: f["label"])).alias("base_labels"),
        joined(F.concat(phrase_labels, tag_labels)).alias("labels"),
        (F.greatest(F.coalesce(by_phrase, F.lit(0)), F.coalesce(by_tag, F.lit(0))) / MOST).alias("score"),
        F.array_join(F.transform("expressions", lambda e: e["postfix"]), ";").alias("expressions"),
        joined(F.flatten(F.transform("expressions", lambda e: e["needed"]))).alias("needed_labels"),
    )
