"""Secret scanning over a document-partitioned trigram inverted index.

From every rule's regular expression a Boolean query over trigrams is derived: an AND of the
literal runs it cannot match without, an OR over its alternatives. Each Arrow batch of documents
is an index shard: postings (trigram -> sorted document ordinals) are built for the trigrams the
rules ask for, the queries intersect and unite postings, and only the candidates are verified
with the regular expression. A rule without mandatory trigrams (plain hex runs) scans all.
Shards are independent, so the job is map-only: no shuffle, no skew, no state to lose.

The index of a shard lives as long as its batch: a kept one would have to be read beside every text that it names.

Defined results: null text is empty; spans are code points, end exclusive, leftmost and
non-overlapping per kind, ordered by start and then kind; repeated rows each get their own spans; texts of any length are read whole;
an empty table gives an empty result; a column named like the one that is added is replaced, others are kept.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.arrow import append_columns

try:  # the parser moved in 3.11
    from re import _constants as sre
    from re import _parser as sre_parse
except ImportError:
    import sre_constants as sre
    import sre_parse


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    ignore_case: bool = False
    group: int = 0
    min_len: int = 1


#: Order is the tie order of spans with one start.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", min_len=18),
    Rule("hex", r"[0-9a-f]+", min_len=16),
)
#: A key up to its END line, which is the next marker; where there is none, the header and the base64 lines after it.
_KEY_HEAD = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
_KEY_END = r"[^-]*(?:-(?!----)[^-]*)*-----+END [A-Z ]{0,40}PRIVATE KEY-----"
_KEY_GAP = r"(?:\s|\\[nr])+"
_KEY_LINES = rf"(?:(?:{_KEY_GAP}(?:(?:Proc-Type|DEK-Info):[^\n]*|[A-Za-z0-9+/]{{16,}}={{0,2}}))+(?:{_KEY_GAP}[A-Za-z0-9+/]+={{0,2}}(?=[\s\"'\\]|\Z))?)?"
EXTRA_RULES = (
    Rule("private_key", f"{_KEY_HEAD}(?:{_KEY_END}|{_KEY_LINES})"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]+", min_len=40),
    Rule("chat_token", r"xox[baprs]-[A-Za-z0-9-]+", min_len=20),
    Rule("signed_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)
RULES = BASE_RULES + EXTRA_RULES

SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))

#: Bytes of text whose trigrams are looked up at a time.
_SLICE = 4_000_000
#: A literal set larger than this is cut into two shorter ones.
_MOST_LITERALS = 16


def _all(parts: list) -> object:
    parts = [p for p in parts if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts: list) -> object:
    return True if any(p is True for p in parts) else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _literal(text: str) -> object:
    text = text.lower()
    return _all([text[i : i + 3] for i in range(len(text) - 2)])


def _small_set(items: list) -> list[str] | None:
    if any(op is not sre.LITERAL for op, _ in items) or len(items) > 6:
        return None
    return [chr(c) for _, c in items]


def _walk(nodes: object) -> tuple[set[str] | None, object]:
    """(the exact strings a sequence can be, or None if it is not a small set; its trigram query)."""
    exact, done, whole = {""}, [], True

    def cut(nxt: set[str]) -> None:
        nonlocal exact, whole
        done.append(_any([_literal(s) for s in sorted(exact)]))
        exact, whole = nxt, False

    def extend(options: set[str]) -> None:
        nonlocal exact
        if len(exact) * len(options) > _MOST_LITERALS:
            cut(options)
        else:
            exact = {a + b for a in exact for b in options}

    for op, arg in nodes:
        if op is sre.LITERAL:
            extend({chr(arg)})
        elif op is sre.IN and (chars := _small_set(arg)):
            extend(set(chars))
        elif op is sre.SUBPATTERN or op is sre.BRANCH:
            options = [arg[3]] if op is sre.SUBPATTERN else arg[1]
            found = [_walk(o) for o in options]
            if all(f[0] is not None for f in found):
                extend(set().union(*(f[0] for f in found)))
            else:
                cut({""})
                done.append(_any([f[1] for f in found]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            least, most, sub = arg
            inner = _walk(sub)
            if most == 1 and inner[0] is not None:
                extend(inner[0] | {""})
            else:
                cut({""})
                if least:
                    done.append(inner[1])
        elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            continue
        else:
            cut({""})
    tail = _any([_literal(s) for s in sorted(exact)])
    return (exact if whole else None), _all([*done, tail])


@cache
def trigram_query(pattern: str) -> object:
    """True (no mandatory trigram), a trigram, or ('and'|'or', parts); lower case throughout, so
    it is a necessary condition for rules that ignore case too."""
    return _walk(sre_parse.parse(pattern))[1]


def trigrams_of(query: object) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*(trigrams_of(p) for p in query[1]))


def build_postings(texts: list[bytes], wanted: set[str]) -> dict[str, np.ndarray]:
    """Postings of one shard (trigram -> sorted ordinals of the texts that have it), for the trigrams that the rule set asks about.

    One pass over the shard's trigrams, `_SLICE` bytes at a time: each is looked up by its code.
    """
    names = sorted(wanted)
    number = np.zeros(1 << 24, np.uint8 if len(names) < 256 else np.uint16)
    for k, g in enumerate(names):
        if len(g.encode()) == 3:
            number[int.from_bytes(g.encode(), "big")] = k + 1
    found = [np.zeros((0, 2), np.int64)]
    part: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        part.append(i)
        size += len(t)
        if size >= _SLICE or i + 1 == len(texts):
            # A line end between texts is part of no trigram asked for.
            raw = np.frombuffer(b"\n\n".join(texts[j] for j in part).lower(), np.uint8).astype(np.uint32)
            if len(raw) > 2:
                kind = number[raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]]
                at = np.flatnonzero(kind)
                ends = np.cumsum([len(texts[j]) + 2 for j in part])
                pairs = np.stack([kind[at].astype(np.int64) - 1, np.array(part)[np.searchsorted(ends, at, "right")]], axis=1)
                found.append(np.unique(pairs, axis=0))
            part, size = [], 0
    pairs = np.concatenate(found)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    cuts = np.searchsorted(pairs[:, 0], np.arange(len(names) + 1))
    postings = {g: pairs[cuts[k] : cuts[k + 1], 1] for k, g in enumerate(names)}
    # A trigram of wider characters has no code of three bytes; it is looked for as it is.
    for g in names:
        if len(g.encode()) != 3:
            postings[g] = np.fromiter((i for i, t in enumerate(texts) if g.encode() in t.lower()), np.int64)
    return postings


def candidates(query: object, postings: dict[str, np.ndarray], n: int) -> np.ndarray:
    if query is True:
        return np.arange(n)
    if isinstance(query, str):
        return postings[query]
    op, parts = query
    out = candidates(parts[0], postings, n)
    for p in parts[1:]:
        other = candidates(p, postings, n)
        out = np.intersect1d(out, other, assume_unique=True) if op == "and" else np.union1d(out, other)
    return out


def verify(rule: Rule, text: str) -> list[tuple[int, int]]:
    regex = re.compile(rule.pattern, re.ASCII | (re.IGNORECASE if rule.ignore_case else 0))
    return [m.span() for m in regex.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.min_len]


def scan_shard(texts: list[str | None], rules: tuple[Rule, ...] = RULES) -> list[list[dict]]:
    texts = [t or "" for t in texts]
    queries = [trigram_query(r.pattern) for r in rules]
    postings = build_postings([t.encode() for t in texts], set().union(*(trigrams_of(q) for q in queries)))
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        for i in candidates(query, postings, len(texts)):
            found[i] += [(a, k, b) for a, b in verify(rule, texts[i])]
    return [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in sorted(f)] for f in found]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", out: str = "secrets") -> DataFrame:
    """`docs` with an array of (kind, start, end)."""
    return append_columns(docs, [text_col], [T.StructField(out, SPAN)], lambda texts: [scan_shard(texts, rules)])


def mask(text: str, spans: list[dict], token: str = "[SECRET]") -> str:
    """`text` with every run of overlapping spans replaced by one token."""
    parts, at, end = [], 0, 0
    for s in sorted(spans, key=lambda s: s["start"]):
        if s["start"] >= end:
            parts += [text[at : s["start"]], token]
        end = max(end, s["end"])
        at = end
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """`docs` with every secret masked in place and `n_chars` brought up to date; no row is dropped."""
    names, clean = docs.columns, "clean"
    while clean in names:
        clean += "_"
    made = append_columns(
        docs,
        [text_col],
        [T.StructField(clean, T.StringType())],
        lambda texts: [[t if not f else mask(t, f) for t, f in zip(texts, scan_shard(texts, rules), strict=True)]],
    )
    new = {text_col: F.col(clean)}
    if "n_chars" in names:
        new["n_chars"] = F.length(clean).cast(docs.schema["n_chars"].dataType)
    return made.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in names))
