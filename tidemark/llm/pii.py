"""Personal data: exact base patterns, and contextual patterns bootstrapped from them.

Base matches (e-mail, IPv4, card, phone) are the seeds. Around seeds and around every other
identifier-like token (groups of digits, spelt-out addresses) lexical contexts are taken: one and two words before, one and two
words after, and the words on both sides. Contexts (patterns) and identifiers (instances) form a
bipartite graph, scored on Spark in rounds until no round finds anything new:

  pattern confidence for a kind = known / (known + against + open / 4 + 1/2), each a number of distinct instances in the pattern's place:
      known of the kind, against it (of another kind, or of a shape the kind does not allow), and open (unknown, the shape allows the kind)
  instance confidence = 1 - prod(1 - pattern confidence), over trusted patterns of a kind its shape allows

Plain short numbers speak against every kind, so a context that any number can
have ("the 12", "in 1999") is not trusted. Instances above the threshold join the known ones in the next round, and their
occurrences become added spans. Edges are distinct before any join, so a context or an identifier that a third of
all rows share is one row of the graph per neighbour; the list of found identifiers is broadcast only below Spark's threshold, and
beyond it the join is split by AQE where one identifier is frequent. Texts are read once.

Defined results: null text is empty; spans are code points, end exclusive, by kind as listed and then start;
base spans always stay and added ones never overlap them; an identifier that two kinds claim equally goes to the first as listed; contexts are the
two nearest words on either side at any distance, a word of more than `LONG` characters by its near end and its length; texts of any length are read whole; repeated rows get equal spans; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.arrow import append_columns
from tidemark.sources.shared import materialise

KINDS = ("email", "ip", "card", "phone")
#: Characters that are looked at first for the words next to a span, and of a long word that stand for it.
NEAR, LONG = 80, 64

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: The look-behinds only spare starts inside a run that its own start has settled.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Groups of digits with single separators (or a bracket and a space) between them, not inside a longer word.
_LOOSE_DIGITS = re.compile(r"(?<![0-9A-Za-z])(?<![0-9][.:/-])[+(]?[0-9]+(?:(?:\[\.\]|\) ?| ?\(|[ .:/-])[0-9]+)*(?![0-9A-Za-z])")
#: Addresses whose signs are spelt out or spaced, found from the first sign; a domain has two parts at least.
_LOOSE_AT = re.compile(r" ?[(\[](?:at|@)[)\]] ?| at | ?@ ?", re.I)
_LOOSE_DOT = re.compile(r" ?[(\[](?:dot|\.)[)\]] ?| dot |\.", re.I)
_LOOSE_HOST = re.compile(rf"[A-Za-z0-9-]+(?:(?:{_LOOSE_DOT.pattern})[A-Za-z0-9-]+)+", re.I)
_WORDS = re.compile(r"[^\s.,;!?|\"()\[\]<>]+")

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
OCC = T.StructType(
    [
        T.StructField("instance", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("seed", T.StringType()),
        T.StructField("shapes", T.ArrayType(T.StringType())),
        T.StructField("patterns", T.ArrayType(T.StringType())),
    ]
)


@dataclass(frozen=True)
class Trust:
    """Thresholds of the bootstrap: confidences, and the distinct known instances that a pattern needs."""

    pattern: float = 0.8
    instance: float = 0.8
    support: int = 4
    #: More rounds than this are an error.
    max_rounds: int = 100


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _at_spans(text: str, pattern: re.Pattern) -> list[tuple[int, int]]:
    """Address matches found from their @: the local part is the run before it, back to the last match."""
    out, last = [], 0
    for m in pattern.finditer(text):
        a = m.start()
        while a > last and text[a - 1] in _LOCAL:
            a -= 1
        if a < m.start():
            out.append((a, m.end()))
            last = m.end()
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in _at_spans(text, _DOMAIN)] if "@" in text else []
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


def _shapes(token: str) -> list[str]:
    """The kinds a candidate could be; a token of none (a short number) only speaks against its contexts."""
    if not token[0].isdigit() and token[0] not in "+(":
        return ["email"]
    groups = re.findall("[0-9]+", token)
    digits = sum(map(len, groups))
    found = []
    if len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups) and not set(token) & set("+()/ -"):
        return ["ip"]
    if 13 <= digits <= 19 and not set(token) - set("0123456789 -"):
        found.append("card")
    if 7 <= digits <= 15 and ":" not in token:
        found.append("phone")
    return found


class _Words:
    """The words next to any place of a text. A look at `NEAR` characters mostly shows them; where it does not, all words of the text are
    listed, once."""

    def __init__(self, text: str) -> None:
        self.text, self.spans = text, None

    def _whole(self) -> np.ndarray:
        if self.spans is None:
            self.spans = np.fromiter((x for m in _WORDS.finditer(self.text) for x in m.span()), np.int64).reshape(-1, 2)
        return self.spans

    def before(self, start: int) -> list[str]:
        """The two words before `start`, in order; a word that reaches across it counts up to there."""
        low = max(0, start - NEAR)
        found = [m.span() for m in _WORDS.finditer(self.text, low, start)][-2:]
        if low and (len(found) < 2 or found[0][0] == low):
            spans = self._whole()
            k = int(np.searchsorted(spans[:, 0], start))
            found = [(int(a), min(int(b), start)) for a, b in spans[max(0, k - 2) : k]]
        return [_name(self.text[max(a, b - LONG) : b], b - a) for a, b in found]

    def after(self, end: int) -> list[str]:
        high = min(len(self.text), end + NEAR)
        found = [m.span() for m in islice(_WORDS.finditer(self.text, end, high), 2)]
        if high < len(self.text) and (len(found) < 2 or found[1][1] == high):
            spans = self._whole()
            k = int(np.searchsorted(spans[:, 1], end, "right"))
            found = [(max(int(a), end), int(b)) for a, b in spans[k : k + 2]]
        return [_name(self.text[a : min(b, a + LONG)], b - a) for a, b in found]


def _name(word: str, length: int) -> str:
    """A long word is known by the end that is near the span and by its length."""
    return word.lower() if length <= LONG else f"{word.lower()}~{length}"


def _context(words: _Words, start: int, end: int) -> list[str]:
    """Lexical patterns around a span: of the two nearest words on either side, however far they are."""
    left, right = words.before(start), words.after(end)
    out = []
    if left:
        out.append(f"{left[-1]} _")
    if len(left) == 2:
        out.append(" ".join(left) + " _")
    if right:
        out.append(f"_ {right[0]}")
    if len(right) == 2:
        out.append("_ " + " ".join(right))
    if left and right:
        out.append(f"{left[-1]} _ {right[0]}")
    return out


def _said_addresses(text: str) -> list[tuple[int, int]]:
    out, last = [], 0
    for m in _LOOSE_AT.finditer(text):
        a, host = m.start(), _LOOSE_HOST.match(text, m.end())
        while host and a > last and text[a - 1] in _LOCAL:
            a -= 1
        if host and a < m.start():
            out.append((a, host.end()))
            last = host.end()
    return out


def _norm(token: str, kind: str | None = None) -> str:
    """One name for all ways to write an identifier."""
    if "@" in token or token[0] not in "0123456789+(":
        return _LOOSE_DOT.sub(".", _LOOSE_AT.sub("@", token)).lower()
    return ".".join(re.findall("[0-9]+", token)) if kind == "ip" or _shapes(token) == ["ip"] else re.sub("[^0-9]", "", token)


def _occurrences(text: str, base: list[tuple[str, int, int]]) -> list[dict]:
    taken = sorted((a, b) for _, a, b in base)
    words = _Words(text)
    out = [
        {"instance": _norm(text[a:b], k), "start": a, "end": b, "seed": k, "shapes": [k], "patterns": _context(words, a, b)} for k, a, b in base
    ]
    loose = [m.span() for m in _LOOSE_DIGITS.finditer(text)] + _said_addresses(text)
    i, last = 0, 0
    for a, b in sorted(loose):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        # Not over a base span (which are in order of start, but may overlap each other), nor over the candidate before.
        clear, j = a >= last, i
        while clear and j < len(taken) and taken[j][0] < b:
            clear = taken[j][1] <= a
            j += 1
        if clear:
            last = b
            out.append({"instance": _norm(text[a:b]), "start": a, "end": b, "seed": None, "shapes": _shapes(text[a:b]), "patterns": _context(words, a, b)})
    return out


def extract(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with `base` (spans) and `occ` (identifier occurrences with their contexts)."""

    def fn(texts: list[str | None]) -> list[list]:
        base = [base_spans(t or "") for t in texts]
        occ = [_occurrences(t or "", b) for t, b in zip(texts, base, strict=True)]
        return [[[{"kind": k, "start": a, "end": e} for k, a, e in b] for b in base], occ]

    return append_columns(docs, [text_col], [T.StructField("base", T.ArrayType(SPAN)), T.StructField("occ", T.ArrayType(OCC))], fn)


def _place(kind: F.Column) -> F.Column:
    return F.array_position(F.array(*(F.lit(x) for x in KINDS)), kind)


def bootstrap(occurrences: DataFrame, trust: Trust = Trust()) -> tuple[DataFrame, DataFrame]:
    """(trusted patterns: pattern, kind, confidence; found instances: instance, kind, confidence).

    `occurrences`: instance, seed, shapes, patterns.
    """
    edges = materialise(
        occurrences.select("instance", "seed", "shapes", F.explode("patterns").alias("pattern")).distinct(), "pii-edges"
    )
    # An identifier counts as known by its first kind; the rest of the graph is open.
    known = edges.groupBy("instance").agg(F.min("seed").alias("kind")).where("kind IS NOT NULL")
    may = [F.bool_or(F.array_contains("shapes", k)).alias(f"may_{k}") for k in KINDS]
    links = materialise(edges.groupBy("pattern", "instance").agg(*may), "pii-links")
    open_ = edges.where("seed IS NULL").select("pattern", "instance", F.explode("shapes").alias("kind")).distinct()
    patterns = found = seen = None
    for _ in range(trust.max_rounds):
        labelled = links.join(known.withColumnRenamed("kind", "known"), "instance", "left")
        tally = [F.struct(F.lit(k).alias("kind"), F.count_if(F.col("known") == k).alias("n"), F.count_if(F.col("known").isNull() & F.col(f"may_{k}")).alias("open")) for k in KINDS]
        counts = labelled.groupBy("pattern").agg(F.count(F.lit(1)).alias("all"), F.array(*tally).alias("kinds"))
        sure = F.col("n") / (F.col("all") - 0.75 * F.col("open") + 0.5)
        patterns = counts.select("pattern", "all", F.inline("kinds")).select("pattern", "kind", sure.alias("confidence"), F.col("n").alias("support"))
        patterns = patterns.where((F.col("support") >= trust.support) & (F.col("confidence") >= trust.pattern))
        patterns = materialise(patterns, "pii-patterns")
        scored = open_.join(patterns, ["pattern", "kind"]).groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("confidence"))
        ranked = F.struct("confidence", (-_place(F.col("kind"))).alias("o"), "kind")
        best = scored.groupBy("instance").agg(F.max(ranked).alias("b")).select("instance", "b.kind", "b.confidence")
        found = materialise(best.where(F.col("confidence") >= trust.instance), "pii-found")
        known = known.unionByName(found.select("instance", "kind")).groupBy("instance").agg(F.min("kind").alias("kind"))
        known = materialise(known, "pii-known")
        # The known only grow and their kinds only fall, so equal tables mean that nothing is left to find.
        state = known.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("instance", "kind")).alias("h")).first()
        if state == seen:
            return patterns, found
        seen = state
    raise RuntimeError("the bootstrap did not settle")


def find(docs: DataFrame, text_col: str = "text", trust: Trust = Trust()) -> DataFrame:
    """doc_id, base (array of spans), added (array of spans)."""
    rows = materialise(
        extract(docs.select("doc_id", text_col), text_col).select("doc_id", "base", "occ").withColumn("row", F.monotonically_increasing_id()), "pii-rows"
    )
    _, found = bootstrap(rows.select(F.inline("occ")), trust)
    added = (
        rows.select("row", F.inline("occ"))
        .where("seed IS NULL")
        .join(found, "instance")
        .groupBy("row")
        .agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    )
    nothing = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    return rows.drop("occ").join(added, "row", "left").select("doc_id", "base", F.coalesce("added", nothing).alias("added"))


def by_kind(spans: F.Column) -> F.Column:
    """Spans by kind as listed, then start."""
    keyed = F.transform(spans, lambda s: F.struct(_place(s["kind"]).alias("o"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.sort_array(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
