"""The filter audit against a plain version on awkward rows; the query itself is held against SQL."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import filter_audit

LONG = " ".join(f"w{i % 977}" for i in range(30_000))


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def measures(t):
    w, t = words(t), t or ""
    return [len(w), len(set(w)), len(re.findall("[A-Z]", t)), len(t), len(re.findall("[#$%&*|]", t))]


def transduced(texts):
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    return np.array(filter_audit.transduce(np.frombuffer(b"".join(raw), np.uint8), offsets)).T.tolist()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab A#é日😀\t\n\x0b\x1f\x85 "), max_size=30), min_size=1, max_size=8))
def test_transducer(texts):
    assert transduced(texts) == [measures(t) for t in texts]


def test_transducer_on_long_words_and_texts():
    same = "y" * 300
    texts = ["", LONG, "x" * 5000, f"{same} {same} {same}z {'é' * 400}", "a" * 255 + " " + "a" * 256 + " " + "a" * 255, "", LONG + " Tail", "word" * 3 + " " + "word" * 3]
    assert transduced(texts) == [measures(t) for t in texts]


def test_equal_hashes_do_not_make_equal_words(monkeypatch):
    monkeypatch.setattr(filter_audit, "_MIX", np.uint64(0))
    texts = [" ".join(f"w{i}" for i in range(300)) + " w3 w4", "aaaaaaaab aaaaaaaac aaaaaaaab"]
    assert transduced(texts) == [measures(t) for t in texts]


def plain(docs, labels):
    """The contract, document by document."""
    smallest = {}
    for i, t, _ in docs:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    good, toxic = ({d for d, *q in labels if q[k] == 1} for k in (0, 1))
    out = Counter()
    fails = []
    for i, t, part in docs:
        n, distinct, caps, chars, symbols = measures(t)
        f = {"A": n < 200, "B": 100 * distinct < 50 * n, "C": 100 * caps > 2 * chars, "D": symbols > 0, "E": i is not None and smallest[t or ""] < i}
        fails.append((part or "", f, i in good and i is not None, i in toxic and i is not None))
    for order in map("".join, permutations("ABCDE")):
        for part, f, g, x in fails:
            gone = False
            for step, c in enumerate(order, 1):
                key = (part, order, step)
                out[*key, "redundant"] += f[c] and gone
                if f[c] and not gone:
                    gone = True
                    out[*key, "removed"] += 1
                    out[*key, "good_lost"] += g
                    out[*key, "toxic_lost"] += x
                    out[part, c, "shapley"] += 1
                out[*key, "unique_fails"] += f[c] and sum(f.values()) == 1
                out[*key, "kept"] += not gone
    return out, {p for p, *_ in fails}


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def test_audit_equals_the_plain_version(spark):
    rng = random.Random(3)
    texts = [None, "", LONG, "Short TEXT", "a # b"] + [" ".join(rng.choices(["word", "other", "Third", "#", f"u{k}"], k=rng.choice([5, 250]))) for k in range(30)]
    docs = [(rng.choice([k, k, None]), t, rng.choice(["x", "y", None, ""])) for k, t in enumerate(texts + texts[:20])]
    docs += [docs[7], docs[8]]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 60, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    table = spark.createDataFrame([(*d, "z", 1) for d in docs], "doc_id long, text string, source string, n_words string, failed int").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): r for r in filter_audit.audit(table, marks).collect()}
    want, parts = plain(docs, labels)
    assert set(got) == {(p, "".join(o), k) for p in parts for o in permutations("ABCDE") for k in range(1, 6)}
    for (part, order, step), r in got.items():
        assert [r[c] for c in COUNTS] == [want[part, order, step, c] for c in COUNTS]
        assert r.shapley == want[part, order[step - 1], "shapley"]


def test_own_filters_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (2, "a b c", "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    rows = filter_audit.audit(docs, labels, {"x": "n_words < 3", "y": "n_distinct > 2"}).collect()
    assert {(r.filter_order, r.step, r.kept, r.removed) for r in rows} == {("xy", 1, 1, 1), ("xy", 2, 0, 1), ("yx", 1, 1, 1), ("yx", 2, 0, 1)}
