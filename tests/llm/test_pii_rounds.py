"""The bootstrap goes on until nothing is found."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import pii


def test_long_chains_are_followed(spark):
    rows = []
    # Context k becomes trusted by six instances that it shares with context k - 1, and gives six of the next.
    for k in range(6):
        seed = "phone" if k == 0 else None
        rows += [(f"b{k}-{i}", seed, ["phone"], [f"c{k}"]) for i in range(40)]
        rows += [(f"b{k + 1}-{i}", None, ["phone"], [f"c{k}"]) for i in range(6)]
    df = spark.createDataFrame(rows, "instance string, seed string, shapes array<string>, patterns array<string>")
    trust = pii.Trust(pattern=0.1, instance=0.1)
    found = {r.instance for r in pii.bootstrap(df, trust)[1].collect()}
    assert {f"b6-{i}" for i in range(6)} <= found and {f"b5-{i}" for i in range(40)} <= found
    with pytest.raises(RuntimeError):
        pii.bootstrap(df, pii.Trust(pattern=0.1, instance=0.1, max_rounds=2))


def brute_bootstrap(rows, trust):
    """The bootstrap over plain sets; (doc, start, end, kind) of added spans."""
    occ = [(d, o) for d, t in rows for o in pii._occurrences(t or "", pii.base_spans(t or ""))]
    edges = {(p, o["instance"]) for _, o in occ for p in o["patterns"]}
    open_ = {(p, o["instance"], k) for _, o in occ if o["seed"] is None for p in o["patterns"] for k in o["shapes"]}
    known = {}
    for _, o in occ:
        if o["seed"]:
            known[o["instance"]] = min(o["seed"], known.get(o["instance"], o["seed"]))
    while True:
        everything, of = Counter(p for p, _ in edges), Counter((p, known[i]) for p, i in edges if i in known)
        unsure = Counter((p, k) for p, i, k in open_ if i not in known)
        conf = {pk: n / (everything[pk[0]] - 0.75 * unsure[pk] + 0.5) for pk, n in of.items() if n >= trust.support}
        conf = {pk: c for pk, c in conf.items() if c >= trust.pattern}
        left = defaultdict(lambda: 1.0)
        for p, i, k in open_:
            left[i, k] *= 1 - conf.get((p, k), 0)
        found = {}
        for (i, k), rest in left.items():
            if 1 - rest >= trust.instance and (i not in found or (1 - rest, -pii.KINDS.index(k)) > found[i][:2]):
                found[i] = (1 - rest, -pii.KINDS.index(k), k)
        now = dict(known)
        for i, f in found.items():
            now[i] = min(f[2], now.get(i, f[2]))
        if now == known:
            return {(d, o["start"], o["end"], found[o["instance"]][2]) for d, o in occ if o["seed"] is None and o["instance"] in found}
        known = now


def planted():
    """(documents, the unseen identifiers in them as (doc, kind, text))."""
    rng = np.random.default_rng(6)
    rows, want = [], set()
    say = {
        "phone": ["please call me on {} after lunch", "my mobile number: {} (home)", "reach the front desk, dial {} today"],
        "card": ["paid with visa {} last week", "charge my card number {} please"],
        "ip": ["connect to server {} over ssh", "the router at address {} is down"],
        "email": ["write me an email to {} soon", "contact {} for details"],
    }
    seen = {
        "phone": lambda: f"+1 ({rng.integers(100, 999)}) 555-{rng.integers(1000, 9999)}",
        "card": lambda: card(),
        "ip": lambda: ".".join(str(x) for x in rng.integers(1, 255, 4)),
        "email": lambda: f"user{rng.integers(10**6)}@mail{rng.integers(9)}.example.com",
    }
    unseen = {
        "phone": lambda: str(rng.choice(["({}) 555-{}", "{} 555 {}", "{}.555.{}", "{}-555-{}"])).format(rng.integers(100, 999), rng.integers(1000, 9999)),
        "card": lambda: "4111 1111 1111 111" + str(rng.choice([2, 3, 4, 5])) if rng.random() < 0.3 else str(rng.integers(10**15, 10**16 - 1)),
        "ip": lambda: "[.]".join(str(x) for x in rng.integers(1, 255, 4)),
        "email": lambda: f"user{rng.integers(10**6)} [at] mail{rng.integers(9)} [dot] example [dot] com",
    }

    def card():
        while True:
            c = "4" + "".join(map(str, rng.integers(0, 10, 15)))
            if pii._luhn(c):
                return c

    for kind, ways in say.items():
        for k in range(90):
            rows.append((len(rows), "Some words first. " + ways[k % len(ways)].format(seen[kind]())))
        for k in range(30):
            x = unseen[kind]()
            if kind == "card" and pii._luhn(x.replace(" ", "")):
                continue
            rows.append((len(rows), "Other words first. " + ways[k % len(ways)].format(x)))
            want.add((rows[-1][0], kind, x))
    for k in range(300):  # numbers that identify nobody, and an odd seed in their contexts
        number = rng.choice([str(rng.integers(1, 3000)), str(rng.integers(10**6, 10**9)), str(rng.integers(10**15, 10**16))])
        rows.append((len(rows), str(rng.choice(["there were {} of the items in stock", "in {} the total of {} was reached", "look at {} for section 4.5.6"])).format(number, number)))
    rows += [(len(rows) + k, f"there were {seen['phone']()} of the items") for k in range(5)]
    return [*rows, (10_000, None), (10_001, "")], want


def test_unseen_identifiers_are_found(spark):
    rows, want = planted()
    text = dict(rows)
    out = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {(r.doc_id, s.start, s.end, s.kind) for r in out for s in r.added}
    assert got == brute_bootstrap(rows, pii.Trust())
    named = {(d, k, text[d][a:b]) for d, a, b, k in got}
    right = len(named & want)
    assert right >= 0.9 * len(want) and right >= 0.9 * len(named), (right, len(named), len(want), sorted(named - want)[:5], sorted(want - named)[:5])
