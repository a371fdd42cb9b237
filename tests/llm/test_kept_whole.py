"""Keys that are no integers, messages that repeat, and contexts at any distance."""

import random
import re

from pyspark.sql import functions as F

from tidemark.llm import chat, pii, warc

WORD = re.compile(pii._WORDS.pattern)


def plain(text, a, b):
    left = [(m.group(), len(m.group())) for m in WORD.finditer(text[:a])][-2:]
    right = [(m.group(), len(m.group())) for m in WORD.finditer(text[b:])][:2]
    name = lambda w, n, near: w.lower() if n <= pii.LONG else f"{near(w).lower()}~{n}"
    return [name(w, n, lambda w: w[-pii.LONG :]) for w, n in left], [name(w, n, lambda w: w[: pii.LONG]) for w, n in right]


def test_contexts_at_any_distance():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["Word", "x" * rng.choice([3, 70, 90, 300]), " ", ". " * rng.choice([1, 60, 200]), "\n", "5", "é"]) for _ in range(rng.randrange(1, 30)))
        words = pii._Words(text)
        for _ in range(8):
            a = rng.randrange(len(text) + 1)
            b = rng.randrange(a, len(text) + 1)
            assert (words.before(a), words.after(b)) == plain(text, a, b)
    far = pii._Words("call Me " + " " * 5000 + "555" + "." * 5000 + " Now please")
    assert pii._context(far, 5008, 5011) == ["me _", "call me _", "_ now", "_ now please", "me _ now"]


def test_keys_that_are_no_integers_are_null(spark):
    pages = spark.createDataFrame([("7", "http://a/", "x" * 200), ("p-8", "http://b/", "x" * 200), (None, "http://c/", "y")], "page_id string, url string, html string")
    got = warc.read_warc(spark, warc.convert(spark, [warc.write_arc(pages, 1)])).where("record_type <> 'warcinfo'").collect()
    assert sorted((r.key is None, r.key, r.record_type, r.payload_bytes) for r in got if r.key is not None) == [(False, 7, "response", 200)]
    assert sorted((r.record_type, r.payload_bytes) for r in got if r.key is None) == [("response", 1), ("revisit", 200)]


def test_repeated_messages_are_one(spark):
    rows = [(1, 1, None, "user", "hi", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 2, 1, "assistant", "b", 0.5), (1, 2, 1, "assistant", "b", 0.5)]
    df = spark.createDataFrame(rows, "tree long, id long, parent long, role string, text string, score double")
    for parts in (1, 4):
        got = chat.chosen_paths(df.repartition(parts, F.rand(parts))).orderBy("place").collect()
        assert [(r.place, r.role, r.text, r.branch_score) for r in got] == [(1, "user", "hi", 0.25), (2, "assistant", "b", 0.25)]
