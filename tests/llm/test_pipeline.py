"""The pipeline against a plain version of all its stages."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import decontam, packing, queries, secret_scan
from test_near_copies import brute_groups


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def plain_quality(rows):
    """Lines that more than 20 families of a host have go; the fixture's families are its exact copies."""
    held = defaultdict(set)
    norm = lambda x: " ".join(words(x.lower()))
    for _, t, _, s, _ in rows:
        for x in (t or "").split("\n"):
            if words(x):
                held[s, norm(x)].add(t)
    out = []
    for i, t, lang, s, n in rows:
        w = words(t)
        at = defaultdict(list)
        for k in range(len(w) - 4):
            at[tuple(w[k : k + 5])].append(k)
        repeated = {p + k for ps in at.values() if len(ps) > 1 for p in ps for k in range(5)}
        lines = (t or "").split("\n")
        kept = [x for x in lines if not words(x) or len(held[s, norm(x)]) <= 20]
        left = sum(len(words(x)) for x in kept)
        if len(w) >= 10 and 100 * len(repeated) <= 20 * len(w) and left >= 10 and left >= 0.3 * len(w):
            clean = "\n".join(kept)
            out.append((i, clean, lang, s, n if clean == t else len(clean)))
    return out


def plain_dedup(rows):
    root = brute_groups([(i, t) for i, t, *_ in rows if i is not None])
    done, out = set(), []
    for r in rows:
        if r[0] is None or (root[r[0]] == r[0] and r[0] not in done):
            done.add(r[0])
            out.append(r)
    return out


def plain_decontaminate(rows, items):
    code = lambda t: np.array([zlib.crc32(w) for w in decontam.words_of(t)], np.int64)
    return [r for r in rows if not any(len(code(i)) >= 8 and decontam.align(code(i), code(r[1]))[0] >= 0.5 for _, i in items)]


def plain_redact(rows):
    out = []
    for i, t, lang, s, n in rows:
        spans = sorted(x for r in secret_scan.RULES for x in secret_scan.verify(r, t or ""))
        merged = []
        for a, b in spans:
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        clean, at = "", 0
        for a, b in merged:
            clean, at = clean + (t[at:a] + "[SECRET]"), b
        clean = clean + (t or "")[at:]
        out.append((i, clean if t is not None else None, lang, s, len(clean)))
    return out


def fixture_rows():
    rng = np.random.default_rng(11)
    say = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 3000, n))
    items = [(k, say(30)) for k in range(3)]
    rows = [(i, f"{say(40)}\n{say(25)}\nAll rights   reserved by the host", "en", "h", 0) for i in range(30)]
    rows += [(100 + i, f"{say(8)}\nall rights reserved by the host\n" + "all rights reserved by the HOST\n" * 3, "en", "h", 0) for i in range(4)]  # depleted
    rows += [(200 + i, rows[3][1], "en", "h", 0) for i in range(30)]  # copies, with a line of the host's
    copy = say(80).split()
    for i in range(12):
        edit = copy.copy()
        edit[int(rng.integers(80))] = f"edit{i}"
        rows.append((300 + i, " ".join(edit), "en", "g", 0))
    leak = items[1][1].split()
    leak[4] = "changed"
    rows += [(400, f"{say(30)} {items[0][1]} {say(30)}", "en", "g", 0), (401, f"{say(20)} {' '.join(leak)}", "de", None, 0)]
    rows += [(500, f"{say(20)} password = 'abcdefghijkl99' {say(10)} AKIA{'Q' * 20} 0123456789abcdef01", "en", "g", 0)]
    rows += [(600, None, "en", "g", 0), (601, "", "en", "g", None), (602, "few words", "en", "g", 0), (603, "same words again and " * 30, "en", "g", 0), (None, say(30), None, None, None)]
    rows += [(700, say(9000), "en", "g", 0)]
    return [(i, t, lang, s, None if n is None else len(t or "")) for i, t, lang, s, n in rows], items


def test_run_is_the_plain_pipeline(spark, tmp_path):
    rows, items = fixture_rows()
    rows += [rows[0], rows[-1]]  # repeated rows
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = {}
    now = rows
    for (name, stage), plain in zip(corpus_pipeline.STAGES[:-1], (plain_quality, plain_dedup, lambda r: plain_decontaminate(r, items), plain_redact), strict=True):
        before = spark.createDataFrame(now, docs.schema)
        out = stage(spark, before, str(tmp_path))
        now = plain(now)
        assert out.columns == docs.columns
        got = Counter(map(tuple, out.collect()))
        assert got == Counter(now), (name, sorted(set(got) ^ set(now), key=str)[:3])
        want[name] = len(now)
    assert want["quality_rules"] < len(rows) - 5 and want["near_dedup"] < want["quality_rules"] - 30 and want["decontaminate"] == want["near_dedup"] - 2
    tok = packing.WordTokenizer(queries.tokenizer_path()).tok
    pieces = Counter()
    for i, t, *_ in now:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, packing.END_ID]
        for s in range(0, len(ids), 4096):
            part = ids[s : s + 4096]
            pieces[i, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)] += 1
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in packed) == pieces
    by = defaultdict(list)
    for r in packed:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        assert [o for o, _ in sorted(spans)] == np.cumsum([0, *(n for _, n in sorted(spans))])[:-1].tolist() and sum(n for _, n in spans) <= 4096


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stages_take_empty_tables(spark, sf, stage):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("__id", F.lit("x")).limit(0)
    assert stage(spark, docs, sf).count() == 0


def test_every_query_answers(spark, sf):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name, f in queries.QUERIES.items():
        rows = f(spark, sf).count()
        assert rows > 0, name
        if name.split("_")[0] in ("op1", "op2", "op4", "op5", "op8", "op9"):
            assert rows == n


def test_quality_rules_alike_with_and_without_a_broadcast(spark, sf):
    from tidemark.llm import line_quality

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sent, joined = (line_quality.apply(docs, broadcast_longs=n) for n in (1 << 40, 0))
    assert sorted(map(tuple, sent.collect())) == sorted(map(tuple, joined.collect()))
    assert "BroadcastHashJoin" in sent._jdf.queryExecution().executedPlan().toString()
