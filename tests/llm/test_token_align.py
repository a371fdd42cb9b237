"""Token alignment against a brute-force version, texts with awkward characters included."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm import queries, token_align

RANKS, PIECES = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")
BITS = ["a", "  ", "\n", " ", "\t", "é", "▁", "<0x41>", "<s>", "</s>", "<|endoftext|>", "日本", "😀", "'s", "12", "foo", " bar", "\r\n", "\0", "…", "́", "x" * 50, "Ა", " ", "ﬁ"]
LONG = " ".join(f"w{i % 977} x{i % 31}" for i in range(500))


@pytest.fixture(scope="module")
def tok():
    return token_align.Tokenizers(RANKS, PIECES)


@pytest.fixture(scope="module")
def whole():
    """Both encoders over whole texts, A from the vocabulary's other file."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    chars = sorted([*range(33, 127), *range(0xA1, 0xAD), *range(0xAE, 0x100)])
    byte = {chr(c): c for c in chars} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in chars)}
    table_a = {i: bytes(byte[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items() if all(c in byte for c in t)}

    def encode(text):
        if not text:
            return [], []
        ids_a, ids_b = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
        bytes_a = [table_a[i] for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        same = b"".join(bytes_a) == b"".join(bytes_b) == f" {text}".encode()
        return (list(zip(ids_a, map(len, bytes_a), strict=True)), list(zip(ids_b, map(len, bytes_b), strict=True))) if same else ([], [])

    return encode


def brute(encode, texts):
    """The contract's columns, by comparing all tokens of a group."""
    held, parts = Counter(), []
    for text in texts:
        spans = []
        for side in encode(text):
            ends = np.cumsum([n for _, n in side]).tolist()
            spans.append([(i, e - n, e) for (i, n), e in zip(side, ends, strict=True)])
        a, b = spans
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, links, last = [], [], 0
        for cut in cuts:
            ga, gb = ([t for t in side if last <= t[1] < cut] for side in (a, b))
            groups.append(",".join(str(t[0]) for t in ga) + "|" + ",".join(str(t[0]) for t in gb))
            links += [(x[0], y[0]) for x in ga for y in gb if x[1] < y[2] and y[1] < x[2]]
            last = cut
        held.update(set(links))
        parts.append((len(a), len(b), groups, links))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    for n_a, n_b, groups, links in parts:
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        yield n_a, n_b, len(groups), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), sha


def awkward():
    rng = random.Random(7)
    texts = [None, "", " ", "\n", "one", "one two", "x" * 3000, " " * 3000, "Ა" * 300 + " " * 500 + "Ა", LONG]
    texts += ["".join(rng.choices(BITS, k=rng.randint(1, 25))) for _ in range(150)]
    return [*texts, "one two", "one two", texts[20]]


def test_alignment_is_that_of_all_token_pairs(spark, whole, monkeypatch):
    texts = awkward()
    monkeypatch.setattr(token_align, "STEP_CHARS", 300)
    rows = [(i if i != 5 else None, t, "a", [1]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string, pair array<int>").repartition(3)
    out = token_align.align(docs, RANKS, PIECES)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = Counter((i if i != 5 else None, *row) for i, row in enumerate(brute(whole, texts)))
    assert Counter(map(tuple, out.collect())) == want
    assert sum(not t[1] for t in want) < len(texts) / 2


def test_several_blocks_share_their_counts(tok, spark, whole, monkeypatch):
    texts = awkward()[:60]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(token_align, "BLOCK_PAIRS", 50)
    monkeypatch.setattr(token_align, "STEP_CHARS", 20)
    assert token_align._blocks(docs, "doc_id", "text", RANKS, PIECES).count() >= 1
    assert Counter(map(tuple, token_align.align(docs, RANKS, PIECES).collect())) == Counter((i, *row) for i, row in enumerate(brute(whole, texts)))


def test_words_are_encoded_as_in_whole_texts(tok, whole):
    """Every settled character beside letters, digits, signs and spaces, with the vocabulary's other file as witness."""
    settled = [c for c in map(chr, range(0xD800)) if token_align._SETTLED(c)]
    for start in range(0, len(settled), 400):
        texts = [f"a{c}a 1{c}1 !{c}!  {c} {c}{c}'s" for c in settled[start : start + 400 : 3]]
        got_a, got_b = tok.encode(texts)
        for text, a, b in zip(texts, got_a, got_b, strict=True):
            want_a, want_b = whole(text)
            assert (a.tolist(), b.tolist()) == ([i for i, _ in want_a], [i for i, _ in want_b]), text


def test_groups_break_where_both_sides_end():
    # A: 3 2 1, B: 1 2 1 2 -> [3|1 2] [2 1|1 2]
    found = token_align.coalesce(np.array([3, 2, 1]), np.array([1, 2, 1, 2]))
    assert found.group.tolist() == [0, 0, 0, 1, 1, 1, 1]
    assert list(zip(found.link_a.tolist(), found.link_b.tolist(), strict=True)) == [(0, 0), (0, 1), (1, 2), (1, 3), (2, 3)]


def test_empty_table_and_text_ids(spark):
    docs = spark.createDataFrame([("k", "one two")], "doc_id string, text string")
    assert token_align.align(docs.limit(0), RANKS, PIECES).count() == 0
    assert token_align.align(docs, RANKS, PIECES).first().doc_id == "k"


def test_query_covers_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = queries.op11_token_alignment(spark, sf)
    assert out.count() == docs.count()
    assert out.where("n_links <> n_a + n_b - n_groups").count() == 0
