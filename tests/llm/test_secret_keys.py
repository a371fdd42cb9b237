"""Private keys go with their body."""

import time

import pytest

from tidemark.llm import secret_scan

BODY = "\n".join("MIIEv" + c * 59 for c in "AbC+/9") + "\nQUJD=="


@pytest.mark.parametrize(
    "key,rest",
    [
        (f"-----BEGIN RSA PRIVATE KEY-----\n{BODY}\n-----END RSA PRIVATE KEY-----", "\nplain words follow"),
        (f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FF\n\n{BODY}\n-----END RSA PRIVATE KEY-----", " and more"),
        ("-----BEGIN PRIVATE KEY-----\\n" + BODY.replace("\n", "\\n") + "\\n-----END PRIVATE KEY-----", '\\n"}'),
        (f"-----BEGIN EC PRIVATE KEY-----\r\n{BODY}", "\nplain words follow"),
        (f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n\n{BODY}", ""),
        ("-----BEGIN PRIVATE KEY-----", " is how a key starts"),
    ],
)
def test_redact_removes_the_body(spark, key, rest):
    df = spark.createDataFrame([(1, f"before {key}{rest}")], "doc_id long, text string")
    assert secret_scan.redact(df).first().text == f"before [SECRET]{rest}"


def test_two_keys_are_two_spans():
    key = f"-----BEGIN PRIVATE KEY-----\n{BODY}\n-----END PRIVATE KEY-----"
    spans = [s for s in secret_scan.scan_shard([f"{key}\nbetween\n{key}"])[0] if s["kind"] == "private_key"]
    assert [(s["start"], s["end"]) for s in spans] == [(0, len(key)), (len(key) + 9, 2 * len(key) + 9)]


def test_odd_texts_take_linear_time():
    began = time.monotonic()
    for text in ("-----BEGIN PRIVATE KEY-----" * 20_000, "-----BEGIN PRIVATE KEY-----" + "- " * 300_000, "-----BEGIN PRIVATE KEY-----" + "A \n" * 200_000):
        secret_scan.scan_shard([text])
    assert time.monotonic() - began < 20
