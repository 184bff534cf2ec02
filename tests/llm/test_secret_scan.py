import random
import re

import pytest

from conftest import SMALL
from perilake.llm.secret_scan import ACCESS, ASSIGN, HEX, KINDS, RANDOM, mixed, scan_secrets

TEXTS = [
    None, "", "password: hunter2hunter2", "PassWord='abc'", "secret==abcdefgh", "secret=token=abcdefghij", "api_key : \"A1b2C3d4E5\"",
    "apikey=short", "AKIAABCDEFGHIJKL", "AKIAAKIAABCDEFGHIJ", "xAKIA123", "deadbeef" * 4, "deadbeef" * 3 + "x" + "0" * 40,
    "é token=ABCDEFGHIJ é " + "f" * 33, "ſecret=abcdefghij", "toKen=abcdefghij", "token=" + "ab12" * 20_000,
    "see ghp_8fK2Lq9ZxYwV7uT3sR1pNmBcD4 here", "plain words, nothing else. " * 30, "password=abcdefgh password=abcdefgi",
]


def brute(text):
    text, out = text or "", []
    for k, (pattern, ok) in enumerate(((ASSIGN, lambda m: len(m[2]) >= 8), (ACCESS, lambda m: len(m[0]) >= 16), (HEX, lambda m: len(m[0]) >= 32))):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if ok(m)]
    return [f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(out)]


def test_base_spans(spark):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r for r in scan_secrets(frame).collect()}
    for i, text in enumerate(TEXTS):
        want = brute(text)
        assert got[i].base_spans == ",".join(want), text
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(w.startswith(k + ":") for w in want) for k in KINDS[:3]]
        assert set(want) <= set(got[i].spans.split(",")) or not want
    assert got[15].n_assign == 0 and got[16 - 2].n_assign == 0  # look-alike letters are no letters of the keyword


@pytest.mark.parametrize("secret", ["ghp_8fK2Lq9ZxYwV7uT3sR1pNmBcD4", "sk-4f9Kd82lQmZx71PvWw0"])
def test_models_add_random_strings(spark, secret):
    prose = "the reader finds ordinary words like containerRuntimeOptions2 and some_long_identifier_name here. " * 400
    frame = spark.createDataFrame([(1, prose), (2, f"{prose} {secret} {prose}")], "doc_id long, text string")
    got = {r.doc_id: r for r in scan_secrets(frame, threshold=1.5).collect()}
    assert got[1].spans == ""
    assert got[2].spans == f"markov:{len(prose) + 1}:{len(prose) + 1 + len(secret)}"


def test_repeated_and_empty(spark):
    frame = spark.createDataFrame([(None, "token=abcdefgh1"), (3, None), (3, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.spans) for r in scan_secrets(frame).collect()) == [("3", ""), ("3", ""), ("None", "assign:0:15")]
    assert scan_secrets(frame.limit(0)).collect() == []


@pytest.mark.parametrize("secret", ["ghp_8fK2Lq9ZxYwV7uT3sR1pNmBcD4", "sk-4f9Kd82lQmZx71PvWw0"])
def test_production_threshold_finds_random_strings(spark, secret):
    prose = "the reader finds ordinary words like containerRuntimeOptions2 and some_long_identifier_name here. " * 400
    frame = spark.createDataFrame([(1, prose), (2, f"{prose} {secret} {prose}")], "doc_id long, text string")
    got = {r.doc_id: r for r in scan_secrets(frame).collect()}
    assert (got[1].spans, got[2].spans) == ("", f"markov:{len(prose) + 1}:{len(prose) + 1 + len(secret)}")


def test_production_threshold_by_kind(spark):
    rng = random.Random(5)
    real = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    n = 15
    planted = {-k: [] for k in range(1, len(RANDOM) + 1)}
    for k, (_, alphabet) in enumerate(RANDOM, 1):
        while len(planted[-k]) < n:
            token = "".join(rng.choices(alphabet, k=20))
            planted[-k] += [token] * mixed(token)
    frame = real.unionByName(spark.createDataFrame([(k, " and ".join(v)) for k, v in planted.items()], real.schema))
    got = {r.doc_id: r for r in scan_secrets(frame).collect()}
    assert all(got[k].n_markov >= 0.9 * n for k in planted), [(k, got[k].n_markov) for k in planted]
    assert not any(r.n_markov for k, r in got.items() if k not in planted)
