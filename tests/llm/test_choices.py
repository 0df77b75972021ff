"""Secrets of any length after a secret's name, and settings chosen in folds of the training rows."""

from __future__ import annotations

import numpy as np
import pytest

from probeframe.llm import secret_scan, toxicity

#: Lines labelled by hand, in forms that the made findings don't have: the candidate, and whether it is a secret.
LINES = [
    ('password = "hunter2secret!"', "hunter2secret!", 1), ('token = "abcdefghijklmnopqrstuvwx"', "abcdefghijklmnopqrstuvwx", 1), ("password: s3cr3tP@ssw0rdLongEnough!! and", "s3cr3tP@ssw0rdLongEnough!!", 1),
    ('{"api_key":"Qx7-pp2","n":1}', "Qx7-pp2", 1), ("go to url?token=ab12cd34ef&user=bob", "ab12cd34ef", 1), ("passwd=Winter2024! ok", "Winter2024!", 1), ("passphrase: kTzqRwpLmvXb", "kTzqRwpLmvXb", 1),
    ("credential = 'aZ9!kk#2mQ'", "aZ9!kk#2mQ", 1), ("access_key => 7hGd82Kls0", "7hGd82Kls0", 1), ("(DB_PASSWORD: Str0ng;Pa55)", "Str0ng", 1), ("$pwd := `x9$Lm2!q`", "x9$Lm2!q", 1), ("smtp_password_2='gr33n-Tea#44'", "gr33n-Tea#44", 1),
    ("the password: required for all", "required", 0), ("token = None", "None", 0), ("tokens: 128 of them", "128", 0), ("my secret: never give up", "never", 0), ("Password: bitte nicht weitergeben", "bitte", 0),
    ('password = os.environ["DB"]', "os.environ[", 0), ("api-key: optional", "optional", 0), ('password="correct"', "correct", 0), ("secret: internationalization", "internationalization", 0), ("passwords: Montag um acht", "Montag", 0),
]


@pytest.fixture(scope="module")
def model(spark):
    return secret_scan.fit(secret_scan.labelled_findings(spark))


def test_short_and_digitless_secrets(spark, model):
    docs = spark.createDataFrame([(i, f"some words\n{line}") for i, (line, _, _) in enumerate(LINES)], "doc_id int, text string")
    found = {r["doc_id"]: r for r in secret_scan.scan(docs, model).collect()}
    assert {i: r["finding"] for i, r in found.items()} == {i: f for i, (_, f, _) in enumerate(LINES)}
    flagged, secret = {i for i, r in found.items() if r["is_secret"]}, {i for i, x in enumerate(LINES) if x[2]}
    assert len(flagged & secret) >= 0.9 * len(flagged) and len(flagged & secret) >= 0.9 * len(secret), (flagged - secret, secret - flagged)


def test_values_and_their_places(spark, model):
    key = "9f8e7d6c5b4a39281706f5e4d3c2b1a0"
    texts = [
        f"pass password:pass,{key}", f'a token="{key}" b token = "{key}"', "token", "token =", "password: ''", "password=", "token : = :", None, "", "tokenizer: wordpiece secretary: Smith",
        "token_" * 20_000, "password " + "=" * 5_000, "pwd: " + ")" * 50_000 + "x", "secret=" + "a1!" * 50_000, "pwd: .)]",
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, finding string")
    rows = sorted((r["doc_id"], r["nth"], r["finding"]) for r in secret_scan.scan(docs, model).collect())
    by = {i: [f for d, _, f in rows if d == i] for i in range(len(texts))}
    assert by[0] == ["pass", key] and by[1] == [key, key]
    assert not any(by[i] for i in (2, 3, 4, 5, 7, 8, 9, 14)) and by[13] == ["a1!" * 50_000]
    assert len({r[:2] for r in rows}) == len(rows)
    assert secret_scan.scan(docs.limit(0), model).count() == 0


def test_cross_validation():
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("aeinrstlmo"), 6))
    rows = [(" ".join(word() for _ in range(30)) + (" wretchling dunderhead" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(240)]
    good = toxicity.cross_validate(rows, epochs=40)
    assert good["f1"] > 0.9 and good["recall"] > 0.9 and good["false_alarms"] < 0.05
    unlearnt = toxicity.cross_validate([(t, int(rng.integers(2))) for t, _ in rows], epochs=10)
    assert unlearnt["f1"] < 0.75 and unlearnt["log_loss"] > good["log_loss"]
    assert toxicity.cross_validate([]) == {"log_loss": 0.0, "recall": 0.0, "false_alarms": 0.0, "f1": 0.0}
    assert toxicity.cross_validate([("", 0), ("same", 1), ("same", 1)], epochs=2)["recall"] in (0.0, 1.0)
