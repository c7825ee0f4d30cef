"""The quick look before the chain of transducers may leave out no text that the chain changes."""

import random

import pytest

from spanforge.llm import pii

PIECES = [
    *"@.-_+ \t\n[](){}<>,:0123456789OoIl|", " ", " ", "at", "AT", "arroba", "dot", "Dot", "punkt", "point", "plus", "Plus", "one", "ONE", "zéro", "fünf", "six", "ſeven", "fıve",
    "john", "doe", "example", "com", "example.com", "me.org", "john.doe", "é", "4111 1111 1111 111", "+49 170 123456", "192.168.0.1", "@ ", " at ", "(at)", "[ . ]", "<.>", "—", "“",
]


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("write to john.doe at example.com today", "email", "john.doe at example.com"),
        ("card 4111 1111 1111 111 one", "card", "4111 1111 1111 111 one"),
        ("john@example[ . ]com", "email", "john@example[ . ]com"),
        ("john@example<.>com", "email", "john@example<.>com"),
        ("call plus\t49 170 1234567", "phone", "plus\t49 170 1234567"),
        ("john@\nexample.com", "email", "john@\nexample.com"),
    ],
)
def test_disguises_without_another_cue(text, kind, found):
    assert (kind, found) in [(k, text[a:b]) for k, a, b, _ in pii.find(text)]


def test_the_filter_changes_nothing(monkeypatch):
    rng = random.Random(8)
    texts = ["".join(rng.choice(PIECES) + rng.choice(["", "", " "]) for _ in range(rng.randint(1, 12))) for _ in range(40000)]
    quick = [pii.find(t) for t in texts]
    passed = [pii.suspicious(t) for t in texts]
    assert 0.05 < sum(passed) / len(passed) < 0.95
    monkeypatch.setattr(pii, "suspicious", lambda text: True)
    assert [pii.find(t) for t in texts] == quick
    for t in (t for t, s in zip(texts, passed, strict=True) if not s):
        m = pii.Mapped(t)
        for step in pii.TRANSDUCERS:
            step(m)
        assert m.text == t
