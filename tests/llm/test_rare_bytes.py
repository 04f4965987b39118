"""The share of characters that aren't ASCII is of the whole text."""

import pytest

from waymark.llm.classifier import FEATURES, features


@pytest.mark.parametrize(
    "text",
    [
        "plain words",
        "é",
        "word " * 400 + "日本語 " + "word " * 400,
        # Every 8th character, once where a stride of 8 begins and once beside it.
        "é bcdef " * 256,
        "a é bcd " * 256,
        "ab\U0001f600d efg" * 300,
    ],
)
def test_rare_bytes(text):
    assert features(text)[FEATURES.index("rare_bytes")] == pytest.approx(sum(ord(c) > 127 for c in text) / len(text), abs=1e-12)
