"""Cleaning of nested values: few searches per value, the same text as the column rule."""

import json

import pytest

from shelfwise.functions import arrays as ar


def test_nested_cleaning_takes_few_searches(monkeypatch):
    made = {"n": 0}

    class Counted:
        def sub(self, by, text):
            made["n"] += 1
            return text
    for name in ("_TAG", "_SPACES", "_NOT_ALLOWED", "_SPACES_ASCII", "_NOT_ALLOWED_ASCII"):
        monkeypatch.setattr(ar, name, Counted())
    assert ar._clean_nested(json.loads('{"a b":["c-d","1.5",{"e":"0"}],"f":7}')) == {"a b": ["c-d", "1.5"], "f": "7"} and not made["n"]
    assert ar._clean("a *") == "a *" and made["n"] == 3


@pytest.mark.parametrize("text, want", [("  a <b>x</b> * ", "a x "), ("é  ö #", "é ö "), ("\x1c a", " a"), ("0", None), ("<p></p>", None), ("a  b", "a b"), ("a\u00850", "a 0")])
def test_cleaned_scalars_equal_the_columns_rule(text, want):
    assert ar._clean(text) == want
