"""Phrases, the signatures that an index looks addresses up by: pairs of tokens, of sounds and of trigrams.

All take an array of tokens and give an array of phrases, copies kept.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Positions in a token at which trigrams begin.
POSITIONS = 7


def _none() -> Column:
    return F.array().cast("array<string>")


def _once(array: Column, make) -> Column:
    """``make(array)`` with the array computed once, not anew for each of its elements."""
    return F.get(F.transform(F.array(array), make), F.lit(0))


def _pairs(tokens: Column, step: int, where=None) -> Column:
    """``t[i] t[i + step]`` for every i that has both."""
    spaced = lambda i: F.concat(F.get(tokens, i), F.lit(" "), F.get(tokens, i + step))
    at = F.sequence(F.lit(0), F.size(tokens) - (step + 1))
    if where is not None:
        at = F.filter(at, lambda i: where(F.get(tokens, i)))
    return F.when(F.size(tokens) > step, F.transform(at, spaced)).otherwise(_none())


def _is_integer(token: Column) -> Column:
    return token.try_cast("int").isNotNull()


def bigrams(tokens: Column) -> Column:
    """Neighbouring tokens."""
    return _once(tokens, lambda t: _pairs(t, 1))


def standard(tokens: Column) -> Column:
    """Neighbouring tokens, and an integer with the token after the next."""
    return _once(tokens, lambda t: F.concat(_pairs(t, 1), _pairs(t, 2, _is_integer)))


def skips(tokens: Column) -> Column:
    """Each token with the one after the next."""
    return _once(tokens, lambda t: _pairs(t, 2))


def sounds(tokens: Column) -> Column:
    """Standard phrases of the tokens' soundex codes; integers are told by the tokens themselves."""
    return _once(tokens, lambda t: _once(F.transform(t, F.soundex), lambda code: _sounds(t, code)))


def _sounds(tokens: Column, code: Column) -> Column:
    pair = lambda step: lambda i: F.concat(F.get(code, i), F.lit(" "), F.get(code, i + step))
    near = F.when(F.size(tokens) > 1, F.transform(F.sequence(F.lit(0), F.size(tokens) - 2), pair(1))).otherwise(_none())
    skip = F.filter(F.sequence(F.lit(0), F.size(tokens) - 3), lambda i: _is_integer(F.get(tokens, i)))
    return F.concat(near, F.when(F.size(tokens) > 2, F.transform(skip, pair(2))).otherwise(_none()))


def _grams(token: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(POSITIONS)), lambda p: F.substr(token, p, F.lit(3)))


def _crossed(a: Column, b: Column) -> Column:
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.concat(x, F.lit(" "), y))))


def trigrams_of_phrase(phrase: Column) -> Column:
    """On the index side: trigrams of both words of a phrase, together of 5 characters at least."""
    crossed = lambda words: _once(_grams(F.get(words, F.lit(1))), lambda b: _crossed(_grams(F.get(words, F.lit(0))), b))
    return F.filter(_once(F.split(phrase, " "), crossed), lambda g: F.length(g) >= 5)


def trigrams_of_input(tokens: Column) -> Column:
    """On the input side: trigrams of two bytes at least of neighbouring tokens."""

    def both(own: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.size(own) - 2), lambda i: _crossed(F.get(own, i), F.get(own, i + 1)))
        return F.when(F.size(own) > 1, F.flatten(pairs)).otherwise(_none())

    return _once(F.transform(tokens, lambda t: F.filter(_grams(t), lambda g: F.octet_length(g) >= 2)), both)


def md5_prefix(phrase: Column, digits: int = 5) -> Column:
    """A short text key of a phrase."""
    return F.substring(F.md5(phrase), 1, digits)


def integer_key(phrase: Column) -> Column:
    """An integer key of a phrase, from its md5; different phrases may share one."""
    return F.conv(F.substring(F.md5(phrase), 1, 7), 16, 10).cast("int")
