"""Grammars of the six checked languages: ``verdicts(text)`` is what each of them says about a text.

A grammar says True (accepts), False (refuses) or None (nested too deep for its parser). The recognisers of our own and
the TOML parser are run again with ``DEPTH`` frames where the usual recursion does not suffice, JSON with a stack of its
own, so only nesting of tens of thousands of levels is left undecided. Python is what CPython's parser takes: its own
limits (200 open brackets, 100 indentations, its stack) are refusals or, where the stack overflows, None.
"""

from __future__ import annotations

import _symtable
import ast
import json
import re
import sys
import tomllib
import warnings
from collections.abc import Callable

from .ecma import check_ecma
from .golang import check_go

#: Path ending -> language; the order breaks ties of the ranking.
ENDINGS = {".py": "python", ".js": "javascript", ".ts": "typescript", ".go": "go", ".json": "json", ".toml": "toml"}
#: Frames a parser may use on one text (Python calls only, so they lie on the heap).
DEPTH = 1_000_000


def _constant(name: str):
    raise ValueError(name)


def _python(text: str) -> bool:
    text = text.removeprefix("\ufeff")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            # Parses without making Python objects of the tree.
            _symtable.symtable(text, "file", "exec")
        except RecursionError:
            # The parser's own overflow is a MemoryError; this one comes after it, from the passes over the tree.
            return True
        except (SyntaxError, ValueError):
            # Of scopes, perhaps: only the grammar counts.
            try:
                ast.parse(text)
            except RecursionError:
                return True
    return True


_JSON = re.compile(r"""[ \t\n\r]*(?:([\[\]{},:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null))""")


def _deep_json(text: str) -> bool:
    """JSON with a stack of its own; ``want`` says what may come next."""
    stack: list[str] = []
    want, at = "value", 0
    text = text.rstrip(" \t\n\r")
    while at < len(text):
        m = _JSON.match(text, at)
        if m is None:
            return False
        at = m.end()
        sign, atom = m[1], m[2]
        if atom is not None:
            if want in ("key", "first key") and atom[0] == '"':
                want = "colon"
                continue
            if want not in ("value", "first"):
                return False
        elif sign in "[{":
            if want not in ("value", "first"):
                return False
            stack.append(sign)
            want = "first" if sign == "[" else "first key"
            continue
        elif sign == ":":
            if want != "colon":
                return False
            want = "value"
            continue
        elif sign == ",":
            if want != "next" or not stack:
                return False
            want = "value" if stack[-1] == "[" else "key"
            continue
        elif not stack or want not in ("next", "first" if sign == "]" else "first key") or (stack.pop() == "[") != (sign == "]"):
            return False
        want = "next"
    return want == "next" and not stack


def _json(text: str) -> bool:
    try:
        json.loads(text, parse_constant=_constant, parse_int=str)
    except RecursionError:
        return _deep_json(text)
    return True


def _toml(text: str) -> bool:
    tomllib.loads(text)
    return True


def _settle(check: Callable[[str], object], text: str, refused: object) -> object:
    """What the check returns, ``refused`` where it refuses, None where the text is too deep for it."""
    for depth in (None, DEPTH):
        usual = sys.getrecursionlimit()
        try:
            if depth:
                sys.setrecursionlimit(depth)
            return check(text)
        except (RecursionError, MemoryError):
            continue
        except (SyntaxError, ValueError):
            return refused
        finally:
            sys.setrecursionlimit(usual)
    return None


_CHECK = {"python": _python, "go": check_go, "json": _json, "toml": _toml}


def accepts(language: str, text: str) -> bool | None:
    """Does the grammar take the text? None: too deep to tell."""
    if language in _CHECK:
        return _settle(_CHECK[language], text, False)
    both = _settle(check_ecma, text, (False, False))
    return None if both is None else both[language == "typescript"]


def verdicts(text: str) -> dict[str, bool | None]:
    """language -> what its grammar says; both ECMAScript grammars share their tokens."""
    js, ts = _settle(check_ecma, text, (False, False)) or (None, None)
    return {k: js if k == "javascript" else ts if k == "typescript" else _settle(_CHECK[k], text, False) for k in ENDINGS.values()}
