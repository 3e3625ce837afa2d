"""Literals that scripts assign to names, as JSON: a scanner that knows quotes, comments and nesting.

``register`` makes the table function ``script_literals(script)`` known to SQL; ``script_value`` is the same as a column.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?\*/)|(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`(?:[^`\\]|\\.)*`)|(?P<name>[A-Za-z_$][\w$]*)"""
    r"""|(?P<number>0[xX][0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<sign>.)""",
    re.DOTALL,
)
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(\r?\n)|(.))", re.DOTALL)
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}
_WORDS = {"true": "true", "false": "false", "null": "null", "undefined": "null", "NaN": "null", "Infinity": "null"}
_CLOSES = {"[": "]", "{": "}"}


def _text(token: str) -> str:
    """A quoted string as JSON."""
    def plain(m: re.Match) -> str:
        code, byte, line, other = m.groups()
        return chr(int(code or byte, 16)) if code or byte else "" if line else _PLAIN.get(other, other)

    return json.dumps(_ESCAPE.sub(plain, token[1:-1]), ensure_ascii=False)


def _number(token: str) -> str:
    return str(int(token, 16)) if token[:2] in ("0x", "0X") else json.dumps(float(token)) if re.search(r"[.eE]", token) else str(int(token))


def _literal(tokens: list[tuple[str, str]], at: int) -> tuple[str | None, int]:
    """The JSON of the array or object that begins at a token, and where it ends; None where it is no literal."""
    out, open_ = [], []
    while at < len(tokens):
        kind, token = tokens[at]
        after = tokens[at + 1][1] if at + 1 < len(tokens) else ""
        if token in _CLOSES and kind == "sign":
            open_.append(_CLOSES[token])
            out.append(token)
        elif kind == "sign" and token in "]}":
            if not open_ or open_.pop() != token:
                return None, at
            out.append(token)
            if not open_:
                return "".join(out), at + 1
        elif kind == "text":
            out.append(_text(token))
        elif after == ":" and open_ and open_[-1] == "}" and out[-1] in "{,":
            out.append(json.dumps(token))  # a key
        elif kind == "number":
            out.append(_number(token))
        elif kind == "name" and token in _WORDS:
            out.append(_WORDS[token])
        elif token in "-+" and kind == "sign" and at + 1 < len(tokens) and (tokens[at + 1][0] == "number" or after in _WORDS):
            out += ["-"] if token == "-" and tokens[at + 1][0] == "number" else []
        elif token == "," and after in ("]", "}"):
            pass
        elif token in ",:":
            out.append(token)
        else:
            return None, at
        at += 1
    return None, at


def literals(script: str | None) -> Iterator[tuple[str, str | None]]:
    """Each name that a script assigns an array or object to, in order, and its JSON; NULL where that is no plain literal."""
    tokens = [(m.lastgroup, m[0]) for m in _TOKEN.finditer(script or "") if m.lastgroup != "space"]
    at = 0
    while at + 2 < len(tokens):
        (kind, name), (_, equal), (_, opens) = tokens[at : at + 3]
        if kind == "name" and equal == "=" and opens in _CLOSES:
            value, end = _literal(tokens, at + 2)
            if value is not None:
                try:
                    json.loads(value)
                except ValueError:
                    value = None
            yield name, value
            at = max(end, at + 3)
        else:
            at += 1


class ScriptLiterals:
    """The table function: name, value (JSON) of a script's literals."""

    def eval(self, script: str) -> Iterator[tuple[str, str | None]]:
        yield from literals(script)


def register(spark: SparkSession) -> None:
    spark.udtf.register("script_literals", F.udtf(ScriptLiterals, returnType="name string, value string"))


def script_value(script: Column, name: str) -> Column:
    """The JSON text of the first literal that the script assigns to ``name``; NULL without one."""

    @F.pandas_udf("string")
    def value(scripts: pd.Series) -> pd.Series:
        return pd.Series([next((v for n, v in literals(s) if n == name), None) for s in scripts], dtype=object)

    return value(script)
