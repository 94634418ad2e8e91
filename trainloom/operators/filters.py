"""Filter expressions over a table of clusters, as Column expressions.

Grammar: `or` of `and` of `not` of comparisons `name op literal`; operators == = != < <= > >=, words and/or/not or
&& || !, parentheses, quoted strings, numbers. A comparison that cannot be made (unknown name, number against
text) is an error, kept as null: `false and error` is false and `true or error` true, any other use of an error
first is an error; a row whose filter errs stays visible. NaN compares false, except by !=. Text that is no
expression is searched for as a substring of the id, the label, tags and origin.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType, StructType

TOKEN = re.compile(r"""\s*(?:(?P<op>==|!=|<=|>=|&&|\|\||[<>=!()])|(?P<number>[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)|(?P<text>"[^"]*"|'[^']*')|(?P<word>[A-Za-z_][\w.]*))""")
COMPARE = ("==", "=", "!=", "<", "<=", ">", ">=")


@dataclass(frozen=True)
class Token:
    kind: str
    text: str


def tokenize(text: str) -> list[Token] | None:
    """Tokens, or None where a character fits none."""
    out, at = [], 0
    while at < len(text.rstrip()):
        m = TOKEN.match(text, at)
        if m is None:
            return None
        kind = m.lastgroup or ""
        word = m.group(kind)
        if kind == "word" and word.lower() in ("and", "or", "not"):
            kind, word = "op", {"and": "&&", "or": "||", "not": "!"}[word.lower()]
        out.append(Token(kind, word))
        at = m.end()
    return out


class Parser:
    """Recursive descent to nested tuples; raises ValueError where text is no expression."""

    def __init__(self, tokens: list[Token]):
        self.tokens, self.at = tokens, 0

    def peek(self) -> str:
        return self.tokens[self.at].text if self.at < len(self.tokens) and self.tokens[self.at].kind == "op" else ""

    def take(self) -> Token:
        if self.at >= len(self.tokens):
            raise ValueError("the expression ends too soon")
        self.at += 1
        return self.tokens[self.at - 1]

    def chain(self, op: str, below) -> tuple:
        parts = [below()]
        while self.peek() == op:
            self.take()
            parts.append(below())
        return parts[0] if len(parts) == 1 else (op, *parts)

    def either(self) -> tuple:
        return self.chain("||", lambda: self.chain("&&", self.negated))

    def negated(self) -> tuple:
        if self.peek() == "!":
            self.take()
            return ("!", self.negated())
        if self.peek() == "(":
            self.take()
            inside = self.either()
            if self.take().text != ")":
                raise ValueError("a parenthesis is open")
            return inside
        name, op, literal = self.take(), self.take(), self.take()
        if name.kind != "word" or op.text not in COMPARE or literal.kind not in ("number", "text", "word"):
            raise ValueError("no comparison")
        return ("cmp", name.text, op.text, float(literal.text) if literal.kind == "number" else literal.text.strip("\"'"))


def parse(text: str) -> tuple | None:
    """The expression's tree, or None if text is none."""
    tokens = tokenize(text)
    if not tokens:
        return None
    parser = Parser(tokens)
    try:
        tree = parser.either()
    except ValueError:
        return None
    return tree if parser.at == len(tokens) else None


def compare(x: Column, op: str, y: Column) -> Column:
    return {"==": x == y, "=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def evaluate(tree: tuple, schema: StructType) -> Column:
    """The tree as a boolean column; null is an error."""
    kind = tree[0]
    error = F.lit(None).cast("boolean")
    if kind == "!":
        return ~evaluate(tree[1], schema)
    if kind in ("&&", "||"):
        stops = kind == "||"
        step = lambda left, right: F.when(left.isNull(), error).when(left == F.lit(stops), F.lit(stops)).otherwise(right)
        parts = [evaluate(x, schema) for x in tree[1:]]
        return reduce(lambda a, b: step(a, b), parts)
    _, name, op, literal = tree
    field = next((f for f in schema.fields if f.name.lower() == name.lower()), None)
    if field is None:
        return error
    x = F.col(f"`{field.name}`")
    if isinstance(field.dataType, NumericType) and isinstance(literal, float):
        x = x.cast("double")
        return F.when(x.isNull() | F.isnan(x), F.lit(op == "!=")).otherwise(compare(x, op, F.lit(literal)))
    if isinstance(field.dataType, StringType) and isinstance(literal, str) and op in ("==", "=", "!="):
        return compare(F.lower(x), op, F.lit(literal.lower()))
    return error


def matches_text(text: str, schema: StructType, columns: tuple = ("cluster_id", "label", "tags", "origin")) -> Column:
    """Whether any of the columns that the table has contains the text."""
    found = [F.contains(F.lower(F.coalesce(F.col(f.name).cast("string"), F.lit(""))), F.lit(text.lower())) for f in schema.fields if f.name in columns]
    return reduce(lambda a, b: a | b, found, F.lit(False))


def visible(clusters: DataFrame, text: str) -> DataFrame:
    """The rows that the filter text shows."""
    if not text.strip():
        return clusters
    tree = parse(text)
    if tree is None:
        return clusters.where(matches_text(text.strip(), clusters.schema))
    return clusters.where(F.coalesce(evaluate(tree, clusters.schema), F.lit(True)))
