"""Expressions of the query language as Spark columns."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from graphloom.plans import syntax as S
from graphloom.plans.errors import GqlError


@dataclass
class NodeBinding:
    id: str
    labels: str | None = None
    props: dict[str, str] = field(default_factory=dict)


@dataclass
class EdgeBinding:
    id: str
    type: str
    src: str
    dst: str
    props: dict[str, str] = field(default_factory=dict)


@dataclass
class PathBinding:
    parts: list[NodeBinding | EdgeBinding]


@dataclass
class ValueBinding:
    column: str


@dataclass
class LetBinding:
    expression: object


class Scope(dict):
    """Visible names."""

    def find(self, name: str):
        if name not in self:
            raise GqlError(f"GQL binding variable '{name}' is not defined")
        return self[name]


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def has_labels(b: NodeBinding | EdgeBinding, labels: tuple[str, ...]) -> Column:
    """Whether the element has all labels; false if it is absent."""
    out = F.lit(True)
    for x in labels:
        if isinstance(b, EdgeBinding):
            test = quoted(b.type) == x
        elif b.labels is None:
            raise GqlError("GQL labels of this element are not available")
        else:
            test = F.array_contains(quoted(b.labels), x)
        out = out & F.coalesce(test, F.lit(False))
    return out


def node_value(b: NodeBinding) -> Column:
    fields = [quoted(b.id).alias("vertex_id"), F.concat_ws(";", quoted(b.labels)).alias("__gql_labels")]
    fields += [quoted(b.props[p]).alias(p) for p in sorted(b.props)]
    return F.when(quoted(b.id).isNotNull(), F.struct(*fields))


def edge_value(b: EdgeBinding) -> Column:
    fields = [quoted(b.id).alias("edge_id"), quoted(b.type).alias("__gql_type"), quoted(b.src).alias("__gql_source"), quoted(b.dst).alias("__gql_target")]
    fields += [quoted(b.props[p]).alias(p) for p in sorted(b.props)]
    return F.when(quoted(b.id).isNotNull(), F.struct(*fields))


def path_value(b: PathBinding) -> Column:
    nodes, edges = b.parts[::2], b.parts[1::2]
    there = F.lit(True)
    for x in b.parts:
        there = there & quoted(x.id).isNotNull()
    listed = F.array(*[edge_value(x) for x in edges]) if edges else F.array().cast("array<string>")
    return F.when(there, F.struct(F.array(*[node_value(x) for x in nodes]).alias("nodes"), listed.alias("edges")))


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFC")


def _divide(a: Column, b: Column) -> Column:
    x, y = a.cast("double"), b.cast("double")
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    return F.when(y != 0, x / F.when(y != 0, y)).otherwise(F.when(y.isNull() | x.isNull(), F.lit(None)).when(x > 0, inf).when(x < 0, -inf).otherwise(nan))


def _head(s: Column, n: Column) -> Column:
    n = n.cast("int")
    return F.when(n >= 0, F.left(s, n)).otherwise(F.left(s, F.greatest(F.char_length(s) + n, F.lit(0))))


def _tail(s: Column, n: Column) -> Column:
    n = n.cast("int")
    return F.when(n >= 0, F.right(s, n)).otherwise(F.right(s, F.greatest(F.char_length(s) + n, F.lit(0))))


_SCALAR = {
    "upper": (1, F.upper), "lower": (1, F.lower), "left": (2, _head), "right": (2, _tail), "char_length": (1, F.char_length), "abs": (1, F.abs),
    "ceil": (1, lambda x: F.ceil(x).cast("double")), "floor": (1, lambda x: F.floor(x).cast("double")), "sqrt": (1, F.sqrt),
    "mod": (2, lambda a, b: F.when(b != 0, a % F.when(b != 0, b))),
}
_TRIM = {"trim": F.btrim, "ltrim": F.ltrim, "rtrim": F.rtrim}
_AGGREGATE = {"sum": (F.sum, F.sum_distinct), "avg": (F.avg, lambda c: F.expr("1")), "min": (F.min, F.min), "max": (F.max, F.max)}


def resolve(e, scope: Scope):
    """The expression with names that LET gave replaced, and record fields and list items taken."""
    if isinstance(e, S.Var) and isinstance(scope.get(e.name), LetBinding):
        return resolve(scope[e.name].expression, scope)
    if isinstance(e, S.Prop):
        base = resolve(e.base, scope)
        if isinstance(base, S.Record):
            own = dict(base.items)
            return resolve(own[e.name], scope) if e.name in own else S.Lit(None)
        return S.Prop(base, e.name)
    if isinstance(e, S.Bin):
        return S.Bin(e.op, resolve(e.left, scope), resolve(e.right, scope))
    if isinstance(e, S.Un):
        return S.Un(e.op, resolve(e.arg, scope))
    if isinstance(e, S.IsNull):
        return S.IsNull(resolve(e.arg, scope), e.negated)
    if isinstance(e, S.Labeled):
        return S.Labeled(resolve(e.arg, scope), e.labels, e.negated)
    if isinstance(e, S.Call):
        return S.Call(e.name, tuple(resolve(x, scope) for x in e.args), e.distinct, e.star)
    if isinstance(e, S.Record):
        return S.Record(tuple((k, resolve(v, scope)) for k, v in e.items))
    if isinstance(e, S.ListOf):
        return S.ListOf(tuple(resolve(x, scope) for x in e.items))
    return e


def variables(e, scope: Scope) -> set[str]:
    """Names of the scope or not that the expression reads, LET names followed."""
    return {x.name for x in S.walk(resolve(e, scope)) if isinstance(x, S.Var)}


def column(e, scope: Scope, aggregates: bool = False) -> Column:
    """The Spark column of an expression; aggregates only where they may stand."""
    return _column(resolve(e, scope), scope, aggregates)


def element(e, scope: Scope, what: str):
    if not isinstance(e, S.Var) or not isinstance(b := scope.find(e.name), (NodeBinding, EdgeBinding)):
        raise GqlError(f"GQL {what} needs a node or edge variable")
    return b


def _column(e, scope: Scope, agg: bool) -> Column:
    go = lambda x: _column(x, scope, agg)
    if isinstance(e, S.Lit):
        return F.lit(e.value)
    if isinstance(e, S.Var):
        b = scope.find(e.name)
        if isinstance(b, ValueBinding):
            return quoted(b.column)
        return node_value(b) if isinstance(b, NodeBinding) else edge_value(b) if isinstance(b, EdgeBinding) else path_value(b)
    if isinstance(e, S.Prop):
        if not isinstance(e.base, S.Var):
            raise GqlError("GQL property reference needs a variable")
        b = scope.find(e.base.name)
        if not isinstance(b, (NodeBinding, EdgeBinding)):
            raise GqlError(f"GQL variable '{e.base.name}' has no properties")
        return quoted(b.props[e.name]) if e.name in b.props else F.lit(None)
    if isinstance(e, S.IsNull):
        b = scope.find(e.arg.name) if isinstance(e.arg, S.Var) else None
        c = quoted(b.id) if isinstance(b, (NodeBinding, EdgeBinding)) else go(e.arg)
        return c.isNotNull() if e.negated else c.isNull()
    if isinstance(e, S.Labeled):
        test = has_labels(element(e.arg, scope, "label test"), e.labels)
        return ~test if e.negated else test
    if isinstance(e, S.Un):
        x = go(e.arg)
        return ~x.cast("boolean") if e.op == "not" else -x if e.op == "-" else x
    if isinstance(e, S.Bin):
        return _binary(e, scope, go)
    if isinstance(e, S.Call):
        return _call(e, scope, agg, go)
    raise GqlError("GQL list and record values are only supported in LET, SET and DELETE")


def _binary(e: S.Bin, scope: Scope, go) -> Column:
    for x in (e.left, e.right):
        if isinstance(x, S.Var) and not isinstance(scope.find(x.name), ValueBinding):
            raise GqlError("GQL operators need scalar values")
    a, b = go(e.left), go(e.right)
    if e.op == "and":
        return a.cast("boolean") & b.cast("boolean")
    if e.op == "or":
        return a.cast("boolean") | b.cast("boolean")
    if e.op == "xor":
        return a.cast("boolean") != b.cast("boolean")
    if e.op == "||":
        return F.concat(a.cast("string"), b.cast("string"))
    if e.op == "/":
        return _divide(a, b)
    return {"+": a + b, "-": a - b, "*": a * b, "=": a == b, "<>": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[e.op]


def _call(e: S.Call, scope: Scope, agg: bool, go) -> Column:
    if e.name in S.AGGREGATES:
        if not agg:
            raise GqlError("GQL aggregate functions are not allowed here")
        if any(S.has_aggregate(x) for x in e.args):
            raise GqlError("GQL aggregate functions cannot be nested")
        if e.star:
            return F.count(F.lit(1))
        x = e.args[0]
        b = scope.find(x.name) if isinstance(x, S.Var) else None
        c = quoted(b.id) if isinstance(b, (NodeBinding, EdgeBinding)) else _column(x, scope, False)
        if e.name == "count":
            return F.count_distinct(c) if e.distinct else F.count(c)
        if isinstance(b, (NodeBinding, EdgeBinding)):
            raise GqlError(f"GQL {e.name.upper()} needs scalar values")
        if e.name == "avg" and e.distinct:
            return F.sum_distinct(c) / F.count_distinct(c)
        return _AGGREGATE[e.name][e.distinct](c)
    if e.name == "element_id":
        if len(e.args) != 1:
            raise GqlError("GQL ELEMENT_ID takes one argument")
        return quoted(element(e.args[0], scope, "ELEMENT_ID").id)
    args = [go(x) for x in e.args]
    if e.name == "coalesce":
        return F.coalesce(*args)
    if e.name == "normalize":
        return _nfc(args[0].cast("string"))
    if e.name in _TRIM:
        return _TRIM[e.name](args[0].cast("string"), args[1] if len(args) > 1 else F.lit(" "))
    n, f = _SCALAR[e.name]
    if len(args) != n:
        raise GqlError(f"GQL {e.name.upper()} takes {n} arguments")
    return f(*args)


def names_of(e) -> Iterator[str]:
    for x in S.walk(e):
        if isinstance(x, S.Var):
            yield x.name
