"""Read-only SQL over the ledger's tables, with head, price and name parameters.

Spark's parser makes a tree of a query, and nothing here looks at the text but at places that the tree names. The tree tells
which relations and functions a query has, which parameters it needs, and where in the text sums, products and names stand; these are
written anew in terms of built-in functions, and Spark analyses the result."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import Any, NamedTuple

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import u256 as u
from ledgerloom.operators.coverage import head

#: Functions of the SQL surface that take integers or bytes of any width.
FUNCTIONS = {"u256_product": u.u256_mul, "u256_add": u.add_any, "u256_to_dec": u.dec_any, "u256": u.u256, "format_ether": u.ether_any, "format_gwei": u.gwei_any, "erc20_to_real": u.real_any, "convert_usd": u.usd_any}
#: Functions that are written anew before the query runs.
REWRITTEN = ("u256_sum", "u256_mul", "format_usd", "wei_to_eth", "resolve")
#: Built-in functions that reach beyond the query's rows.
REFUSED = frozenset("reflect java_method try_reflect input_file_name input_file_block_start input_file_block_length current_user user session_user current_catalog current_database current_schema version".split())
#: What a parsed query may consist of; expressions other than these two kinds may be anything.
PLANS = frozenset(
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Distinct Union Intersect Except Join SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedWith UnresolvedHaving"
    " UnresolvedRelation OneRowRelation WithWindowDefinition UnresolvedInlineTable LocalRelation Generate LateralJoin UnresolvedHint Pivot Unpivot".split()
)
REFUSED_EXPRESSIONS = frozenset("ExpressionWithUnresolvedIdentifier PlanWithUnresolvedIdentifier CallMethodViaReflection TryReflect CurrentUser InputFileName InputFileBlockStart InputFileBlockLength".split())
#: Levels that a recursive query may ask for; without asking, Spark ends it after 100.
MAX_LEVELS = 1000


class QueryError(ValueError):
    """A query that isn't allowed or whose parameters can't be filled in."""


class Node(NamedTuple):
    """A node of the parsed tree, the one that it stands in, its class and whether it is a plan."""

    tree: Any
    above: Any
    kind: str
    plan: bool


class Trees:
    """Walks over trees of the JVM."""

    def __init__(self, spark: SparkSession):
        jvm = spark.sparkContext._jvm
        load = lambda name: jvm.java.lang.Class.forName(name, False, jvm.Thread.currentThread().getContextClassLoader())
        self.parser = spark._jsparkSession.sessionState().sqlParser()
        self.tree = load("org.apache.spark.sql.catalyst.trees.TreeNode")
        self.plan = load("org.apache.spark.sql.catalyst.plans.logical.LogicalPlan")

    def parse(self, sql: str) -> Any:
        return self.parser.parsePlan(sql)

    def inside(self, value: Any) -> Iterator[Any]:
        """The nodes in a constructor's argument: itself, or those of a sequence, map, option or tuple."""
        if not isinstance(value, JavaObject):
            return
        name = value.getClass().getName()
        if self.tree.isInstance(value):
            yield value
        elif name == "scala.Some":
            yield from self.inside(value.get())
        elif name.startswith("scala.Tuple"):
            for i in range(value.productArity()):
                yield from self.inside(value.productElement(i))
        elif name.startswith("scala.collection."):
            items = value.toSeq()
            for i in range(items.size()):
                yield from self.inside(items.apply(i))

    def walk(self, tree: Any, above: Any = None) -> Iterator[Node]:
        """A tree's nodes: plans, their expressions, and what subqueries, common tables and named windows hold."""
        plan = self.plan.isInstance(tree)
        kind = tree.getClass().getSimpleName().rstrip("$")
        yield Node(tree, above, kind, plan)
        if kind != "LocalRelation":  # literal rows
            for i in range(tree.productArity()):
                for x in self.inside(tree.productElement(i)):
                    yield from self.walk(x, tree)


def _list(seq: Any) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _span(tree: Any) -> tuple[int, int]:
    """Where in the text a node stands."""
    origin = tree.origin()
    return origin.startIndex().get(), origin.stopIndex().get() + 1


# --- sums and products in terms of built-in functions ---

_BASE = 1 << 72


def whole_sql(parts: list[str]) -> str:
    """Longs that stand 24 bits apart, the lowest first, as 32 bytes; no function of functions is in it, so it may stand in ORDER BY as well."""
    parts = parts + ["0L"] * (12 - len(parts))
    three = [" + ".join(f"CAST({p} AS DECIMAL(19,0)) * {1 << 24 * i}BD" for i, p in enumerate(parts[k : k + 3]) if p != "0L") or "0BD" for k in range(0, 12, 3)]
    digits, carry = [], ""
    for k, d in enumerate(three):
        t = f"({d}{carry})"
        if k == 3:  # 256 - 3 * 72 bits
            over = "CAST(raise_error('u256_sum exceeds 256 bits') AS STRING)"
            digits.append(f"IF({t} >= {1 << 40}BD, {over}, lpad(hex(CAST({t} AS BIGINT)), 10, '0'))")
        else:
            low = f"({t} % {_BASE}BD)"
            digits.append(f"lpad(hex({low} div {1 << 36}BD), 9, '0') || lpad(hex(CAST({low} % {1 << 36}BD AS BIGINT)), 9, '0')")
        carry = f" + CAST({t} div {_BASE}BD AS DECIMAL(20,0))"
    return f"unhex({' || '.join(reversed(digits))})"


def _limb_sql(digits: str, i: int) -> str:
    """One of the 24-bit limbs of a number in hex."""
    return f"CAST(conv(substring(lpad({digits}, {6 * u.SUM_LIMBS}, '0'), {6 * (u.SUM_LIMBS - i) - 5}, 6), 16, 10) AS BIGINT)"


def _limbs_sql(x: str) -> list[str]:
    """The 24-bit limbs of an integer, which fills three of them, or bytes; a negative integer raises."""
    sign = f"IF(typeof({x}) <> 'binary' AND left(CAST({x} AS STRING), 1) = '-', CAST(raise_error('a negative number is no unsigned integer') AS BIGINT), 0L)"
    limbs = [_limb_sql(f"hex({x})", i) for i in range(u.SUM_LIMBS)]
    return [f"{limbs[0]} + {sign}", *limbs[1:3], *(f"IF({_integers_sql(x)}, 0L, {limb})" for limb in limbs[3:])]


def _integers_sql(*operands: str) -> str:
    """Whether all are integers, which is settled before the query runs, so that the other branch leaves the plan."""
    return " AND ".join(f"typeof({x}) IN ('tinyint', 'smallint', 'int', 'bigint')" for x in operands)


def _product_sql(a: str, b: str) -> list[str]:
    """The limbs of the product of two integers, without carries."""
    ends = [f"CAST(CAST({x} AS STRING) AS BIGINT)" for x in (a, b)]  # through text, since bytes would be refused even where this isn't taken
    cut = lambda x, i: f"(shiftrightunsigned({x}, {24 * i}) & 16777215L)"
    places: list[list[str]] = [[] for _ in range(6)]
    for i in range(3):
        for j in range(3):
            p = f"{cut(ends[0], i)} * {cut(ends[1], j)}"
            places[i + j].append(f"({p} & 16777215L)")
            places[i + j + 1].append(f"shiftrightunsigned({p}, 24)")
    sign = f"IF({ends[0]} < 0 OR {ends[1]} < 0, CAST(raise_error('a negative number is no unsigned integer') AS BIGINT), 0L)"
    places[0].append(sign)
    return [f"({' + '.join(p)})" for p in places]


class Rewriter:
    """Writes a query's text anew where its tree has functions of REWRITTEN. SQL functions of a session can't take their place: with
    one in its list, a grouped query can't be ordered by another aggregate."""

    def __init__(self, trees: Trees, sql: str, nodes: list[Node], names: Callable[[str], str]):
        self.trees, self.sql, self.names = trees, sql, names
        self.calls = {}
        for n in nodes:
            if n.kind == "UnresolvedFunction" and (name := _list(n.tree.nameParts())[-1].lower()) in REWRITTEN:
                self.calls[_span(n.tree)] = (name, n)

    def text(self, begin: int, end: int, but: tuple[int, int] | None = None) -> str:
        """A stretch of the text with its outermost calls written anew; but: a call that stays as it is."""
        out, at = [], begin
        for a, b in sorted(self.calls, key=lambda s: (s[0], -s[1])):
            if a >= at and b <= end and (a, b) != but:
                out += [self.sql[at:a], self.call((a, b))]
                at = b
        return "".join(out) + self.sql[at:end]

    def argument(self, tree: Any) -> str:
        """An argument's text, written anew and in brackets; it has to be what the tree has there."""
        a, b = _span(tree)
        if self.trees.parser.parseExpression(self.sql[a:b]).toString() != tree.toString():
            raise QueryError(f"can't tell the argument of a call near {self.sql[a:b]!r}")
        return f"({self.text(a, b)})"

    def call(self, span: tuple[int, int]) -> str:
        name, node = self.calls[span]
        args = _list(node.tree.arguments())
        if len(args) != (2 if name == "u256_mul" else 1):
            raise QueryError(f"{name} has a wrong number of arguments")
        if name == "resolve":
            if args[0].getClass().getSimpleName() != "Literal":
                raise QueryError("resolve() takes a name in quotes")
            return self.names(args[0].toString())
        if name == "u256_mul":
            a, b = map(self.argument, args)
            return f"IF({_integers_sql(a, b)}, {whole_sql(_product_sql(a, b))}, u256_product({a}, {b}))"
        if name == "format_usd":
            return f"('$' || nullif(format_string('%,.2f', CAST({self.argument(args[0])} AS DOUBLE)), 'null'))"
        if name == "wei_to_eth":
            return f"(CAST({self.argument(args[0])} AS DOUBLE) / 1e18D)"
        return self.sum(node, args[0])

    def sum(self, node: Node, arg: Any) -> str:
        tail = ""
        if node.tree.filter().isDefined():
            tail += f" FILTER (WHERE {self.argument(node.tree.filter().get())})"
        over = node.above.getClass().getSimpleName() if node.above is not None else ""
        if over == "UnresolvedWindowExpression":
            tail += f" OVER {node.above.productElement(1).name()}"
        elif over == "WindowExpression":
            a, b = _span(node.above.productElement(1))
            tail += f" OVER {self.text(a, b)}"
        of = lambda parts: whole_sql([f"sum({p}){tail}" for p in parts])
        if node.tree.isDistinct():  # a group's different values first
            first = self.argument(arg)
            checked = f"IF(typeof({first}) <> 'binary' AND left(CAST({first} AS STRING), 1) = '-', CAST(raise_error('a negative number is no unsigned integer') AS STRING), hex({first}))"
            zero = f"array({', '.join(['0L'] * u.SUM_LIMBS)})"
            add = f"zip_with(a, array({', '.join(_limb_sql('x', i) for i in range(u.SUM_LIMBS))}), (p, q) -> p + q)"
            whole = whole_sql([f"get(v, {i})" for i in range(u.SUM_LIMBS)])  # of a name, since the fold would be made for each place that it stands at
            return f"IF(count({first}){tail} > 0, aggregate(collect_set({checked}){tail}, {zero}, (a, x) -> {add}, v -> {whole}), NULL)"
        if arg.getClass().getSimpleName() == "UnresolvedFunction" and _span(arg) in self.calls and self.calls[_span(arg)][0] == "u256_mul":
            ends = _list(arg.arguments())
            if len(ends) == 2:
                a, b = map(self.argument, ends)
                longs = _integers_sql(*(f"max({x}){tail}" for x in (a, b)))  # aggregates, as ORDER BY of a grouped query knows nothing else
                return f"IF({longs}, {of(_product_sql(a, b))}, {of(_limbs_sql(f'u256_product({a}, {b})'))})"
        return of(_limbs_sql(self.argument(arg)))


class Ledger:
    """The tables that queries may read (transactions, logs, blocks, event tables), under their names, and the functions of the SQL surface.

    In a query, `:latest_block` is the newest block and `:native_token_price` the price of a coin; `resolve('name.eth')`
    is the address that the names table (name, address) has. Values of these are parameters, never text of the query.
    Several ledgers may stand side by side in a session; none leaves views there."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], names: DataFrame | None = None):
        self.spark, self.tables, self.names = spark, {k.lower(): v for k, v in tables.items()}, names
        self.trees = Trees(spark)
        for name, f in FUNCTIONS.items():
            spark.udf.register(name, f)
        builtin = {r[0].lower() for r in spark.sql("SHOW SYSTEM FUNCTIONS").collect()}  # some hundred names
        self.functions = (builtin - REFUSED) | set(FUNCTIONS) | set(REWRITTEN)

    def latest_block(self) -> int | None:
        return head(self.tables["blocks"]) if "blocks" in self.tables else None

    def address_of(self, name: str) -> bytes:
        if not name.lower().endswith(".eth"):
            raise QueryError(f"a name ends in .eth: {name}")
        found = self.names and self.names.where(F.lower("name") == name.lower()).select("address").first()
        if not found:
            raise QueryError(f"no such name: {name}")
        return bytes(found["address"])

    def query(self, sql: str, latest_block: int | None = None, native_token_price: float | None = None, max_rows: int | None = None, args: dict | None = None) -> DataFrame:
        """The result of a SELECT. Raises QueryError for commands, other relations, functions that reach beyond the rows, an output name that comes twice,
        a parameter without a value, more levels of recursion than MAX_LEVELS and, once max_rows is given, a larger result."""
        nodes = list(self.trees.walk(self.trees.parse(sql)))
        self._guard(nodes)
        args, named = dict(args or {}), {}

        def name(text: str) -> str:
            """The parameter that stands for a name's address."""
            if text not in named:
                named[text] = f"name_{len(named)}"
                args[named[text]] = self.address_of(text)
            return f":{named[text]}"

        wanted = {n.tree.name() for n in nodes if n.kind == "NamedParameter"}
        if "latest_block" in wanted:
            args["latest_block"] = latest_block if latest_block is not None else self.latest_block()
            if args["latest_block"] is None:
                raise QueryError("there is no latest block")
        if "native_token_price" in wanted:
            if native_token_price is None:
                raise QueryError("the query needs a native token price")
            args["native_token_price"] = float(Decimal(str(native_token_price)))
        text = Rewriter(self.trees, sql, nodes, name).text(0, len(sql))
        read = {_list(n.tree.multipartIdentifier())[0].lower() for n in nodes if n.kind == "UnresolvedRelation"}
        views = {t: f"ledger_{uuid.uuid4().hex}" for t in self.tables if t in read}
        try:
            for t, view in views.items():
                self.tables[t].createOrReplaceTempView(view)
            own = ", ".join(f"`{t}` AS (SELECT * FROM `{view}`)" for t, view in views.items())
            df = self.spark.sql(f"{'WITH ' + own if own else ''} SELECT * FROM (\n{text}\n)", args={k: F.lit(v) for k, v in args.items()} or None)
        finally:
            for view in views.values():
                self.spark.catalog.dropTempView(view)
        self._guard_relations(df._jdf.queryExecution().analyzed(), set(views.values()))
        if len(set(df.columns)) < len(df.columns):
            raise QueryError("an output name comes twice")
        if max_rows is not None:
            df = df.limit(max_rows + 1)
            if df.count() > max_rows:
                raise QueryError(f"the result has more than {max_rows} rows")
        return df

    def _guard(self, nodes: list[Node]) -> None:
        """What the parser makes of the text has to be a query, of known functions, over relations that have a name of one part."""
        for n in nodes:
            if n.plan and n.kind not in PLANS:
                raise QueryError(f"only queries over the ledger's tables may run ({n.kind})")
            if n.kind in REFUSED_EXPRESSIONS:
                raise QueryError(f"no such function ({n.kind})")
            if n.kind == "UnresolvedRelation" and n.tree.multipartIdentifier().size() != 1:
                raise QueryError("only the ledger's tables may be read")
            name = None
            if n.kind == "UnresolvedFunction":
                name = ".".join(_list(n.tree.nameParts()))
            elif n.kind == "UnresolvedGenerator":
                name = n.tree.name().funcName()
            if name is not None and name.lower() not in self.functions:
                raise QueryError(f"no such function: {name}")
            if n.kind == "UnresolvedWith":
                for relation in _list(n.tree.cteRelations()):
                    levels = relation.productElement(2) if relation.productArity() > 2 else None
                    if levels is not None and levels.isDefined() and not 0 <= int(levels.get()) <= MAX_LEVELS:
                        raise QueryError(f"a recursive query may have {MAX_LEVELS} levels")

    def _guard_relations(self, plan: Any, views: set[str]) -> None:
        """What the analyser made of it may read the ledger's views, literal rows, common tables and their recursion, and nothing else."""
        found = [plan]
        while found:
            node = found.pop()
            kind = node.nodeName()
            if kind == "View":
                if node.desc().identifier().table() not in views:
                    raise QueryError(f"no such table: {node.desc().identifier().table()}")
                continue  # what the ledger's own view reads is its own matter
            if node.children().isEmpty() and kind not in ("OneRowRelation", "CTERelationRef", "UnionLoopRef", "LocalRelation"):
                raise QueryError("only the ledger's tables may be read")
            found += _list(node.children()) + _list(node.subqueries())
