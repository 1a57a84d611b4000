"""The contract gate: which SQL the engine admits.

A query is parsed by Spark and every node and expression of its unresolved plan is looked at before anything runs.
Statements that define or change data, and the constructs switched off, raise ``ContractError`` with the construct's name.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import ParseException
from pyspark.sql import SparkSession

FLAGS = (
    "joins", "outer_joins", "cross_joins", "semi_joins", "set_operations", "ctes", "recursive_ctes", "subqueries",
    "windows", "having", "distinct", "order_limit", "pattern_match", "grouping",
)

#: Logical nodes a read-only query may consist of.
_PLAIN = {
    "Project", "Filter", "UnresolvedRelation", "SubqueryAlias", "OneRowRelation", "LocalRelation", "UnresolvedInlineTable", "UnresolvedSubqueryColumnAliases",
    "UnresolvedTableValuedFunction", "ResolvedInlineTable",
}
_FLAG_OF_NODE = {
    "Aggregate": "grouping", "UnresolvedHaving": "having", "Distinct": "distinct", "Sort": "order_limit", "GlobalLimit": "order_limit", "LocalLimit": "order_limit", "Offset": "order_limit",
    "Union": "set_operations", "Intersect": "set_operations", "Except": "set_operations", "WithWindowDefinition": "windows", "UnresolvedWith": "ctes", "UnionLoop": "recursive_ctes",
}
_FLAG_OF_EXPRESSION = {
    "ScalarSubquery": "subqueries", "Exists": "subqueries", "InSubquery": "subqueries", "ListQuery": "subqueries", "WindowExpression": "windows", "UnresolvedWindowExpression": "windows",
    "Like": "pattern_match", "ILike": "pattern_match",
}
_NEVER = {"RLike": "regular expressions", "UnresolvedGenerator": "generators", "Explode": "generators", "ScriptInputOutputSchema": "scripts"}
#: Functions a query may call.
FUNCTIONS = frozenset(
    "sum count avg mean min max approx_count_distinct count_if any_value stddev variance abs ceil ceiling floor round bround mod div sign sqrt power pow exp ln log10 greatest least lower upper lcase ucase length char_length"
    " octet_length substring substr left right between trim ltrim rtrim lpad rpad concat replace reverse position instr startswith endswith contains like ilike coalesce nullif ifnull nvl nvl2 if isnull isnotnull"
    " year month day dayofmonth dayofyear weekofyear quarter hour minute second date_trunc trunc date_add date_sub datediff date_format to_date to_timestamp extract date_part"
    " row_number rank dense_rank percent_rank cume_dist ntile lag lead first_value last_value nth_value first last grouping grouping_id cast int bigint double decimal string date boolean float"
    .split()
)
TABLE_FUNCTIONS = frozenset({"range"})
_REGEX_NAMES = {"regexp", "regexp_like", "rlike", "regexp_extract", "regexp_extract_all", "regexp_replace", "regexp_count", "regexp_instr", "regexp_substr", "split"}


class ContractError(ValueError):
    """A query outside the contract."""


class Contract:
    """Switches for the constructs a query may use; all but theta joins and regular expressions are on by default."""

    def __init__(self, theta_joins: bool = False, regex: bool = False, **flags: bool):
        unknown = set(flags) - set(FLAGS)
        if unknown:
            raise ContractError(f"unknown flags: {sorted(unknown)}")
        self.flags = {f: flags.get(f, True) for f in FLAGS}
        self.theta_joins, self.regex = theta_joins, regex

    def check(self, spark: SparkSession, text: str, tables: Iterable[str] | None = None) -> None:
        """Raises ContractError unless the text is one query within the contract.

        It may read ``tables`` and its own common table expressions; where ``tables`` isn't given, any plain name, but no file or other catalog.
        """
        if not text or not text.strip():
            raise ContractError("empty query")
        try:
            plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
        except ParseException as e:
            raise ContractError(f"not parsed: {str(e).splitlines()[0]}") from e
        except Exception as e:
            raise ContractError(f"not parsed: {e}") from e
        self._node(plan, None if tables is None else frozenset(t.lower() for t in tables))

    def _need(self, flag: str, what: str) -> None:
        if not self.flags[flag]:
            raise ContractError(f"{what} is off ({flag})")

    def _node(self, plan, names: frozenset[str] | None) -> None:
        name = plan.getClass().getSimpleName()
        if name == "Join":
            self._join(plan)
        elif name in _FLAG_OF_NODE:
            self._need(_FLAG_OF_NODE[name], name)
        elif name not in _PLAIN:
            raise ContractError(f"{name} is not a query construct")
        if name == "UnresolvedWith":
            if plan.allowRecursion():
                self._need("recursive_ctes", "WITH RECURSIVE")
            relations = plan.cteRelations()
            names = None if names is None else names | {relations.apply(i)._1().lower() for i in range(relations.size())}
            for i in range(relations.size()):
                self._node(relations.apply(i)._2(), names)
        if name == "UnresolvedRelation":
            called = self._items(plan.multipartIdentifier())
            if len(called) != 1 or names is not None and called[0].lower() not in names:
                raise ContractError(f"{'.'.join(called)} is not a table of the engine")
        if name == "UnresolvedTableValuedFunction" and ".".join(self._items(plan.name())).lower() not in TABLE_FUNCTIONS:
            raise ContractError("table functions other than range are not admitted")
        for part in self._items(plan.expressions()):
            self._expression(part, names)
        for child in self._items(plan.children()):
            self._node(child, names)

    def _join(self, plan) -> None:
        kind = plan.joinType().toString()
        if "Outer" in kind:
            self._need("outer_joins", kind)
        elif kind in ("LeftSemi", "LeftAnti"):
            self._need("semi_joins", kind)
        elif kind == "Cross" or plan.condition().isEmpty() and kind == "Inner":
            self._need("cross_joins", kind)
        self._need("joins", kind)
        if plan.condition().isDefined() and not self.theta_joins:
            self._equality(plan.condition().get())

    def _equality(self, condition) -> None:
        name = condition.getClass().getSimpleName()
        if name == "And":
            for child in self._items(condition.children()):
                self._equality(child)
        elif name not in ("EqualTo", "EqualNullSafe") or any(c.getClass().getSimpleName() != "UnresolvedAttribute" for c in self._items(condition.children())):
            raise ContractError("a join condition must be equalities of columns")

    def _expression(self, part, names: frozenset[str] | None) -> None:
        name = part.getClass().getSimpleName()
        if name in _NEVER and not (self.regex and name == "RLike"):
            raise ContractError(f"{_NEVER[name]} are not admitted")
        if name == "UnresolvedFunction":
            called = part.nameParts().mkString(".").lower()
            if called in _REGEX_NAMES and not self.regex:
                raise ContractError("regular expressions are not admitted")
            if called not in FUNCTIONS and called not in _REGEX_NAMES:
                raise ContractError(f"the function {called} is not admitted")
        if name in _FLAG_OF_EXPRESSION:
            self._need(_FLAG_OF_EXPRESSION[name], name)
        if hasattr(part, "plan") and name in ("ScalarSubquery", "Exists", "ListQuery"):
            self._node(part.plan(), names)
        for child in self._items(part.children()):
            self._expression(child, names)
        if name == "InSubquery":
            self._expression(part.query(), names)

    @staticmethod
    def _items(seq):
        return [seq.apply(i) for i in range(seq.size())]
