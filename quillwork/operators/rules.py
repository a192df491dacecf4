"""Rule labelling: rules become one boolean expression per rule, evaluated in a single projection."""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import NUMBER_PATTERN, safe_number
from .columnstats import FLOATING, cell, field_kinds, is_number

LABEL = "__label__"
STRATEGIES = ("first_match", "highest_priority", "all")


@dataclass(frozen=True)
class Condition:
    column: str
    operator: str
    value: Any = None


@dataclass(frozen=True)
class Rule:
    label: str
    conditions: tuple[Condition, ...]
    priority: int = 0
    logic: str = "and"


@dataclass(frozen=True)
class RuleSet:
    rules: tuple[Rule, ...]
    strategy: str = "first_match"
    notes: tuple[str, ...] = field(default=())


# ---- values -------------------------------------------------------------------------------------

def literal_number(value: Any) -> float | None:
    """A rule operand as a number, by the same cautious reading as for cells."""
    if isinstance(value, bool):
        return None
    if isinstance(value, (int, float)):
        return float(value)
    text = str(value)
    if not re.match(NUMBER_PATTERN, text):
        return None
    number = float(text)
    return number if abs(number) != float("inf") else None


def literal_range(value: Any) -> tuple[float, float] | None:
    """Two bounds from a pair, ``"a,b"`` or ``"a - b"`` (signs allowed), in ascending order."""
    number = r"\s*([+-]?[\d.]+(?:[eE][+-]?\d+)?)\s*"
    if isinstance(value, str):
        found = re.fullmatch(number + "[,-]" + number, value)
        value = found.groups() if found else ()
    if not isinstance(value, (list, tuple)) or len(value) != 2:
        return None
    try:
        return tuple(sorted(float(v) for v in value))
    except (TypeError, ValueError):
        return None


def java_pattern(pattern: str) -> str | None:
    """The pattern in the engine's dialect, or None when it is not a valid one."""
    try:
        re.compile(pattern)
    except re.error:
        warnings.warn(f"invalid pattern {pattern!r} matches nothing", stacklevel=2)
        return None
    pattern = pattern.replace("(?P<", "(?<")
    return re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern)


# ---- operators ----------------------------------------------------------------------------------

def _number_of(c: Column, t: T.DataType) -> Column:
    return safe_number(c, is_number(t), isinstance(t, T.BooleanType))


def _equals(c: Column, t: T.DataType, value: Any) -> Column:
    number = literal_number(value)
    if is_number(t) and number is not None:
        return c.cast("double") == F.lit(number)
    return c.cast("string") == F.lit(str(value))


def _in_list(c: Column, t: T.DataType, value: Any) -> Column:
    if isinstance(value, str):
        value = [v.strip() for v in value.split(",") if v.strip()]
    if not isinstance(value, (list, tuple, set)) or not value:
        return F.lit(False)
    hit = c.cast("string").isin([str(v) for v in value])
    numbers = [n for n in map(literal_number, value) if n is not None]
    if numbers:
        hit = hit | F.coalesce(_number_of(c, t).isin(numbers), F.lit(False))
    return hit


def _between(c: Column, t: T.DataType, value: Any) -> Column:
    bounds = literal_range(value)
    return _number_of(c, t).between(*bounds) if bounds else F.lit(False)


def _regex(c: Column, t: T.DataType, value: Any) -> Column:
    pattern = java_pattern(str(value))
    return F.lit(False) if pattern is None else c.cast("string").rlike(pattern)


def _compare(test: Callable[[Column, float], Column]):
    def build(c: Column, t: T.DataType, value: Any) -> Column:
        number = literal_number(value)
        return F.lit(False) if number is None else test(_number_of(c, t), number)
    return build


def _text(test: Callable[[Column, str], Column]):
    return lambda c, t, value: test(c.cast("string"), str(value))


OPERATORS: dict[str, Callable[[Column, T.DataType, Any], Column]] = {
    "equals": _equals,
    "not_equals": lambda c, t, v: ~_equals(c, t, v),
    "contains": _text(lambda c, v: c.contains(v)),
    "not_contains": _text(lambda c, v: ~c.contains(v)),
    "starts_with": _text(lambda c, v: c.startswith(v)),
    "ends_with": _text(lambda c, v: c.endswith(v)),
    "greater_than": _compare(lambda c, v: c > v),
    "less_than": _compare(lambda c, v: c < v),
    "greater_equal": _compare(lambda c, v: c >= v),
    "less_equal": _compare(lambda c, v: c <= v),
    "between": _between,
    "regex_match": _regex,
    "in_list": _in_list,
    "is_null": lambda c, t, v: c.isNull(),
    "is_not_null": lambda c, t, v: c.isNotNull(),
}


# ---- loading ------------------------------------------------------------------------------------

def load_rules(definitions: Sequence[dict], strategy: str = "first_match") -> RuleSet:
    """Check compound or flat definitions; raises ``ValueError`` on anything unusable."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown conflict strategy {strategy!r}; use one of {STRATEGIES}")
    rules, notes = [], []
    for i, d in enumerate(definitions):
        parts = d.get("conditions", [d] if "operator" in d or "column" in d else None)
        if not isinstance(parts, list) or not parts:
            raise ValueError(f"rule {i}: at least one condition is required")
        for p in parts:
            if p.get("operator") not in OPERATORS:
                raise ValueError(f"rule {i}: unsupported operator {p.get('operator')!r}")
        logic = (d.get("logic") or "and").lower()
        if logic not in ("and", "or"):
            raise ValueError(f"rule {i}: logic must be 'and' or 'or'")
        label = str(d["label"])
        if strategy == "all" and "," in label:
            notes.append(f"rule {i}: label {label!r} holds a comma and will be counted in parts")
        conditions = tuple(Condition(p.get("column", ""), p["operator"], p.get("value")) for p in parts)
        rules.append(Rule(label, conditions, int(d.get("priority") or 0), logic))
    return RuleSet(tuple(rules), strategy, tuple(notes))


# ---- expressions --------------------------------------------------------------------------------

def condition_expression(df: DataFrame, condition: Condition) -> Column:
    """True or False for every row: missing columns and missing values never match."""
    kinds = field_kinds(df)
    if condition.column not in kinds:
        return F.lit(False)
    kind = kinds[condition.column]
    c = cell(condition.column)
    if isinstance(kind, FLOATING):
        c = F.when(~F.isnan(c), c)
    return F.coalesce(OPERATORS[condition.operator](c, kind, condition.value), F.lit(False))


def rule_expression(df: DataFrame, rule: Rule) -> Column:
    parts = [condition_expression(df, c) for c in rule.conditions]
    return reduce(or_ if rule.logic == "or" else and_, parts)


def label_expression(matches: Sequence[Column], rules: RuleSet) -> Column:
    if not rules.rules:
        return F.lit(None).cast("string")
    pairs = list(zip(matches, rules.rules))
    if rules.strategy == "all":
        labels = F.array(*[F.when(m, r.label) for m, r in pairs])
        found = F.array_compact(labels)
        return F.when(F.size(found) > 0, F.array_join(found, ","))
    if rules.strategy == "highest_priority":
        pairs.sort(key=lambda p: -p[1].priority)
    return F.coalesce(*[F.when(m, r.label) for m, r in pairs])


# ---- operators over tables ----------------------------------------------------------------------

def apply_rules(df: DataFrame, rules: RuleSet, label_column: str = LABEL) -> DataFrame:
    matches = [rule_expression(df, r) for r in rules.rules]
    return df.withColumn(label_column, label_expression(matches, rules))


def rule_warnings(df: DataFrame, rules: RuleSet) -> list[str]:
    notes = list(rules.notes)
    for i, r in enumerate(rules.rules):
        missing = sorted({c.column for c in r.conditions} - set(df.columns))
        if missing:
            notes.append(f"rule {i}: columns {missing} do not exist, their conditions never match")
    return notes


def rule_report(df: DataFrame, rules: RuleSet) -> DataFrame:
    """(section, name, count): totals, matches per rule, label distribution, and warnings such as columns that do not exist.

    Labels come from the rule set, so the distribution is a fixed set of conditional counts and needs
    no shuffle of rows.
    """
    matches = [rule_expression(df, r) for r in rules.rules]
    n = len(matches)
    flags = df.select(*[m.alias(f"m{i}") for i, m in enumerate(matches)],
                      label_expression(matches, rules).alias("label"))
    hits = reduce(lambda a, b: a + b, [F.col(f"m{i}").cast("int") for i in range(n)], F.lit(0))
    singles = sorted({part.strip() for r in rules.rules
                      for part in (r.label.split(",") if rules.strategy == "all" else [r.label])})
    if rules.strategy == "all":
        # A label given by several matching rules is counted once per rule.
        def counted(label: str) -> Column:
            times = [F.col(f"m{i}").cast("int") * [p.strip() for p in r.label.split(",")].count(label)
                     for i, r in enumerate(rules.rules)]
            return F.sum(reduce(lambda a, b: a + b, times, F.lit(0)))
    else:
        def counted(label: str) -> Column:
            return F.count_if(F.col("label") == label)
    entries: list[tuple[str, str, Column]] = [
        ("summary", "total_rows", F.count("*")),
        ("summary", "labeled", F.count("label")),
        ("summary", "unlabeled", F.count_if(F.col("label").isNull())),
        ("summary", "conflicts", F.count_if(hits > 1)),
        ("summary", "rules_applied", F.max(F.lit(n))),
    ]
    entries += [("rule", f"{i}:{r.label}", F.count_if(F.col(f"m{i}"))) for i, r in enumerate(rules.rules)]
    entries += [("label", s, counted(s)) for s in singles]
    wide = flags.agg(*[F.coalesce(e, F.lit(0)).cast("long").alias(f"e{i}")
                       for i, (_, _, e) in enumerate(entries)])
    rows = [F.struct(F.lit(s).alias("section"), F.lit(k).alias("name"), F.col(f"e{i}").alias("count"))
            for i, (s, k, _) in enumerate(entries)]
    rows += [F.struct(F.lit("warning").alias("section"), F.lit(note).alias("name"), F.lit(1).cast("long").alias("count"))
             for note in rule_warnings(df, rules)]
    long = wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return long.filter("section <> 'label' or count > 0")


def label_distribution(labeled: DataFrame, strategy: str = "first_match",
                       label_column: str = LABEL) -> DataFrame:
    """(label, count) of an already labelled table."""
    c = F.col(label_column)
    if strategy == "all":
        labeled = labeled.select(F.explode(F.split(c, ",")).alias("label"))
        labeled = labeled.select(F.trim("label").alias("label"))
    else:
        labeled = labeled.select(c.alias("label"))
    return labeled.filter("label is not null").groupBy("label").agg(F.count("*").alias("count"))


def predictions(labeled: DataFrame, id_column: str | None = None,
                label_column: str = LABEL) -> DataFrame:
    """(item_id, label, confidence 1.0) of the labelled rows."""
    if id_column is None:
        id_column = next((c for c in ("id", "Id", "ID", "item_id") if c in labeled.columns), None)
    if id_column is not None:
        item = cell(id_column).cast("string")
    else:
        item = F.hex(F.xxhash64(*[cell(c) for c in labeled.columns if c != label_column]))
    return labeled.filter(F.col(label_column).isNotNull()).select(
        item.alias("item_id"), F.col(label_column).alias("label"), F.lit(1.0).alias("confidence"))


def preview(df: DataFrame, rules: RuleSet, order_by: str, rows: int = 200,
            samples_per_rule: int = 5) -> DataFrame:
    """Dry run on the first ``rows`` rows: (rule, label, matches, coverage, samples).

    Both bounds are part of the request (1-5000 rows, 0-25 samples), so each rule's sample list is small.
    """
    if not 1 <= rows <= 5000 or not 0 <= samples_per_rule <= 25:
        raise ValueError("rows must be 1..5000 and samples_per_rule 0..25")
    head = df.orderBy(cell(order_by)).limit(rows)
    matches = [rule_expression(head, r) for r in rules.rules]
    entries = [F.struct(F.lit(i).alias("rule"), F.lit(r.label).alias("label"), m.alias("hit"))
               for i, (m, r) in enumerate(zip(matches, rules.rules))]
    flat = head.select(cell(order_by).alias("key"), F.explode(F.array(*entries)).alias("e"))
    flat = flat.select("key", "e.*")
    keys = F.array_sort(F.collect_list(F.when(F.col("hit"), F.col("key"))))
    return flat.groupBy("rule", "label").agg(
        F.count_if("hit").alias("matches"),
        (F.count_if("hit") / F.count("*")).alias("coverage"),
        F.array_join(F.slice(keys, 1, samples_per_rule).cast("array<string>"), ",").alias("samples"))


