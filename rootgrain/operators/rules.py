"""The rule engine: a list of declared rules becomes one projection.

Rules apply in order to each record and see what earlier ones wrote. The first that fails quarantines
the record, with its original columns, the rule and a code; input = output + quarantine. The rule
list is compiled once: each rule is a pair of columns, its values and its failure, so that a record
costs no Python.
"""

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import times, units

NUMERIC = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


@dataclass(frozen=True)
class Rule:
    """kind: time, unit, map, regex, template, lookup or expr. source and target are column names; the
    rest depends on the kind:

    time: layout, assume_offset_minutes, offset_target. unit: source_unit, target_unit.
    map: values, default. regex: pattern with named groups, each of which is a column.
    template: templates (name, text with {parameters}), whose parameters become a map column.
    lookup: values, default. expr: expression over columns, with + - * / and brackets.
    """

    id: str
    kind: str
    target: str
    source: str | None = None
    layout: str = "iso8601"
    assume_offset_minutes: int | None = None
    offset_target: str | None = None
    source_unit: str = ""
    target_unit: str = ""
    values: dict = field(default_factory=dict)
    default: str | None = None
    pattern: str = ""
    templates: tuple[tuple[str, str], ...] = ()
    expression: str = ""


class ExpressionError(ValueError):
    pass


def number(value: Column) -> Column:
    """A text or number as a double: white space around it is ignored, an empty text is 0, anything else null."""
    text = value.cast("string")
    return F.when(text.rlike(r"^\s*$"), 0.0).when(text.rlike(NUMERIC), F.trim(text).try_cast("double"))


def expression(text: str, columns: dict[str, Column]) -> Column:
    """text as a double column, null where a division by zero or a value that is no number occurs.
    A null value counts as 0. Names are known columns, dotted or plain."""
    tokens = re.findall(r"\s*(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+|[A-Za-z_][\w.]*|[-+*/()])", text)
    if "".join(tokens) != re.sub(r"\s+", "", text):
        raise ExpressionError(f"cannot read {text!r}")
    at = 0

    def peek() -> str:
        return tokens[at] if at < len(tokens) else ""

    def take() -> str:
        nonlocal at
        at += 1
        return tokens[at - 1] if at <= len(tokens) else ""

    def unary() -> Column:
        token = take()
        if token == "-":
            return -unary()
        if token == "+":
            return unary()
        if token == "(":
            inner = total()
            if take() != ")":
                raise ExpressionError("a bracket is not closed")
            return inner
        if re.match(r"[\d.]", token):
            return F.lit(float(token))
        if token in columns:
            c = columns[token]
            return F.when(c.isNull(), 0.0).otherwise(number(c))
        raise ExpressionError(f"unknown name {token!r}" if token else "the expression breaks off")

    def product() -> Column:
        left = unary()
        while peek() in ("*", "/"):
            if take() == "*":
                left = left * unary()
            else:
                right = unary()
                left = left / F.when(right != 0, right)
        return left

    def total() -> Column:
        left = product()
        while peek() in ("+", "-"):
            left = left + product() if take() == "+" else left - product()
        return left

    out = total()
    if at < len(tokens):
        raise ExpressionError(f"unexpected {peek()!r}")
    return out


def _groups(pattern: str) -> tuple[str, dict[str, int]]:
    """The pattern without group names, and the number of each named group."""
    names, number = {}, 0
    for m in re.finditer(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\((?!\?)|\(\?<([A-Za-z_]\w*)>|\(\?P<([A-Za-z_]\w*)>", pattern):
        if m[0][0] == "(":
            number += 1
            if name := m[1] or m[2]:
                names[name] = number
    return re.sub(r"\(\?P?<[A-Za-z_]\w*>", "(", pattern), names


def template_pattern(template: str) -> tuple[str, list[str]] | None:
    """An anchored pattern for a text with {parameters}, or None where a name is empty or occurs twice."""
    parts = re.split(r"\{([^{}]*)\}", " ".join(template.split()))
    names = parts[1::2]
    if len(set(names)) != len(names) or any(not re.fullmatch(r"[A-Za-z_]\w*", n) for n in names):
        return None
    quoted = [re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", p) for p in parts[::2]]
    return "^" + "(.+?)".join(quoted) + "$", names


def _literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair]) if values else F.lit(None).cast("map<string,string>")


def _apply(rule: Rule, columns: dict[str, Column]) -> tuple[dict[str, Column], Column, str]:
    """The columns that the rule writes, when it fails, and the code of that."""
    if rule.kind == "expr":
        out = expression(rule.expression, columns)
        return {rule.target: out}, out.isNull(), "EXPR_FAILED"
    source = columns[rule.source]
    if rule.kind == "time":
        read = times.parse(source.cast("string"), rule.layout, rule.assume_offset_minutes)
        out = {rule.target: times.iso_utc(read["ms"])}
        if rule.offset_target:
            out[rule.offset_target] = read["offset_minutes"]
        return out, read["ms"].isNull(), "BAD_TIMESTAMP"
    if rule.kind == "unit":
        value = number(source)
        return {rule.target: units.convert(value, rule.source_unit, rule.target_unit)}, value.isNull(), "BAD_NUMBER"
    if rule.kind in ("map", "lookup"):
        value = F.coalesce(_literal_map(rule.values)[source.cast("string")], F.lit(rule.default))
        return {rule.target: value}, value.isNull(), "UNMAPPED_VALUE" if rule.kind == "map" else "LOOKUP_MISS"
    if rule.kind == "regex":
        pattern, names = _groups(rule.pattern)
        found = {n: F.regexp_extract(source, pattern, i) for n, i in names.items()}
        missed = ~source.rlike(pattern)
        for name, i in names.items():
            # an empty group may have taken part or not; only one that has can be referred to
            missed = missed | ((found[name] == "") & ~source.rlike(f"(?:{pattern})\\{i}"))
        return found, missed, "PATTERN_MISMATCH"
    if rule.kind == "template":
        text = F.trim(F.regexp_replace(source, r"\s+", " "))
        chosen, parameters = F.when(F.lit(False), ""), F.when(F.lit(False), F.create_map().cast("map<string,string>"))
        for name, template in rule.templates:
            if compiled := template_pattern(template):
                pattern, names = compiled
                values = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.regexp_extract(text, pattern, i + 1))]).cast("map<string,string>")
                chosen, parameters = chosen.when(text.rlike(pattern), name), parameters.when(text.rlike(pattern), values)
        return {rule.target: chosen, f"{rule.target}_params": parameters}, chosen.isNull(), "TEMPLATE_MISMATCH"
    raise ValueError(f"unknown kind of rule {rule.kind!r}")


def classify(records: DataFrame, rules: list[Rule]) -> DataFrame:
    """records with the rules' columns and `failure`, a struct of rule and code, null where none failed.
    A source that is null or empty fails with MISSING_INPUT."""
    columns = {c: F.col(f"`{c}`") for c in records.columns}
    failure = F.lit(None).cast("struct<rule:string,code:string>")
    for rule in rules:
        values, failed, code = _apply(rule, columns)
        failed = F.coalesce(failed, F.lit(True))
        told = F.when(failed, F.struct(F.lit(rule.id).alias("rule"), F.lit(code).alias("code")))
        if rule.source is not None:
            empty = columns[rule.source].isNull() | (columns[rule.source].cast("string") == "")
            told = F.when(empty, F.struct(F.lit(rule.id).alias("rule"), F.lit("MISSING_INPUT").alias("code"))).otherwise(told)
        failure = F.coalesce(failure, told)
        columns |= values
    return records.select(*[F.col(f"`{c}`").alias(f"_in_{c}") for c in records.columns], *[v.alias(k) for k, v in columns.items()], failure.alias("failure"))


def transform(records: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """(output, quarantine): the records on which all rules held, and the others as they came, with
    `failure`. Cache or write the records first where they are costly to read twice."""
    told = classify(records, rules)
    original = [F.col(f"_in_{c}").alias(c) for c in records.columns]
    written = [c for c in told.columns if not c.startswith("_in_") and c != "failure"]
    return told.where("failure IS NULL").select(*written), told.where("failure IS NOT NULL").select(*original, "failure")


def duplicate_ids(records: DataFrame, record_id: str, order: str) -> DataFrame:
    """Ids that occur twice or more, with the place of the second occurrence."""
    n = F.row_number().over(Window.partitionBy(record_id).orderBy(order))
    return records.where(F.col(record_id).isNotNull()).select(record_id, F.col(order).alias("second"), n.alias("_n")).where("_n = 2").drop("_n")
