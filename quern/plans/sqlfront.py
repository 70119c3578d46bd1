"""SQL text with TABLESAMPLE SWR and APPROX_ aggregates, rewritten to what Spark runs.

    SELECT approx_sum(x), approx_sum_half_ci(x, 0.95) FROM t TABLESAMPLE SWR (500) REPEATABLE (7) WHERE k >= 1 AND k < 9

The sampled table becomes a view that carries the draw probability; comparisons of its key with literals that every row of
the result must pass are the range the draws come from, all predicates stay behind the sample. The table may be joined
with others, which are not sampled.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import estimators, sampling

SAMPLE = re.compile(
    r"(?is)(?P<lead>\bFROM\b|\bJOIN\b|,)\s*(?P<table>\w+)(?:\s+(?:AS\s+)?(?P<alias>(?!TABLESAMPLE\b)\w+))?\s+TABLESAMPLE\s+(?P<method>SWR|BERNOULLI|SYSTEM_ROWS|SYSTEM_TIME|SYSTEM)"
    r"\s*\(\s*(?P<size>[^)]*?)\s*\)(?:\s*REPEATABLE\s*\(\s*(?P<seed>[^)]*?)\s*\))?"
)
CALL = re.compile(r"(?i)\b(approx_sum_half_ci|approx_count_star_half_ci|approx_count_half_ci|approx_sum|approx_count|approx_avg|sample_prob|inv_sample_prob)\s*\(")


@dataclass(frozen=True)
class SampledTable:
    """How a table may be sampled: the key whose ranges draws come from, the layout of ranks, and a block number."""

    key: str
    layout: sampling.Layout
    block: str | None = None


def rewrite(text: str) -> str:
    """APPROX_ calls as plain aggregates over the hidden columns."""
    p, n = sampling.P, sampling.N
    out = text
    while m := CALL.search(out):
        args, end = _arguments(out, m.end())
        name = m[1].lower()
        x = args[0] if args else ""
        each = {"approx_sum_half_ci": f"CAST({x} AS DOUBLE) / {p}", "approx_count_star_half_ci": f"1 / {p}", "approx_count_half_ci": f"IF({x} IS NOT NULL, 1 / {p}, NULL)"}.get(name)
        if each is not None:
            new = _half_ci(each, float(args[-1]))
        elif name == "approx_sum":
            new = f"(SUM(CAST({x} AS DOUBLE) / {p}) / MAX({n}))"
        elif name == "approx_count":
            one = f"1 / {p}" if x.strip() == "*" else f"IF({x} IS NOT NULL, 1 / {p}, NULL)"
            new = f"COALESCE(SUM({one}) / MAX({n}), 0D)"
        elif name == "approx_avg":
            new = f"(SUM(CAST({x} AS DOUBLE) / {p}) / SUM(IF({x} IS NOT NULL, 1 / {p}, NULL)))"
        else:
            new = p if name == "sample_prob" else f"(1 / {p})"
        out = out[: m.start()] + new + out[end:]
    return out


def _half_ci(x: str, confidence: float) -> str:
    n, d, k = f"COUNT({x})", f"(VAR_POP({x}) * COUNT({x}))", f"MAX({sampling.N})"
    spread = f"CASE WHEN {n} = 0 THEN 0 WHEN {k} - {n} <= 0 THEN {d} ELSE {d} + {n} * ({k} - {n}) / {k} * POWER(SUM({x}) / {n}, 2) END"
    return f"(CASE WHEN {k} > 1 THEN {estimators.erf_inv_value(confidence)!r}D * SQRT(2 * ({spread}) / ({k} * ({k} - 1))) END)"


def _arguments(text: str, at: int) -> tuple[list[str], int]:
    """Arguments from just behind an opening parenthesis, and the place behind the closing one."""
    depth, start, out, quote = 0, at, [], ""
    for i in range(at, len(text)):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")" and depth:
            depth -= 1
        elif c == ")" or c == "," and not depth:
            if text[start:i].strip() or c == ",":
                out.append(text[start:i].strip())
            start = i + 1
            if c == ")":
                return out, i + 1
    raise ValueError("a parenthesis is not closed")


LITERAL = r"(?:(?:(?:DATE|TIMESTAMP)\s*)?'[^']*'|[-+]?\d+(?:\.\d+)?)"
TOKEN = re.compile(r"(?is)'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|\w+|\s+|.")


def conjuncts(where: str) -> list[str]:
    """The top-level conjuncts of a predicate; just the predicate itself if it has a top-level OR."""
    parts, depth, between, cases = [[]], 0, 0, 0
    for token in TOKEN.findall(where):
        word = token.upper()
        depth += (token == "(") - (token == ")")
        cases += (word == "CASE") - (word == "END")
        if not depth and not cases:
            if word == "OR":
                return [where.strip()]
            between += word == "BETWEEN"
            if word == "AND" and between:
                between -= 1
            elif word == "AND":
                parts.append([])
                continue
        parts[-1].append(token)
    out = []
    for part in ("".join(p).strip() for p in parts):
        inner = part[1:-1] if part.startswith("(") and _arguments(part, 1)[1] == len(part) else None
        out += conjuncts(inner) if inner is not None else [part]
    return out


def key_range(where: str, key: str, names: tuple[str, ...] = ()) -> str | None:
    """The top-level conjuncts that compare the key, by itself or qualified by one of names, with a literal: the only
    ones that hold for every row of the result, so that draws may come from their range alone."""
    qualified = rf"(?:(?:{'|'.join(map(re.escape, names))})\.)?" if names else ""
    column = rf"{qualified}(?P<key>{re.escape(key)})"
    wanted = re.compile(rf"(?is){column}\s*(?P<rest>(?:<=|>=|<|>|=)\s*{LITERAL}|BETWEEN\s+{LITERAL}\s+AND\s+{LITERAL})")
    found = [m for m in (wanted.fullmatch(c) for c in conjuncts(where)) if m]
    return " AND ".join(f"{key} {m['rest']}" for m in found) or None


def _where(text: str) -> str | None:
    """The WHERE clause of a query's rest, as far as its own level goes."""
    depth, out, inside = 0, [], False
    for token in TOKEN.findall(text):
        depth += (token == "(") - (token == ")")
        if depth < 0:
            break
        word = token.upper()
        if not depth and inside and word in ("GROUP", "ORDER", "LIMIT", "HAVING", "UNION", "INTERSECT", "EXCEPT", "WINDOW", "OFFSET", "FETCH", ";"):
            break
        if inside:
            out.append(token)
        inside = inside or not depth and word == "WHERE"
    return "".join(out).strip() or None


def sql(spark: SparkSession, text: str, tables: dict[str, SampledTable]) -> DataFrame:
    """Runs a query; without TABLESAMPLE it is plain Spark SQL, and approximate aggregates in it raise."""
    found = list(SAMPLE.finditer(text))
    if not found:
        if CALL.search(text):
            raise ValueError("approximate aggregates need a sampled table: TABLESAMPLE is missing")
        return spark.sql(text)
    if len(found) > 1:
        raise ValueError("one table of a query can be sampled; draws of two tables are not draws of their join")
    m = found[0]
    name, method = m["table"], m["method"].upper()
    if name not in tables:
        raise ValueError(f"{name} has no layout to sample by")
    how, df = tables[name], spark.table(name)
    alias, rest, seed = m["alias"], text[m.end() :], m["seed"]
    if alias is None and (after := re.match(r"(?is)\s+(?:AS\s+)?(?!(?:WHERE|JOIN|INNER|LEFT|RIGHT|FULL|CROSS|NATURAL|GROUP|ORDER|LIMIT|HAVING|ON|USING|UNION|INTERSECT|EXCEPT|WINDOW|OFFSET)\b)(\w+)", rest)):
        alias, rest = after[1], rest[after.end() :]
    if seed is not None and seed.strip().upper() == "NULL":
        raise sampling.SampleError("TABLESAMPLE REPEATABLE parameter cannot be null")
    seed = int(float(seed)) if seed is not None else uuid.uuid4().int % (1 << 31)
    size = None if m["size"].upper() == "NULL" else float(m["size"])
    if method == "SWR":
        where = _where(rest)
        # A row of an outer join's other side has no draw, so its predicates bind the sampled rows only where all joins are inner.
        outer = re.search(r"(?i)\b(LEFT|RIGHT|FULL)\b", rest)
        inside = key_range(where, how.key, (alias or name,)) if where and not outer else None
        sampled = sampling.swr_sample(df.where(inside) if inside else df, None if size is None else int(size), how.layout, seed)
    elif method == "BERNOULLI":
        sampled = sampling.bernoulli_sample(df, size, how.layout.identity, seed)
    elif method == "SYSTEM":
        sampled = sampling.system_sample(df, size, F.expr(how.block or how.layout.identity[0]), seed)
    elif method == "SYSTEM_TIME":
        sampled = sampling.time_sample(df, float("nan") if size is None else size, how.layout.identity, seed)
    else:
        sampled = sampling.rows_sample(df, None if size is None else int(size), how.layout.identity, seed)
    view = f"__sample_{uuid.uuid4().hex}"
    sampled.createOrReplaceTempView(view)
    try:
        return spark.sql(rewrite(text[: m.start()] + f"{m['lead']} {view} AS {alias or name}" + rest))
    finally:
        spark.catalog.dropTempView(view)


def explain_plan(spark: SparkSession, text: str, tables: dict[str, SampledTable]) -> str:
    """The plan of a query, with how its scan is sampled as the first line."""
    plan = sql(spark, text, tables)._jdf.queryExecution().simpleString()
    return "\n".join(x for x in (explain(text), plan) if x)


def explain(text: str) -> str:
    """How the scan of a query text is sampled; empty if it isn't."""
    m = SAMPLE.search(text)
    return sampling.explain_sampling(m["method"].lower(), [m["size"]], m["seed"]) if m else ""
