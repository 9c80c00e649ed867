"""SQL of formulas: the same graph of nodes, written out for a SQL engine."""

from __future__ import annotations

from panelwright.plans.formulas import Node


def settled(x: str) -> str:
    return f"round_even(({x}) * 1e9, 0)"


def _frame(d: int) -> str:
    return f"OVER (w ROWS {d - 1} PRECEDING)"


def _over(fn: str):
    return lambda x, d: f"CASE WHEN count({x}) {_frame(d)} >= {d} THEN {fn}({x}) {_frame(d)} END"


def _pairs(x: str, y: str) -> tuple[str, str]:
    return tuple(f"CASE WHEN ({x}) IS NOT NULL AND ({y}) IS NOT NULL THEN {z} END" for z in (x, y))


def _corr(x: str, y: str, d: int) -> str:
    a, b = _pairs(x, y)
    f = _frame(d)
    return f"CASE WHEN count({a}) {f} >= {d} AND min({a}) {f} < max({a}) {f} AND min({b}) {f} < max({b}) {f} THEN corr({x}, {y}) {f} END"


def _tsrank(x: str, d: int) -> str:
    s, f = settled(x), _frame(d)
    return f"CASE WHEN ({x}) IS NOT NULL AND count({x}) {f} >= {d} THEN (len(list_filter(list({s}) {f}, lambda e: e < {s})) + (len(list_filter(list({s}) {f}, lambda e: e = {s})) + 1) / 2.0) / count({x}) {f} END"


#: Nodes along a code, on windows w of the code's rows by date.
TS = {
    "lag": lambda x, d: f"lag({x}, {d}) OVER w",
    "diff": lambda x, d: f"({x}) - lag({x}, {d}) OVER w",
    "mean": _over("avg"), "std": _over("stddev_samp"), "sum": _over("sum"), "min": _over("min"), "max": _over("max"),
    "corr": _corr,
    "cov": lambda x, y, d: f"CASE WHEN count({_pairs(x, y)[0]}) {_frame(d)} >= {d} THEN covar_samp({x}, {y}) {_frame(d)} END",
    "tsrank": _tsrank,
    "argmax": lambda x, d: f"CASE WHEN count(*) {_frame(d)} = {d} AND count({x}) {_frame(d)} >= 1 THEN list_position(list(coalesce({x}, '-infinity'::DOUBLE)) {_frame(d)}, max({x}) {_frame(d)}) - 1 END",
    "decay": lambda x, n: "(" + " + ".join(f"{n - i} * " + (f"lag({x}, {i}) OVER w" if i else f"({x})") for i in range(n)) + f") / {n * (n + 1) / 2}",
}
#: Nodes across a date.
XS = {
    "rank": lambda x: f"CASE WHEN ({x}) IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {settled(x)} NULLS LAST) + (count(*) OVER (PARTITION BY date, {settled(x)}) - 1) / 2.0) / count({x}) OVER (PARTITION BY date) END",
    "scale": lambda x: f"({x}) / nullif(sum(abs({x})) OVER (PARTITION BY date), 0)",
}
EL = {
    "+": lambda a, b: f"({a} + {b})", "-": lambda a, b: f"({a} - {b})", "*": lambda a, b: f"({a} * {b})", "/": lambda a, b: f"({a} / nullif({b}, 0))", "neg": lambda a: f"(-{a})",
    ">": lambda a, b: f"({a} > {b})", "<": lambda a, b: f"({a} < {b})", "<=": lambda a, b: f"({a} <= {b})",
    "abs": lambda a: f"abs({a})", "sgn": lambda a: f"CAST(sign({a}) AS DOUBLE)", "ln": lambda a: f"CASE WHEN {a} > 0 THEN ln({a}) END", "if": lambda c, a, b: f"CASE WHEN {c} THEN {a} ELSE {b} END",
    "gt": lambda a, b: f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN greatest({a}, {b}) END", "lt": lambda a, b: f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN least({a}, {b}) END",
    "first unless second is less": lambda a, b: f"CASE WHEN {b} IS NULL OR {a} <= {b} THEN {a} ELSE {b} END",
}
#: The grid's names of inputs.
COLUMNS = {"volume": "v"}


def text(formulas: dict[str, Node], prefix: str = "") -> str:
    """CTEs over the grid g, one for each level of windows; the last, <prefix>values, has code, date and a column a formula."""
    names: dict[Node, str] = {}
    levels: dict[tuple[int, int], list[Node]] = {}

    def visit(n: Node) -> None:
        if n in names:
            return
        for a in n.args:
            visit(a)
        if n.kind != "el":
            names[n] = f"n{len(names)}"
            levels.setdefault((n.phase, n.depth), []).append(n)

    def value(n: Node) -> str:
        name, *parameters = n.key
        if name == "lit":
            return f"{parameters[0]!r}::DOUBLE"
        if name == "col":
            return COLUMNS.get(parameters[0], parameters[0])
        return names[n] if n in names else "(" + EL[name](*map(value, n.args)) + ")"

    def window(n: Node) -> str:
        name, *parameters = n.key
        own = names.pop(n)
        out = f"{(TS if n.kind == 'ts' else XS)[name](*map(value, n.args), *parameters)} AS {own}"
        names[n] = own
        return out

    for f in formulas.values():
        visit(f)
    before, out = "g", []
    for i, level in enumerate(sorted(levels)):
        columns = ", ".join(window(n) for n in levels[level])
        out.append(f"{prefix}l{i} AS (SELECT *, {columns} FROM {before} WINDOW w AS (PARTITION BY code ORDER BY date))")
        before = f"{prefix}l{i}"
    last = ", ".join(f"CASE WHEN isfinite(CAST({value(f)} AS DOUBLE)) THEN CAST({value(f)} AS DOUBLE) END AS {name}" for name, f in formulas.items())
    return ",\n".join([*out, f"{prefix}values AS (SELECT code, date, {last} FROM {before})"])
