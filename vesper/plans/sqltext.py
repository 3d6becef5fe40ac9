"""A formula as SQL text over plain tables, for other engines to compare with.

It states the semantics by SQL's own means (RANGE frames, self-joins, IGNORE NULLS), node by node, as a chain
of common table expressions over ``base`` (trace, t, s0, s1, ...).
"""

from __future__ import annotations

from .formula import Formula, expression_over, micros, normalize

INF = "'Infinity'::double"


def signals_base(names: list[str], source: str, synchronization: str = "None", late: bool = False, until: str = "") -> str:
    """``base`` from a subquery giving (trace, signal, t, value) and, to drop late samples, arrival_seq."""
    kept = f"select trace, signal, t, min(value) as value, null::bigint as reached from ({source}) group by all"
    if late:
        kept = f"select trace, signal, t, value, max(t) over (partition by trace, signal order by arrival_seq rows between unbounded preceding and 1 preceding) as reached from ({source})"
    columns = ", ".join(f"max(case when signal = '{n}' then value end) as s{i}" for i, n in enumerate(names))
    inside = ", ".join(f"'{n}'" for n in names)
    text = f"kept as ({kept}), wide as (select trace, t, {columns} from kept where (reached is null or t > reached) and signal in ({inside}) {until} group by trace, t)"
    if synchronization == "None":
        return text + ", base as (select * from wide)"
    past, ahead = "(partition by trace order by t rows between unbounded preceding and current row)", "(partition by trace order by t rows between current row and unbounded following)"
    if synchronization == "ZeroOrderHold":
        held = ", ".join(f"case when count(s{i}) over {ahead} > 0 then last_value(s{i} ignore nulls) over {past} end as s{i}" for i in range(len(names)))
        return text + f", base as (select trace, t, {held} from wide)"
    ends = ", ".join(
        f"last_value(s{i} ignore nulls) over {past} as v{i}, last_value(case when s{i} is not null then t end ignore nulls) over {past} as a{i}, "
        f"first_value(s{i} ignore nulls) over {ahead} as w{i}, first_value(case when s{i} is not null then t end ignore nulls) over {ahead} as b{i}" for i in range(len(names))
    )
    line = ", ".join(f"coalesce(s{i}, v{i} + (w{i} - v{i}) * (((t - a{i}) / 1e6) / ((b{i} - a{i}) / 1e6))) as s{i}" for i in range(len(names)))
    return text + f", ends as (select *, {ends} from wide), base as (select trace, t, {line} from ends)"


def verdict_sql(formula: Formula, base: str, semantics: str = "DelayedQuantitative", names: list[str] | None = None, ignore_start: bool = False, thresholds: dict[str, str] | None = None) -> str:
    formula = normalize(formula)
    sampled = names or formula.bases()
    names = sampled + formula.derived()
    truth, rosi = semantics == "DelayedQualitative", semantics == "Rosi"
    ends = ("lo", "hi") if rosi else ("v",)
    steps, last, member = [base], "base", {}
    if made := names[len(sampled) :]:
        columns = {b: f"s{i}" for i, b in enumerate(sampled)}
        steps.append(f"derived as (select *, {', '.join(f'{expression_over(n, columns)} as s{i}' for i, n in enumerate(made, len(sampled)))} from base)")
        last = "derived"

    def column(node: Formula, end: str) -> str:
        return f"n{node.key}_{end}"

    for node in formula.walk():
        made: dict[str, str] = {}
        p = node.parts
        frame = ""
        if node.kind in ("always", "eventually"):
            frame = f"(partition by trace order by t range between {micros(node.args[0])} following and {micros(node.args[1])} following)"
        match node.kind:
            case "true" | "false":
                member[node.key] = "true"
                made = dict.fromkeys(ends, node.kind if truth else ("" if node.kind == "true" else "-") + INF)
            case "gt" | "lt" | "gt_var" | "lt_var":
                s = f"s{names.index(node.args[0])}"
                limit = f"({node.args[1]!r})" if isinstance(node.args[1], float) else (thresholds or {})[node.args[1]]
                member[node.key] = f"({s} is not null and {limit} is not null)"
                above = node.kind.startswith("gt")
                made = dict.fromkeys(ends, f"{s} {'>' if above else '<'} {limit}" if truth else f"{s} - {limit} + 0.0" if above else f"{limit} - {s} + 0.0")
            case "not":
                member[node.key] = member[p[0].key]
                swap = dict(zip(ends, reversed(ends), strict=True))
                made = {e: f"not {column(p[0], e)}" if truth else f"-{column(p[0], swap[e])} + 0.0" for e in ends}
            case "and" | "or":
                member[node.key] = f"({member[p[0].key]} and {member[p[1].key]})"
                pick = {"and": "least", "or": "greatest"}[node.kind]
                made = {e: f"{column(p[0], e)} {node.kind} {column(p[1], e)}" if truth else f"{pick}({column(p[0], e)}, {column(p[1], e)})" for e in ends}
            case "always" | "eventually":
                member[node.key] = member[p[0].key]
                up = node.kind == "eventually"
                empty = str(not up).lower() if truth else ("-" if up else "") + INF
                pick = {(True, True): "bool_or", (True, False): "bool_and", (False, True): "max", (False, False): "min"}[(truth, up)]
                for e in ends:
                    made[e] = f"coalesce({pick}({column(p[0], e)}) over {frame}, {empty})"
                if rosi:
                    still = f"t + {node.depth} > max(case when {member[p[0].key]} then t end) over (partition by trace)"
                    e = "hi" if up else "lo"
                    made[e] = f"case when {still} then {'' if up else '-'}{INF} else {made[e]} end"
            case "until":
                member[node.key] = f"({member[p[0].key]} and {member[p[1].key]})"
                start, end = (0 if ignore_start else micros(node.args[0])), micros(node.args[1])
                rows = f"select trace, t, {', '.join(column(x, e) + ' as ' + w + '_' + e for w, x in zip('lr', p, strict=True) for e in ends)} from {last} where {member[node.key]}"
                reach = ", ".join(f"{'bool_and' if truth else 'min'}(j.l_{e}) over (partition by i.trace, i.t order by j.t) as m_{e}, j.r_{e} as r_{e}" for e in ends)
                pairs = f"select i.trace, i.t, j.t as u, {reach} from u{node.key} i join u{node.key} j on i.trace = j.trace and j.t between i.t and i.t + {end}"
                best = ", ".join((f"coalesce(bool_or(m_{e} and r_{e}) filter (where u >= t + {start}), false)" if truth else f"coalesce(max(least(m_{e}, r_{e})) filter (where u >= t + {start}), -{INF})") + f" as {column(node, e)}" for e in ends)
                steps += [f"u{node.key} as ({rows})", f"p{node.key} as ({pairs})", f"x{node.key} as (select trace, t, {best} from p{node.key} group by trace, t)"]
                steps.append(f"c{node.key} as (select c.*, {', '.join('x.' + column(node, e) for e in ends)} from {last} c left join x{node.key} x on c.trace = x.trace and c.t = x.t)")
                last = f"c{node.key}"
                if rosi:
                    hi = column(node, "hi")
                    steps.append(f"d{node.key} as (select * replace (case when t + {node.depth} > max(case when {member[node.key]} then t end) over (partition by trace) then {INF} else {hi} end as {hi}) from {last})")
                    last = f"d{node.key}"
                continue
        made = {e: f"case when {member[node.key]} then {x} end" for e, x in made.items()}
        steps.append(f"c{node.key} as (select *, {', '.join(f'{x} as {column(node, e)}' for e, x in made.items())} from {last})")
        last = f"c{node.key}"
    if rosi:
        final = f"select trace, t, {column(formula, 'lo')} as lo, {column(formula, 'hi')} as hi from {last} where {member[formula.key]}"
    else:
        final = f"select trace, t, {column(formula, 'v')} as value from (select *, max(t) over (partition by trace) as newest from {last}) where {member[formula.key]} and t + {formula.depth} <= newest"
    return "with " + ", ".join(steps) + " " + final
