"""Small helpers for composing the oracle SQL."""

from __future__ import annotations


def num(x: float) -> str:
    """Double literal for DuckDB (a plain decimal literal would be DECIMAL)."""
    text = repr(float(x))
    return f"({text if 'e' in text else text + 'e0'})"


def case_map(key: str, table: dict) -> str:
    lit = lambda v: num(v) if isinstance(v, (int, float)) else f"'{v}'"
    return f"(case {key} " + " ".join(f"when '{k}' then {lit(v)}" for k, v in table.items()) + " end)"


def r(*names: str, digits: int = 6) -> str:
    """Rounded output columns; adding zero turns -0.0 into 0.0."""
    return ", ".join(f"round({n}, {digits}) + 0e0 as {n}" for n in names)


def rx(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0e0 as {name}"


def ctes(parts: list[tuple[str, str]], select: str) -> str:
    return "with recursive " + ",\n".join(f"{n} as ({q})" for n, q in parts) + "\n" + select


def layered(items: list[str], src: str) -> str:
    """select *, <items> from src, where an item may use names defined by earlier items.

    Items that depend on earlier ones go to an outer subquery (lateral aliases would be
    expanded in place and grow exponentially).
    """
    import re

    levels: list[list[tuple[str, str]]] = [[]]
    for item in items:
        expr, name = item.rsplit(" as ", 1)
        current = [n for _, n in levels[-1]]
        if any(re.search(rf"\b{re.escape(n)}\b", expr) for n in current):
            levels.append([])
        levels[-1].append((expr, name))
    query = src
    for level in levels:
        cols = ", ".join(f"{e} as {n}" for e, n in level)
        inner = query if query == src else f"({query})"
        query = f"select *, {cols} from {inner}"
    return query
