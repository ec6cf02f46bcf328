"""Collects queries with the SQL that checks them."""
from checks import standins

QUERIES: dict = {}
SQL: dict = {}
DUCK = {**standins.duck(), "s_heads": standins.duck_heads()}
ORDER = list(DUCK)
NEEDS = {"s_det": ["s_tracks"], "s_videos": ["s_tracks"]}


def define(name: str, body: str, *needs: str) -> None:
    """A shared step of the checking SQL."""
    DUCK[name], NEEDS[name] = body, list(needs)
    ORDER.append(name)


def with_steps(sql: str, *needs: str, recursive: bool = False) -> str:
    todo, seen = list(needs), set()
    while todo:
        n = todo.pop()
        if n not in seen:
            seen.add(n)
            todo += NEEDS.get(n, [])
    steps = ",\n".join(f"{n} AS MATERIALIZED ({DUCK[n].strip()})" for n in ORDER if n in seen)
    return f"WITH {'RECURSIVE ' if recursive else ''}{steps}\n{sql.strip()}" if steps else sql.strip()


def query(name: str, sql: str | None = None, *needs: str):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_steps(sql, *needs)
        return fn
    return add


def r(x: str, n: int = 4) -> str:
    """Rounded in SQL, without negative zero."""
    return f"(ROUND({x}, {n}) + 0e0)"


def r9(x: str, n: int) -> str:
    """Nine exact digits, then rounded: a double's own ROUND leaves halves to its last bit."""
    return f"(CAST(ROUND(CAST({x} AS DECIMAL(18, 9)), {n}) AS DOUBLE) + 0e0)"
