"""Registry of queries and of the SQL each one is checked against.

``views`` holds named SQL subqueries (the DuckDB side of the fixture views);
``oracle`` prepends the ones a statement mentions, in dependency order.
"""

import re

QUERIES = {}
ORACLES = {}
VIEWS = {}


def view(name, sql):
    """Register the SQL text of a fixture view."""
    VIEWS[name] = sql


def _mentions(sql, known):
    words = set(re.findall(r"[a-z_][a-z0-9_]*", sql))
    return [name for name in known if name in words]


def oracle(sql):
    """Full statement: the fixture views the SQL needs, then the SQL itself."""
    needed = set()
    todo = [sql]
    while todo:
        for name in _mentions(todo.pop(), VIEWS):
            if name not in needed:
                needed.add(name)
                todo.append(VIEWS[name])
    if not needed:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS (\n{VIEWS[n].strip()}\n)" for n in VIEWS if n in needed)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def query(name, sql=None):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return fn

    return wrap
