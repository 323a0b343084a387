"""Where queries and their SQL are kept."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Registers a query by its name, with SQL that gives the same rows if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


#: White space in SQL, as functions.text.SPACE has it.
SPACE_SQL = r"[\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def stripped(x: str) -> str:
    """strip() in SQL."""
    return f"regexp_replace({x}, '^{SPACE_SQL}+|{SPACE_SQL}+$', '', 'g')"
