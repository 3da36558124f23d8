"""Oracle-side helpers: inline the binding views a query uses as WITH clauses.

The driver registers only the base tables in DuckDB; each oracle statement
therefore carries the bindings it reads. Bindings shared with Spark come from
``BINDING_SQL``; views whose text differs between the engines (ordered list
aggregation, JSON helpers) are written here in DuckDB's dialect.
"""

from __future__ import annotations

import re

from careflow.sources.bindings import BINDING_SQL

# DuckDB texts of derived views (the Spark side builds them with DataFrames).
DUCK_VIEWS: dict[str, str] = {
    "b_clinical": """
SELECT c.*, coalesce(i.prescriptions, []::VARCHAR[]) AS prescriptions,
       coalesce(i.lab_tests, []::VARCHAR[]) AS lab_tests,
       coalesce(i.symptoms, []::VARCHAR[]) AS symptoms
FROM b_consultations c LEFT JOIN (
  SELECT consultation_id,
         list(medicine ORDER BY line, part_id) AS prescriptions,
         list_sort(list_distinct(list(test))) AS lab_tests,
         list_sort(list_distinct(flatten(list(string_split(medicine, ' '))))) AS symptoms
  FROM b_items GROUP BY consultation_id) i ON c.consultation_id = i.consultation_id""",
}

_REF = re.compile(r"\bb_[a-z_]+\b")


def oracle_with(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the WITH clauses of every binding it references."""
    views = {**DUCK_VIEWS, **(extra or {})}
    order: list[str] = []

    def visit(n: str):
        if n in order:
            return
        text = BINDING_SQL.get(n) or views.get(n)
        if text is None:
            return
        for d in dict.fromkeys(_REF.findall(text)):
            if d != n:
                visit(d)
        order.append(n)

    for n in dict.fromkeys(_REF.findall(sql)):
        visit(n)
    if not order:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS ({(BINDING_SQL.get(n) or views[n]).strip()})" for n in order)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
