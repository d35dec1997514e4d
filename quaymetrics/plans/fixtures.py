"""Oracle-side definitions of the input views."""

from quaymetrics.registry import cte
from quaymetrics.views import ASSIGNMENTS_SQL, VIEW_SQL

for _name, _sql in VIEW_SQL.items():
    cte(_name, _sql)
cte("assignments", ASSIGNMENTS_SQL)
