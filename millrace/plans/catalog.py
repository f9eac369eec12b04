"""All registered queries outside ``millrace.llm`` and their SQL."""

from ..functions import scalars, udfs
from ..operators import aggregates, changes, gaps, intervals, joins, ordered, percentiles, sets, windows
from ..sources import chunks, formats, ranges, stored
from ..streaming import event_time, stateful
from . import sql_text

FLAGSHIP = "region_revenue"
_FAMILIES = (joins, intervals, aggregates, percentiles, windows, ordered, gaps, changes, sets, scalars, udfs, ranges, formats, stored, chunks, event_time, stateful, sql_text)
QUERIES = {name: query for family in _FAMILIES for name, query in family.QUERIES.items()}
ORACLES = {name: sql for family in _FAMILIES for name, sql in family.ORACLES.items()}
