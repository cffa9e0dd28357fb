"""Every registered query and its SQL."""

from __future__ import annotations

from lodestone.plans import catalog_queries, manual_queries, more_queries, parts_queries, task_queries, text_queries

QUERIES = {**parts_queries.Q, **text_queries.Q, **more_queries.Q, **catalog_queries.Q, **manual_queries.Q, **task_queries.Q}
ORACLES = {**parts_queries.SQL, **text_queries.SQL, **more_queries.SQL, **catalog_queries.SQL, **manual_queries.SQL, **task_queries.SQL}
