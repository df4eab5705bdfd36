"""Catalogued queries."""

from . import event_queries, evidence_queries, function_queries, item_queries, key_queries, schema_queries, state_queries, text_queries  # noqa: F401  they register themselves
