"""All queries."""

from __future__ import annotations

from textloom.plans import analytics, calendars, editorial, history, lexicons, personas, posts, profiles, schemas, texts  # noqa: F401
from textloom.plans.registry import FIXTURE_SQL, FIXTURES, QUERIES, SQL  # noqa: F401
