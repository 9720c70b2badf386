"""Named queries over the star schema, each with its SQL twin where SQL can say it."""

from sparkgrid.catalog import aggregates, cleaning, gaps, kept, learning, ordered, reporting, tables  # noqa: F401
from sparkgrid.catalog.base import QUERIES, SQL  # noqa: F401
