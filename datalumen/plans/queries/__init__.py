"""All registered queries; importing this package fills the registry."""

from datalumen.plans.queries import (  # noqa: F401
    cleaning, exploration, inspection, relational, reports, statistics, streams, tables, text,
)
