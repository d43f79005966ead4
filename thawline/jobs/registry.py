"""All queries over the given tables, and the SQL that each must agree with."""

from thawline.jobs.oracles import ORACLES
from thawline.jobs.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
