"""User cohorts and money flows of a fundraising platform, as Spark DataFrame operators."""

from cohortloom.config import Config

__all__ = ["Config"]
