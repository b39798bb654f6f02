"""A per-run bundle of the base tables and the tracker views built on them."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_conf
from ..sources import adapters
from ..sources.settings import user_settings
from ..sources.tables import Tables

# Dates the fixtures are built around (FIXTURES.md): the event log covers
# January 2024; problems and plans cover 1992-1998 order/ship dates.
AS_OF_LOG = "2024-01-20"
AS_OF_PLAN = "1998-03-04"


class Ctx:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = ensure_conf(spark)
        self.t = Tables(spark, sf_dir)

    def __getattr__(self, name: str) -> DataFrame:
        fn = getattr(adapters, name, None)
        if fn is None or name.startswith("_"):
            raise AttributeError(name)
        return fn(self.t)

    @cached_property
    def user_settings(self) -> DataFrame:
        return user_settings(self.users, self.settings)

    def register_views(self) -> None:
        """Temp views of the base tables and of every tracker view, so SQL
        users can write ``spark.sql("select ... from problems")``."""
        self.t.register_views()
        for name in ("users", "problems", "daily_log", "daily_plan", "projects", "milestones", "algorithms",
                     "settings", "articles", "imports", "prompts", "tasks", "status_events", "activity",
                     "feedback", "sheet_rows", "sheet_cells"):
            getattr(self, name).createOrReplaceTempView(name)
        self.user_settings.createOrReplaceTempView("user_settings")
