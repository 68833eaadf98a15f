"""The four normalized tables a report reads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.schema import MATCHES, METRICS

VIEWS = ("competitions", "teams", "matches", "match_metrics")


@dataclass(frozen=True)
class MatchTables:
    """Competitions, teams, matches and match metrics.

    ``wide`` holds each match with its metrics on one row, where the storage
    already keeps them together; it spares the reports the one-to-one join of
    the two large tables.
    """

    competitions: DataFrame
    teams: DataFrame
    matches: DataFrame
    match_metrics: DataFrame
    wide: DataFrame | None = None

    @classmethod
    def from_wide(cls, competitions: DataFrame, teams: DataFrame, wide: DataFrame) -> MatchTables:
        # A match with unknown goals may still have metrics.
        measured = wide.filter(F.coalesce("total_goals", "home_win").isNotNull())
        return cls(
            competitions=competitions,
            teams=teams,
            matches=wide.select(*MATCHES.names),
            match_metrics=measured.select(F.col("id").alias("match_id"), *METRICS),
            wide=measured,
        )

    @property
    def results(self) -> DataFrame:
        """Every match, metrics or not."""
        return self.matches.withColumnRenamed("id", "match_id")

    @property
    def facts(self) -> DataFrame:
        """Matches with their metrics; a match without metrics is left out."""
        if self.wide is not None:
            return self.wide.withColumnRenamed("id", "match_id")
        return self.results.join(self.match_metrics, "match_id")

    def leagues(self, code: str | None = None) -> DataFrame:
        rows = self.competitions.select(
            F.col("id").alias("competition_id"),
            F.col("code").alias("competition_code"),
            F.col("name").alias("competition"),
        )
        return rows if code is None else rows.filter(F.col("competition_code") == code)

    def in_league(self, rows: DataFrame, code: str | None = None) -> DataFrame:
        """Rows of one league, or of all, with the league's code and name."""
        return rows.join(self.leagues(code), "competition_id")

    def named(self, rows: DataFrame, key: str = "team_id", into: str = "team") -> DataFrame:
        """Rows with the team's name; rows of an unknown team are left out."""
        names = self.teams.select(F.col("id").alias(key), F.col("name").alias(into))
        return rows.join(names, key)

    def query(self, sql: str, **params) -> DataFrame:
        """Run SQL with ``:name`` parameters over the four tables.

        Temporary views of the session with their names are put back afterwards.
        """
        spark = self.competitions.sparkSession
        own = {t.name for t in spark.catalog.listTables() if t.isTemporary}
        before = {view: spark.table(view) for view in VIEWS if view in own}
        for view in VIEWS:
            getattr(self, view).createOrReplaceTempView(view)
        try:
            return spark.sql(sql, args=params)
        finally:
            for view in VIEWS:
                spark.catalog.dropTempView(view)
            for view, frame in before.items():
                frame.createOrReplaceTempView(view)
