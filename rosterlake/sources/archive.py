"""Versions of a round's predictions with their roster, published together.

A round is written under a version of its own, predictions and roster side by side. Its season's manifest says which version
counts; a new manifest is written aside and put in place by one rename to the next number, which fails where another writer
has been faster. Readers go through the newest manifest, so they see the old pair or the new one, never one of each, wherever
a writer has stopped. Versions that no manifest names stay until ``vacuum``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.operators.quality import identity_mismatches, raise_if_any
from rosterlake.sources.predictions import PARTITION, tag_rows

_IDENTITY = ["full_name", "team_name", "team_id"]
_MANIFEST = "gameweek int, version string"


class RoundArchive:
    """The archive under ``path``; any number of seasons."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, predictions: DataFrame, roster: DataFrame, season: str, gameweek: int) -> str:
        """Validate, write and publish one round, in place of what was published for it; returns its version. Rows that are
        tagged for another season or round, or that do not match the roster, stop it before anything is written."""
        raise_if_any(
            identity_mismatches(predictions, roster, "player_id", _IDENTITY), f"round {gameweek} does not match the roster"
        )
        tagged = tag_rows(predictions, season, gameweek)
        version = uuid.uuid4().hex
        home = self._home(season, version)
        self._write(tagged.sortWithinPartitions(F.desc_nulls_last("expected_points")), f"{home}/predictions")
        self._write(roster.withColumns({"season_name": F.lit(season), "gameweek": F.lit(gameweek)}), f"{home}/roster")
        self.publish(season, {gameweek: version})
        return version

    def _write(self, df: DataFrame, path: str) -> None:
        df.write.parquet(path)

    def publish(self, season: str, versions: dict[int, str]) -> None:
        """Make versions count, all of them or none."""
        number, published = self._manifest(season)
        rows = sorted((published | versions).items())
        aside = f"{self.path}/aside/{uuid.uuid4().hex}"
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.json(aside)
        files, to = self._files(f"{self._manifests(season)}/{number + 1:08d}.json")
        files.mkdirs(to.getParent())
        written = next(s.getPath() for s in files.listStatus(self._at(aside)) if s.getPath().getName().startswith("part-"))
        if files.exists(to) or not files.rename(written, to):
            raise RuntimeError(f"another writer has published {season}; write the round again")

    def rounds(self, season: str) -> DataFrame:
        """(gameweek, version) of what is published."""
        return self.spark.createDataFrame(sorted(self._manifest(season)[1].items()), _MANIFEST)

    def predictions(self, season: str, first: int | None = None, last: int | None = None) -> DataFrame:
        """Published rounds of a season; only their files are read. None at all is an error."""
        return self._read(season, "predictions", first, last)

    def rosters(self, season: str, first: int | None = None, last: int | None = None) -> DataFrame:
        """The rosters that the same rounds were published with."""
        return self._read(season, "roster", first, last)

    def vacuum(self, season: str) -> int:
        """Delete versions that the newest manifest does not name, and older manifests. Not for use beside a writer."""
        number, published = self._manifest(season)
        files, home = self._files(f"{self.path}/versions/season={season}")
        gone = [s.getPath() for s in files.listStatus(home) if s.getPath().getName() not in published.values()] if files.exists(home) else []
        _, manifests = self._files(self._manifests(season))
        old = [s.getPath() for s in files.listStatus(manifests) if _number(s) < number] if files.exists(manifests) else []
        for place in gone + old:
            files.delete(place, True)
        return len(gone)

    def _read(self, season: str, part: str, first: int | None, last: int | None) -> DataFrame:
        _, published = self._manifest(season)
        wanted = [v for g, v in sorted(published.items()) if (first is None or g >= first) and (last is None or g <= last)]
        if not wanted:
            raise ValueError(f"no round of {season} from {first} to {last} is published under {self.path}")
        return self.spark.read.option("mergeSchema", True).parquet(*[f"{self._home(season, v)}/{part}" for v in wanted])

    def _manifest(self, season: str) -> tuple[int, dict[int, str]]:
        """The newest number and its versions by round: at most one row a round of the season."""
        files, folder = self._files(self._manifests(season))
        numbers = [_number(s) for s in files.listStatus(folder)] if files.exists(folder) else []
        if not numbers:
            return 0, {}
        rows = self.spark.read.schema(_MANIFEST).json(f"{self._manifests(season)}/{max(numbers):08d}.json").collect()
        return max(numbers), {r.gameweek: r.version for r in rows}

    def _home(self, season: str, version: str) -> str:
        return f"{self.path}/versions/season={season}/{version}"

    def _manifests(self, season: str) -> str:
        return f"{self.path}/manifests/season={season}"

    def _at(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self, path: str):
        place = self._at(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place


def _number(status) -> int:
    return int(status.getPath().getName().split(".")[0])


def migrate(archive: RoundArchive, legacy: DataFrame, roster: DataFrame, season: str, gameweek: int) -> str:
    """Bring untagged rows of an old file into the archive (A16): tagged, held against the roster, published with it."""
    return archive.write(legacy.drop(*[c for c in PARTITION if c in legacy.columns and legacy.filter(F.col(c).isNotNull()).isEmpty()]), roster, season, gameweek)
