"""The pipeline of a region: convert, merge, clean, dedup, compare, summary."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..functions.keys import KeyOptions
from ..operators.cleaning import Box, drop_na, drop_qc, filter_region
from ..operators.compare import compare
from ..operators.duplicates import drop_duplicate_profiles, mark_duplicates
from .pages import page
from .render import duplicates_tsv, emit, write_report
from .report import report


@dataclass(frozen=True)
class Region:
    include: Box
    exclude: tuple[Box, ...] = ()


#: Boxes of the regions (west, east, south, north).
REGIONS = {
    "arctic": Region(Box(-180, 180, 60, 90)),
    "baltic": Region(Box(6, 30, 53, 66), (Box(6, 15, 60, 66),)),
    "mediterranean": Region(Box(-5.61, 35.567, 28.378, 45.755), (Box(27, 36, 41, 46), Box(-5.61, 0, 42, 46))),
}


class Pipeline:
    """Stages of one region over several products (stem -> merged table). Each stage's table goes to
    ``output/<stage>/<stem>.parquet`` and its report to ``report/<stage>/<stem>.parquet.tsv``."""

    def __init__(self, spark: SparkSession, region: str, root: str | Path, key: KeyOptions = KeyOptions()):
        self.spark, self.region, self.root, self.key = spark, REGIONS[region], Path(root), key

    def _keep(self, stage: str, stem: str, df: DataFrame) -> DataFrame:
        path = self.root / "output" / stage / f"{stem}.parquet"
        df.write.mode("overwrite").parquet(str(path))
        out = self.spark.read.parquet(str(path))
        dest = self.root / "report" / stage / f"{stem}.parquet.tsv"
        dest.parent.mkdir(parents=True, exist_ok=True)
        write_report(report(out, "platform"), "tsv", dest)
        return out

    def run(self, products: dict[str, DataFrame]) -> dict[str, str]:
        """Runs all stages; returns the summary page of each product. An empty mapping does nothing."""
        final = {}
        for stem, df in products.items():
            df = self._keep("convert", stem, df)
            df = self._keep("clean/dropqc", stem, drop_qc(df))
            df = self._keep("clean/dropna", stem, drop_na(df))
            df = self._keep("clean/filter", stem, filter_region(df, self.region.include, self.region.exclude))
            marked, dups = mark_duplicates(df, self.key)
            df = self._keep("dedup/markdup", stem, marked)
            emit(duplicates_tsv(dups), self.root / "output" / "dedup" / "markdup" / f"{stem}.dups.tsv")
            final[stem] = self._keep("dedup/dedup", stem, drop_duplicate_profiles(df, self.key))
        folder = self.root / "report" / "compare"
        folder.mkdir(parents=True, exist_ok=True)
        stems = list(final)
        for i, a in enumerate(stems):
            for b in stems[i + 1 :]:
                write_report(compare(final[a], final[b], a, b), "tsv", folder / f"{a}__{b}.tsv")
        pages = {}
        for stem in stems:
            pages[stem] = page(stem, self.root / "report", self.root / "output")
            dest = self.root / "summary" / f"{stem}.md"
            dest.parent.mkdir(parents=True, exist_ok=True)
            dest.write_text(pages[stem])
        return pages
