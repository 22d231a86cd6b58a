"""The test views as silver tables, written once for each data folder and session, and the record table built from them."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.plans.views import Views
from tickerloom.session import materialize
from tickerloom.sources.silver import bucketed, by_month

#: Tables of this session by (application, folder, state of its files, name).
_WRITTEN: dict[tuple, DataFrame] = {}

#: The lines lie by order: what is grouped by order (order lines, regulatory rows, filings) and joined with orders moves no line.
LAYOUT: dict[str, Callable[[DataFrame], DataFrame]] = {
    "v_lines": lambda df: bucketed(df, "lines", "orderkey"),
    "v_daily": lambda df: materialize(df, "daily"),
    "v_order_lines": lambda df: bucketed(df, "order_lines", "ord", deal=False),
    "v_financials": lambda df: materialize(df, "financials"),
    "v_profile": lambda df: bucketed(df, "profile"),
}
#: Views grouped by company and more: the lines are dealt to tasks by company once, so each company's rows end up in one file,
#: and the readers' row limits by symbol cut them before they move again.
BY_COMPANY = ("v_daily", "v_financials")
#: The layouts of lookups by company and by day.
LOOKUPS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "v_eod": lambda df: bucketed(df, "eod"),
    "v_filings": lambda df: by_month(df, "filings"),
    "v_calendar": lambda df: by_month(df, "calendar"),
}
#: What records read more than once, in order of what it is made from; each step's tables are written at the same time.
STEPS = (("v_lines", "v_profile"), ("v_daily", "v_order_lines", "v_financials"))


def folder_state(v: Views) -> int:
    """Changes when a file of the folder does: a digest of paths, lengths and times."""
    files = v.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(v.folder)
    return files.agg(F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first()[0] or 0


class SilverViews(Views):
    """The views over silver tables; a table is written when it is first used, or with others by ``prepare``."""

    def __init__(self, v: Views):
        super().__init__(v.spark, v.folder)
        self._key = (v.spark.sparkContext.applicationId, self.folder, folder_state(v))

    def stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The session's table of this name, built the first time."""
        key = (*self._key, name)
        if key not in _WRITTEN:
            _WRITTEN[key] = build()
        return _WRITTEN[key]

    def lookup(self, name: str) -> DataFrame:
        """A table in the layout for lookups."""
        return self.stored(f"lookup {name}", lambda: LOOKUPS[name](getattr(self, name)))

    def __getattr__(self, name: str) -> DataFrame:
        if name in LAYOUT and name not in self._built:
            plain = super().__getattr__
            if name in BY_COMPANY:
                plain = Views(self.spark, self.folder, v_lines=self.v_lines.repartition("suppkey")).__getattr__
            self._built[name] = self.stored(name, lambda: LAYOUT[name](plain(name)))
        return super().__getattr__(name)

    def prepare(self) -> SilverViews:
        """Write the tables that records read more than once."""
        for step in STEPS:
            with ThreadPoolExecutor(len(step)) as pool:
                list(pool.map(lambda name: getattr(self, name), step))
        return self
