"""A session: programs in, tables, listings and log messages out; state stays between programs."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession

from stepframe.frame import Library, Table, from_dataframe
from stepframe.lang.macro import Macros
from stepframe.lang.parser import DataStep, Global, ProcStep, parse
from stepframe.plans.procs import Listing, run_proc
from stepframe.plans.step import run_step
from stepframe.shared import ship_package
from stepframe.sources.databases import assign

log = logging.getLogger("stepframe")


class _Counter(logging.Handler):
    """Counts the errors that are logged while a session's program runs."""

    def __init__(self):
        super().__init__(logging.ERROR)
        self.n = 0

    def emit(self, record: logging.LogRecord) -> None:
        self.n += 1


class Session:
    """html: also keep every PROC PRINT as an HTML table in listing.html."""

    def __init__(self, spark: SparkSession, html: bool = False):
        ship_package(spark)
        self.spark, self.library, self.macros, self.listing = spark, Library(spark), Macros(), Listing()
        self.listing.html = [] if html else None
        self._errors = _Counter()

    @property
    def errors(self) -> int:
        return self._errors.n

    def submit(self, text: str) -> list[str]:
        """Runs a program; returns the lines it listed. A text that does not parse runs nothing; a failing step ends the program."""
        steps = parse(self.macros.expand(text))
        before = len(self.listing)
        log.addHandler(self._errors)
        try:
            for step in steps:
                if isinstance(step, DataStep):
                    self._note(run_step(step, self.library))
                elif isinstance(step, ProcStep):
                    run_proc(step, self.library, self.listing)
                else:
                    self._global(step)
        finally:
            log.removeHandler(self._errors)
        return list(self.listing[before:])

    def _note(self, made: dict[str, Table]) -> None:
        """A note on every table a step made; rows are counted only if somebody reads notes of this detail."""
        for name, t in made.items():
            full = (name if "." in name else f"work.{name}").upper()
            if log.isEnabledFor(logging.DEBUG):
                log.info("NOTE: The data set %s has %d observations and %d variables.", full, t.df.count(), len(t.vars))
            else:
                log.info("NOTE: The data set %s has %d variables.", full, len(t.vars))

    def _global(self, g: Global) -> None:
        p = g.parts
        if g.kind != "libname":
            self.library.title(g.kind, p["level"], p["text"])
        elif p["clear"]:
            self.library.librefs.pop(p["lib"], None)
        else:
            try:
                self.library.librefs[p["lib"]] = assign(self.spark, p["engine"], p["path"])
            except ValueError as x:
                log.error("LIBNAME %s: %s", p["lib"], x)

    def add(self, name: str, df: DataFrame) -> Table:
        """A DataFrame as a WORK table."""
        self.library.tables[name.lower()] = t = from_dataframe(df)
        return t

    def table(self, name: str) -> Table:
        lib, _, member = name.rpartition(".")
        return self.library.get(lib, member)

    def dataframe(self, name: str) -> DataFrame:
        return self.table(name).data()
