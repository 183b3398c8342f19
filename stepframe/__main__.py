"""python -m stepframe run FILE | parse FILE | tokens FILE | test DIR [--parse-only] [--json] [-v] | repl

test: every folder under DIR with a program.sas is a case; each <table>.csv beside it holds the rows expected of that
table, in order. Columns compare without case, numbers within 1e-9 of their size or 1e-6.
"""

from __future__ import annotations

import csv
import json
import sys
from pathlib import Path


def read_cases(top: Path) -> list[Path]:
    return sorted(p.parent for p in top.rglob("program.sas"))


def same(got, want: str) -> bool:
    if got is None or isinstance(got, float):
        if want in ("", "."):
            return got is None
        try:
            return got is not None and abs(got - float(want)) <= max(1e-6, 1e-9 * abs(float(want)))
        except ValueError:
            return False
    return got == want


def run_case(spark, case: Path, parse_only: bool) -> str:
    """'' or what is wrong."""
    from stepframe.lang.macro import Macros
    from stepframe.lang.parser import parse
    from stepframe.session import Session

    text = (case / "program.sas").read_text(encoding="utf-8")
    try:
        if parse_only:
            parse(Macros().expand(text))
            return ""
        session = Session(spark)
        session.submit(text)
        for path in sorted(case.glob("*.csv")):
            with path.open(newline="", encoding="utf-8") as f:
                head, *rows = csv.reader(f)
            table = session.table(path.stem)
            if [n.lower() for n in table.names] != [h.lower() for h in head]:
                return f"{path.stem}: columns {table.names}"
            got = table.rows()
            if len(got) != len(rows):
                return f"{path.stem}: {len(got)} rows, not {len(rows)}"
            for k, (g, w) in enumerate(zip(got, rows, strict=True), 1):
                if not all(map(same, g, w)):
                    return f"{path.stem}, row {k}: {g}"
    except Exception as x:  # a case that fails is reported, and the next one runs
        return f"{type(x).__name__}: {x}"
    return ""


def run_cases(args: list[str], spark=None) -> int:
    flags, folders = {a for a in args if a.startswith("-")}, [a for a in args if not a.startswith("-")]
    if spark is None and "--parse-only" not in flags:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.getOrCreate()
    results = {str(c): run_case(spark, c, "--parse-only" in flags) for c in read_cases(Path(folders[0] if folders else "."))}
    failed = {k: v for k, v in results.items() if v}
    if "--json" in flags:
        print(json.dumps({"passed": len(results) - len(failed), "failed": failed}))
    else:
        for k, v in results.items():
            if v or flags & {"-v", "--verbose"}:
                print(f"{'FAIL' if v else 'ok'}  {k}" + (f"  {v}" if v else ""))
        print(f"{len(results) - len(failed)} passed, {len(failed)} failed")
    return int(bool(failed) or not results)


def main(args: list[str]) -> int:
    from stepframe.lang.macro import Macros
    from stepframe.lang.parser import ParseError, Tokens, cut, parse

    if len(args) >= 2 and args[0] in ("parse", "tokens"):
        text = Macros().expand(Path(args[1]).read_text(encoding="utf-8"))
        if args[0] == "parse":
            print(*parse(text), sep="\n")
        else:
            for piece in cut(text):
                for kind, value, *_ in Tokens(piece.text).items:
                    print(f"{kind:<4} {value if isinstance(value, str) else value[0]!r}")
        return 0
    if args[:1] == ["test"]:
        return run_cases(args[1:])
    if not args or args[0] not in ("run", "repl") or (args[0] == "run" and len(args) < 2):
        print(__doc__)
        return 2
    from pyspark.sql import SparkSession

    from stepframe.session import Session

    session = Session(SparkSession.builder.getOrCreate())
    if args[0] == "run":
        print("\n".join(session.submit(Path(args[1]).read_text(encoding="utf-8"))))
        return int(session.errors > 0)
    held: list[str] = []
    for line in sys.stdin:
        held.append(line)
        if line.strip().lower() in ("run;", "quit;"):
            try:
                print("\n".join(session.submit("".join(held))))
            except (ParseError, KeyError, ValueError) as x:
                print(f"ERROR: {x}")
            held = []
    return int(session.errors > 0)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
