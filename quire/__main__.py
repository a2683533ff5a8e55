"""Converts books: one, or a folder of them.

    python -m quire convert BOOK [-o OUT] ...
    python -m quire folder FOLDER -o OUT ...        (python -m quire FOLDER -o OUT is the same)
"""

from __future__ import annotations

import argparse
import importlib
import os
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession

from quire.operators import batch as B
from quire.plans import folder as D
from quire.plans.runs import Run
from quire.sinks.epub import checker

COMMANDS = ("convert", "convert-pdf", "folder")


def resolve_key(given: str | None, variable: str = "OCR_API_KEY") -> str | None:
    """The argument if there is one, even blank, else the environment's; blank counts as none."""
    key = os.environ.get(variable) if given is None else given
    return key.strip() or None if key else None


def loaded(name: str | None) -> Callable | None:
    """What module:function names."""
    if not name:
        return None
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def table_format(value: str) -> str:
    """html or markdown, in any case."""
    if value.strip().lower() not in ("html", "markdown"):
        raise argparse.ArgumentTypeError(f"{value!r} is neither html nor markdown")
    return value.strip().lower()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quire", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = p.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        c = commands.add_parser(name)
        c.add_argument("input")
        c.add_argument("-o", "--output", required=name == "folder", help="a folder, or for one book the file to write: beside it if left out")
        c.add_argument("--cache", default=".quire-cache")
        c.add_argument("--provider", help="module:function, called with a book's bytes and options")
        c.add_argument("--metadata-model", help="module:function, asked for what metadata a book lacks")
        c.add_argument("--table-format", type=table_format)
        for field in ("model", "title", "author", "publisher", "language"):
            c.add_argument(f"--{field}")
        c.add_argument("--debug", help="a folder for payloads and chapters to look at")
        c.add_argument("--epubcheck", help="a program that is run on each package before it is moved into place")
        c.add_argument("--fail-on-warn", action="store_true")
        for field in ("extract-header", "extract-footer"):
            c.add_argument(f"--{field}", action=argparse.BooleanOptionalAction, default=True)
        for field in ("no-cache", "comic", "delete-sources", "no-images", "check-packages", "quiet"):
            c.add_argument(f"--{field}", action="store_true")
        if name == "folder":
            c.add_argument("--recursive", action="store_true")
            c.add_argument("--run", help="a folder that keeps what has been done, to be cancelled and taken up again")
    return p


def settings_of(a: argparse.Namespace) -> D.Settings:
    chosen = {k: v for k, v in vars(a).items() if v is not None and k in D.Settings.__dataclass_fields__}
    return D.Settings(**chosen | {"include_images": not a.no_images})


def main(args: list[str] | None = None) -> int:
    args = list(sys.argv[1:] if args is None else args)
    if args and args[0] not in COMMANDS and not args[0].startswith("-"):
        args.insert(0, "folder")
    a = parser().parse_args(args)
    settings, provider, model = settings_of(a), loaded(a.provider), loaded(a.metadata_model)
    check = checker(a.epubcheck, a.fail_on_warn) if a.epubcheck else None
    spark = SparkSession.builder.appName("quire").getOrCreate()
    if a.command == "folder" and a.run:
        run = Run(spark, a.run)
        run.convert(a.input, a.output, a.cache, provider, settings, model=model, check=check)
        out = run.outcomes()
    elif a.command == "folder":
        out = D.convert_folder(spark, a.input, a.output, a.cache, provider, settings, check, model)
    else:
        out = D.convert_file(spark, a.input, a.output or os.path.splitext(a.input)[0] + ".epub", a.cache, provider, settings, ("pdf",) if a.command == "convert-pdf" else ("pdf", "cbz"), model, check)
    if not a.quiet:
        print("\n".join(B.report(out)))
    failure = B.first_failure(out).first()
    if failure is None and a.command != "folder" and out.isEmpty():
        print(f"{a.input}: no such book", file=sys.stderr)
        return 2
    return failure.exit_code if failure else 0


if __name__ == "__main__":
    sys.exit(main())
