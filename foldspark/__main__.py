"""The engine from a shell: python -m foldspark --mm a.mm --mm b.mm --output out.json"""

from __future__ import annotations

import argparse
import sys
from dataclasses import MISSING, fields

from . import __doc__ as about
from .params import Params

VERSION = "0.2.0"


def parser() -> argparse.ArgumentParser:
    """One option for each field of Params, ``_`` written as ``-``."""
    out = argparse.ArgumentParser(prog="foldspark", description=about, formatter_class=argparse.ArgumentDefaultsHelpFormatter)
    out.add_argument("--version", action="version", version=VERSION)
    for f in fields(Params):
        name = "--" + f.name.replace("_", "-")
        default = f.default if f.default is not MISSING else None
        if f.name == "mm":
            out.add_argument(name, action="append", required=True, help="a mutation map; once for each replicate, in order")
        elif isinstance(default, bool):
            out.add_argument(name, action="store_true", help=f.name)
        elif default is None:
            out.add_argument(name, help=f.name)
        else:
            out.add_argument(name, type=type(default) if not f.type.startswith("float") else float, default=default, help=f.name)
    return out


def params(argv: list[str]) -> Params:
    given = vars(parser().parse_args(argv))
    given["mm"] = tuple(given["mm"])
    return Params(**given)


def main(argv: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    from .plans.deconvolve import run

    p = params(sys.argv[1:] if argv is None else argv)
    builder = SparkSession.builder.appName("foldspark")
    if p.processors > 0:  # as many threads on one machine; a cluster's size is its own
        builder = builder.master(f"local[{p.processors}]")
    run(builder.getOrCreate(), p)


if __name__ == "__main__":
    main()
