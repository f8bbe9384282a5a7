"""``python -m quire.cli INPUT -o FOLDER -f markdown``: files to books. What is given here goes before the settings file."""

from __future__ import annotations

import argparse
import logging
import os
import sys
from dataclasses import replace

from pyspark.sql import SparkSession

from quire import config as settings
from quire import logs
from quire.operators import recognize, translators
from quire.plans import books
from quire.sources import files
from quire.tables import is_local


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quire", description="Scanned or plain files to structured books.")
    p.add_argument("input", help="a file or folder")
    p.add_argument("--config", help="settings as YAML")
    p.add_argument("-o", "--output", help="folder of the results")
    p.add_argument("-f", "--format", action="append", choices=list(books.SUFFIXES), help="may be given more than once")
    p.add_argument("--lang", action="append", help="language of the text, three letters; may be given more than once")
    p.add_argument("--engine", choices=sorted(recognize.ENGINES))
    p.add_argument("--translate-to", help="language code; switches translation on")
    p.add_argument("--translation-engine", choices=["none", *sorted(translators.ENGINES)])
    p.add_argument("--workers", type=int, help="threads of a local session; a session that spark-submit gives stays as it is")
    p.add_argument("--log-file", help="a file for the log, besides the console")
    p.add_argument("-v", "--verbose", action="store_true")
    return p


def configured(args: argparse.Namespace) -> settings.Config:
    c = settings.load(args.config)
    export = replace(c.export, **({"formats": tuple(args.format)} if args.format else {}), **({"output_dir": args.output} if args.output else {}))
    ocr = replace(c.ocr, **({"languages": tuple(args.lang)} if args.lang else {}), **({"engine": args.engine} if args.engine else {}))
    tongue = replace(c.translation, **({"enabled": True, "target_language": args.translate_to} if args.translate_to else {}), **({"engine": args.translation_engine} if args.translation_engine else {}))
    return replace(c, export=export, ocr=ocr, translation=tongue)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0, or 1 after an error, which goes to standard error."""
    args = parser().parse_args(argv)
    logs.configure(logging.DEBUG if args.verbose else logging.INFO, args.log_file)
    try:
        config = configured(args)
        if spark is None:
            builder = SparkSession.builder.appName("quire")
            spark = (builder.master(f"local[{args.workers}]") if args.workers else builder).getOrCreate()
        out = config.export.output_dir
        if not is_local(spark) and ("://" not in out or out.startswith("file:")):
            raise ValueError(f"{out} is a folder of one machine: on a cluster the output must be a shared one, with its scheme")
        out = out if "://" in out else "file://" + os.path.abspath(out)
        blocks = books.processed(files.pages(spark, args.input, dpi=config.image.target_dpi), config, replies=f"{out}/.replies")
        names = books.export(blocks, f"{out}/.blocks", out, config, lambda stage, at, of: print(f"[{stage}] {at}/{of}"))
    except Exception as error:
        print(f"Error: {error}", file=sys.stderr)
        return 1
    for name in names:
        print(f"{out}/{name}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
