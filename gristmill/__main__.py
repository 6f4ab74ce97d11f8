"""Command line: ``python -m gristmill VERB INPUT [OTHER] [--name value ...] [--out FILE]``.

A verb is an operator's name; ``join``, ``fuzzy_join``, ``concat`` and ``diff``
take a second input, ``run`` applies the one-shot pipeline, ``explain`` prints
its steps and plan, ``inspect``, ``formats`` and ``report`` describe. Values are
read as JSON where they are JSON and are text otherwise.
"""

from __future__ import annotations

import json
import sys

from pyspark.sql import SparkSession

from .errors import ArgumentError, EngineError
from .plans.frame import OPERATORS, Frame, pipeline
from .sources import generate, readers, writers

TWO = ("join", "fuzzy_join", "concat", "diff")


def parse(args: list[str]) -> tuple[list[str], dict[str, object]]:
    """Positional arguments and options; an option without a value is true."""
    words, options, i = [], {}, 0
    while i < len(args):
        a = args[i]
        if a.startswith("--"):
            name, eq, value = a[2:].partition("=")
            if not eq:
                if i + 1 < len(args) and not args[i + 1].startswith("--"):
                    i, value = i + 1, args[i + 1]
                else:
                    value = "true"
            try:
                options[name.replace("-", "_")] = json.loads(value)
            except ValueError:
                options[name.replace("-", "_")] = value
        else:
            words.append(a)
        i += 1
    return words, options


def run(spark: SparkSession, words: list[str], options: dict) -> str | None:
    """The text to print, if any; results go to ``out`` or are printed as a table."""
    if not words:
        raise ArgumentError(__doc__)
    verb, *inputs = words
    out, shown = options.pop("out", None), int(options.pop("show", 50))
    if verb == "formats":
        return json.dumps(writers.capabilities(), indent=1)
    if verb == "generate":
        frame = Frame(generate.generate(spark, inputs[0], int(options.get("n", 10)), int(options.get("seed", 1))))
    else:
        if not inputs:
            raise ArgumentError(f"{verb} needs an input")
        read = {k: options.pop(k) for k in ("format", "file_col", "infer_types", "delimiter", "sheet", "table") if k in options}
        frame = Frame.read(spark, inputs[0], **read)
        if verb == "inspect":
            return json.dumps(readers.inspect(frame.df), indent=1)
        if verb == "report":
            writers.html_report(frame.df, out or "report.html", options.get("title", inputs[0]))
            return None
        if verb == "explain":
            return pipeline(frame, **options).explain()
        if verb in ("run", "convert"):
            frame = pipeline(frame, **options)
        elif verb in TWO:
            if len(inputs) < 2:
                raise ArgumentError(f"{verb} needs two inputs")
            frame = getattr(frame, verb)(Frame.read(spark, inputs[1], **read), **options)
        elif verb in OPERATORS:
            frame = getattr(frame, verb)(**options)
        else:
            raise ArgumentError(f"unknown verb {verb!r}")
    if out:
        frame.to(out)
        return None
    return writers.text_table(frame.df, shown)


def main(args: list[str] | None = None) -> int:
    spark = SparkSession.builder.appName("gristmill").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        text = run(spark, *parse(sys.argv[1:] if args is None else args))
    except EngineError as e:
        print(e, file=sys.stderr)
        return e.exit_code
    except TypeError as e:  # an option that the operator does not have
        print(e, file=sys.stderr)
        return ArgumentError.exit_code
    if text:
        print(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
