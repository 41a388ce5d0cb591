"""``python -m textquarry FILE SAMPLE_RATE [PATTERN]``: indexes a text file and reports on it."""

from __future__ import annotations

import sys


def main(args: list[str]) -> int:
    if len(args) < 2:
        # fixed value: the message that callers match
        raise ValueError("Error: Please use parameters:\n<input file> <sample rate>")
    from pyspark.sql import SparkSession

    from textquarry.operators import index
    from textquarry.sources.texts import read_texts

    spark = SparkSession.builder.appName("textquarry").getOrCreate()
    pattern = args[2] if len(args) > 2 else "INFO"
    built = index.build_index(read_texts(spark, args[0]), sample_rate=int(args[1])).cache()
    meta = built.select("alphabet_length", "input_length").first()
    found = index.count(built, [pattern]).first()
    print(f"alphabet size: {meta['alphabet_length']}\nlength: {meta['input_length']}\ncount({pattern!r}): {found['n'] if found else 0}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
