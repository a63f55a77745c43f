"""python -m evirank query NAME DIR | derive BUNDLE OUT | replay BUNDLE EARLIER OUT (exit 1 if the replay differs)."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from evirank import bundle
from evirank.plans import catalog
from evirank.policy import default_policy


def main(args: list[str]) -> int:
    if not args or args[0] not in ("query", "derive", "replay"):
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("evirank").getOrCreate()
    if args[0] == "query":
        catalog.QUERIES[args[1]](spark, args[2]).show(50, truncate=False)
        return 0
    if args[0] == "derive":
        print(bundle.derive(spark, args[1], default_policy(), args[2])["content_digest"])
        return 0
    return int(not bundle.replay(spark, args[1], default_policy(), args[2], args[3]))


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
