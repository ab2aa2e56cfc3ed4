"""python -m granary QUERY SF_DIR [OUT]: run a query and show or write its rows; --list names all queries."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from granary.queries import all_queries


def main(args: list[str]) -> int:
    known = all_queries()
    if args[:1] == ["--list"]:
        print("\n".join(sorted(known)))
        return 0
    if len(args) < 2 or args[0] not in known:
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("granary").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    df = known[args[0]](spark, args[1])
    if len(args) > 2:
        df.write.mode("errorifexists").parquet(args[2])
    else:
        df.show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
