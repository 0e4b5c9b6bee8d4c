"""Print the formatted physical plan of registered queries.

    python -m drawseries.plans.explain /root/testdata/sf0.01 read_draws last_n
"""

from __future__ import annotations

import sys


def main(argv):
    from ..session import get_spark
    from .. import plans  # noqa: F401
    from .registry import REGISTRY
    sf_dir, names = argv[0], argv[1:] or sorted(REGISTRY)
    spark = get_spark("local[8]", 8)
    for name in names:
        print(f"==== {name}")
        REGISTRY[name].build(spark, sf_dir).explain("formatted")


if __name__ == "__main__":
    main(sys.argv[1:])
