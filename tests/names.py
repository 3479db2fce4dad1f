"""Print the names of the queries of one plan module."""

import sys

from wardline.plans.registry import load_all

print(" ".join(n for n, q in load_all().items() if q.run.__module__.endswith("." + sys.argv[1])))
