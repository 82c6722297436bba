"""Names of the registered queries, of one module if given."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from catascope.plans import registry

registry.load()
wanted = sys.argv[1:]
print(" ".join(n for n, f in registry.QUERIES.items() if not wanted or f.__module__.rsplit(".", 1)[1] in wanted))
