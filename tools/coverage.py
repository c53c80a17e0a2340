"""Print survey operator id -> registered queries (with/without SQL oracle)."""

import os
import re
import sys
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panelkit.plans import registry  # noqa: E402

registry.load_all()
by_id = defaultdict(list)
for name, ids in registry.SURVEY_IDS.items():
    for i in ids.split():
        by_id[i].append(name + ("" if name in registry.ORACLES else " (rows)"))


def key(i):
    m = re.match(r"([A-Z])-?(\d+)", i)
    return (m.group(1), int(m.group(2))) if m else (i, 0)


for i in sorted(by_id, key=key):
    print(f"| {i} | {', '.join(sorted(by_id[i]))} |")
print(f"\n{len(registry.QUERIES)} queries, {len(registry.ORACLES)} with SQL oracle", file=sys.stderr)
