"""Made-up payloads of each kind for the performance report, of the sizes that agents meet."""

from __future__ import annotations

import json

RECORDS = json.dumps(
    [{"id": i, "user": f"person{i}@mail.test", "status": "error" if i % 7 == 0 else "ok", "latency_ms": 40 + i % 13, "zone": "abc"[i % 3], "retries": i % 3} for i in range(180)], indent=2
)
LOG = "\n".join(
    [f"2030-01-01T08:{i // 12:02d}:{i % 12 * 5:02d} INFO  queue heartbeat fine part={i % 4} lag=2ms" for i in range(60)]
    + ["2030-01-01T08:05:13 ERROR  database refused host=10.1.1.1 port=5432", "2030-01-01T08:05:14 FATAL  worker gave up after 5 retries"]
    + [f"2030-01-01T08:06:{5 * i:02d} INFO  queue heartbeat fine part={i % 4} lag=1ms" for i in range(12)]
)
CODE = '''import json
from pathlib import Path


class Ledger:
    """Keeps entries in a file."""

    def __init__(self, path):
        self.path = Path(path)
        self.rows = []
        self.dirty = False

    def add(self, name, amount):
        """Add an entry."""
        if amount <= 0:
            raise ValueError("amount must be positive")
        self.rows.append({"name": name, "amount": amount})
        self.dirty = True
        return len(self.rows)

    def save(self):
        if self.dirty:
            self.path.write_text(json.dumps(self.rows))
            self.dirty = False
        return self.path
'''
PROSE = (
    "The nightly export has two steps. First, a reader walks the archive and lists every file that changed since the last run. "
    "That step is quick and seldom goes wrong. Second, a writer copies the files to the mirror in batches of 500. "
    "The writer must never delete a file before the mirror has confirmed its checksum, because a lost file can't be recovered. "
    "Operators should note that the mirror is read-only on Sundays. If a batch fails three times, the export stops and an alert goes to the person on call. "
) * 4

SAMPLES = {"json": RECORDS, "log": LOG, "code": CODE, "text": PROSE}
