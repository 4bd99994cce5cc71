"""Operators give the same results when tasks fail and are retried."""

from __future__ import annotations

import os
import subprocess
import sys

HERE = os.path.dirname(os.path.abspath(__file__))


def test_results_survive_task_retries():
    proc = subprocess.run(
        [sys.executable, os.path.join(HERE, "retry_script.py"), os.path.dirname(HERE)],
        capture_output=True,
        text=True,
        timeout=600,
    )
    assert proc.returncode == 0, proc.stderr[-2000:]
    assert proc.stdout.strip().splitlines()[-1] == "OK", proc.stdout[-2000:]
