"""Every query that runs kernels, as the first one of an application that was started elsewhere."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from tests.llm import tables

REPO = Path(__file__).resolve().parents[2]
QUERIES = ["op2_language", "op3_toxicity", "op6_substring_dedup", "op8_ngram_jaccard", "op9_token_files", "op10_decontamination",
           "op11_nearest", "op12_whitening", "op13_collocations"]

PROGRAM = """
import sys
sys.path.insert(0, sys.argv[1])
from gridtrack.llm import queries
from gridtrack.session import local_session
for name in sys.argv[3:]:
    spark = local_session(name, 2, 2)
    spark.sparkContext.setLogLevel("OFF")
    try:
        queries.registered()[name](spark, sys.argv[2]).count()
        print("ran", name, flush=True)
    except Exception as problem:
        print("failed", name, str(problem)[-300:], flush=True)
    spark.stop()
"""


def test_queries_start_an_application_from_elsewhere(tmp_path):
    """Each has a new application; the package lies on the driver's path alone."""
    if not Path(tables.DATA).exists():
        pytest.skip("driver tables are not here")
    (tmp_path / "program.py").write_text(PROGRAM)
    clean = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME")}
    done = subprocess.run([sys.executable, "program.py", str(REPO), tables.DATA, *QUERIES], cwd=tmp_path, env=clean,
                          capture_output=True, text=True, timeout=900)
    assert [x for x in done.stdout.splitlines() if x.startswith(("ran", "failed"))] == [f"ran {q}" for q in QUERIES], done.stderr[-2000:]
